"""Registered queries: each runs one part of the library over whole given tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa.functions import linearize as L, parsing, stem, templates as T, text as X
from lakeqa.operators import completions, costs, dense, evaluate, lexical, ranking, report
from lakeqa.operators import requests as R
from lakeqa.plans import embedders, experiment, stages
from lakeqa.plans.meter import RunMeter
from lakeqa.scale import cut_lineage, new_shared_path
from lakeqa.sources import store, tables as table_sources
from lakeqa.workload import inputs as I

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def six(column, name=None):
    """Reported numbers are rounded to six digits."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


CONTENT = {"content": "table_content"}
BOTH = {"content": "table_content", "name": "table_name"}


def index(spark, sf_dir, fields=CONTENT, normalizer=None):
    return lexical.build_index(I.corpus(spark, sf_dir), fields, normalizer=normalizer)


def ranked(spark, sf_dir, k=100):
    """Lexical hits with reciprocal-rank scores, written once: at most k rows per question."""
    hits = lexical.bm25_hits(I.passages(spark, sf_dir), index(spark, sf_dir), k)
    return cut_lineage(ranking.reciprocal_rank(hits))


# Table shaping


@query
def tables_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lake(spark, sf_dir).select(
        "dataset", "ord", "table_id", "table_name",
        *[F.to_json(c).alias(c) for c in ("column_header", "row_header", "data")],
    )


@query
def header_flatten(spark, sf_dir):
    lake = I.lake(spark, sf_dir)
    return lake.select(
        "table_id",
        F.array_join(F.transform("column_header", L.header_text), "|").alias("columns"),
        F.array_join(F.transform("row_header", L.header_text), "|").alias("row_names"),
    )


@query
def linearize_csv(spark, sf_dir):
    return L.linearize(I.lake(spark, sf_dir), "csv").select("table_id", "table_content")


@query
def linearize_json(spark, sf_dir):
    return L.linearize(I.lake(spark, sf_dir), "json").select("table_id", "table_content")


@query
def row_limit(spark, sf_dir):
    return L.linearize(I.lake(spark, sf_dir), "csv", num_rows=2).select("table_id", "table_content")


@query
def cell_truncate(spark, sf_dir):
    return L.linearize(I.lake(spark, sf_dir), "csv", cell_tokens=4).select("table_id", "table_content")


@query
def table_title(spark, sf_dir):
    forms = F.array(
        F.struct(F.lit("csv").alias("form"), L.title_of_text(L.csv_text(), "csv").alias("title")),
        F.struct(F.lit("json").alias("form"), L.title_of_text(L.json_text(), "json").alias("title")),
    )
    return I.lake(spark, sf_dir).select("table_id", F.explode(forms).alias("f")).select("table_id", "f.*")


@query
def questions_normalized(spark, sf_dir):
    """Passages written in both question forms, one with a bare answer, one with an answer list."""
    base = I.passages(spark, sf_dir)
    flat = base.select(
        F.col("query_ord").alias("ord"), F.col("query_id").alias("id"), F.col("query_text").alias("question"),
        F.concat(F.lit("t"), F.col("query_id")).alias("table_id"), F.col("query_text").alias("answers"),
    )
    answer_list = F.to_json(F.array("query_text", "query_id"))
    nested = base.select(
        F.col("query_ord").alias("ord"),
        F.struct(F.concat(F.lit("t"), F.col("query_id")).alias("tableId")).alias("table"),
        F.array(
            F.struct(
                F.col("query_id").alias("id"),
                F.col("query_text").alias("originalText"),
                F.struct(answer_list.alias("answerTexts")).alias("answer"),
            )
        ).alias("questions"),
    )
    both = [
        table_sources.normalize_questions(df, dataset).withColumn("dataset", F.lit(dataset))
        for df, dataset in ((flat, "aitqa"), (nested, "nqtables"))
    ]
    return both[0].unionByName(both[1]).withColumn("ground_truth", F.to_json("ground_truth"))


@query
def sample_questions(spark, sf_dir):
    return table_sources.sample_questions(I.passages(spark, sf_dir), 15, 230032298)


# Words and the lexical index


@query
def tokenize(spark, sf_dir):
    words = I.corpus(spark, sf_dir).select("table_id", X.content_words("table_content").alias("w"))
    return words.select(
        "table_id", F.size("w").cast("bigint").alias("num_words"), F.array_join("w", " ").alias("words")
    )


@query
def vocab_normalize(spark, sf_dir):
    words = lexical.raw_postings(lexical.field_words(I.corpus(spark, sf_dir), BOTH)).select("term").distinct()
    return stem.stem_vocabulary(words)


@query
def lexical_postings(spark, sf_dir):
    return lexical.raw_postings(lexical.field_words(I.corpus(spark, sf_dir), BOTH))


@query
def lexical_postings_stemmed(spark, sf_dir):
    return lexical.normal_postings(index(spark, sf_dir, BOTH, stem.stem_words))


@query
def bm25_stats(spark, sf_dir):
    built = index(spark, sf_dir, BOTH)
    return built.term_stats.join(F.broadcast(built.field_stats), "field").select(
        "field", "term", "df", six("idf"), "num_docs", six("avg_len"), six("avg_idf")
    )


@query
def bm25_topk(spark, sf_dir):
    hits = lexical.bm25_hits(I.passages(spark, sf_dir), index(spark, sf_dir), 100)
    return hits.select("query_id", "table_id", "rank", six("score"))


@query
def bm25_two_field(spark, sf_dir):
    """Content and name scores averaged; the source's name is asked along with the passage."""
    asked = I.passages(spark, sf_dir).withColumn(
        "query_text", F.concat(F.lit("src"), (F.col("query_ord") % 20).cast("string"), F.lit(" "), F.col("query_text"))
    )
    hits = lexical.bm25_hits(asked, index(spark, sf_dir, BOTH), 100)
    return hits.select("query_id", "table_id", "rank", six("score"))


@query
def bm25_stemmed(spark, sf_dir):
    built = index(spark, sf_dir, CONTENT, stem.stem_words)
    hits = lexical.bm25_hits(I.passages(spark, sf_dir), built, 100)
    return hits.select("query_id", "table_id", "rank", six("score"))


# Vectors


@query
def dense_topk(spark, sf_dir):
    hits = dense.dense_hits(
        I.question_vectors(spark, sf_dir), I.table_vectors(spark, sf_dir), 100
    )
    return hits.select("query_id", "table_id", "rank", six("score"))


@query
def dense_accuracy(spark, sf_dir):
    """Accuracy of dense retrieval; tables with the question's label are relevant.

    Labels are few, so relevance is looked up on the hits instead of being listed as pairs.
    """
    questions = cut_lineage(I.question_vectors(spark, sf_dir))
    hits = cut_lineage(dense.dense_hits(questions, I.table_vectors(spark, sf_dir), 100))
    labels = I.table_vectors(spark, sf_dir).select("table_id", F.col("label").alias("table_label"))
    judged = hits.join(labels, "table_id").join(questions.select("query_id", "label"), "query_id")
    relevant = judged.where("label = table_label").select("query_id", "table_id", F.lit(1).alias("rel"))
    unjudged = questions.select("query_id", F.lit(None).cast("string").alias("table_id"), F.lit(0).alias("rel"))
    return evaluate.top_k_accuracy(hits, relevant.unionByName(unjudged))


@query
def dense_passages(spark, sf_dir):
    """Passages against whole documents, both embedded by letter counts."""
    retrieve = stages.dense_retriever(passage_vectors)
    hits = retrieve(I.passages(spark, sf_dir), lines_lake(spark, sf_dir))
    return hits.select("query_id", "table_id", "rank", six("score"))


@query
def distinct_embed(spark, sf_dir):
    """Vectors of distinct texts, by an embedder that is fitted, stored, loaded, and asked for new texts only."""
    texts = I.table(spark, sf_dir, "documents").select("text", "doc_id")
    path, vectors = new_shared_path(spark, "embedder"), new_shared_path(spark, "vectors")
    embedders.HashedIdf(num_features=16).fit(texts.select("text")).save(path)
    model = embedders.HashedIdfModel.load(path)
    store.create_vector_store(spark, vectors)
    store.embed_into_store(texts.where("doc_id % 2 = 0"), vectors, model)
    found = store.embed_into_store(texts, vectors, model)
    return found.select(
        F.md5("text").alias("digest"),
        F.array_join(F.transform("vector", lambda v: F.round(v.cast("double"), 5).cast("decimal(8,5)").cast("string")), " ").alias("vector"),
    )


# Ranking stages


@query
def oracle_retrieve(spark, sf_dir):
    return ranking.oracle_hits(I.questions_with_gold(spark, sf_dir))


@query
def reciprocal_rank(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "table_id", "rank", six("score"))


@query
def zoom_requests(spark, sf_dir):
    hits = ranked(spark, sf_dir)
    asked = R.zoom_requests(
        I.passages(spark, sf_dir), hits, I.corpus(spark, sf_dir), 10, 3, 5, I.MODEL
    )
    return asked.select("query_id", completions.request_text(F.col("request")).alias("request"))


def selections(hits, focus):
    return I.canned_selections(hits, focus).select(
        "query_id", parsing.selected_ids(F.col("content")).alias("selected")
    )


@query
def zoom_stage(spark, sf_dir):
    hits = ranked(spark, sf_dir)
    zoomed = ranking.selected_first(hits, selections(hits, 100), 100)
    return zoomed.select("query_id", "table_id", "rank", six("score"))


@query
def zoom_two_stage(spark, sf_dir):
    hits = ranked(spark, sf_dir)
    for focus in (100, 10):
        hits = ranking.selected_first(hits, selections(hits, focus), focus)
    return ranking.reciprocal_rank(hits).select("query_id", "table_id", "rank", six("score"))


@query
def zoom_selection_sizes(spark, sf_dir):
    hits = ranked(spark, sf_dir)
    return ranking.selection_sizes(hits, selections(hits, 100), 100)


@query
def rerank_requests(spark, sf_dir):
    asked = R.question_requests(ranked(spark, sf_dir), I.corpus(spark, sf_dir), 10, "aitqa", I.MODEL)
    return asked.select("table_id", completions.request_text(F.col("request")).alias("request"))


def generated(spark, sf_dir, hits):
    replies = I.canned_questions(I.corpus(spark, sf_dir)).select(
        "table_id", I.response_of(F.col("content")).alias("response")
    )
    return stages.parse_generated(hits, replies, 10)


@query
def parse_questions(spark, sf_dir):
    found = generated(spark, sf_dir, ranked(spark, sf_dir))
    return found.select("query_id", "table_id", F.to_json("questions").alias("questions"))


def passage_vectors(texts):
    """A small repeatable embedder for checks: how often each of eight letters occurs."""
    counts = [F.regexp_count("text", F.lit(letter)).cast("float") for letter in "aeinorst"]
    return texts.withColumn("vector", F.array(*counts))


def similarities(spark, sf_dir, hits):
    return dense.max_similarity(I.passages(spark, sf_dir), generated(spark, sf_dir, hits), passage_vectors)


@query
def rerank_scores(spark, sf_dir):
    return similarities(spark, sf_dir, ranked(spark, sf_dir)).select("query_id", "table_id", six("score"))


@query
def rerank_merge(spark, sf_dir):
    hits = ranked(spark, sf_dir)
    merged = ranking.merge_reranked(hits, similarities(spark, sf_dir, hits), 10)
    return merged.select("query_id", "table_id", "rank", six("score"))


@query
def run_dedupe(spark, sf_dir):
    """Questions renamed so that ids repeat, tables renamed so that hits repeat."""
    number = F.regexp_extract("query_id", r"(\d+)", 1).cast("bigint")
    hits = ranked(spark, sf_dir).select(
        number.alias("query_ord"),
        F.concat(F.lit("q"), F.floor(number / 2).cast("string")).alias("query_id"),
        F.floor(F.col("table_id").cast("bigint") / 3).cast("string").alias("table_id"),
        "rank",
        "score",
    )
    return ranking.last_question_only(hits).select("query_id", "table_id", "rank", six("score"))


# Prompts and answers


@query
def template_fill(spark, sf_dir):
    """Values that look like variables are inserted as they are."""
    text = T.fill(
        T.QUESTIONS_PROMPT["aitqa"],
        airline_name=F.col("table_name"),
        table_id=F.concat(F.lit("{{table}}"), F.col("table_id")),
        table=F.col("table_content"),
    )
    return I.corpus(spark, sf_dir).select("table_id", text.alias("prompt"))


@query
def answer_prompt(spark, sf_dir):
    """Every answer prompt, filled with every passage and a short context, in one pass."""
    prompts = [
        F.struct(
            F.lit(template).alias("template"), F.lit(dataset).alias("dataset"), F.lit(mode).alias("mode"),
            T.fill(
                T.answer_template(template, dataset, mode),
                query=F.col("query_text"),
                context=F.concat(F.lit("Table 1: "), F.col("query_id")),
            ).alias("prompt"),
        )
        for template in T.TEMPLATES for dataset in table_sources.DATASETS for mode in T.MODES
    ]
    return I.passages(spark, sf_dir).select("query_id", F.explode(F.array(*prompts)).alias("p")).select(
        "query_id", "p.*"
    )


def contexts(spark, sf_dir, template="QTTT", num_context=3):
    return R.open_book_context(
        I.passages(spark, sf_dir), ranked(spark, sf_dir), I.corpus(spark, sf_dir), num_context, template
    )


@query
def context_assemble(spark, sf_dir):
    return contexts(spark, sf_dir)


@query
def context_assemble_repeated(spark, sf_dir):
    return contexts(spark, sf_dir, "QTQTQT")


@query
def context_oracle(spark, sf_dir):
    asked = cut_lineage(I.questions_with_gold(spark, sf_dir))
    return R.oracle_context(asked, ranking.oracle_hits(asked), I.corpus(spark, sf_dir), "QTQTQT")


@query
def context_budget(spark, sf_dir):
    joined = I.passages(spark, sf_dir).join(contexts(spark, sf_dir), "query_id")
    cut = R.fit_context(joined, T.answer_template("QTTT", "aitqa", "open-book"), max_context=1000)
    return cut.select("query_id", "available_tokens", "context_tokens", "was_cut", "context")


def event_replies(spark, sf_dir):
    """Event records as model replies of every kind."""
    kind = F.col("event_id") % 8
    answer = F.concat(F.lit('{"answer": "'), F.col("event_type"), F.lit('"}'))
    return I.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == 0, answer)
        .when(kind == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .when(kind == 2, F.replace("props", F.lit('"k"'), F.lit('"answer"')))
        .when(kind == 3, F.col("props"))
        .when(kind == 4, F.concat(F.lit('{"answer": '), F.col("event_type")))
        .when(kind == 5, F.concat(F.lit(" \n"), answer, F.lit("\n ")))
        .when(kind == 6, F.lit('{"answer": null}'))
        .otherwise(F.col("event_type"))
        .alias("content"),
    )


@query
def parse_answer(spark, sf_dir):
    return event_replies(spark, sf_dir).select("event_id", parsing.answer(F.col("content")).alias("answer"))


@query
def answers_closed(spark, sf_dir):
    """No retrieval and no model: every question gets its closed-book request and an empty answer."""
    asked = R.answer_requests(
        I.passages(spark, sf_dir), "closed-book", "QTTT", "nqtables", I.MODEL, costs.max_context(I.MODEL)
    )
    answered = stages.no_generator()(asked)
    return answered.select(
        "query_id", completions.request_text(F.col("request")).alias("request"), "prediction"
    )


# Requests, responses and money


@query
def cache_lookup(spark, sf_dir):
    known = I.turn_responses(spark, sf_dir)
    found = completions.look_up(I.turn_requests(spark, sf_dir), known)
    return found.select(
        "request_id", "request_hash", F.col("response").isNotNull().alias("is_known"),
        parsing.content_of(F.col("response")).alias("content"),
    )


@query
def cache_misses(spark, sf_dir):
    missing = completions.misses(I.turn_requests(spark, sf_dir), I.turn_responses(spark, sf_dir))
    return missing.select("request_hash", completions.request_text(F.col("request")).alias("request"))


def echo_length(requests: list[dict]) -> list[dict]:
    """A stand-in completion function: answers with the length of what was said."""
    return [
        {
            "model": r["model"],
            "choices": [{"message": {"role": "assistant", "content": str(len(r["messages"][1]["content"]))}}],
        }
        for r in requests
    ]


@query
def complete_requests(spark, sf_dir):
    """Misses are completed as a Spark job, stored, and read back with the known responses."""
    path = new_shared_path(spark, "responses")
    store.create_response_store(spark, path, 8)
    requests = I.turn_requests(spark, sf_dir)
    resolved = store.complete_into_store(requests, path, echo_length)
    return resolved.select("request_id", parsing.content_of(F.col("response")).alias("content"))


@query
def request_tokens(spark, sf_dir):
    return I.turn_requests(spark, sf_dir).select(
        "request_id", costs.input_tokens(F.col("request.messages")).alias("input_tokens")
    )


def priced(spark, sf_dir, **options):
    found = completions.look_up(I.turn_requests(spark, sf_dir), I.turn_responses(spark, sf_dir))
    named = found.select("request_id", (F.col("conv_id") % 3).cast("string").alias("run_id"), "response")
    return costs.response_costs(named, costs.prices(spark, options.pop("mode", "default")), **options)


@query
def response_cost(spark, sf_dir):
    return priced(spark, sf_dir).select("request_id", "model", F.round("cost", 9).alias("cost"))


@query
def response_cost_batch(spark, sf_dir):
    batch = priced(spark, sf_dir, mode="batch", ignore_token_caching=True)
    return batch.select("request_id", "model", F.round("cost", 9).alias("cost"))


@query
def cost_per_query(spark, sf_dir):
    asked = I.turn_requests(spark, sf_dir).select((F.col("conv_id") % 3).cast("string").alias("run_id"))
    spent = costs.cost_per_question(priced(spark, sf_dir, ignore_token_caching=True), asked)
    return spent.select(
        "run_id", F.round("total_cost", 9).alias("total_cost"), "num_questions",
        F.round("cost_per_question", 9).alias("cost_per_question"),
    )


@query
def cost_estimate(spark, sf_dir):
    missing = completions.misses(I.turn_requests(spark, sf_dir), I.turn_responses(spark, sf_dir))
    estimated = costs.estimate_costs(missing, costs.prices(spark))
    return estimated.select(
        "request_hash", "input_tokens", "output_limit", "max_usage", F.round("max_cost", 9).alias("max_cost")
    )


# Scores


@query
def topk_accuracy(spark, sf_dir):
    """Accuracy before and after a zoom stage, two runs in one pass."""
    hits = ranked(spark, sf_dir)
    zoomed = ranking.selected_first(hits, selections(hits, 100), 100)
    runs = [(hits, "retrieved"), (zoomed, "zoomed")]
    pairs = I.gold_pairs(spark, sf_dir)
    both_hits = [h.select(F.lit(n).alias("run_id"), "query_id", "table_id", "rank") for h, n in runs]
    both_pairs = pairs.withColumn("run_id", F.explode(F.array(*[F.lit(n) for _, n in runs])))
    return evaluate.top_k_accuracy(
        both_hits[0].unionByName(both_hits[1]), both_pairs, run_keys=["run_id"]
    )


@query
def answer_normalize(spark, sf_dir):
    return I.corpus(spark, sf_dir).select(
        "table_id", X.answer_form(F.col("table_content")).alias("answer")
    )


@query
def answer_scores(spark, sf_dir):
    scored = evaluate.answer_scores(I.document_answers(spark, sf_dir))
    return scored.select("query_id", "exact_match", six("f1_score"), "relaxed_match")


@query
def answer_metrics(spark, sf_dir):
    scored = evaluate.answer_scores(I.document_answers(spark, sf_dir))
    means = evaluate.mean_answer_scores(scored, ["run_id"])
    return means.select("run_id", "num_questions", *[six(c) for c in ("exact_match", "f1_score", "relaxed_match")])


@query
def relaxed_match(spark, sf_dir):
    return I.document_answers(spark, sf_dir).select(
        "query_id",
        F.contains(X.relaxed_form(F.col("prediction")), X.relaxed_form(F.get("ground_truth", F.lit(0)))).alias("found"),
    )


@query
def split_easy_hard(spark, sf_dir):
    """Documents as closed-book answers; many share partition, id and answers."""
    documents = I.table(spark, sf_dir, "documents")
    said = F.when(
        F.col("n_chars") % 2 == 0, F.concat(F.col("text"), F.lit(' "'), F.upper("source"), F.lit('"'), F.col("lang"))
    ).otherwise(F.col("text"))
    answers = documents.select(
        F.col("lang").alias("partition"),
        F.col("source").alias("id"),
        F.col("doc_id").alias("ord"),
        said.alias("prediction"),
        F.array(F.concat(F.lit("'"), F.col("source"), F.lit("'")), F.col("lang")).alias("answers"),
    )
    questions = documents.select(
        F.col("lang").alias("partition"),
        F.col("source").alias("id"),
        F.array(F.concat(F.lit('"'), F.col("source"), F.lit('"')), F.col("lang")).alias("answers"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").alias("source_question"),
    )
    split = evaluate.split_by_difficulty(answers, questions)
    return split.withColumn("answers", F.to_json("answers")).groupBy(
        "partition", "id", "answers", "source_question", "difficulty"
    ).agg(F.count("*").alias("num_questions"))


# Runs and reports


def records(spark, sf_dir, outcomes=I.run_outcomes):
    """Run records from question outcomes, in one pass over the outcomes."""
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    per_run = cut_lineage(
        outcomes(spark, sf_dir).groupBy("run_id", "config_name", "exp", "zoom").agg(
            *[share(F.col("found_at") < k).alias(f"accuracy_at_{k}") for k in evaluate.K_VALUES],
            share(F.col("quality") > 3).alias("exact_match"),
            share(F.col("quality") > 1).alias("relaxed_match"),
            F.avg(F.col("quality") / 7).alias("f1_score"),
            F.count_if("was_cut").alias("cutoff_context_ctr"),
            F.count("*").alias("processed_queries_ctr"),
            (F.sum("cost") / F.count("*")).alias("cost_per_question"),
        )
    )
    sizes = F.array(
        *[
            F.struct(F.lit(s["num_tables"]).alias("num_tables"), F.lit(s["num_rows"]).alias("num_rows"))
            for s in stages.ZOOM_STAGES
        ]
    )
    configs = per_run.select(
        "run_id",
        F.struct(
            "config_name",
            "exp",
            F.struct(F.when(F.col("zoom") == "RowBasedZoom", sizes).alias("next_focus_sizes")).alias("zoom"),
        ).alias("config"),
    )
    counters = per_run.select("run_id", "cutoff_context_ctr", "processed_queries_ctr")
    return report.run_records(configs, per_run, per_run, counters, per_run)


@query
def run_counters(spark, sf_dir):
    return report.run_counters(I.run_outcomes(spark, sf_dir))


@query
def run_components(spark, sf_dir):
    return report.components(I.run_outcomes(spark, sf_dir).select("run_id", "config_name").distinct())


@query
def run_record(spark, sf_dir):
    """Run records written as JSON and read back."""
    path = new_shared_path(spark, "runs")
    store.write_runs(records(spark, sf_dir), path)
    runs = store.read_runs(spark, path)
    return runs.select(
        "run_id", "config.config_name", "cutoff_context_ctr", "processed_queries_ctr",
        *[six(F.try_element_at("retrieval_results", F.lit(f"Accuracy@{k}")), f"accuracy_at_{k}") for k in evaluate.K_VALUES],
        *[six(f"qa_results.{m}", m) for m in ("exact_match", "relaxed_match", "f1_score")],
        six("total_llm_cost"),
    )


@query
def report_flat(spark, sf_dir):
    return report.flat_report(records(spark, sf_dir), "retrieval")


@query
def report_zoom(spark, sf_dir):
    """Stages of each zoom run; runs differ by retriever, so equal stages give several rows."""
    return report.flat_report(records(spark, sf_dir), "zoom")


@query
def report_pivot(spark, sf_dir):
    return report.pivot_report(records(spark, sf_dir), "tqa")


# Whole runs


@query
def ranked_accuracy(spark, sf_dir):
    """Retrieve, zoom twice, rerank, score: the whole ranking half of a run."""
    hits = ranked(spark, sf_dir)
    for focus in (100, 10):
        hits = ranking.selected_first(hits, selections(hits, focus), focus)
    hits = cut_lineage(ranking.reciprocal_rank(hits))
    hits = ranking.merge_reranked(hits, similarities(spark, sf_dir, hits), 10)
    return evaluate.top_k_accuracy(hits, I.gold_pairs(spark, sf_dir))


def pick_and_answer(requests: list[dict]) -> list[dict]:
    """A stand-in model: picks tables whose number divides by 3, answers with the first table's number."""
    import json
    import re

    replies = []
    for request in requests:
        system, user = (m["content"] for m in request["messages"])
        if system.startswith("You are a data specialist"):
            ids = re.findall(r"^table_id: (\d+)$", user, flags=re.M)
            content = json.dumps([i for i in ids if int(i) % 3 == 0])
        else:
            first = re.search(r"Context: Table 1: (\d+),", user)
            content = json.dumps({"answer": "Table " + first.group(1) if first else ""})
        replies.append(
            {
                "model": request["model"],
                "choices": [{"message": {"role": "assistant", "content": "```json\n" + content + "\n```"}}],
                "usage": {"prompt_tokens": len(user), "completion_tokens": 1, "total_tokens": len(user) + 1},
            }
        )
    return replies


def lines_lake(spark, sf_dir):
    """Documents as one-column tables whose rows are lines, under their plain number as id."""
    return I.corpus(spark, sf_dir).select(
        "ord", F.lit("nqtables").alias("dataset"), "table_id", "table_name",
        F.array(F.array(F.lit("line"))).alias("column_header"),
        F.array().cast("array<array<string>>").alias("row_header"),
        F.transform(F.split("table_content", "\n"), lambda line: F.array(line)).alias("data"),
    )


@query
def answered_run(spark, sf_dir):
    """Retrieve, zoom and answer with a stand-in model over stored requests, then score answers."""
    path = new_shared_path(spark, "responses")
    store.create_response_store(spark, path, 8)
    exchange = stages.store_exchange(path, pick_and_answer)
    tables = lines_lake(spark, sf_dir)
    _, _, scored = experiment.run_experiment(
        cut_lineage(I.questions_and_gold(spark, sf_dir)),
        tables,
        stages.bm25_retriever(separate_names=False),
        stages.completion_generator(exchange),
        I.MODEL,
        "nqtables",
        zoom=stages.row_zoom(tables, exchange, I.MODEL),
    )
    return scored.select("query_id", "was_cut", "prediction", "exact_match", six("f1_score"), "relaxed_match")


@query
def repeated_ids_run(spark, sf_dir):
    """A run whose questions share ids and whose tables share ids; each question is answered once.

    One question has a single word, one has two. Of tables with one id the last is shown.
    """
    path = new_shared_path(spark, "responses")
    store.create_response_store(spark, path, 8)
    position = F.col("query_ord")
    short = F.when(position == 0, F.lit("the")).when(position == 1, F.lit("to the")).otherwise(F.col("query_text"))
    asked = I.questions_and_gold(spark, sf_dir).select(
        "query_ord",
        F.concat(F.lit("q"), (position % 7).cast("string")).alias("query_id"),
        short.alias("query_text"),
        (F.col("table_id").cast("bigint") % 100).cast("string").alias("table_id"),
        "ground_truth",
    )
    number = (F.col("ord") % 100).cast("string")
    tables = lines_lake(spark, sf_dir).withColumn("table_id", number)
    _, _, scored = experiment.run_experiment(
        cut_lineage(asked),
        tables,
        stages.bm25_retriever(separate_names=False),
        stages.completion_generator(stages.store_exchange(path, pick_and_answer)),
        I.MODEL,
        "nqtables",
    )
    return scored.select("query_ord", "query_id", "was_cut", "prediction")


def reply_to_all(requests: list[dict]) -> list[dict]:
    """A stand-in model for whole runs: also invents a question for each line of a table.

    It rejects question requests about tables whose number divides by 7. Its usage counts tables
    shown and named, 1000 and 10 for invented questions, 3 and 1 for answers.
    """
    import json
    import re

    replies = []
    for request, plain in zip(requests, pick_and_answer(requests), strict=True):
        system, user = (m["content"] for m in request["messages"])
        if system.startswith("You are a data specialist"):
            ids = re.findall(r"^table_id: (\d+)$", user, flags=re.M)
            used = (len(ids), sum(int(i) % 3 == 0 for i in ids))
        elif system.startswith("You are a chatbot that generates questions"):
            table_id, table = re.search(r'exactly as shown here: "(\d+)"\. Table: (.*)', user, flags=re.S).groups()
            if int(table_id) % 7 == 0:
                replies.append({"error": "rejected"})
                continue
            lines = table.split("\r\n")[2:-1]
            plain["choices"][0]["message"]["content"] = json.dumps({table_id: lines})
            used = (1000, 10)
        else:
            used = (3, 1)
        plain["usage"] = dict(zip(("prompt_tokens", "completion_tokens", "total_tokens"), (*used, sum(used)), strict=True))
        replies.append(plain)
    return replies


def whole_stages(spark, tables, meter=None):
    """Zoom, reranker and generator of a whole run over one response store."""
    path = new_shared_path(spark, "responses")
    store.create_response_store(spark, path, 8)
    exchange = stages.store_exchange(path, reply_to_all)
    if meter is not None:
        exchange = meter.exchange(exchange)
    zoom = stages.row_zoom(tables, exchange, I.MODEL, meter=meter)
    reranker = stages.question_reranker(tables, exchange, passage_vectors, I.MODEL, "nqtables")
    return zoom, reranker, stages.completion_generator(exchange)


@query
def pipeline_retrieval(spark, sf_dir):
    """Retrieve, zoom and rerank with a stand-in model: the whole ranking of every question."""
    tables = lines_lake(spark, sf_dir)
    zoom, reranker, _ = whole_stages(spark, tables)
    hits = experiment.ranked_tables(
        I.passages(spark, sf_dir), tables, stages.bm25_retriever(separate_names=False), zoom, reranker
    )
    return hits.select("query_id", "table_id", "rank", six("score"))


@query
def pipeline_answers(spark, sf_dir):
    """A whole run over all questions: its record, with what was counted and spent, written and read back."""
    tables, meter = lines_lake(spark, sf_dir), RunMeter()
    zoom, reranker, generator = whole_stages(spark, tables, meter)
    run = experiment.whole_run(
        cut_lineage(I.questions_and_gold(spark, sf_dir)), tables, stages.bm25_retriever(separate_names=False), generator,
        I.MODEL, "nqtables", meter, "r1", f"exp=whole model={I.MODEL}", "whole", zoom, reranker, stages.ZOOM_STAGES,
    )
    path = new_shared_path(spark, "runs")
    store.write_runs(run.record, path)
    return report.records_of(store.read_run_documents(spark, path)).select(
        "config.config_name", *report.COUNTERS,
        *[F.try_element_at("retrieval_results", F.lit(f"Accuracy@{k}")).alias(f"accuracy_at_{k}") for k in evaluate.K_VALUES],
        *[six(F.col("qa_results")[m], m) for m in ("exact_match", "relaxed_match", "f1_score")],
        F.round("total_llm_cost", 9).alias("total_llm_cost"),
    )


@query
def fetched_tables(spark, sf_dir):
    """Hit tables by the way of a Bloom filter and a shuffle, as if their ids were too many to send."""
    hits = ranked(spark, sf_dir).where("rank <= 3")
    found = R.hit_tables(hits, I.corpus(spark, sf_dir), broadcast_bytes=0)
    return found.select("table_id", F.md5("table_content").alias("digest"))


@query
def bucketed_lookup(spark, sf_dir):
    """The stored responses, appended twice, read from a store bucketed by digest."""
    path = new_shared_path(spark, "responses")
    store.create_response_store(spark, path, 8)
    known = cut_lineage(I.turn_responses(spark, sf_dir))
    store.append_responses(known, path)
    store.append_responses(known, path)
    found = completions.look_up(I.turn_requests(spark, sf_dir), store.read_responses(spark, path))
    return found.select(
        "request_id", "request_hash", F.col("response").isNotNull().alias("is_known"),
        parsing.content_of(F.col("response")).alias("content"),
    )


@query
def stored_index_topk(spark, sf_dir):
    """Two-field retrieval from an index that was written and read back."""
    path = new_shared_path(spark, "index")
    lexical.write_index(index(spark, sf_dir, BOTH, stem.stem_words), path)
    built = lexical.read_index(spark, path, normalizer=stem.stem_words)
    hits = lexical.bm25_hits(I.passages(spark, sf_dir), built, 100)
    return hits.select("query_id", "table_id", "rank", six("score"))


@query
def dense_many_questions(spark, sf_dir):
    """Every customer asks for the ten suppliers most alike in nation and balance: many tiles of questions."""
    likeness = lambda key, nation, balance: F.array(
        F.col(nation) + 1.0, F.col(balance) / 1000, (F.col(key) % 7).cast("double"), (F.col(key) % 11).cast("double")
    )
    asked = I.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("query_id"),
        likeness("c_custkey", "c_nationkey", "c_acctbal").alias("vector"),
    )
    tables = I.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("table_id"),
        likeness("s_suppkey", "s_nationkey", "s_acctbal").alias("vector"),
    )
    hits = dense.dense_hits(asked, tables, 10)
    return hits.select("query_id", "table_id", "rank", six("score"))


def report_file(spark, sf_dir, experiment, outcomes=I.other_outcomes):
    """Run files written as JSON, read whatever their shape, reported, and the report's CSV file read back."""
    runs, path = new_shared_path(spark, "runs"), new_shared_path(spark, "report")
    store.write_runs(records(spark, sf_dir, outcomes), runs)
    found = report.records_of(store.read_run_documents(spark, runs))
    make = report.flat_report if experiment in report.FLAT_REPORTS else report.pivot_report
    made = make(found, experiment)
    store.write_report(made, path)
    return spark.read.schema(made.schema).option("header", True).csv(path)


@query
def report_file_retrieval(spark, sf_dir):
    return report_file(spark, sf_dir, "retrieval", I.run_outcomes)


@query
def report_file_zoom(spark, sf_dir):
    return report_file(spark, sf_dir, "zoom", I.run_outcomes).withColumn(
        "next_focus_sizes", F.coalesce("next_focus_sizes", F.lit(""))
    )


@query
def report_file_tqa(spark, sf_dir):
    return report_file(spark, sf_dir, "tqa", I.run_outcomes)


@query
def report_file_metadata(spark, sf_dir):
    return report_file(spark, sf_dir, "metadata")


@query
def report_file_template(spark, sf_dir):
    return report_file(spark, sf_dir, "template")


@query
def report_file_linear(spark, sf_dir):
    return report_file(spark, sf_dir, "linear")


@query
def split_files(spark, sf_dir):
    """Documents as closed-book answers of a run, in run relations; the split written twice and read back."""
    documents = I.table(spark, sf_dir, "documents")
    runs, path = new_shared_path(spark, "runs"), new_shared_path(spark, "split")
    name = "exp=x retriever=lib.retrieval.{} reranker=lib.reranking.NoReranker zoom=lib.zoom.NoZoom generator=lib.generation.LLMGenerator model=" + I.MODEL
    answers = documents.select(
        F.lit("closed").alias("run_id"),
        F.col("doc_id").alias("query_ord"),
        F.col("source").alias("query_id"),
        F.when(F.col("n_chars") % 2 == 0, F.concat("text", F.lit(' "'), F.upper("source"), F.lit('"'), "lang"))
        .otherwise(F.col("text"))
        .alias("prediction"),
        F.array(F.concat(F.lit("'"), F.col("source"), F.lit("'")), F.col("lang")).alias("ground_truth"),
    )
    hits = answers.select("run_id", "query_id", F.lit("t").alias("table_id"), F.lit(1).cast("bigint").alias("rank"), F.lit(1.0).alias("score"))
    store.write_run_relations(hits, hits.select("run_id", "query_id", "table_id", F.lit(1).alias("rel")), answers, runs)
    configs = spark.createDataFrame(
        [("closed", (name.format("NoRetriever"),)), ("open", (name.format("BM25Retriever"),))], "run_id string, config struct<config_name string>"
    )
    questions = documents.select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("id"),
        F.array(F.concat(F.lit('"'), F.col("source"), F.lit('"')), F.col("lang")).alias("answers"),
        F.col("doc_id").alias("source_question"),
    )
    split = experiment.split_questions(
        configs, store.read_run_relation(spark, runs, "predictions"), store.read_run_relation(spark, runs, "references"),
        questions, "test", I.MODEL,
    )
    for _ in range(2):
        store.write_split(split, path)
    back = store.read_split(spark, path, "id string, answers array<string>, source_question bigint")
    return back.withColumn("answers", F.to_json("answers")).groupBy(
        "partition", "id", "answers", "source_question", "difficulty"
    ).agg(F.count("*").alias("num_questions"))


FILE_ROWS = 50_000


def as_files(spark, rows):
    """Rows written as JSON lines in the order of ``ord``, into folders of 1, 2, 4, 8 and so on rows."""
    path = new_shared_path(spark, "lines")
    # A task sorts about FILE_ROWS rows, however many there are.
    num_tasks = max(8, -(-(rows.agg(F.max("ord")).first()[0] or 0) // FILE_ROWS))
    placed = rows.withColumn("chunk", F.format_string("%03d", F.floor(F.log2(F.col("ord") + 1)).cast("int")))
    ordered = placed.repartitionByRange(num_tasks, "chunk", "ord").sortWithinPartitions("chunk", "ord").drop("ord")
    ordered.write.partitionBy("chunk").json(path)
    return path


@query
def tables_from_files(spark, sf_dir):
    """Both forms of tables, written as many files of unequal size and read back in file order."""
    both = [
        table_sources.read_tables(spark, as_files(spark, raw), dataset)
        for raw, dataset in ((I.raw_documents(spark, sf_dir), "aitqa"), (I.raw_orders(spark, sf_dir), "nqtables"))
    ]
    return both[0].unionByName(both[1]).select(
        "dataset", "ord", "table_id", "table_name", *[F.md5(F.to_json(c)).alias(c) for c in ("column_header", "row_header", "data")]
    )


@query
def questions_from_files(spark, sf_dir):
    """Events as questions, written as many files of unequal size and read back in file order."""
    raw = I.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.col("props").alias("question"),
        F.col("event_type").alias("table_id"), F.to_json(F.array("event_type", "props")).alias("answers"),
    )
    found = table_sources.read_questions(spark, as_files(spark, raw), "aitqa")
    return found.withColumn("ground_truth", F.array_join("ground_truth", "|"))
