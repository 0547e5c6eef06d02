"""The given tables seen as a lake, questions, vectors, requests, answers and runs.

Every relation is derived from whole tables, row by row wherever possible, and each has a SQL twin
in ``oracle.py``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa.functions import text as text_functions
from lakeqa.operators import completions, requests as R
from lakeqa.scale import broadcast_if_small
from lakeqa.sources import tables as table_sources

MODEL = "gpt-4o-mini-2024-07-18"
OTHER_MODEL = "gpt-4o-2024-11-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on the test files, which are one split each. Fewer than 8 splits hold no more
    than 8 of a split's bytes, so nothing large is ever moved; larger inputs stay in place."""
    return df.repartition(8) if df.rdd.getNumPartitions() < 8 else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as linearized lake tables; ``doc_id`` runs from 0 without gaps."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("table_id"),
        F.col("source").alias("table_name"),
        F.col("text").alias("table_content"),
    )


def aitqa_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_sources.normalize_tables(raw_documents(spark, sf_dir), "aitqa")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested tables: a row per line of text, a cell per sentence."""
    lines = F.split("text", "\n")
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.col("source"), F.lit(', "'), F.col("lang"), F.lit('"')).alias("title"),
        F.array(
            F.array(F.lit("first")), F.array(F.lit("second"), F.lit("part")),
            F.array(F.lit("third"), F.lit("part"), F.lit("ignored level")),
        ).alias("column_header"),
        F.transform(
            lines,
            lambda line, i: F.when(i % 2 == 0, F.array(F.lit("line"), (i + 1).cast("string"))).otherwise(
                F.array((i + 1).cast("string"))
            ),
        ).alias("row_header"),
        F.transform(lines, lambda line: F.split(line, r"\. ")).alias("data"),
    )


def nq_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_sources.normalize_tables(raw_orders(spark, sf_dir), "nqtables")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as field / value tables, with a row for each of their lines."""

    def row(name, value):
        cells = [F.struct(F.lit(name).alias("text")), F.struct(value.alias("text"))]
        return F.struct(F.array(*cells).alias("cells"))

    line = row(
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")),
        F.concat_ws(
            " ", F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.lit("of part"), F.col("l_partkey").cast("string"),
            "l_returnflag",
        ),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda l: l["line"]
        ).alias("lines")
    )
    facts = F.array(
        row("customer", F.col("o_custkey").cast("string")),
        row("status", F.col("o_orderstatus")),
        row("total price", F.col("o_totalprice").cast("decimal(12,2)").cast("string")),
        row("date", F.date_format("o_orderdate", "yyyy-MM-dd")),
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("tableId"),
        F.col("o_orderpriority").alias("documentTitle"),
        F.array(
            F.struct(F.lit("field").alias("text")), F.struct(F.lit("value, as text").alias("text"))
        ).alias("columns"),
        F.when(F.col("lines").isNull(), facts).otherwise(F.concat(facts, "lines")).alias("rows"),
    )


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aitqa_lake(spark, sf_dir).unionByName(nq_lake(spark, sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; an item's whole text is asked."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_ord"),
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"),
        F.col("text").alias("query_text"),
    )


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, table_id, rel)``: tables whose text contains the whole question.

    Candidates meet on the question's longest inner word, which any such text must have as a word;
    the containment itself is then checked on the candidates' whole texts. Questions of one or two
    words have no inner word and are looked for in every text, in place.
    """
    inner = text_functions.words(F.col("query_text"))
    anchored = passages(spark, sf_dir).select(
        "query_id",
        "query_text",
        F.array_max(
            F.transform(
                F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))),
                lambda w: F.struct(F.length(w), w.alias("w")),
            )
        )["w"].alias("word"),
    )
    tables = corpus(spark, sf_dir)
    long = anchored.where("word IS NOT NULL")
    candidates = tables.select(
        "ord", F.explode(F.array_distinct(text_functions.words(F.col("table_content")))).alias("word")
    ).join(broadcast_if_small(long), "word")
    # The candidates move to the texts, not the texts to them.
    found = broadcast_if_small(candidates.drop("word")).join(tables, "ord")
    short = anchored.where("word IS NULL").select("query_id", "query_text")
    if not short.isEmpty():
        asked = [F.struct(*[F.lit(v) for v in (r["query_id"], r["query_text"])]) for r in short.collect()]
        each = F.explode(F.array(*asked)).alias("q")
        found = found.select("query_id", "query_text", "table_id", "table_content").unionByName(
            tables.select("table_id", "table_content", each).select(
                F.col("q.col1").alias("query_id"), F.col("q.col2").alias("query_text"), "table_id", "table_content"
            )
        )
    return found.where(F.contains("table_content", F.col("query_text"))).select(
        "query_id", "table_id", F.lit(1).alias("rel")
    )


def questions_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with one gold table, the first of those containing them, and their ground truth."""
    return questions_and_gold(spark, sf_dir).where("table_id IS NOT NULL")


def questions_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions; those that no table contains have no gold table, and ``none`` as the truth."""
    first = gold_pairs(spark, sf_dir).groupBy("query_id").agg(
        F.min(F.col("table_id").cast("bigint")).cast("string").alias("table_id")
    )
    known = F.array(F.col("table_id"), F.concat(F.lit("table "), F.col("table_id")))
    return passages(spark, sf_dir).join(first, "query_id", "left").withColumn(
        "ground_truth", F.when(F.col("table_id").isNotNull(), known).otherwise(F.array(F.lit("none")))
    )


def table_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("ord"),
        F.col("vec_id").cast("string").alias("table_id"),
        F.col("embedding").alias("vector"),
        "label",
    )


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per label: the mean of all vectors with that label.

    Means are taken per position before anything is gathered, so a list only holds one vector.
    """
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding"))
    means = values.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("value"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("vector")
    ).select(F.concat_ws(" ", F.lit("label"), "label").alias("query_id"), "vector", "label")


SYSTEM = "Answer with one word."


def turn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per conversation turn; repeated texts give identical requests."""
    request = R.request_struct(MODEL, SYSTEM, F.col("text"), 70)
    return completions.with_digests(
        table(spark, sf_dir, "conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("request_id"), "conv_id", "role",
            request.alias("request"),
        )
    )


def turn_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses to what users and systems said; system turns failed."""
    failed = F.col("role") == "system"
    words = text_functions.token_count(F.get("request.messages", F.lit(1))["content"])
    message = F.struct(
        F.lit("assistant").alias("role"), F.concat(F.lit("re: "), F.col("request_id")).alias("content")
    )
    response = F.struct(
        F.when(~failed, F.when(F.col("conv_id") % 2 == 0, MODEL).otherwise(OTHER_MODEL)).alias("model"),
        F.when(~failed, F.array(F.struct(message.alias("message")))).alias("choices"),
        F.when(
            ~failed,
            F.struct(
                (words * 3).alias("prompt_tokens"),
                words.alias("completion_tokens"),
                (words * 4).alias("total_tokens"),
                F.struct(words.alias("cached_tokens")).alias("prompt_tokens_details"),
            ),
        ).alias("usage"),
        F.when(failed, F.lit("rejected")).alias("error"),
    )
    kept = turn_requests(spark, sf_dir).where("role <> 'assistant'").withColumn("response", response)
    return kept.groupBy("request_hash", "provider", "request_check").agg(
        F.min_by("response", "request_id").alias("response")
    )


def canned_selections(hits: DataFrame, focus: int) -> DataFrame:
    """Zoom replies: a fenced list of the candidates whose number divides by 3.

    Every 7th question gets a reply that is no JSON, every 11th also names an unknown table.
    """
    number = F.regexp_extract("query_id", r"(\d+)", 1).cast("int")
    picked = F.array_sort(
        F.collect_list(F.when(F.col("table_id").cast("bigint") % 3 == 0, F.col("table_id")))
    )
    listed = (
        hits.where(F.col("rank") <= focus)
        .groupBy("query_id")
        .agg(picked.alias("ids"))
        .withColumn(
            "ids", F.when(number % 11 == 0, F.array_append("ids", F.lit("unknown"))).otherwise(F.col("ids"))
        )
    )
    return listed.select(
        "query_id",
        F.when(number % 7 == 0, F.lit('["broken'))
        .otherwise(F.concat(F.lit("```json\n"), F.to_json("ids"), F.lit("\n```")))
        .alias("content"),
    )


def canned_questions(tables: DataFrame) -> DataFrame:
    """Question-generation replies: a question for each line of a table's text.

    Every 5th table's reply is no JSON; every 7th table's reply is an empty list.
    """
    number = F.col("table_id").cast("bigint")
    lines = F.filter(F.split("table_content", "\n"), lambda line: line != "")
    return tables.select(
        "table_id",
        F.when(number % 5 == 0, F.lit("no questions today"))
        .when(number % 7 == 0, F.concat(F.lit('{"'), F.col("table_id"), F.lit('":[]}')))
        .otherwise(
            F.concat(
                F.lit("```json\n"), F.to_json(F.create_map(F.col("table_id"), lines)), F.lit("\n```")
            )
        )
        .alias("content"),
    )


def response_of(content):
    """A successful response whose only choice says ``content``."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    return F.struct(F.lit(MODEL).alias("model"), F.array(F.struct(message.alias("message"))).alias("choices"))


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against whole texts: equal, re-cased, padded, or something else."""
    kind = F.col("doc_id") % 4
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("query_id"),
        F.col("lang").alias("run_id"),
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("The "), F.lower("text"), F.lit("!")))
        .when(kind == 2, F.concat(F.replace("text", F.lit(","), F.lit(" ;")), F.lit(" and one more")))
        .otherwise(F.concat_ws(" ", "lang", "source"))
        .alias("prediction"),
        F.array("text", "source").alias("ground_truth"),
    )


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as processed questions of runs: each order is one question of the run it names."""
    experiment = (
        F.when(F.col("o_orderstatus") == "F", "tqa")
        .when(F.col("o_orderstatus") == "O", "retrieval")
        .otherwise("zoom")
    )
    retriever = F.when(F.substring("o_orderpriority", 1, 1) < "3", "BM25Retriever").otherwise("SBERTRetriever")
    zoom = F.when(F.col("o_custkey") % 3 == 0, "RowBasedZoom").otherwise("NoZoom")
    name = F.concat(
        F.lit("exp="), experiment,
        F.lit(" retriever=lib.retrieval."), retriever,
        F.lit(" reranker=lib.reranking.NoReranker zoom=lib.zoom."), zoom,
        F.lit(" generator=lib.generation.LLMGenerator model="),
        F.when(F.col("o_custkey") % 2 == 0, MODEL).otherwise(OTHER_MODEL),
        F.lit(" num_context="), F.when(F.col("o_orderpriority").startswith("1"), "100").otherwise("3"),
        F.lit(" linearization=Linearization.CSV template=Template.QTTT"),
    )
    return table(spark, sf_dir, "orders").select(
        F.md5(name).alias("run_id"),
        name.alias("config_name"),
        experiment.alias("exp"),
        zoom.alias("zoom"),
        *_measures(),
    )


def _measures() -> list:
    return [
        F.col("o_orderkey").cast("string").alias("query_id"),
        F.pmod(F.floor("o_totalprice").cast("bigint"), F.lit(120)).alias("found_at"),
        F.pmod(F.floor(F.col("o_totalprice") * 100).cast("bigint"), F.lit(7)).alias("quality"),
        (F.col("o_totalprice") / 1e9).alias("cost"),
        (F.col("o_totalprice") > 400000).alias("was_cut"),
    ]


def other_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions of runs of the other three experiments; one run for each cell of their reports."""
    experiment = (
        F.when(F.col("o_orderstatus") == "F", "metadata")
        .when(F.col("o_orderstatus") == "O", "template")
        .otherwise("linear")
    )
    first = F.substring("o_orderpriority", 1, 1) < "3"
    pick = lambda exp, yes, no: F.when((experiment == exp) & first, yes).otherwise(no)
    name = F.concat(
        F.lit("exp="), experiment,
        F.lit(" retriever=lib.retrieval.BM25Retriever reranker=lib.reranking.NoReranker zoom=lib.zoom.NoZoom"),
        F.lit(" generator=lib.generation.LLMGenerator model="),
        F.when(F.col("o_custkey") % 2 == 0, MODEL).otherwise(OTHER_MODEL),
        F.lit(" num_context=3 linearization=Linearization."), pick("linear", "JSON", "CSV"),
        F.lit(" template=Template."), pick("template", "TTTQ", "QTTT"),
        F.when(experiment == "metadata", F.concat(F.lit(" metadata="), pick("metadata", "True", "False"))).otherwise(""),
    )
    return table(spark, sf_dir, "orders").select(
        F.md5(name).alias("run_id"),
        name.alias("config_name"),
        experiment.alias("exp"),
        F.lit("NoZoom").alias("zoom"),
        *_measures(),
    )
