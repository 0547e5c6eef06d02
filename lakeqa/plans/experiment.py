"""Whole runs: retrieve, zoom, rerank, then assemble, answer and score."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from lakeqa import schemas
from lakeqa.functions import linearize as L
from lakeqa.operators import costs, evaluate, ranking, report, requests as R
from lakeqa.plans.meter import RunMeter
from lakeqa.scale import broadcast_if_small, cut_lineage


def by_position(questions: DataFrame) -> DataFrame:
    """Questions under their position instead of their id, which several may share."""
    return questions.withColumn("query_id", F.col("query_ord").cast("string"))


def by_id(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows of positions under ``query_ord`` and the ids of ``questions`` again."""
    ids = questions.select(F.col("query_ord").cast("string").alias("_at"), "query_ord", F.col("query_id").alias("_id"))
    named = rows.withColumnRenamed("query_id", "_at").join(broadcast_if_small(ids), "_at")
    return named.withColumnRenamed("_id", "query_id").drop("_at")


def ranked_tables(questions: DataFrame, tables: DataFrame, retriever, zoom=None, reranker=None) -> DataFrame:
    """``hits`` after all ranking stages, with reciprocal-rank scores after each of them."""
    return _ranked(questions, tables, retriever, zoom, reranker)[0]


def _ranked(questions, tables, retriever, zoom, reranker) -> tuple[DataFrame, DataFrame]:
    """Hits, and the tables that retrieval hit, written once: no later stage reads the lake again."""
    hits = cut_lineage(ranking.reciprocal_rank(retriever(questions, tables)))
    if retriever.mode == "closed-book":
        return hits, tables
    met = R.met_tables(hits, tables)
    for stage in (zoom, reranker):
        if stage is not None:
            hits = ranking.reciprocal_rank(stage(questions, hits, met))
    return cut_lineage(hits), met


def gold(questions: DataFrame) -> DataFrame:
    return questions.where("table_id IS NOT NULL").select("query_id", "table_id", F.lit(1).alias("rel"))


def scored_run(hits: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and gold pairs as a run is scored: of questions that share an id, the last one's."""
    latest = questions.groupBy("query_id").agg(F.max("query_ord").alias("query_ord"))
    kept = questions.join(latest, ["query_id", "query_ord"])
    own = hits.join(latest, ["query_id", "query_ord"])
    return ranking.last_question_only(own), gold(kept)


def answered_questions(
    questions: DataFrame, tables: DataFrame, hits: DataFrame, mode: str, generator, model: str,
    dataset: str, template: str = "QTTT", linearization: str = "csv", num_context: int = 3,
    num_rows: int | None = None, cell_tokens: int | None = None,
) -> DataFrame:
    """``(query_id, was_cut, request, …, prediction, ground_truth)`` for every question."""
    contexts = None
    if mode != "closed-book":
        shown = L.linearize(tables, linearization, num_rows, cell_tokens)
        contexts = (
            R.oracle_context(questions, hits, shown, template)
            if mode == "oracle"
            else R.open_book_context(questions, hits, shown, num_context, template)
        )
    asked = R.answer_requests(
        questions, mode, template, dataset, model, costs.max_context(model), contexts
    )
    return generator(asked).join(questions.select("query_id", "ground_truth"), "query_id")


@dataclass
class Run:
    hits: DataFrame
    accuracies: DataFrame
    scored: DataFrame
    record: DataFrame


def run_experiment(
    questions: DataFrame, tables: DataFrame, retriever, generator, model: str, dataset: str,
    zoom=None, reranker=None, **settings,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(hits, accuracies, answer scores per question)``; the mode follows from the retriever.

    A question is its position ``query_ord`` all along; ids, which several questions may share, come
    back at the end, and only the scoring of the retrieval goes by them.
    """
    asked = by_position(questions)
    hits, met = _ranked(asked, tables, retriever, zoom, reranker)
    answers = answered_questions(asked, met, hits, retriever.mode, generator, model, dataset, **settings)
    named = by_id(hits, questions)
    accuracies = evaluate.top_k_accuracy(*scored_run(named, questions))
    return named, accuracies, by_id(evaluate.answer_scores(answers), questions)


def whole_run(
    questions: DataFrame, tables: DataFrame, retriever, generator, model: str, dataset: str, meter: RunMeter,
    run_id: str, config_name: str, exp: str, zoom=None, reranker=None, zoom_stages=None, **settings,
) -> Run:
    """A run with its record: counters, accuracies, answer scores and cost, next to its relations.

    The stages ask through ``meter.exchange``, so the record has all that was spent; the counters of the
    answers are observed while the scored answers are written. The cost is per processed question.
    """
    hits, accuracies, scored = run_experiment(
        questions, tables, retriever, generator, model, dataset, zoom, reranker, **settings
    )
    metrics = ("exact_match", "relaxed_match", "f1_score")
    scored = meter.written(
        scored.select("query_ord", "query_id", "was_cut", "prediction", "ground_truth", *metrics),
        cutoff_context_ctr=F.count_if("was_cut"),
        processed_queries_ctr=F.count(F.lit(1)),
        **{m: F.sum(m) for m in metrics},
    )
    accuracies = cut_lineage(accuracies)
    seen, spark = meter.totals, questions.sparkSession
    processed = max(1, seen.get("processed_queries_ctr", 0))
    sizes = [(s["num_tables"], s["num_rows"]) for s in zoom_stages] if zoom_stages else None
    config = spark.createDataFrame(
        [(run_id, (config_name, exp, (sizes,)))], T.StructType([schemas.RUN_RECORD["run_id"], schemas.RUN_RECORD["config"]])
    )
    counters = [(run_id, *(int(seen.get(c, 0)) for c in report.COUNTERS))]
    means = [(run_id, *(float(seen.get(m, 0)) / processed for m in metrics), seen.get("cost", 0.0) / processed)]
    summed = spark.createDataFrame(means, "run_id string, " + ", ".join(f"{m} double" for m in (*metrics, "cost_per_question")))
    record = report.run_records(
        config,
        accuracies.withColumn("run_id", F.lit(run_id)),
        summed,
        spark.createDataFrame(counters, "run_id string, " + ", ".join(f"{c} bigint" for c in report.COUNTERS)),
        summed,
    )
    return Run(hits, accuracies, scored, record)


def split_questions(
    records: DataFrame, predictions: DataFrame, references: DataFrame, questions: DataFrame,
    partition: str, model: str,
) -> DataFrame:
    """Easy and hard questions of a partition, judged by its closed-book run with ``model``.

    ``predictions`` and ``references`` are run relations (``sources.store``); of several closed-book
    runs the first by id counts. ``questions(ord, id, answers, …)`` is the partition's source.
    """
    closed = report.runs_with(
        records, retriever="NoRetriever", reranker="NoReranker", zoom="NoZoom",
        generator="LLMGenerator", model=model,
    )
    first = closed.agg(F.min("run_id")).scalar()
    said = predictions.where(F.col("run_id") == first)
    meant = references.where(F.col("run_id") == first)
    answers = said.join(meant, ["run_id", "query_ord", "query_id"]).select(
        F.lit(partition).alias("partition"),
        F.col("query_ord").alias("ord"),
        F.col("query_id").alias("id"),
        "prediction",
        F.col("ground_truth").alias("answers"),
    )
    return evaluate.split_by_difficulty(answers, questions.withColumn("partition", F.lit(partition)))
