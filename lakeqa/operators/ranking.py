"""Ranked hits ``(query_id, table_id, rank, score)``: stages that reorder them.

A question has at most as many hits as were retrieved, so every window below is small.
"""

from pyspark.sql import DataFrame, functions as F, Window as W

SCORE_DIGITS = 9


def _rerank(hits: DataFrame, *order) -> DataFrame:
    return hits.withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("bigint")
    )


def reciprocal_rank(hits: DataFrame) -> DataFrame:
    """Scores become 1/rank; done after every stage."""
    return hits.withColumn("score", 1.0 / F.col("rank"))


def no_hits(questions: DataFrame) -> DataFrame:
    return questions.where(F.lit(False)).select(
        "query_id",
        F.lit(None).cast("string").alias("table_id"),
        F.lit(None).cast("bigint").alias("rank"),
        F.lit(None).cast("double").alias("score"),
    )


def oracle_hits(questions: DataFrame) -> DataFrame:
    """The gold table of each question as its only hit."""
    return questions.select(
        "query_id", "table_id", F.lit(1).cast("bigint").alias("rank"), F.lit(1.0).alias("score")
    )


def selected_first(
    hits: DataFrame, selections: DataFrame, focus: int, sizes: str | None = None
) -> DataFrame:
    """Within the first ``focus`` hits, put the selected ones in front; both groups keep their order.

    ``selections(query_id, selected array<string>)``: ids that are no candidate have no effect, a
    missing or null list selects nothing, and selecting too many truncates nothing. ``sizes`` names
    a column for how many candidates the question's selection named.
    """
    chosen = hits.join(selections.select("query_id", "selected"), "query_id", "left").withColumn(
        "_chosen", F.coalesce(F.array_contains("selected", F.col("table_id")), F.lit(False))
    )
    behind = F.col("rank") > focus
    if sizes:
        named = F.count_if(F.col("_chosen") & ~behind).over(W.partitionBy("query_id"))
        chosen = chosen.withColumn(sizes, named)
    return _rerank(chosen, behind, behind | ~F.col("_chosen"), "rank").drop("selected", "_chosen")


def selection_sizes(hits: DataFrame, selections: DataFrame, focus: int) -> DataFrame:
    """How many candidates each question's selection really named."""
    return (
        hits.where(F.col("rank") <= focus)
        .join(selections.select("query_id", "selected"), "query_id", "left")
        .groupBy("query_id")
        .agg(
            F.count_if(
                F.coalesce(F.array_contains("selected", F.col("table_id")), F.lit(False))
            ).alias("num_selected")
        )
    )


def merge_reranked(hits: DataFrame, similarities: DataFrame, num_rerank: int) -> DataFrame:
    """Score the head by similarity and squeeze everything else below the lowest new score.

    ``similarities(query_id, table_id, score)`` lacks the hits whose request failed; those move to
    the front of the tail. A question without any new score keeps its old ranking and scores. The
    tail is multiplied by (lowest new score - 0.01) / (highest tail score); equal scores rank by
    new before failed before tail, then by old rank.
    """
    per_question = W.partitionBy("query_id")
    joined = hits.join(
        similarities.select("query_id", "table_id", F.col("score").alias("_new")),
        ["query_id", "table_id"],
        "left",
    ).withColumn("_new", F.when(F.col("rank") <= num_rerank, F.col("_new")))
    measured = joined.withColumns(
        {
            "_lowest_new": F.min("_new").over(per_question),
            "_highest_rest": F.max(F.when(F.col("_new").isNull(), F.col("score"))).over(per_question),
        }
    )
    squeezed = F.col("score") * (F.col("_lowest_new") - 0.01) / F.nullif("_highest_rest", F.lit(0.0))
    group = (
        F.when(F.col("_new").isNotNull(), 0).when(F.col("rank") <= num_rerank, 1).otherwise(2)
    )
    merged = measured.withColumns(
        {
            "_group": F.when(F.col("_lowest_new").isNull(), 0).otherwise(group),
            "score": F.when(F.col("_lowest_new").isNull(), F.col("score")).otherwise(
                F.coalesce("_new", squeezed, F.lit(0.0))
            ),
            "_key": F.when(F.col("_lowest_new").isNull(), F.lit(0.0)).otherwise(
                F.round(F.coalesce("_new", squeezed, F.lit(0.0)), SCORE_DIGITS)
            ),
        }
    )
    ranked = _rerank(merged, F.col("_key").desc(), "_group", "rank")
    return ranked.select("query_id", "table_id", "rank", "score")


def last_question_only(hits: DataFrame) -> DataFrame:
    """The run as it is scored: of questions sharing an id the last counts, of a question's repeated
    tables the last score counts at the first position.

    Needs ``query_ord``, the position of the question the hit belongs to.
    """
    latest = hits.groupBy("query_id").agg(F.max("query_ord").alias("query_ord"))
    once = (
        hits.join(latest, ["query_id", "query_ord"])
        .groupBy("query_id", "table_id")
        .agg(F.max_by("score", "rank").alias("score"), F.min("rank").alias("_first"))
    )
    return _rerank(once, F.round("score", SCORE_DIGITS).desc(), "_first").select(
        "query_id", "table_id", "rank", "score"
    )
