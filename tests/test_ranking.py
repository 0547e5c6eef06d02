import pytest
from pyspark.sql import functions as F

from lakeqa.operators import ranking

SCHEMA = "query_id string, table_id string, rank long, score double"


def hits(spark, ids="abcdef", q="q"):
    return spark.createDataFrame([(q, t, i, 1.0 / i) for i, t in enumerate(ids, 1)], SCHEMA)


def order(df, q="q"):
    rows = sorted((r for r in df.collect() if r.query_id == q), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return "".join(r.table_id for r in rows)


def select(spark, ids, q="q"):
    return spark.createDataFrame([(q, ids)], "query_id string, selected array<string>")


@pytest.mark.parametrize(
    "ids, focus, expected",
    [
        (["c", "a"], 6, "acbdef"),  # membership counts, not the order of the list
        (["d", "zz"], 6, "dabcef"),  # unknown ids have no effect
        (["f"], 4, "abcdef"),  # ids behind the focus cannot be selected
        (["d"], 4, "dabcef"),
        ([], 6, "abcdef"),
        (None, 6, "abcdef"),
        (list("fedcb"), 6, "bcdefa"),  # selecting too many truncates nothing
    ],
)
def test_selected_first(spark, ids, focus, expected):
    assert order(ranking.selected_first(hits(spark), select(spark, ids), focus)) == expected


def test_question_without_selection_keeps_its_order(spark):
    assert order(ranking.selected_first(hits(spark), select(spark, ["f"], "other"), 6)) == "abcdef"


def test_selection_sizes(spark):
    got = ranking.selection_sizes(hits(spark), select(spark, ["a", "f", "zz"]), 5).collect()
    assert [(r.query_id, r.num_selected) for r in got] == [("q", 1)]


def similar(spark, scores):
    return spark.createDataFrame([("q", t, s) for t, s in scores.items()] or [], "query_id string, table_id string, score double")


def scores(df):
    return {r.table_id: r.score for r in df.collect()}


def test_merge_squeezes_the_tail_under_the_head(spark):
    merged = ranking.merge_reranked(hits(spark), similar(spark, {"a": 0.5, "b": 0.9, "c": 0.7}), 3)
    assert order(merged) == "bcadef"
    got = scores(merged)
    assert got["d"] == pytest.approx(0.25 * 0.49 / 0.25) and got["f"] == pytest.approx((1 / 6) * 0.49 / 0.25)


def test_failed_hits_join_the_tail(spark):
    merged = ranking.merge_reranked(hits(spark), similar(spark, {"a": 0.4, "c": 0.6}), 3)
    assert order(merged) == "cabdef"
    assert scores(merged)["b"] == pytest.approx(0.5 * 0.39 / 0.5)


def test_failed_hits_rank_first_among_equal_scores(spark):
    flat = hits(spark).withColumn("score", F.lit(1.0))
    assert order(ranking.merge_reranked(flat, similar(spark, {"a": 0.4}), 3)) == "abcdef"


def test_all_failed_keeps_the_old_ranking(spark):
    merged = ranking.merge_reranked(hits(spark), similar(spark, {}), 3)
    assert order(merged) == "abcdef" and scores(merged)["d"] == 0.25


def test_no_tail_only_sorts(spark):
    merged = ranking.merge_reranked(hits(spark, "abc"), similar(spark, {"a": 0.1, "b": 0.3, "c": 0.2}), 10)
    assert order(merged) == "bca" and scores(merged) == {"a": 0.1, "b": 0.3, "c": 0.2}


def test_low_head_scores_flip_the_tail(spark):
    assert order(ranking.merge_reranked(hits(spark, "abcd"), similar(spark, {"a": 0.0, "b": 0.2}), 2)) == "badc"


def test_scores_outside_the_head_are_ignored(spark):
    assert order(ranking.merge_reranked(hits(spark), similar(spark, {"a": 0.5, "f": 0.9}), 3)) == "abcdef"


def test_reciprocal_rank(spark):
    got = scores(ranking.reciprocal_rank(hits(spark).withColumn("score", F.lit(7.0))))
    assert got["a"] == 1.0 and got["d"] == 0.25


def test_last_question_only(spark):
    df = spark.createDataFrame(
        [(1, "q", "x", 1, 1.0), (2, "q", "a", 1, 1.0), (2, "q", "b", 2, 0.5), (2, "q", "a", 3, 0.3), (3, "p", "z", 1, 1.0)],
        "query_ord long, " + SCHEMA,
    )
    once = ranking.last_question_only(df)
    assert order(once) == "ba" and order(once, "p") == "z"
    assert scores(once) == {"a": 0.3, "b": 0.5, "z": 1.0}


def test_oracle_and_no_hits(spark):
    questions = spark.createDataFrame([("q", "t9")], "query_id string, table_id string")
    assert order(ranking.oracle_hits(questions)) == "t9"
    assert ranking.no_hits(questions).dtypes == ranking.oracle_hits(questions).dtypes
    assert ranking.no_hits(questions).count() == 0
