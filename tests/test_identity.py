"""Ids that repeat, tables and prices that are absent, files in order: nothing is lost or multiplied."""

import json

import pytest
from pyspark.sql import functions as F

from lakeqa.operators import completions, costs, requests as R
from lakeqa.plans import experiment, stages
from lakeqa.sources import tables as S
from lakeqa.workload import inputs as I
from tests.test_plans import MODEL, lake, questions


def first_height(asked):
    """Answers with the text of the request's first table."""
    text = F.regexp_extract(F.col("request.messages")[1]["content"], r"Table 1: (\w+),", 1)
    return asked.withColumn("prediction", text)


def test_questions_that_share_an_id_are_answered_each(spark):
    asked = questions(spark).withColumn("query_id", F.concat(F.lit("q"), F.col("query_ord") % 2))
    hits, accuracies, scores = experiment.run_experiment(
        asked, lake(spark), stages.bm25_retriever(separate_names=False, num_retrieve=3), first_height, MODEL, "nqtables"
    )
    rows = scores.collect()
    assert sorted(r["query_ord"] for r in rows) == list(range(12))
    assert all(r["prediction"] == f"t{r['query_ord']}" for r in rows)
    assert all(r["query_id"] == f"q{r['query_ord'] % 2}" for r in rows)
    assert hits.count() == 36
    found = accuracies.first()
    assert found["num_questions"] == 2 and found["accuracy_at_1"] == 1.0


def test_the_last_of_tables_sharing_an_id_is_shown_once(spark):
    tables = spark.createDataFrame(
        [(0, "ta", "n", "a"), (1, "tb", "n", "old"), (2, "tb", "n", "new")],
        "ord long, table_id string, table_name string, table_content string",
    )
    hits = spark.createDataFrame(
        [("q", "ta", 1, 1.0), ("q", "tb", 2, 0.5), ("q", "tb", 3, 0.3)],
        "query_id string, table_id string, rank long, score double",
    )
    asked = spark.createDataFrame([("q", "?")], "query_id string, query_text string")
    context = R.open_book_context(asked, hits, tables, 3, "QTTT").first()["context"]
    assert context == "Table 1: a\nTable 2: new\nTable 3: new"


def test_an_absent_table_is_an_error(spark):
    tables = spark.createDataFrame([("ta", "n", "a")], "table_id string, table_name string, table_content string")
    hits = spark.createDataFrame([("q", "gone", 1, 1.0)], "query_id string, table_id string, rank long, score double")
    with pytest.raises(Exception, match="no table gone"):
        R.with_table_text(hits, tables).collect()


def test_an_unpriced_model_is_an_error(spark):
    prices = costs.prices(spark)
    usage = F.struct(*[F.lit(1).cast("bigint").alias(n) for n in ("prompt_tokens", "completion_tokens")], F.struct(F.lit(0).cast("bigint").alias("cached_tokens")).alias("prompt_tokens_details"))
    made = spark.range(1).select(F.struct(F.lit("strange").alias("model"), usage.alias("usage")).alias("response"))
    with pytest.raises(Exception, match="no price for model strange"):
        costs.response_costs(made, prices).collect()


def test_files_are_numbered_by_path_and_place(spark, tmp_path):
    names = {"a": 3, "b": 200, "c": 1}
    at = 0
    for name, n in names.items():
        with open(tmp_path / f"{name}.json", "w") as out:
            for _ in range(n):
                out.write(json.dumps({"id": f"t{at}", "title": "x" * 400}) + "\n")
                at += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = S.read_tables(spark, str(tmp_path), "aitqa").select("ord", "table_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["ord"], r["table_id"]) for r in got) == [(i, f"t{i}") for i in range(at)]


def test_a_doubled_store_doubles_nothing(spark):
    asked = completions.with_digests(
        spark.range(3).select(R.request_struct("m", "s", F.col("id").cast("string"), 5).alias("request"))
    )
    said = F.struct(F.lit("m").alias("model"), F.col("request_hash").alias("error")).alias("response")
    store = asked.select("request_hash", "provider", "request_check", said)
    assert completions.look_up(asked, store.unionByName(store)).count() == 3


def test_short_questions_have_gold(spark, tmp_path):
    spark.createDataFrame([(0, "x", "the wood stands"), (1, "y", "thewood")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the wood"), (1, "wood"), (2, "the wood stands")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["query_id"], r["table_id"]) for r in I.gold_pairs(spark, str(tmp_path)).collect())
    assert got == [("q0", "0"), ("q1", "0"), ("q1", "1"), ("q2", "0")]
