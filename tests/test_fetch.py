"""Rows by ids: the filter lets all wanted rows through, few others, and no other text is moved."""

from pyspark.sql import functions as F

from lakeqa.operators import fetch, requests


def tables_of(spark, n):
    return spark.range(n).select(
        F.col("id").alias("ord"), (F.col("id") % (n - 5)).cast("string").alias("table_id"), F.lit("name").alias("table_name"),
        F.repeat(F.col("id").cast("string"), F.lit(50)).alias("table_content"),
    )


def test_filter_holds_all_ids_and_few_others(spark):
    ids = spark.range(3000).select((F.col("id") * 7).cast("string").alias("table_id")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS table_id"))
    made = fetch.IdFilter(ids, "table_id")
    held = made.might_hold(F.col("table_id"))
    assert ids.where(held).count() == 3000
    others = spark.range(50_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("table_id"))
    assert others.where(held).count() < 250
    # A filter that is too small only lets more through.
    tight = fetch.IdFilter(ids, "table_id", max_bytes=64).might_hold(F.col("table_id"))
    assert ids.where(tight).count() == 3000


def test_no_ids(spark):
    none = spark.createDataFrame([], "table_id string")
    for limit in (0, 1 << 20):
        assert fetch.rows_of_ids(tables_of(spark, 20), none, "table_id", limit).count() == 0


def exchanges(frame):
    """Rows that each exchange of an executed plan wrote."""
    frame.collect()
    pending, found = [frame._jdf.queryExecution().executedPlan()], []
    while pending:
        node = pending.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            pending.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            pending.append(node.plan())
        if node.nodeName() == "Exchange":
            found.append((node.output().toString(), node.metrics().get("shuffleRecordsWritten").get().value()))
        pending += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_only_hit_texts_move(spark):
    tables = tables_of(spark, 20_000)
    hits = spark.createDataFrame([("q", str(i), 1) for i in (3, 14, 1592, 19_990)] + [("q", None, 2), ("q", "unknown", 3)], "query_id string, table_id string, rank long")
    expected = sorted(map(tuple, tables.where("ord IN (14, 1592, 19990, 19998)").select("table_id", "ord", "table_content").collect()))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = requests.hit_tables(hits, tables, broadcast_bytes=0)
        moved = [n for columns, n in exchanges(found) if "table_content" in columns or "_last" in columns]
        assert moved and max(moved) <= 10
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    # Of the tables that share id 3 the last counts.
    assert sorted(map(tuple, found.select("table_id", "ord", "table_content").collect())) == expected
