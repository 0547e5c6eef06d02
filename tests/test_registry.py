import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import __spark_entry__ as entry  # noqa: E402
from lakeqa.workload import queries  # noqa: E402
from lakeqa.workload.oracle import ORACLE  # noqa: E402
from lakeqa.workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("LAKEQA_TEST_DATA", "/root/testdata/sf0.001")


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in records), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, name):
    db = duckdb.connect()
    for t in "orders lineitem customer supplier documents embeddings benchmark conversations events labels".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_files_of_tables_are_sorted_by_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    path = queries.as_files(spark, spark.range(200).selectExpr("id as ord", "cast(id as string) as id"))
    tasks = {os.path.basename(f).split("-")[1] for f in spark.read.json(path).inputFiles()}
    assert len(tasks) > 8
