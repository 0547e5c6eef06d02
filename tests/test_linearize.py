import csv
import io
import json

from pyspark.sql import functions as F

from lakeqa import schemas
from lakeqa.functions import linearize as L
from lakeqa.sources import tables as S

AITQA = [
    {
        "id": "t1", "title": 'Air "X", Inc', "column_header": [["2019"], ["2020", "Restated"], ["a", "b", "c"]],
        "row_header": [["Fuel"], ["Cost", "Labor"]], "data": [["1,200", "900", ""], ["5", '"n/a"', "two\nlines"], ["lost"]],
    },
    {"id": "t2", "title": "Plain", "column_header": [["only"]], "row_header": [], "data": [[""], ["x y "], ["\r"]]},
    {"id": "t3", "title": "Empty path", "column_header": [[], ["z"]], "row_header": [["r"]], "data": [["é/ß", "<b>"]]},
]
NQ = [
    {
        "tableId": "Oak_1", "documentTitle": "Oak", "columns": [{"text": "Year"}, {"text": "Height"}],
        "rows": [{"cells": [{"text": "1990"}, {"text": "3 m"}]}, {"cells": [{"text": "2,000"}, {"text": ""}]}],
        "documentUrl": "http://x",
    }
]


def head(path):
    return " ".join(path[:2]) if path else ""


def python_csv(table, rows=None):
    out = io.StringIO()
    w = csv.writer(out)
    if "tableId" in table:
        w.writerow([table["tableId"], table["documentTitle"]])
        w.writerow([c["text"] for c in table["columns"]])
        w.writerows([[c["text"] for c in r["cells"]] for r in table["rows"][:rows]])
        return out.getvalue()
    w.writerow([table["id"], table["title"]])
    names = [head(h) for h in table["column_header"]]
    heads = [head(h) for h in table["row_header"]]
    w.writerow(([""] if heads else []) + names)
    if heads:
        w.writerows([h, *d] for h, d in zip(heads[:rows], table["data"][:rows]))
    else:
        w.writerows(table["data"][:rows])
    return out.getvalue()


def lake(spark):
    def frame(rows, schema, dataset):
        lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ord long, line string")
        return S.normalize_tables(lines.select("ord", F.from_json("line", schema).alias("t")).select("ord", "t.*"), dataset)

    return frame(AITQA, schemas.AITQA_TABLE, "aitqa").unionByName(frame(NQ, schemas.NQ_TABLE, "nqtables"))


def texts(df):
    return {r.table_id: r.table_content for r in df.collect()}


def test_csv_equals_python_writer(spark):
    got = texts(L.linearize(lake(spark), "csv"))
    for table in AITQA + NQ:
        assert got[table.get("id", table.get("tableId"))] == python_csv(table)


def test_row_limit(spark):
    got = texts(L.linearize(lake(spark), "csv", num_rows=1))
    for table in AITQA + NQ:
        assert got[table.get("id", table.get("tableId"))] == python_csv(table, 1)


def test_json_text(spark):
    got = {k: json.loads(v) for k, v in texts(L.linearize(lake(spark), "json")).items()}
    assert got["t1"] == AITQA[0]
    assert list(got["t2"]) == ["id", "title", "column_header", "row_header", "data"]
    assert got["Oak_1"] == {
        "id": "Oak_1", "title": "Oak", "columns": NQ[0]["columns"], "rows": NQ[0]["rows"],
    }


def test_missing_lists_become_empty(spark):
    raw = spark.createDataFrame([(0, '{"id":"a","title":"b"}')], "ord long, line string").select(
        "ord", F.from_json("line", schemas.AITQA_TABLE).alias("t")
    ).select("ord", "t.*")
    got = texts(L.linearize(S.normalize_tables(raw, "aitqa"), "json"))
    assert got["a"] == '{"id":"a","title":"b","column_header":[],"row_header":[],"data":[]}'


def test_cells_are_cut_but_headers_are_not(spark):
    got = {r.table_id: r for r in L.cut_cells(lake(spark), 1).collect()}
    assert got["t1"].data == [["1", "900", ""], ["5", '"', "two"], ["lost"]]
    assert got["t1"].column_header == AITQA[0]["column_header"]


def test_title_from_text(spark):
    for form in ("csv", "json"):
        rows = L.linearize(lake(spark), form).select(
            "table_name", L.title_of_text(F.col("table_content"), form).alias("title")
        ).collect()
        assert all(r.title == r.table_name for r in rows)


def test_a_text_is_made_once_for_its_title(spark):
    assert str(L.title_of_text(F.col("content"), "csv")).count("content") == 1
    texts = ['t,plain\r\nx', '"t,1","a ""b"", c"\r\n', "t,\r\n", "no line", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = [r.title for r in rows.select("i", L.title_of_text(F.col("content"), "csv").alias("title")).orderBy("i").collect()]
    assert got == ["plain", 'a "b", c', "", "", "", None]
