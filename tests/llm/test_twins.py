"""The new queries against their SQL, on given tables with nulls, repeats and odd rows added."""

import duckdb
import pytest

from lakeqa.llm.oracle import ORACLE
from lakeqa.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD = {
    "documents": "SELECT * FROM '{sf}/documents.parquet' UNION ALL SELECT NULL, NULL, NULL, NULL, NULL UNION ALL "
    "SELECT doc_id, text, NULL, source, n_chars FROM '{sf}/documents.parquet' WHERE doc_id < 20 UNION ALL "
    "SELECT doc_id, text, lang, NULL, n_chars FROM '{sf}/documents.parquet' WHERE doc_id < 9 UNION ALL "
    "SELECT 5, 'ÄÉ Ab_c 日本 x9y', 'xx', '', 3",
    "conversations": "SELECT * FROM '{sf}/conversations.parquet' UNION ALL SELECT * FROM '{sf}/conversations.parquet' WHERE turn % 3 = 1 UNION ALL "
    "SELECT NULL, turn, role, text FROM '{sf}/conversations.parquet' WHERE conv_id < 2 UNION ALL "
    "SELECT conv_id, NULL, role, NULL FROM '{sf}/conversations.parquet' WHERE conv_id < 5 AND turn < 2 UNION ALL "
    "SELECT 77777, 3, NULL, 'no role.' UNION ALL SELECT conv_id, turn + 4, 'tool', text || ' cut' FROM '{sf}/conversations.parquet' WHERE turn = 1",
}


@pytest.mark.parametrize("name, table", [("op11_divergence", "documents"), ("op13_conversation_repair", "conversations")])
@pytest.mark.parametrize("empty", [False, True])
def test_query_equals_its_twin_on_odd_rows(spark, tmp_path, name, table, empty):
    db = duckdb.connect()
    rows = ODD[table].format(sf=SF_DIR) + (" LIMIT 0" if empty else "")
    db.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)
