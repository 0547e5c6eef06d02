import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lakeqa.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        if item is None or not w:
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(own), sorted(hit), sorted(found)


@pytest.mark.parametrize("sample_every", [1, 3, 16])
def test_index_against_brute_force(sample_every):
    draw = np.random.default_rng(sample_every)
    for symbols in (2, 3, 9):
        text = draw.integers(0, symbols, 300)
        index = D.FMIndex(text, sample_every)
        for length in (1, 2, 5):
            windows = np.concatenate([draw.integers(1, symbols, (30, length)), np.full((1, length), symbols + 3)])
            low, high = index.search(windows)
            for w, a, b in zip(windows, low, high, strict=True):
                wanted = [i for i in range(len(text) - length + 1) if (text[i : i + length] == w).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == wanted


def rows_of(spark, docs):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, spans string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_hits_against_brute_force(spark, block_bytes):
    draw = random.Random(2)
    vocabulary = ["aa", "bb", "cc", "éé", "x1", "Dd"]
    make = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, k=n))
    items = [(i, make(draw.choice([1, 3, 6, 9]))) for i in range(12)] + [(3, "aa bb"), (None, "aa"), (20, None), (21, "?")]
    docs = [make(draw.randint(0, 60)) for _ in range(40)] + [None, "", "..", "zz " * 50, make(3000)]
    docs += docs[:3] + ["zz " * 3 + items[2][1].upper() + " zz"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for row in D.find_contamination(rows_of(spark, docs), bench, window=5, block_bytes=block_bytes).collect():
        n, hit, found = brute(docs[row["doc_id"]], items, 5)
        assert row["n_words"] == n and row["hit_items"] == found
        assert [i for s in row["hit_words"] for i in range(s["start"], s["end"])] == hit
        text = docs[row["doc_id"]] or ""
        assert [w for s in row["spans"] for w in words(text[s["start"] : s["end"]])] == [words(text)[i] for i in hit]


def test_cutting_out(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [f"Ünd before. {passage}, after", "clean text", passage, None, "", f"{passage} {passage} x"]
    rows = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in D.decontaminate(rows, bench).collect()}
    assert got == {0: ("Ünd before.  , after", 20), 1: ("clean text", 10), 3: (None, 0), 4: ("", 0), 5: ("  x", 3)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    row = D.find_contamination(rows_of(spark, ["a b"]), none).first()
    assert (row["n_words"], row["hit_items"], row["spans"]) == (2, [], [])
    assert D.find_contamination(rows_of(spark, ["a"]).where("1 = 0"), none).collect() == []


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_items_without_an_id(spark, block_bytes):
    passage, other = "one two three four five six seven eight nine ten", "red green blue"
    docs = [f"x {passage}, y", f"{passage} {other}", "clean", other]
    bench = spark.createDataFrame([(None, passage), (None, other), (7, other)], "item_id long, text string")
    found = D.find_contamination(rows_of(spark, docs), bench, block_bytes=block_bytes, unnamed=True)
    assert {r["doc_id"]: r["hit_items"] for r in found.collect()} == {0: [None], 1: ["7", None], 2: [], 3: ["7", None]}
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in D.decontaminate(rows, bench).collect()} == {0: "x  , y", 2: "clean"}


def test_query_against_sql_with_null_ids(spark, tmp_path):
    import duckdb

    from lakeqa.llm.oracle import ORACLE
    from lakeqa.llm.queries import QUERIES

    passage, other = "one two three four five six seven eight nine ten", "red green blue"
    docs = list(enumerate([f"x {passage}, y", f"{passage} {other}", "clean", other]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(None, passage), (None, other), (7, other), (8, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {name} AS FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = QUERIES["op5_decontamination"](spark, str(tmp_path))
    wanted = base.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE['op5_decontamination']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_documents_are_indexed_in_small_shards(spark, monkeypatch):
    draw = random.Random(2)
    vocabulary = [f"v{i}" for i in range(30)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.choice([0, 3, 60]))) for _ in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(D.shards_of([batch], "text", 1000))
    assert sum(p.num_rows for p in parts) == 301 and len(parts) > 10
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts) <= 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(str(i), texts[i]) for i in range(0, 300, 50)], "item_id string, text string")
    whole = sorted(map(repr, D.find_contamination(docs, items, 3).collect()))
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    assert sorted(map(repr, D.find_contamination(docs, items, 3).collect())) == whole
