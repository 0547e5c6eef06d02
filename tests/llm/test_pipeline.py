import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lakeqa import scale
from lakeqa.llm import decontaminate, packing, secrets
from lakeqa.llm.oracle import ORACLE
from lakeqa.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": "the on er re th at".split(), "de": "sch ein ver und äu ßt".split()}
PASSAGE = "erthat reon there onat therth atre thon rethe onon erre thth atat"
SECRET = "token=0123456789abcdef0123456789abcdef"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Clean documents, and one planted case of each kind."""
    draw = random.Random(8)
    make = lambda lang, n: " ".join("".join(draw.choices(PARTS[lang], k=draw.randint(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 60), lang, "s") for i, lang in enumerate(["en", "de"] * 60)]
    base = rows[10][1].split()
    rows += [
        (200, rows[10][1], "en", "s"),
        (201, " ".join([*base[:-1], "changed"]), "en", None),
        (202, f"{make('en', 30)} {PASSAGE} {make('en', 30)}", "en", "s"),
        (203, f"{make('de', 30)} {SECRET} {make('de', 30)}", "de", "s"),
        (204, "1234 5678 !!", None, "s"),
        (205, None, "en", "s"),
        (206, "", "en", "s"),
        (207, make("en", 4000), "en", "s"),
    ]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i: t for i, t, _, _ in rows}


def test_stages_against_brute_force(spark, fixture):
    folder, texts = fixture
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            seen[name] = {r["doc_id"]: r for r in docs.collect()}
    spoken = {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert seen["language"].keys() == spoken.keys()
    single = {i: t for i, t in spoken.items() if i not in (200, 201)}
    assert {i: r["text"] for i, r in seen["near copies"].items()} == single
    clean = {i: t.replace(f" {PASSAGE} ", "   ") for i, t in single.items()}
    assert {i: r["text"] for i, r in seen["benchmark"].items()} == clean
    told = {i: t.replace(SECRET, "[secret]") for i, t in clean.items()}
    assert {i: r["text"] for i, r in seen["secrets"].items()} == told
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secrets"].values())
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = set()
    for i, text in told.items():
        ids = np.array(encoder.encode(text, add_special_tokens=False).ids + [0], np.uint32)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            wanted.add((i, piece, start, len(ids[start : start + 2048]), zlib.crc32(ids[start : start + 2048].tobytes())))
    packed = docs.collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed} == wanted
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole} == {(w[0], w[1], w[4]) for w in wanted}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op6_secrets", "op9_language"])
def test_queries_on_the_smallest_table(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    if name == "op6_secrets":
        for row in rows:
            base = ",".join(s for s in row["spans"].split(",") if not s.startswith("model"))
            assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    else:
        held = [r for r in rows if r["held_out"]]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.9


def test_workers_get_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """Of each stage that sends whole texts to workers, the job that does so."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(limit, None), []

    def noting(module):
        write = module.cut_lineage

        def noted(df, *more):
            if "text" in df.columns or "ids_crc32" in df.columns:
                seen.append((module.__name__, spark.conf.get(limit, None)))
            return write(df, *more)

        return noted

    for module in (corpus_pipeline, decontaminate, secrets, packing):
        monkeypatch.setattr(module, "cut_lineage", noting(module))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = "the house of a friend near old river bridge and some more words"
    rows = [(i, f"{words} {i}", "en", "web", 60) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name != "near copies":
            stage(spark, docs, str(tmp_path))
    small = f"{scale.BATCH_BYTES}b"
    assert seen == [
        ("corpus_pipeline", small),
        ("lakeqa.llm.decontaminate", small),
        ("lakeqa.llm.secrets", small),
        ("lakeqa.llm.packing", f"{corpus_pipeline.TOKENIZED_BYTES}b"),
    ]
    assert spark.conf.get(limit, None) == before


def test_near_copies_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i : i + 30]) for i in range(10)]
    docs = spark.createDataFrame([(i, f"{t} end") for i, t in enumerate([*texts, *texts])], "doc_id long, text string")
    before = shuffled()
    kept = corpus_pipeline.join_copies(spark, docs, "")
    assert not shuffled() - before
    assert len({r["text"] for r in kept.collect()}) == kept.count()


def test_copies_of_texts_are_written_small(spark, tmp_path):
    """Between steps; the session's own setting holds again afterwards."""
    codec = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(codec)
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"the house of a friend near old river bridge and some more words {i}", "en", "web", 60) for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.remove_benchmark, corpus_pipeline.redact_secrets):
        file = stage(spark, docs, str(tmp_path)).inputFiles()[0].removeprefix("file:")
        assert pq.ParquetFile(file).metadata.row_group(0).column(1).compression == "ZSTD"
        assert spark.conf.get(codec) == before
