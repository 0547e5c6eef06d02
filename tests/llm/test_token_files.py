import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeqa.llm import queries, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
FIELDS = "doc_id long, text string, shard int, ids string, Uid long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def expected(tokenizer, rows):
    coded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), crc(r[1])))
    out, start = [], 0
    for doc_id, ids in coded:
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return sorted(out, key=repr)


def written(spark, folder, rows, **options):
    docs = spark.createDataFrame([(*r, 7, "x", None) for r in rows], FIELDS)
    return token_files.write_token_files(docs, TOKENIZER, str(folder), **options)


def sums(spark, folder, **options):
    found = token_files.check_sums(token_files.read_token_files(spark, str(folder), **options))
    return sorted(map(tuple, found.collect()), key=repr)


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    draw = random.Random(3)
    parts = [" ", " ", "a", "The", "'s", "'", "\n", "\t", "\xa0", "᠎", "​", "\x1c", "1", ".", ",", "é", "日", "Ġ", "😀", "\r", "<|endoftext|>", "\0", "word"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(20_000)]
    encoder = token_files.PieceEncoder(Path(TOKENIZER).read_text())
    for at in range(0, len(texts), 700):
        check(encoder, tokenizer, texts[at : at + 700])


def check(encoder, tokenizer, texts):
    ids, sizes = encoder.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_no_texts_and_texts_of_one_kind(tokenizer):
    encoder = token_files.PieceEncoder(Path(TOKENIZER).read_text())
    for texts in ([], ["one safe text"], [" unsafe "], ["", ""]):
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
        assert len(sizes) == len(texts)


ROWS = [
    (5, "some words, and more."), (3, None), (3, ""), (3, "b"), (3, "b"), (None, "no id"), (None, None),
    (-4, "first"), (9, "x " * 50_000), (8, "  two   blanks \n\n and lines\t"),
]


@pytest.mark.parametrize("shard_tokens", [1 << 27, 3000])
def test_round_trip(spark, tmp_path, tokenizer, shard_tokens, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 10)
    monkeypatch.setattr(token_files, "PLACED_ROWS", 2)
    shards = written(spark, tmp_path, ROWS, shard_tokens=shard_tokens).orderBy("shard").collect()
    assert sums(spark, tmp_path) == expected(tokenizer, ROWS)
    assert [s["base"] for s in shards] == [sum(t["n_tokens"] for t in shards[:i]) for i in range(len(shards))]
    ids = [s["first_id"] for s in shards if s["first_id"] is not None]
    assert ids == sorted(ids)
    if shard_tokens == 3000:
        assert len(shards) > 1


def test_copies_of_one_id_spread_over_shards(spark, tmp_path, tokenizer):
    rows = [(1, "the same text")] * 3000
    shards = written(spark, tmp_path, rows, shard_tokens=1000)
    assert shards.count() > 5
    assert sums(spark, tmp_path) == expected(tokenizer, rows)


def test_empty_table(spark, tmp_path):
    assert written(spark, tmp_path, []).collect() == []
    assert sums(spark, tmp_path) == []


def test_files_have_stripes_and_prune_by_id(spark, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 16)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    rows = [(2 * i, " ".join(word() for _ in range(60))) for i in range(8000)]
    written(spark, tmp_path, rows, shard_tokens=500_000)
    files = sorted((tmp_path / "ids").glob("*.orc"))
    assert len(files) > 1 and all(orc.ORCFile(f).row_index_stride == 1000 for f in files)
    assert sum(orc.ORCFile(f).nstripes for f in files) > len(files)
    assert sums(spark, tmp_path, doc_ids=[4, 10_001, 15_000]) == [r for r in expected(tokenizer, rows) if r[0] in (4, 15_000)]

    def rows_read(ids):
        found = token_files._ids(spark, str(tmp_path)).where(F.col("doc_id").isin(ids))
        found.collect()
        pending, total = [found._jdf.queryExecution().executedPlan()], 0
        while pending:
            node = pending.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                pending.append(node.executedPlan())
            if node.nodeName().startswith("Scan"):
                total += node.metrics().get("numOutputRows").get().value()
            children = node.children()
            pending += [children.apply(i) for i in range(children.size())]
        return total

    assert 0 < rows_read([4, 15_000]) <= 4000
    # An odd id lies between smallest and largest ids; only the Bloom filters tell that it is absent.
    assert rows_read([10_001]) < 1000


def test_query_equals_brute_force(spark, tokenizer):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = queries.QUERIES["op12_token_files"](spark, sf_dir)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(tokenizer, [tuple(r) for r in docs.collect()])


def test_pieces_of_earlier_texts_are_not_encoded_again(tokenizer, monkeypatch):
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.randint(1, 9)))
    texts = [" ".join([*(word() for _ in range(80)), "Same, again."]) for _ in range(50)]
    encoder, asked = token_files.PieceEncoder(Path(TOKENIZER).read_text()), []
    behind = encoder._with_blanks
    monkeypatch.setattr(encoder, "_with_blanks", lambda pieces: asked.append(len(pieces)) or behind(pieces))
    for _ in range(2):
        check(encoder, tokenizer, texts)
    assert asked[0] > 2000 and sum(asked[2:]) == 0
    monkeypatch.setattr(token_files, "KEPT_PIECES", 3)
    few = token_files.PieceEncoder(Path(TOKENIZER).read_text())
    for at in range(0, 50, 10):
        check(few, tokenizer, texts[at : at + 10] + ["", "one"])
    assert len(few.kept[0]) == 3
