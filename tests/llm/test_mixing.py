import math
import pickle
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from lakeqa.llm import mixing as M


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return lowered.encode().split() + [b"end of text"]


def corpus(seed, n):
    draw = random.Random(seed)
    parts = "the on er re th at ä ß".split()
    return [" ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(draw.randint(1, 60))) for _ in range(n)]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")


@pytest.mark.parametrize("held_words", [0, 5, 10_000])
def test_base_scores_against_brute_force(spark, monkeypatch, held_words):
    monkeypatch.setattr(M, "HELD_WORDS", held_words)
    train = [*corpus(1, 60), None, "", "x" * 500, "The THE the"]
    texts = [*corpus(2, 20), None, "", "x" * 500, "unseen\x00word", *corpus(2, 3)]
    counts = Counter(t for text in train for t in tokens(text))
    total, size = counts.total(), len(counts)
    found = M.score_texts(rows_of(spark, texts), rows_of(spark, train)).collect()
    assert len(found) == len(texts)
    for row in found:
        own = tokens(texts[row["doc_id"]])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), total)
        base = sum(math.log10((counts[t] + 1) / (total + size + 1)) for t in own)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert row["score"] < 0


def test_model_learns_and_is_a_probability(spark):
    words, grams = M.count_corpus(rows_of(spark, corpus(1, 300)))
    assert words.count() and grams.count()
    model = M.train_mixer(grams)
    held = [t.encode() for t in corpus(7, 50)]
    windows, starts = M.windows_of(held)
    assert len(windows) == sum(len(b) + 1 for b in held) and starts[1] == len(held[0]) + 1
    bits = model.byte_costs(windows).mean() / math.log10(2)
    frequency = Counter(b"".join(held))
    order0 = -sum(n / frequency.total() * math.log2(n / frequency.total()) for n in frequency.values())
    assert bits < 0.8 * order0
    for window in windows[[0, 5, 40]]:
        every = (window & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** -model.byte_costs(every)).sum(), 1, rel_tol=1e-3)


def test_windows_do_not_cross_texts():
    alone = M.windows_of([b"xyz"])[0]
    assert np.array_equal(M.windows_of([b"abcdefgh", b"", b"xyz"])[0][-4:], alone)


def test_chunks_do_not_change_scores(spark, monkeypatch):
    texts = corpus(3, 40)
    whole = {r["doc_id"]: r["score"] for r in M.score_texts(rows_of(spark, texts), rows_of(spark, texts)).collect()}
    monkeypatch.setattr(M, "SCORE_CHUNK", 100)
    parts = {r["doc_id"]: r["score"] for r in M.score_texts(rows_of(spark, texts), rows_of(spark, texts)).collect()}
    assert whole.keys() == parts.keys() and all(math.isclose(whole[k], parts[k], rel_tol=1e-6) for k in whole)


def test_empty_tables(spark):
    none = rows_of(spark, [])
    assert M.score_texts(none, rows_of(spark, ["a b"])).collect() == []
    row = M.score_texts(rows_of(spark, ["a b"]), none).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert math.isclose(row["base_score"], 0, abs_tol=1e-9) and math.isclose(row["score"], -4 * 8 * math.log10(2), rel_tol=1e-6)


def test_words_met_by_a_join_grow_as_the_text_does(spark, monkeypatch):
    """Also where all words of the smaller corpus would have been few enough to be held by every task."""
    draw, met = random.Random(6), []
    join = M.cut_lineage

    def written(df):
        out = join(df)
        if "_rare" in out.columns:
            met.append(out.agg(M.F.sum(M.F.size("_rare"))).first()[0])
        return out

    monkeypatch.setattr(M, "cut_lineage", written)
    for size in (1, 5):
        words = [f"w{draw.randrange(10 ** draw.choice([2, 9, 9, 9]))}" for _ in range(400_000 * size)]
        texts = [" ".join(words[at : at + 3000]) for at in range(0, len(words), 3000)]
        docs = rows_of(spark, texts)
        M.score_texts(docs, docs).count()
    assert met[0] > 0 and met[1] < 8 * met[0]


def test_a_task_works_the_tables_out_part_by_part(monkeypatch):
    monkeypatch.setattr(M, "PAGE_BITS", (4, 5, 5, 6, 6))
    counts = np.random.default_rng(3).integers(0, 9, 16 * sum(1 << b for b in M.PAGE_BITS)).astype(np.int32)
    counts[::3] = 0
    whole = M.MixModel(counts)
    monkeypatch.setattr(M, "PART_SLOTS", 1 << 30)
    nodes, stretched = whole.nodes(), whole.stretched()
    monkeypatch.setattr(M, "PART_SLOTS", 64)
    scores, learns = (pickle.loads(pickle.dumps(whole)) for _ in range(2))
    assert all(np.array_equal(a, b) for a, b in zip(scores.stretched(), stretched, strict=True))
    assert scores.counts is None and scores._nodes is None  # never both tables of nodes beside the chances
    assert all(np.array_equal(a[i], b[i]) for a, b in zip(learns.nodes(), nodes, strict=True) for i in range(len(counts)) if i % 16)
    assert learns.counts is None and learns._stretched is None


def test_windows_take_little_beside_themselves():
    bodies = [b"some text that repeats " * 40] * 500 + [b""]
    tracemalloc.start()
    try:
        windows, _ = M.windows_of(bodies)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(windows) == sum(len(b) + 1 for b in bodies)
    assert peak < 3 * windows.nbytes
