import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeqa.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """By exhaustive search."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in {r: k for k, r in enumerate(bins)}.values():
            if bins[b] >= lengths[i]:
                place(i + 1, [r - lengths[i] * (k == b) for k, r in enumerate(bins)])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_and_fit_against_exhaustive_search():
    draw = random.Random(1)
    for _ in range(150):
        capacity = draw.choice([7, 10, 23])
        lengths = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 8))), reverse=True)
        bins, offsets = P.best_fit_decreasing(np.array(lengths), capacity)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= capacity
        for b in set(bins.tolist()):
            own = sorted((o, n) for o, n, k in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if k == b)
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        bound = P.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert bound <= fewest(lengths, capacity) <= len(fill)


def test_bound_beats_volume():
    counts = np.zeros(101, int)
    counts[60] = 10
    assert P.lower_bound(counts, 100) == 10


@pytest.mark.parametrize("group_rows", [1000, 6])
def test_pieces_and_sequences(spark, group_rows):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdeéß,.<&", k=draw.randint(1, 9)))
    texts = [" ".join(word() for _ in range(draw.randint(0, 25))) for _ in range(50)]
    texts += [None, "", " \n\t ", "it's <|endoftext|>here", " x y", "x" * 300, texts[0], texts[0]]
    rows = [(i % 52, t, "no") for i, t in enumerate(texts)] + [(None, "lost id", "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = [r.asDict() for r in P.pack(docs, PATH, capacity=32, group_rows=group_rows, with_ids=True).collect()]
    encoder = Tokenizer.from_file(PATH)
    wanted = []
    for doc_id, text, _ in rows:
        ids = np.array(encoder.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        for piece, start in enumerate(range(0, len(ids), 32)):
            own = ids[start : start + 32].tobytes()
            wanted.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own), own))
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    assert sorted((tuple(bytes(r[n]) if n == "ids" else r[n] for n in names) for r in got), key=repr) == sorted(wanted, key=repr)
    sequences = {}
    for row in got:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 32
    counts = np.bincount([r["length"] for r in got], minlength=33)
    assert len(sequences) <= P.lower_bound(counts, 32) + (1 if group_rows > 100 else 6)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(docs, PATH).collect() == []


def test_ids_are_put_in_place_part_by_part():
    random = np.random.default_rng(5)
    sizes = random.integers(0, 5, 5000)
    ids = np.arange(sizes.sum(), dtype=np.uint32)
    codes = random.integers(0, len(sizes), 1_000_000)
    tracemalloc.start()
    found = P._gathered(ids, sizes, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * found.nbytes
    starts = np.cumsum(sizes) - sizes
    for some in (slice(0, 3000), slice(P.GATHERED_CODES - 10, P.GATHERED_CODES + 10)):
        wanted = [i for c in codes[some] for i in range(starts[c], starts[c] + sizes[c])]
        begin = int(sizes[codes[: some.start]].sum())
        assert found[begin : begin + len(wanted)].tolist() == wanted
    assert P._gathered(ids, sizes, codes[:0]).tolist() == []
