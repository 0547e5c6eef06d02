import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakeqa.llm import divergence

FIELDS = "text string, lang string, source string, Item int, value string, rank int"


def expected(rows, least=3, top=200):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), g or "", s or "") for t, g, s in rows]
    seen, counts, out = Counter(), defaultdict(Counter), []
    for words, lang, source in docs:
        seen.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    for lang in {g for g, _ in counts}:
        kept = [w for (g, w), n in seen.items() if g == lang and n >= least]
        sources = [s for g, s in counts if g == lang]
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        gain = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(gain(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-gain(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], FIELDS)
    return sorted(map(tuple, divergence.audit_sources(docs, **options).collect()))


def random_rows(n, seed):
    draw = random.Random(seed)
    words = ["The", "the", "Ä", "ä", "word", "日本", "x1y", "don't", "\U0001f600", "é"] + [f"w{chr(97 + i)}" for i in range(20)]
    pick = lambda *names: draw.choice(names)
    return [
        (" ".join(draw.choices(words, k=draw.randrange(12))), pick("en", "en", "de", None, ""), pick("a", "b", "b", "c", None, "é"))
        for _ in range(n)
    ]


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"hash_bytes": 1}, {"least": 1}])
def test_equals_brute_force(spark, options):
    rows = random_rows(300, 1) + [(None, "zz", "a"), (None, None, None), ("only one row", "zz", "b"), ("only one row", "yy", "b")]
    brute = {k: v for k, v in options.items() if k != "hash_bytes"}
    assert found(spark, rows, **options) == expected(rows, **brute)


def test_small_units_and_dense_arrays_that_overflow(spark, monkeypatch):
    monkeypatch.setattr(divergence, "UNIT_TERMS", 3)
    rows = random_rows(200, 2) + [("hot " * 30_000, "en", "b")] * 3
    assert found(spark, rows) == expected(rows)


def test_ties_and_repeated_rows(spark):
    rows = [("same same", "en", "a")] * 4 + [("other other", "en", "b")] * 4 + [("same other", "en", "c")] * 3
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal_and_rejects_others(size):
    keys = [f"key {i * 7919}".encode() for i in range(size)]
    table = divergence.PerfectHash.from_bytes(divergence.PerfectHash.build(keys).to_bytes())
    assert len(table) == size
    assert sorted(table.slots(keys).tolist()) == list(range(size))
    assert [table.keys[int(s)].as_py() for s in table.slots(keys[:50])] == keys[:50]
    assert set(table.slots([b"no key", b"", "ü".encode()]).tolist()) == {-1}


def test_keys_that_no_level_places(monkeypatch):
    monkeypatch.setattr(divergence.PerfectHash, "LEVELS", 1)
    keys = [str(i).encode() for i in range(500)]
    table = divergence.PerfectHash.from_bytes(divergence.PerfectHash.build(keys).to_bytes())
    assert table.rest and sorted(table.slots(keys).tolist()) == list(range(500))
    assert table.slots([b"x"]).tolist() == [-1]


def test_shares_of_huge_counts_are_exact():
    counts, total = [0, 3, 10**13, 8 * 10**14], 9 * 10**14
    got = divergence.scaled_shares(np.array(counts), np.array(total)).tolist()
    assert got == [1 + 10**9 * (c + 1) // total for c in counts]
