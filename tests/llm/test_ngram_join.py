import random

import numpy as np
import pandas as pd
import pytest

from lakeqa.llm import ngram_join as J
from lakeqa.llm.components import connected


def grams(text, words):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(docs, words, percent):
    sets = [grams(t, words) for _, t in docs]
    links = {i: set() for i in range(len(docs))}
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id, len(links[i])))
    return sorted(out, key=repr)


def corpus(seed, families, copies):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(families):
        base = draw.choices(vocabulary, k=draw.choice([1, 2, 4, 8, 15, 30, 90]))
        for _ in range(draw.randint(1, copies)):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                k = draw.randrange(len(own))
                own[k : k + 1] = draw.choice([[], ["new"], [draw.choice(vocabulary)], [own[k], "more"]])
                own = own or ["x"]
            texts.append(draw.choice([" ", "\n"]).join(own))
    texts += [None, "", "  \t", "A b C", "a B c", "a b"]
    draw.shuffle(texts)
    return [(10 * i if i % 9 else None, t) for i, t in enumerate(texts)] + [(20, "w1 w2 w3"), (20, "w1 w2 w3")]


def rows_of(spark, docs):
    return spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, n string")


def result(spark, docs, words, percent):
    return sorted(map(tuple, J.link_documents(rows_of(spark, docs), words, percent).collect()), key=repr)


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3), (2, 100, 4)])
def test_against_brute_force(spark, words, percent, seed):
    docs = corpus(seed, 25, 12)
    assert result(spark, docs, words, percent) == brute(docs, words, percent)


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 7)
    docs = corpus(6, 3, 60)
    assert result(spark, docs, 3, 85) == brute(docs, 3, 85)


def test_linked_sets_meet_under_a_probed_key():
    draw = np.random.default_rng(3)
    for percent in (60, 80, 90):
        for size in (4, 9, 20, 60, 200):
            for _ in range(40):
                base = draw.integers(1, 1 << 62, size).astype(np.uint64)
                lost = int(draw.integers(0, max(1, size * (100 - percent) // 100) + 1))
                other = np.concatenate([base[lost:], draw.integers(1, 1 << 62, int(draw.integers(0, 3))).astype(np.uint64)])
                a, b = np.unique(base), np.unique(other)
                common = len(np.intersect1d(a, b))
                if 100 * common < percent * (len(a) + len(b) - common) or np.array_equal(a, b):
                    continue
                if len(a) < len(b):
                    a, b = b, a
                band = J.band_of(len(a), percent)
                own = {k: (key, role) for k, key, role in J.keys_of(a, percent)}[band]
                far = {k: (key, role) for k, key, role in J.keys_of(b, percent)}[band]
                # The larger set probes, and what it probes is indexed for the smaller, in its band or from below.
                assert set(own[0][own[1] == J.PROBE].tolist()) & set(far[0].tolist())


def test_allocation_keeps_the_sum():
    for sizes in ([0, 9, 9], [9, 0, 0, 0], [1], [5, 5], [0, 0]):
        for spare in range(len(sizes)):
            found = J.allocation(np.array(sizes), 1, spare)
            assert (found + 1).sum() == len(sizes) - spare and found.min() >= -1
    assert J.allocation(np.array([9, 0, 9]), 1, 0).tolist() == [1, -1, 0]
    assert J.allocation(np.array([9, 0, 9, 1]), 1, 1).tolist() == [1, -1, 0, -1]


def test_one_of_each_group_stays(spark):
    long = [f"t{i}" for i in range(60)]
    docs = [(5, " ".join(long)), (3, " ".join([*long, "x"])), (9, " ".join(long)), (9, " ".join(long)), (7, "else"), (8, None), (None, "else"), (8, None), (2, "")]
    kept = J.keep_one(rows_of(spark, docs))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, 7, 8, 8, None, 2], key=repr)
    same = [(4, "a b"), (4, "a b"), (4, "other text")]
    assert sorted(r["text"] for r in J.keep_one(rows_of(spark, same)).collect()) == ["a b", "other text"]


def test_only_the_copy_goes_where_ids_repeat(spark):
    long = [f"t{i}" for i in range(60)]
    near, nearer = " ".join([*long, "x"]), " ".join(["y", *long])
    docs = [(3, " ".join(long)), (7, near), (7, "b c d e f g h"), (7, "b c d e f g h"), (7, None), (9, nearer), (9, near), (None, near), (11, near)]
    kept = J.keep_one(rows_of(spark, docs))
    assert kept.columns == ["doc_id", "text", "n"]
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, " ".join(long)), (7, "b c d e f g h"), (7, None), (None, near)], key=repr)


def test_empty_table(spark):
    assert J.link_documents(rows_of(spark, [])).collect() == []
    assert J.keep_one(rows_of(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(29)] + [(order[i], order[30]) for i in range(31, 40)] + [(100, 100)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[n] for n in order[:30]}) == 1 and len({got[n] for n in order[30:]}) == 1
    assert got[order[0]] != got[order[30]]


def test_sketches_lose_no_link():
    draw = np.random.default_rng(5)
    for percent in (50, 80, 90):
        for size in (1, 2, 9, 40, 300):
            base = draw.integers(1, 1 << 62, size).astype(np.uint64)
            sets = [base]
            for _ in range(30):
                lost = int(draw.integers(0, max(1, size * (100 - percent) // 100) + 1))
                sets.append(np.unique(np.concatenate([draw.permutation(base)[lost:], draw.integers(1, 1 << 62, int(draw.integers(0, 4))).astype(np.uint64)])))
            sets = [s for s in sets if len(s)]
            sets += [draw.integers(1, 1 << 62, size).astype(np.uint64) for _ in range(10)]
            n = np.array([len(s) for s in sets])
            bands = J.band_of(n, percent)
            for band in set(bands.tolist()):
                here = [k for k in range(len(sets)) if bands[k] in (band - 1, band)]
                for parts in (1, 2):
                    links, label = set(), {k: k for k in here}
                    rows = pd.DataFrame({"band": band, "block": [k % parts for k in here], "across": parts > 1, "digest": [b"%4d" % k for k in here], "n": n[here], "sketch": [J.sketch_of(sets[k], percent) for k in here]})
                    if rows["block"].nunique() < parts:
                        continue
                    for found in J.near_sets(rows, percent).itertuples():
                        a, b = int(found.a), int(found.b)
                        label = {k: label[b] if x == label[a] else x for k, x in label.items()}
                    for i in here:
                        for j in here:
                            common = len(np.intersect1d(sets[i], sets[j]))
                            if i < j and max(bands[i], bands[j]) == band and (parts == 1 or (i - j) % 2) and 100 * common >= percent * (n[i] + n[j] - common):
                                links.add((i, j))
                    assert all(label[i] == label[j] for i, j in links)


@pytest.mark.parametrize("sets", [8192, 7])
def test_documents_that_only_share_lines_are_not_read_again(spark, monkeypatch, sets):
    """They come into families, of which each block went to every other in a shuffle of whole sets."""
    monkeypatch.setattr(J, "SKETCH_SETS", sets)
    draw, seen, write = random.Random(9), [], J.cut_lineage
    lines = [" ".join(f"line{i}{c}" for c in "abcde") for i in range(8)]
    part = lambda: " ".join(f"w{draw.randrange(9999)}" for _ in range(4))
    texts = [" ".join(f"{line} {part()}" for line in draw.sample(lines, 8)) for _ in range(120)]
    texts += [f"{texts[0]} more", f"{texts[1]} again"]
    monkeypatch.setattr(J, "cut_lineage", lambda df, *more: seen.append(write(df, *more)) or seen[-1])
    docs = list(enumerate(texts))
    assert result(spark, docs, 5, 80) == brute(docs, 5, 80)
    families = [df.count() for df in seen if "family" in df.columns]
    assert families[0] > 30
    assert families[-1] == 4


def test_keys_dealt_in_turns(spark, monkeypatch):
    docs = rows_of(spark, corpus(7, 20, 10))
    whole = sorted(map(tuple, J.candidate_edges(docs, 3, 80).distinct().collect()))
    parts = [set(map(tuple, J.candidate_edges(docs, 3, 80, turn, 3).collect())) for turn in range(3)]
    assert all(parts) and sorted(set().union(*parts)) == whole
