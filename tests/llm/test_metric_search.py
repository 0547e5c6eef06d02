import math

import numpy as np
import pytest

from lakeqa.llm import metric_search as S

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k, scale=256):
    good = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.array(v + [0] * (width - len(v)))) for i, v in good]
    out = []
    for q in {i for i, _ in good if i % 50 == 0}:
        v = min(v.tolist() for i, v in good if i == q)
        found = sorted(((-int(np.dot(v, w)), i) for i, w in good if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def result(spark, rows, **more):
    vectors = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    found = S.top_k(vectors, vectors.where("vec_id % 50 = 0"), **more)
    return sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_against_brute_force(spark, shard_rows):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 12))
    data = centres[draw.integers(0, 6, 900)] + 0.2 * draw.normal(size=(900, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[100][1]) for i in range(300)] + [(100, rows[100][1])]
    rows += [(2000, None), (2050, []), (2100, [1.0, None]), (2150, [float("nan")] * 12), (None, [1.0] * 12), (2200, [float("inf")] * 12), (2250, [0.5] * 3)]
    assert result(spark, rows, shard_rows=shard_rows) == brute(rows, 5)


def test_few_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0]), (1, [-1.0]), (50, [0.25])]
    assert result(spark, rows) == brute(rows, 5)


def test_tree_prunes_and_stays_exact():
    draw = np.random.default_rng(2)
    data = np.floor(256 * (np.repeat(draw.normal(size=(40, 8)), 100, axis=0) + 0.05 * draw.normal(size=(4000, 8))))
    ids = draw.permutation(4000)
    tree = S.build_tree(data, ids)
    asked = np.arange(0, 4000, 97)
    together = S.Search(data[asked], ids[asked], 5, np.full(len(asked), -np.inf))
    together.run(tree)
    for at, row in enumerate(asked.tolist()):
        alone = S.Search(data[[row]], ids[[row]], 5, np.array([-np.inf]))
        alone.run(tree)
        wanted = sorted(((-s, i) for s, i in zip((data @ data[row]).tolist(), ids.tolist(), strict=True) if i != ids[row]))[:5]
        for scores, found in ((alone.scores[0], alone.ids[0]), (together.scores[at], together.ids[at])):
            assert list(zip((-scores).tolist(), found.tolist())) == wanted
        assert alone.work[0] < 2500
        # A floor leaves out what is below it, and no tie at it.
        floor = -wanted[2][0]
        bounded = S.Search(data[[row]], ids[[row]], 5, np.array([floor]))
        bounded.run(tree)
        at_least = [w for w in wanted if -w[0] >= floor]
        place = bounded.found()[1]
        assert sorted(zip((-bounded.scores[0, place]).tolist(), bounded.ids[0, place].tolist()))[: len(at_least)] == at_least
        assert bounded.work[0] <= alone.work[0]
