import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeqa.operators import evaluate


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, table_id string, rank long")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "query_id string, table_id string, rel int")


def test_top_k_accuracy(spark):
    found = hits(spark, [("a", "x", 1), ("a", "y", 2), ("b", "y", 3), ("b", "x", 1), ("c", "z", 1)])
    gold = pairs(spark, [("a", "x", 1), ("a", "q", 1), ("b", "y", 1), ("c", "q", 1), ("c", "z", 0)])
    got = evaluate.top_k_accuracy(found, gold).first()
    assert got.num_questions == 3
    assert (got.accuracy_at_1, got.accuracy_at_3, got.accuracy_at_100) == (0.33333, 0.66667, 0.66667)


def test_many_runs_in_one_pass(spark):
    found = hits(spark, [("a", "x", 1)]).withColumn("run_id", F.lit("r1")).unionByName(
        hits(spark, [("a", "x", 4)]).withColumn("run_id", F.lit("r2"))
    )
    gold = pairs(spark, [("a", "x", 1)]).withColumn("run_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))))
    got = {r.run_id: (r.accuracy_at_1, r.accuracy_at_5) for r in evaluate.top_k_accuracy(found, gold, run_keys=["run_id"]).collect()}
    assert got == {"r1": (1.0, 1.0), "r2": (0.0, 1.0)}


CASES = [
    # prediction, truths, exact, f1, relaxed
    ("The Oak!", ["oak"], 1, 1.0, 1),
    ("red oak tree", ["oak", "red oak"], 0, 0.8, 1),
    ("oak oak", ["oak"], 0, 2 / 3, 1),
    ("a", ["the"], 1, 0.0, 0),  # both empty after normalization: equal, but no shared token
    ("1200", ["1,200"], 1, 1.0, 0),  # relaxed keeps commas
    ("", ["x"], 0, 0.0, 0),
    ("anything", [""], 0, 0.0, 1),  # an empty ground truth matches everything
    ("pine", ["oak", "pine"], 1, 1.0, 0),  # relaxed looks at the first truth only
    ("c++ (x)", ["C x"], 1, 1.0, 1),
]


def test_answer_scores(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t, *_) in enumerate(CASES)], "i long, prediction string, ground_truth array<string>")
    rows = evaluate.answer_scores(df).orderBy("i").collect()
    for row, (_, _, exact, f1, relaxed) in zip(rows, CASES):
        assert (row.exact_match, row.relaxed_match) == (exact, relaxed), row
        assert row.f1_score == pytest.approx(f1), row
    means = evaluate.mean_answer_scores(evaluate.answer_scores(df)).first()
    assert means.exact_match == pytest.approx(sum(c[2] for c in CASES) / len(CASES))


def test_split_by_difficulty(spark):
    answers = spark.createDataFrame(
        [
            (0, "test", "n1", 'It is "3 M" and Oak', ["'3 m'", "oak"]),  # repaired to "3 m" in double quotes
            (1, "test", "n1", "3 m", ["oak"]),
            (2, "test", "n2", "x", ["y"]),
            (3, "test", "gone", "x", ["x"]),
        ],
        "ord long, partition string, id string, prediction string, answers array<string>",
    )
    questions = spark.createDataFrame(
        [
            (0, "test", "n1", ['"3 m"', "oak"], "first"), (1, "test", "n1", ['"3 m"', "oak"], "second"),
            (2, "test", "n1", ["oak"], "third"), (3, "dev", "n2", ["y"], "other part"), (4, "test", "n2", ["y"], "fourth"),
        ],
        "ord long, partition string, id string, answers array<string>, text string",
    )
    got = {r.text: r.difficulty for r in evaluate.split_by_difficulty(answers, questions).collect()}
    assert got == {"first": "easy", "third": "hard", "fourth": "hard"}


def test_hot_keys_are_cut_without_losing_rows(spark):
    from lakeqa import scale

    rows = spark.range(3000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    unique = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        got = scale.join_to_unique(rows, unique, ["k"], "id", how)
        assert sorted(map(tuple, got.select("k", "id", "v").collect()), key=repr) == sorted(
            map(tuple, rows.join(unique, "k", how).select("k", "id", "v").collect()), key=repr
        )


def test_token_f1_of_short_and_long_sides(spark):
    rng = random.Random(6)
    side = lambda n: " ".join(rng.choices("b c d e f g h".split(), k=n))
    rows = [(i, side(rng.choice([0, 1, 3, 9, 40])), [side(rng.choice([0, 1, 8, 9, 40])) for _ in range(2)]) for i in range(80)]
    rows += [(80, "b c", ["c b", "b c"]), (81, "", ["", "b"]), (82, "b", []), (83, None, [None, "b b"]), (84, "b", None)]

    def f1(p, t):
        p, t = Counter((p or "").split()), Counter((t or "").split())
        shared = (p & t).total()
        return 2.0 * shared / (p.total() + t.total()) if shared else 0.0

    scored = evaluate.answer_scores(spark.createDataFrame(rows, "ord long, prediction string, ground_truth array<string>"))
    got = {r.ord: r.f1_score for r in scored.collect()}
    assert got == {i: max((f1(p, x) for x in t), default=None) if t is not None else None for i, p, t in rows}
