import random

import numpy as np

from lakeqa.llm import language as L

PARTS = {"aa": "the on er re th at".split(), "bb": "sch ein ver und äu ßt".split(), "cc": "ñez ción lla os que ta".split()}


def text_of(draw, lang, n):
    return " ".join("".join(draw.choices(PARTS[lang], k=draw.randint(1, 4))) for _ in range(n))


def corpus(seed, n):
    draw = random.Random(seed)
    return [(text_of(draw, lang, draw.randint(2, 30)), lang) for lang in PARTS for _ in range(n)]


def test_held_out_accuracy(spark):
    train = [*corpus(1, 80), (None, "aa"), ("text without label", None)]
    model = L.learn(spark.createDataFrame([(t, g, 1.0) for t, g in train], "text string, lang string, score double"))
    assert model.languages == ["aa", "bb", "cc"]
    held = corpus(2, 40)
    rows = spark.createDataFrame([(t, g, "clash") for t, g in held], "text string, lang string, lang_pred string")
    got = L.predict(rows, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_without_letters_and_long_ones(spark):
    model = L.learn(spark.createDataFrame(corpus(1, 30), "text string, lang string"))
    texts = [None, "", "  ", "123 !?", "the " * 50_000, "Ünd"]
    got = [tuple(r)[1:] for r in L.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    assert got[:4] == [("und", 0.0)] * 4
    assert got[4][0] == "aa" and got[5][0] == "bb"


def test_hot_copies_do_not_fill_the_sample(spark):
    rows = corpus(1, 30) + [("the same text again", "aa")] * 2000
    model = L.learn(spark.createDataFrame(rows, "text string, lang string"), sample_docs=60)
    assert [model.predict(t)[0] for t, _ in corpus(5, 5)].count("bb") >= 4


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert L.learn(none).predict("words") == ("und", 0.0)
    assert L.predict(none, L.learn(none)).collect() == []
    alone = L.learn(spark.createDataFrame([("only one language", "xx")], "text string, lang string"))
    assert alone.predict("words")[0] == "xx"


def test_temperature_lowers_held_out_loss():
    draw = np.random.default_rng(0)
    logits, labels = draw.normal(size=(200, 3)) * 8, draw.integers(0, 3, 200)
    assert L._loss(logits / 10, labels) < L._loss(logits, labels)
