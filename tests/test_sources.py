import math
import zlib

import json

import pytest
from pyspark.sql import functions as F

from lakeqa.functions import linearize as L
from lakeqa.plans import embedders
from lakeqa.operators import completions
from lakeqa.sources import store, tables as S


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_read_tables_numbers_lines(spark, tmp_path):
    rows = [{"id": f"t{i}", "title": f"T{i}", "column_header": [["c"]], "row_header": [], "data": [[str(i)]]} for i in range(50)]
    got = S.read_tables(spark, write_lines(tmp_path / "t.jsonl", rows), "aitqa").orderBy("ord").collect()
    assert [(r.ord, r.table_id) for r in got] == [(i, f"t{i}") for i in range(50)]


def test_ordinals_are_dense_over_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7)
    got = S.with_ordinals(df).orderBy("id").collect()
    assert [r.ord for r in got] == list(range(1000))


def test_read_nq_tables_ignores_other_fields(spark, tmp_path):
    row = {
        "tableId": "Oak_1", "documentTitle": "Oak", "columns": [{"text": "Year"}],
        "rows": [{"cells": [{"text": "1990", "x": 1}]}], "alternativeTableIds": ["q"], "documentUrl": "u",
    }
    tables = S.read_tables(spark, write_lines(tmp_path / "t.jsonl", [row]), "nqtables")
    text = L.linearize(tables, "json").first().table_content
    assert text == '{"id":"Oak_1","title":"Oak","columns":[{"text":"Year"}],"rows":[{"cells":[{"text":"1990"}]}]}'


def test_read_questions_wraps_single_answers(spark, tmp_path):
    rows = [
        {"id": "q1", "question": "How?", "table_id": "t1", "answers": ["1,200", "x"]},
        {"id": "q2", "question": "Why?", "table_id": "t2", "answers": "because"},
    ]
    got = S.read_questions(spark, write_lines(tmp_path / "q.jsonl", rows), "aitqa").orderBy("query_ord").collect()
    assert [r.ground_truth for r in got] == [["1,200", "x"], ["because"]]
    nested = {
        "table": {"tableId": "Oak_1"},
        "questions": [
            {"id": "n7", "originalText": "how tall", "answer": {"answerTexts": ["3 m"]}},
            {"id": "n8", "originalText": "never read", "answer": {"answerTexts": ["no"]}},
        ],
    }
    got = S.read_questions(spark, write_lines(tmp_path / "n.jsonl", [nested]), "nqtables").collect()
    assert [(r.query_id, r.query_text, r.table_id, r.ground_truth) for r in got] == [("n7", "how tall", "Oak_1", ["3 m"])]


def test_unknown_dataset(spark):
    with pytest.raises(ValueError):
        S.read_tables(spark, "nowhere", "other")


def test_last_of_each_id(spark):
    df = spark.createDataFrame([(0, "a", "old"), (1, "b", "b"), (2, "a", "new")], "ord long, table_id string, text string")
    got = {r.table_id: (r.text, r.num_copies) for r in S.last_of_each_id(df).collect()}
    assert got == {"a": ("new", 2), "b": ("b", 1)}


def test_sample_is_repeatable_and_clamped(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("query_id"))
    first = [r.query_id for r in S.sample_questions(df, 5, 1).collect()]
    assert first == [r.query_id for r in S.sample_questions(df.repartition(3), 5, 1).collect()]
    assert first != [r.query_id for r in S.sample_questions(df, 5, 2).collect()]
    assert S.sample_questions(df, 100, 1).count() == 20


def test_embed_into_store_embeds_only_new_texts(spark, tmp_path):
    path = str(tmp_path / "vectors")
    store.create_vector_store(spark, path)

    def embed(texts):
        return texts.withColumn("vector", F.array(F.length("text").cast("float")))

    def frame(*values):
        return spark.createDataFrame([(v,) for v in values], "text string")

    assert store.embed_into_store(frame("a", "bb", "a", None), path, embed, "lengths").count() == 2
    seen = []

    def watching(texts):
        seen.extend(r.text for r in texts.collect())
        return embed(texts)

    found = store.embed_into_store(frame("bb", "ccc"), path, watching, "lengths")
    assert {r.text: r.vector for r in found.collect()} == {"bb": [2.0], "ccc": [3.0]}
    assert seen == ["ccc"]
    # Another model's vectors are its own.
    other = store.embed_into_store(frame("bb"), path, lambda t: t.withColumn("vector", F.array(F.lit(7.0).cast("float"))), "seven")
    assert [tuple(r) for r in other.collect()] == [("bb", [7.0])]
    assert {r.text: r.vector for r in store.embed_into_store(frame("bb"), path, watching, "lengths").collect()} == {"bb": [2.0]}
    assert seen == ["ccc"]


def test_fitted_embedder_is_stored_and_loaded(spark, tmp_path):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a b b", "a c", "", "A d"])], "id long, text string")
    model = embedders.HashedIdf(num_features=64, stop_words=["d"]).fit(texts)
    model.save(str(tmp_path / "model"))
    loaded = embedders.HashedIdfModel.load(str(tmp_path / "model"))
    assert loaded.model_id == model.model_id != embedders.HashedIdf(num_features=64).fit(texts).model_id
    first = {r.id: r.vector for r in model.transform(texts).collect()}
    # Order and company of the texts make no difference.
    assert {r.id: r.vector for r in loaded(texts.where("id <> 1").repartition(2)).collect()} == {i: v for i, v in first.items() if i != 1}
    place = lambda w: zlib.crc32(w.encode()) % 64
    a, b = math.log(5 / 4), 2 * math.log(5 / 2)
    length = math.hypot(a, b)
    assert first[0][place("a")] == pytest.approx(a / length) and first[0][place("b")] == pytest.approx(b / length)
    assert set(first[2]) == {0.0} and first[3][place("a")] == pytest.approx(1.0)


def test_split_and_report_files(spark, tmp_path):
    split = spark.createDataFrame([("test", "easy", "q1"), ("test", "hard", "q2")], "partition string, difficulty string, id string")
    store.write_split(split, str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split/partition=test/difficulty=hard")).collect()[0].id == "q2"
    store.write_report(split, str(tmp_path / "report"))
    files = list((tmp_path / "report").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "partition,difficulty,id"


def test_response_store(spark, tmp_path):
    path = str(tmp_path / "responses")
    store.create_response_store(spark, path)
    requests = completions.with_digests(
        spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a"), ("4", "bad")], "id string, text string").select(
            "id", F.struct(F.lit("m").alias("model"), F.col("text").alias("messages")).alias("request")
        )
    )
    calls = spark.sparkContext.accumulator(0)

    def reply(batch):
        calls.add(len(batch))
        return [
            {"error": "no"} if r["messages"] == "bad"
            else {"model": "m", "choices": [{"message": {"role": "assistant", "content": r["messages"] * 2}}]}
            for r in batch
        ]

    def contents(resolved):
        return {r.id: r.response.choices[0].message.content if r.response else None for r in resolved.collect()}

    unresolved = store.complete_into_store(requests, path)
    assert contents(unresolved) == {"1": None, "2": None, "3": None, "4": None}
    first = contents(store.complete_into_store(requests, path, reply, num_tasks=2))
    assert first == {"1": "aa", "2": "bb", "3": "aa", "4": None}
    assert calls.value == 3
    assert contents(store.complete_into_store(requests, path, reply)) == first
    assert calls.value == 4  # only the failed request is tried again
    assert completions.misses(requests, store.read_responses(spark, path)).count() == 1
    store.append_responses(store.read_responses(spark, path), path)
    assert completions.known_responses(store.read_responses(spark, path)).count() == 2


def test_wrong_number_of_replies_is_an_error(spark):
    requests = completions.with_digests(
        spark.createDataFrame([("a",)], "text string").select(F.struct(F.col("text").alias("model")).alias("request"))
    )
    with pytest.raises(Exception, match="one response per request"):
        completions.complete(requests, lambda batch: []).collect()
