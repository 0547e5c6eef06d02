"""Completion as a resumable stream, and look-ups in a bucketed store."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeqa.operators import completions
from lakeqa.sources import store


def requests_of(spark, texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return completions.with_digests(rows.select("id", F.struct(F.lit("m").alias("model"), F.col("text").alias("messages")).alias("request")))


def contents(resolved):
    return {r.id: r.response.choices[0].message.content if r.response else None for r in resolved.collect()}


def reply_to(request):
    return {"model": "m", "choices": [{"message": {"role": "assistant", "content": request["messages"] * 2}}]}


@pytest.mark.parametrize("batch_files", [1, 100])
def test_a_run_that_fails_half_way_calls_nothing_twice(spark, tmp_path, batch_files):
    path, asked = str(tmp_path / "responses"), tmp_path / "asked"
    asked.mkdir()
    store.create_response_store(spark, path, 4)
    texts = [f"text {i:02}" for i in range(20)] + ["text 00"] * 5

    def fails_late(batch):
        # One file for each call that was paid for.
        out = []
        for request in batch:
            if request["messages"] >= "text 13":
                raise TimeoutError("no answer")
            (asked / f"{request['messages']}-{len(list(asked.iterdir()))}").touch()
            out.append(reply_to(request))
        return out

    def works(batch):
        for request in batch:
            assert not list(asked.glob(f"{request['messages']}-*")), "asked twice"
        return [reply_to(r) for r in batch]

    options = {"file_requests": 3, "batch_files": batch_files, "call_size": 1}
    with pytest.raises(store.CompletionError, match="TimeoutError: no answer"):
        store.complete_into_store(requests_of(spark, texts), path, fails_late, 2, **options)
    assert store.read_responses(spark, path).count() == len(list(asked.iterdir())) > 0
    resolved = store.complete_into_store(requests_of(spark, texts), path, works, 2, **options)
    assert contents(resolved) == {str(i): t * 2 for i, t in enumerate(texts)}
    assert store.read_responses(spark, path).count() == 20


def test_stored_responses_are_not_moved(spark, tmp_path):
    path = str(tmp_path / "responses")
    store.create_response_store(spark, path, 4)
    requests = requests_of(spark, ["a", "b", "a", "c"])
    replies = completions.complete(requests.where("id < 3"), lambda batch: [reply_to(r) for r in batch])
    for _ in range(2):
        store.append_responses(replies, path)
    stored = store.read_responses(spark, path)
    assert stored.count() == 6
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = completions.look_up(requests, stored)
        plan = found.select("id", "response")._jdf.queryExecution().executedPlan().toString()
        # The one exchange is that of the requests, and what it moves has no prompt.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        moved = plan[plan.index("Exchange hashpartitioning") :].splitlines()[1]
        assert "request_hash" in moved and not re.search(r"(\[|, )request#", moved)
        assert contents(found) == {"0": "aa", "1": "bb", "2": "aa", "3": None}
        missing = completions.misses(requests, stored).collect()
        assert [r.request.messages for r in missing] == ["c"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)


def test_the_same_of_differing_responses_counts_each_time(spark, tmp_path):
    requests = requests_of(spark, ["a"])
    replies = [completions.complete(requests, lambda batch, n=n: [{"model": "m", "error": n}]) for n in ("x", "y", "z")]
    stored = replies[0].unionByName(replies[1]).unionByName(replies[2]).drop("failure")
    seen = {completions.look_up(requests, stored.repartition(n)).first().response.error for n in (1, 2, 3)}
    assert len(seen) == 1


def test_texts_are_embedded_in_small_batches(spark, tmp_path):
    def embed(texts):
        def run(batches):
            for batch in batches:
                rows = pa.array([[float(batch.num_rows)]] * batch.num_rows, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["text", "vector"])

        return texts.mapInArrow(run, "text string, vector array<float>")

    path = str(tmp_path / "vectors")
    store.create_vector_store(spark, path)
    wide = spark.range(0, 48, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1 << 20)).alias("text"))
    found = store.embed_into_store(wide, path, embed, "sizes").collect()
    assert len(found) == 48 and max(r["vector"][0] for r in found) <= 6
