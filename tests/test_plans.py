import json
import re

import pytest
from pyspark.sql import functions as F

from lakeqa.operators import evaluate, report
from lakeqa.plans import embedders, experiment, stages
from lakeqa.plans.meter import RunMeter
from lakeqa.sources import store

MODEL = "gpt-4o-mini-2024-07-18"
TREES = ["oak", "elm", "ash", "fir", "yew", "beech", "birch", "cedar", "larch", "maple", "rowan", "alder"]


def lake(spark):
    rows = [
        (i, "nqtables", f"t{i}", f"{t} tree", [["kind"], ["height"]], [], [[t, str(10 + i)], ["common word", "x"]])
        for i, t in enumerate(TREES)
    ]
    return spark.createDataFrame(
        rows,
        "ord long, dataset string, table_id string, table_name string, column_header array<array<string>>, "
        "row_header array<array<string>>, data array<array<string>>",
    )


def questions(spark):
    rows = [(i, f"q{i}", f"How tall is the {t}?", f"t{i}", [str(10 + i)]) for i, t in enumerate(TREES)]
    return spark.createDataFrame(
        rows, "query_ord long, query_id string, query_text string, table_id string, ground_truth array<string>"
    )


def model(calls):
    """Picks the tables whose text names the tree asked for, and reads the height from the first table."""

    def reply(batch):
        calls.add(len(batch))
        out = []
        for r in batch:
            system, user = (m["content"] for m in r["messages"])
            tree = re.search(r"How tall is the (\w+)\?", user)
            if "data specialist" in system:
                blocks = re.findall(r"table_id: (\w+)\n\n(.*?)(?=\ntable_id|\Z)", user, re.S)
                content = json.dumps([i for i, text in blocks if f"\n{tree.group(1)}," in text])
            elif "generates questions" in system:
                table, name = re.search(r'here: "(\w+)".*,(\w+) tree', user, re.S).groups()
                content = json.dumps({table: [f"How tall is the {name}?", "What else?"]})
            else:
                height = re.search(rf"{tree.group(1)},(\d+)", user)
                content = json.dumps({"answer": height.group(1) if height else "unknown"})
            out.append({"model": r["model"], "choices": [{"message": {"role": "assistant", "content": content}}]})
        return out

    return reply


@pytest.fixture()
def exchange(spark, tmp_path):
    path = str(tmp_path / "responses")
    store.create_response_store(spark, path)
    calls = spark.sparkContext.accumulator(0)
    made = stages.store_exchange(path, model(calls))
    made.calls = calls
    return made


def run(spark, retriever, exchange, **options):
    _, accuracies, scored = experiment.run_experiment(
        questions(spark), lake(spark), retriever, stages.completion_generator(exchange), MODEL, "nqtables", **options
    )
    return accuracies.first(), evaluate.mean_answer_scores(scored).first()


def test_closed_book_knows_nothing(spark, exchange):
    accuracy, answers = run(spark, stages.no_retriever(), exchange)
    assert accuracy.accuracy_at_100 == 0.0 and answers.exact_match == 0.0 and answers.num_questions == len(TREES)


def test_oracle_answers_everything(spark, exchange):
    accuracy, answers = run(spark, stages.oracle_retriever(), exchange, template="QTQTQT")
    assert accuracy.accuracy_at_1 == 1.0 and answers.exact_match == 1.0 and answers.f1_score == 1.0


def test_bm25_with_zoom(spark, exchange):
    zoom = stages.row_zoom(
        lake(spark), exchange, MODEL, num_zoom=12, stages=[{"num_tables": 5, "num_rows": 2}, {"num_tables": 2, "num_rows": 1}]
    )
    accuracy, answers = run(spark, stages.bm25_retriever(), exchange, zoom=zoom, num_context=1)
    assert accuracy.accuracy_at_1 == 1.0 and answers.exact_match == 1.0
    first = exchange.calls.value
    assert first == 3 * len(TREES)
    run(spark, stages.bm25_retriever(), exchange, zoom=zoom, num_context=1)
    assert exchange.calls.value == first  # the second run is answered from the store


def bag_of_letters(texts):
    return texts.withColumn("vector", F.array(*[F.regexp_count("text", F.lit(c)).cast("float") for c in "abcdefghijklmnoprstuvwxy"]))


def test_reranker_moves_the_table_whose_question_was_asked(spark, exchange):
    flat = lambda q, t: q.join(
        t.select(F.col("table_id").alias("hit"), (F.lit(12) - F.col("ord")).alias("rank")), F.lit(True)
    ).select("query_id", F.col("hit").alias("table_id"), "rank", F.lit(1.0).alias("score"))
    flat.mode = "open-book"
    reranker = stages.question_reranker(lake(spark), exchange, bag_of_letters, MODEL, "nqtables", num_rerank=12)
    accuracy, _ = run(spark, flat, exchange, reranker=reranker)
    assert accuracy.accuracy_at_1 == 1.0
    assert exchange.calls.value == 2 * len(TREES)  # one per table, one per answer


def test_dense_retriever(spark, exchange):
    accuracy, answers = run(spark, stages.dense_retriever(embedders.HashedIdf(num_features=512)), exchange, num_context=12)
    assert accuracy.accuracy_at_3 == 1.0 and answers.exact_match == 1.0


def test_stages_must_shrink():
    with pytest.raises(ValueError):
        stages.check_stages(100, [{"num_tables": 10, "num_rows": 1}, {"num_tables": 10, "num_rows": 5}])


def test_no_generator(spark):
    answers = experiment.answered_questions(
        questions(spark), lake(spark), None, "closed-book", stages.no_generator(), MODEL, "aitqa"
    )
    assert {r.prediction for r in answers.collect()} == {""}


def test_replies_naming_another_candidate_count_for_it(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "a", 1)], "query_id string, table_id string, rank long")
    replies = spark.sql(
        """SELECT t AS table_id, named_struct('model', 'm', 'choices',
             array(named_struct('message', named_struct('role', 'assistant', 'content', c)))) AS response
           FROM VALUES ('a', '{"b": ["x"]}'), ('b', '{"b": []}') AS v(t, c)"""
    )
    got = stages.parse_generated(hits, replies, 10).collect()
    assert [(r.query_id, r.table_id, r.questions) for r in got] == [("q", "b", ["x"])]


def test_whole_run_counts_what_it_does(spark, tmp_path):
    """Counters, tokens, cost and scores of a run's record, and no cost for replies that failed."""
    path = str(tmp_path / "responses")
    store.create_response_store(spark, path, 4)

    def reply(batch):
        out = []
        for r in model(_NoCount())(batch):
            out.append({**r, "usage": {"prompt_tokens": 100, "completion_tokens": 10, "total_tokens": 110}})
        return out

    meter = RunMeter()
    exchange = meter.exchange(stages.store_exchange(path, reply))
    steps = [{"num_tables": 5, "num_rows": 2}, {"num_tables": 2, "num_rows": 1}]
    zoom = stages.row_zoom(lake(spark), exchange, MODEL, num_zoom=12, stages=steps, meter=meter)
    made = experiment.whole_run(
        questions(spark), lake(spark), stages.bm25_retriever(), stages.completion_generator(exchange), MODEL, "nqtables",
        meter, "r", "exp=x", "x", zoom=zoom, zoom_stages=steps, num_context=1,
    )
    store.write_runs(made.record, str(tmp_path / "runs"))
    got = report.records_of(store.read_run_documents(spark, str(tmp_path / "runs"))).first()
    asked = 3 * len(TREES)
    assert (got.processed_queries_ctr, got.cutoff_context_ctr, got.failed_replies_ctr) == (len(TREES), 0, 0)
    assert (got.prompt_tokens, got.completion_tokens) == (100 * asked, 10 * asked)
    assert got.total_llm_cost == pytest.approx(asked * (100 * 0.15 + 10 * 0.60) / 1e6 / len(TREES))
    assert got.retrieval_results["Accuracy@1"] == 1.0 and got.qa_results["exact_match"] == 1.0
    assert got.off_size_ctr == 2 * len(TREES)  # the model names one table each time
    assert [(s.num_tables, s.num_rows) for s in got.config.zoom.next_focus_sizes] == [(5, 2), (2, 1)]
    assert made.scored.count() == len(TREES)


class _NoCount:
    def add(self, n):
        pass


def test_empty_run_has_a_record(spark, tmp_path):
    path = str(tmp_path / "responses")
    store.create_response_store(spark, path, 4)
    meter = RunMeter()
    exchange = meter.exchange(stages.store_exchange(path, lambda batch: [{} for _ in batch]))
    made = experiment.whole_run(
        questions(spark).where("false"), lake(spark), stages.bm25_retriever(), stages.completion_generator(exchange),
        MODEL, "nqtables", meter, "r", "exp=x", "x",
    )
    assert made.record.first().processed_queries_ctr == 0
