import pytest
from pyspark.sql import functions as F

from lakeqa import schemas
from lakeqa.operators import report
from lakeqa.sources import store

NAME = (
    "exp={exp} retriever=lib.retrieval.{retriever} reranker=lib.reranking.NoReranker zoom=lib.zoom.{zoom} "
    "generator=lib.generation.LLMGenerator model={model} num_context={num_context} "
    "linearization=Linearization.CSV template=Template.QTTT"
)
SIZES = [(10, 1), (3, 5)]


def record(exp, retriever="BM25Retriever", zoom="NoZoom", model="gpt-4o-mini-2024-07-18", num_context=3, em=0.5, cost=0.0016):
    name = NAME.format(exp=exp, retriever=retriever, zoom=zoom, model=model, num_context=num_context)
    accuracy = {f"Accuracy@{k}": v for k, v in zip((1, 3, 5, 10, 100), (0.4, 0.71, 0.8, 0.9, 1.0))}
    return (name, 0, 10, accuracy, (em, 0.6, 0.55), cost, (name, exp, (SIZES if zoom == "RowBasedZoom" else None,)))


def records(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RUN_RECORD)


def test_components(spark):
    runs = records(spark, record("tqa")).select("run_id", "config.config_name")
    got = {r.component: r.value for r in report.components(runs).collect()}
    assert got == {
        "exp": "tqa", "retriever": "BM25Retriever", "reranker": "NoReranker", "zoom": "NoZoom",
        "generator": "LLMGenerator", "model": "gpt-4o-mini-2024-07-18", "num_context": "3",
        "linearization": "Linearization.CSV", "template": "Template.QTTT",
    }
    assert report.component_names(runs).count() == 9


def test_flat_report(spark):
    rows = report.flat_report(records(spark, record("retrieval", "SBERTRetriever"), record("retrieval"), record("tqa")), "retrieval")
    assert rows.columns == ["retriever", "reranker", "zoom", "linearization", "template", "Accuracy@1", "Accuracy@3", "Accuracy@10", "Accuracy@100", "llm_cost (ct)"]
    assert [tuple(r) for r in rows.collect()] == [
        ("BM25Retriever", "NoReranker", "NoZoom", "Linearization.CSV", "Template.QTTT", 0.4, 0.71, 0.9, 1.0, 0.16),
        ("SBERTRetriever", "NoReranker", "NoZoom", "Linearization.CSV", "Template.QTTT", 0.4, 0.71, 0.9, 1.0, 0.16),
    ]


def test_zoom_report_names_stages(spark):
    rows = report.flat_report(records(spark, record("zoom", zoom="RowBasedZoom"), record("zoom")), "zoom").collect()
    assert [r.next_focus_sizes for r in rows] == ["", "-1rows-> 10 -5rows-> 3"]


def test_pivot_report(spark):
    runs = records(
        spark, record("tqa", num_context=100, em=0.68), record("tqa", em=0.59),
        record("tqa", model="gpt-4o-2024-11-20", em=0.64, cost=0.0031),
    )
    rows = [tuple(r) for r in report.pivot_report(runs, "tqa").collect()]
    assert rows == [
        ("BM25Retriever", "NoReranker", "NoZoom", 3, 0.59, 0.64, 0.16, 0.31),
        ("BM25Retriever", "NoReranker", "NoZoom", 100, 0.68, None, 0.16, None),
    ]


def test_two_runs_in_one_cell_are_an_error(spark):
    with pytest.raises(Exception, match="several runs for one cell"):
        report.pivot_report(records(spark, record("tqa"), record("tqa")), "tqa").collect()


def test_runs_round_trip(spark, tmp_path):
    runs = records(spark, record("tqa", zoom="RowBasedZoom"), record("linear"))
    store.write_runs(runs, str(tmp_path / "runs"))
    back = store.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(map(repr, back.drop("path").collect())) == sorted(map(repr, runs.collect()))
    assert back.where(F.col("path").endswith(".json")).count() == 2
    assert report.pivot_report(back, "linear").first()["exact_match|gpt-4o-mini-2024-07-18"] == 0.5


def test_counters(spark):
    answers = spark.createDataFrame([("r", True), ("r", False), ("s", False)], "run_id string, was_cut boolean")
    got = {r.run_id: (r.cutoff_context_ctr, r.processed_queries_ctr) for r in report.run_counters(answers).collect()}
    assert got == {"r": (1, 2), "s": (0, 1)}
    sizes = spark.createDataFrame([("r", 3), ("r", 2)], "run_id string, num_selected long")
    assert report.off_size_selections(sizes, 3).first().off_size_ctr == 1


def test_run_relations_and_split(spark, tmp_path):
    from lakeqa.plans import experiment

    path = str(tmp_path / "relations")
    hits = spark.createDataFrame([("r1", "q1", "t1", 1, 1.0)], "run_id string, query_id string, table_id string, rank long, score double")
    qrels = spark.createDataFrame([("r1", "q1", "t1", 1)], "run_id string, query_id string, table_id string, rel int")
    answers = spark.createDataFrame(
        [("r1", 0, "q1", "It is 3 m.", ["3 m"]), ("r1", 1, "q2", "no idea", ["x"]), ("r2", 0, "q1", "wrong run", ["3 m"])],
        "run_id string, query_ord long, query_id string, prediction string, ground_truth array<string>",
    )
    store.write_run_relations(hits, qrels, answers, path)
    assert store.read_run_relation(spark, path, "run").collect() == hits.collect()
    assert store.read_run_relation(spark, path, "qrels").collect() == qrels.collect()
    runs = records(spark, record("tqa", "NoRetriever"), record("tqa", "BM25Retriever")).withColumn(
        "run_id", F.when(F.col("config.config_name").contains("NoRetriever"), "r1").otherwise("r2")
    )
    questions = spark.createDataFrame(
        [(0, "q1", ["3 m"], "how tall"), (1, "q2", ["x"], "what")], "ord long, id string, answers array<string>, text string"
    )
    split = experiment.split_questions(
        runs, store.read_run_relation(spark, path, "predictions"), store.read_run_relation(spark, path, "references"),
        questions, "test", "gpt-4o-mini-2024-07-18",
    )
    assert {r.text: r.difficulty for r in split.collect()} == {"how tall": "easy", "what": "hard"}


def test_run_files_of_any_shape_are_reported_with_all_their_names(spark, tmp_path):
    import json

    files = [
        {"run_id": "a", "retrieval_results": {"Accuracy@1": 0.123456, "Recall@7": 0.5}, "qa_results": {"exact_match": 1, "bleu": 0.25},
         "total_llm_cost": 2, "cutoff_context_ctr": 3, "config": {"config_name": "exp=x retriever=lib.a.B flavour=sweet", "zoom": {"next_focus_sizes": [{"num_tables": 3, "num_rows": 5}]}}},
        {"run_id": "b", "config": {"config_name": "exp=y depth=2", "zoom": "none"}, "surprise": [1, {"deep": None}]},
        {"qa_results": {"exact_match": None}, "config": {}},
    ]
    (tmp_path / "runs").mkdir()
    for i, document in enumerate(files):
        (tmp_path / "runs" / f"{i}.json").write_text(json.dumps(document))
    records = report.records_of(store.read_run_documents(spark, str(tmp_path / "runs")))
    assert report.metric_names(records) == ["Accuracy@1", "Recall@7", "bleu", "exact_match"]
    full = report.full_report(records)
    rows = {r["run_id"][-6:]: r for r in full.collect()}
    first, second, third = rows["a"], rows["b"], rows["2.json"]
    assert (first["retriever"], first["flavour"], first["exp"], first["depth"]) == ("B", "sweet", "x", None)
    assert (first["Accuracy@1"], first["Recall@7"], first["bleu"], first["exact_match"]) == (0.12346, 0.5, 0.25, 1.0)
    assert first["next_focus_sizes"] == "-5rows-> 3" and second["next_focus_sizes"] == ""
    assert second["depth"] == "2" and second["bleu"] is None and third["exact_match"] is None
    assert records.where("run_id = 'a'").first().cutoff_context_ctr == 3
    store.write_report(full, str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(str(tmp_path / "report"))
    assert back.columns == full.columns and back.count() == 3


def test_split_replaces_only_its_own_folders(spark, tmp_path):
    fields = "partition string, difficulty string, id string"
    path = str(tmp_path / "split")
    store.write_split(spark.createDataFrame([("dev", "easy", "1"), ("dev", "hard", "2"), ("test", "easy", "3")], fields), path)
    store.write_split(spark.createDataFrame([("dev", "easy", "9")], fields), path)
    got = sorted(tuple(r) for r in store.read_split(spark, path, "id string").select("partition", "difficulty", "id").collect())
    assert got == [("dev", "easy", "9"), ("dev", "hard", "2"), ("test", "easy", "3")]
