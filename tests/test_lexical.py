import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeqa import scale
from lakeqa.functions import text as text_functions
from lakeqa.functions.text import ENGLISH_STOP_WORDS
from lakeqa.operators import lexical

K = 5


def split(text):
    return [w for w in re.findall(r"\w+", text) if w not in ENGLISH_STOP_WORDS]


def brute_force(texts, question):
    """Scores of every text, one after the other."""
    docs = [split(t) for t in texts]
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.01 * mean if v < 0 else v for w, v in idf.items()}
    average = sum(map(len, docs)) / len(docs)
    scores = []
    for d in docs:
        tf = Counter(d)
        scores.append(
            sum(idf.get(w, 0) * tf[w] * 1.9 / (tf[w] + 0.9 * (0.6 + 0.4 * len(d) / average)) for w in split(question))
        )
    return scores


def best(scores, k):
    order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 9), i))[:k]
    return [(f"t{i}", pytest.approx(scores[i], abs=1e-9)) for i in order]


def lake(spark, texts, names=None):
    names = names or ["n"] * len(texts)
    return spark.createDataFrame(
        [(i, f"t{i}", n, t) for i, (t, n) in enumerate(zip(texts, names))],
        "ord long, table_id string, table_name string, table_content string",
    ).repartition(3)


def asked(spark, questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, query_text string")


def ranked(hits):
    found = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.table_id, round(r.score, 10)))
    return found


def random_lake(seed=1, n=50):
    rng = random.Random(seed)
    letters = [chr(c) for c in range(97, 117)]
    weights = [1 / (i + 1) for i in range(20)]
    texts = [" ".join("w" + w for w in rng.choices(letters, weights, k=rng.randint(0, 30))) for _ in range(n)]
    questions = [" ".join("w" + w for w in rng.choices(letters, k=4)) for _ in range(8)] + ["zzz unknown", "", "wa wa wa"]
    return texts, questions


FIELD = {"content": "table_content"}


def test_scores_equal_brute_force(spark):
    texts, questions = random_lake()
    got = ranked(lexical.bm25_hits(asked(spark, questions), lexical.build_index(lake(spark, texts), FIELD), K))
    for i, q in enumerate(questions):
        assert got[f"q{i}"] == best(brute_force(texts, q), K)


def test_all_tables_are_ranked_when_k_is_large(spark):
    texts, questions = random_lake(2, 20)
    got = ranked(lexical.bm25_hits(asked(spark, questions), lexical.build_index(lake(spark, texts), FIELD), 100))
    for i, q in enumerate(questions):
        assert got[f"q{i}"] == best(brute_force(texts, q), 20)


def test_negative_scores_rank_below_unmatched_tables(spark):
    # Two words in most tables: both weigh less than zero, and so does their mean.
    texts = ["common usual"] * 6 + ["", "nothing"[:0], "common"]
    index = lexical.build_index(lake(spark, texts), FIELD)
    assert index.below_zero
    for k in (2, 5, 9):
        got = ranked(lexical.bm25_hits(asked(spark, ["common usual"]), index, k))
        assert got["q0"] == best(brute_force(texts, "common usual"), k)


def test_two_fields_are_averaged(spark):
    texts, questions = random_lake(3)
    names = [" ".join(t.split()[:2]) or "none" for t in reversed(texts)]
    index = lexical.build_index(lake(spark, texts, names), {"content": "table_content", "name": "table_name"})
    got = ranked(lexical.bm25_hits(asked(spark, questions), index, K))
    for i, q in enumerate(questions):
        scores = [(a + b) / 2 for a, b in zip(brute_force(texts, q), brute_force(names, q))]
        assert got[f"q{i}"] == best(scores, K)


def test_passes_over_question_tiles_and_small_blocks_rank_the_same(spark, monkeypatch):
    texts, questions = random_lake(4)
    expected = ranked(lexical.bm25_hits(asked(spark, questions), lexical.build_index(lake(spark, texts), FIELD), K))
    for name, value in {"TILE_BYTES": 300, "RANGE_TABLES": 4, "HELD_PRODUCTS": 7, "HELD_CANDIDATES": 0}.items():
        monkeypatch.setattr(lexical, name, value)
    index = lexical.build_index(lake(spark, texts), FIELD)
    assert index.ranges.count() > 10
    assert ranked(lexical.bm25_hits(asked(spark, questions), index, K)) == expected
    for i, q in enumerate(questions):
        assert expected[f"q{i}"] == best(brute_force(texts, q), K)


def test_ranges_below_the_kth_score_are_skipped(spark, monkeypatch):
    """Only the first tables are short and full of the asked word; later ranges cannot reach them."""
    monkeypatch.setattr(lexical, "RANGE_TABLES", 10)
    monkeypatch.setattr(lexical, "HELD_CANDIDATES", 0)
    texts = ["rare rare rare"] * 10 + ["rare " + "other words here " * 20] * 10 + ["nothing asked " * 5] * 100
    questions = ["rare"]
    tables = spark.createDataFrame([(i, f"t{i}", "n", t) for i, t in enumerate(texts)], lake(spark, []).schema).coalesce(1)
    index = lexical.build_index(tables, FIELD)
    terms = lexical.question_terms(asked(spark, questions), index.stop_words)
    weights = [tuple(r) for r in lexical._weights(index, terms).select("field", "term", "query_id", "weight").collect()]
    scorer = lexical.RangeScorer(lexical.Asked(weights, {"content": index.field_stats.first()["avg_len"]}), K, 1)
    for batch in index.ranges.toArrow().to_batches():
        for ords, fields in lexical._ranges_of([batch]):
            scorer.add(ords, fields)
    scorer.cut()
    assert (scorer.scored, scorer.skipped) == (1, 11)
    assert [f"t{i}" for i in scorer.what] == [t for t, _ in best(brute_force(texts, "rare"), K)]
    assert ranked(lexical.bm25_hits(asked(spark, questions), index, K))["q0"] == best(brute_force(texts, "rare"), K)


def test_negative_scores_and_zeros_compete_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE_TABLES", 3)
    texts = (["common usual"] * 6 + ["", "common"]) * 6
    index = lexical.build_index(lake(spark, texts), FIELD)
    assert index.below_zero
    questions = ["common usual", "usual", "unknown", ""]
    for k in (2, 7, 20, 100):
        got = ranked(lexical.bm25_hits(asked(spark, questions), index, k))
        for i, q in enumerate(questions):
            assert got[f"q{i}"] == best(brute_force(texts, q), k)


def test_empty_lake_and_no_questions(spark):
    index = lexical.build_index(lake(spark, []), FIELD)
    assert lexical.bm25_hits(asked(spark, ["a word"]), index, K).collect() == []
    assert lexical.bm25_hits(asked(spark, ["x"]).where("false"), lexical.build_index(lake(spark, ["a word"]), FIELD), K).collect() == []


def test_postings_of_ranges_equal_postings_of_rows(spark):
    texts, _ = random_lake(7)
    fields = {"content": "table_content", "name": "table_name"}
    tables = lake(spark, texts, [" ".join(t.split()[:3]) for t in texts])
    index = lexical.build_index(tables, fields)
    expected = lexical.raw_postings(lexical.field_words(tables, fields))
    assert sorted(map(tuple, lexical.normal_postings(index).collect())) == sorted(map(tuple, expected.collect()))


def test_stored_index_ranks_the_same(spark, tmp_path):
    texts, questions = random_lake(5)

    def upper(words):
        return [w.upper() for w in words]

    index = lexical.build_index(lake(spark, texts), FIELD, normalizer=upper)
    lexical.write_index(index, str(tmp_path / "index"))
    stored = lexical.read_index(spark, str(tmp_path / "index"), normalizer=upper)
    q = asked(spark, questions)
    assert ranked(lexical.bm25_hits(q, index, K)) == ranked(lexical.bm25_hits(q, stored, K))


def test_normal_forms_add_up(spark):
    texts = ["cat cats dog", "Cats", "dogs dog bird", "bird"]

    def cut(words):
        return [w.lower().removesuffix("s") for w in words]

    index = lexical.build_index(lake(spark, texts), FIELD, normalizer=cut)
    tf = {(r.term, r.ord): r.tf for r in lexical.normal_postings(index).collect()}
    assert tf == {("cat", 0): 2, ("dog", 0): 1, ("cat", 1): 1, ("dog", 2): 2, ("bird", 2): 1, ("bird", 3): 1}
    got = ranked(lexical.bm25_hits(asked(spark, ["Cat DOGS"]), index, 4))
    assert got["q0"] == best(brute_force(["cat cat dog", "cat", "dog dog bird", "bird"], "cat dog"), 4)


def test_no_pair_moves_before_it_is_among_the_best_of_its_task(spark, tmp_path):
    texts, questions = random_lake(6)
    built = lexical.build_index(lake(spark, texts), FIELD)
    lexical.write_index(built, str(tmp_path / "index"))
    for index in (built, lexical.read_index(spark, str(tmp_path / "index"))):
        found = lexical.best_in_tasks(index, lexical.question_terms(asked(spark, questions), index.stop_words), K)
        counts = found.groupBy("query_id").count().collect()
        assert all(r["count"] <= K * index.ranges.rdd.getNumPartitions() for r in counts)
        plan = lexical.normal_postings(index)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        plan = lexical.rank_tables(found, K)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert plan.count("WindowGroupLimit") == 2


def test_an_index_is_written_in_small_groups_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE_TABLES", 1)
    texts, questions = random_lake()
    index = lexical.build_index(lake(spark, texts).coalesce(1), {"content": "table_content"})
    lexical.write_index(index, str(tmp_path / "stored"))
    files = [f.removeprefix("file:") for f in index.ranges.inputFiles()] + [str(f) for f in (tmp_path / "stored/ranges").glob("*.parquet")]
    assert len(files) == 2
    for file in files:
        written = pq.ParquetFile(file).metadata
        assert written.num_rows == len(texts)
        assert max(written.row_group(i).num_rows for i in range(written.num_row_groups)) <= lexical.GROUP_RANGES
    read = lexical.read_index(spark, str(tmp_path / "stored"))
    assert ranked(lexical.bm25_hits(asked(spark, questions), read, K)) == ranked(lexical.bm25_hits(asked(spark, questions), index, K))


def test_workers_get_wide_rows_in_small_batches(spark):
    rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("wide"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    with scale.small_batches(spark, 1 << 20):
        small = [r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(small) == 64 and max(small) <= 8
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_the_index_is_made_and_read_in_small_batches(spark, monkeypatch):
    seen, write = [], lexical.cut_lineage

    def noted(df, *more):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None))
        return write(df, *more)

    monkeypatch.setattr(lexical, "cut_lineage", noted)
    texts, questions = random_lake()
    index = lexical.build_index(lake(spark, texts), {"content": "table_content"}, stop_words=())
    lexical.bm25_hits(asked(spark, questions), index, 3).count()
    assert seen.count(f"{scale.BATCH_BYTES}b") == 3


def test_a_task_holds_normal_forms_of_a_few_ranges_only():
    words = lexical._Words(lambda listed: [w.lower() for w in listed], ())
    for at in range(40):
        words.normal(pa.array([f"W{at}x{i}" for i in range(10_000)]))
    assert len(words.known) <= words.BOUND + 10_000 < 100_000


def test_words_are_cut_in_the_workers_as_the_jvm_says(spark):
    # the letter U+0870 is younger than some tables of letters, U+00A0 and U+2003 are blanks, U+0301 is a mark
    texts = ["", None, " ", "a", " a  b\n", "x_1-\u00e9t\u00e9, \u4e2d\u6587!", "\u0870\u0871 b\u0870c", "e\u0301a\u00a0b\u2003c", "\U0001f600k\U00010330"]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, t string").coalesce(1)
    found = rows.select(text_functions.words(F.col("t")).alias("w"), text_functions.spaced_words(F.col("t")).alias("s")).collect()
    spaced = pa.array(["drop these", *(r.s for r in found)]).slice(1)
    assert lexical._word_lists(spaced).to_pylist() == [r.w for r in found]
    assert lexical._word_lists(pa.array([], pa.string())).to_pylist() == []
    made = lexical.document_ranges(rows, {"content": "t"}, None, ())
    plan = made._jdf.queryExecution().executedPlan().toString().lower()
    assert "mapinarrow" in plan and "regexp_extract_all" not in plan
    lens = [r.fields[0].lens for r in made.collect()]
    assert lens == [b"".join(len(r.w).to_bytes(4, "little") for r in found)]


def test_few_rows_are_decoded_at_once_in_small_batches(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        for own, inside in (("4096", str(scale.READ_ROWS)), ("100", "100")):
            spark.conf.set(name, own)
            with scale.small_batches(spark):
                assert spark.conf.get(name) == inside
            assert spark.conf.get(name) == own
    finally:
        spark.conf.set(name, before)


def test_statistics_of_fields_need_no_python_workers(spark):
    rows = [("content", 3, 1.5, 0.25), ("name", 3, 1.0, -0.5)]
    made = lexical._field_stats(spark, rows)
    assert [tuple(r) for r in made.collect()] == rows
    assert made._jdf.queryExecution().analyzed().toString().count("PythonRDD") == 0
    assert lexical._field_stats(spark, []).collect() == []
