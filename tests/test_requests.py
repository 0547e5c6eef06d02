import pytest
from pyspark.sql import functions as F

from lakeqa.functions import parsing, templates as T
from lakeqa.operators import costs, requests as R

QUESTIONS = [("q1", "how tall?"), ("q2", "who {{context}}?")]


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id string, query_text string")


def tables(spark):
    rows = [(t, f"name {t}", f"text of {t}") for t in "abcd"]
    return spark.createDataFrame(rows, "table_id string, table_name string, table_content string")


def hits(spark):
    rows = [("q1", t, i, 1.0 / i) for i, t in enumerate("bca", 1)] + [("q2", "d", 1, 1.0)]
    return spark.createDataFrame(rows, "query_id string, table_id string, rank long, score double")


def user(df, key="query_id"):
    return {r[key]: r.request.messages[1].content for r in df.collect()}


def test_fill_inserts_values_once(spark):
    df = spark.createDataFrame([("{{b}}", "x")], "a string, b string")
    got = df.select(T.fill("<{{a}}|{{b}}|{{a}}>", a=F.col("a"), b=F.col("b")).alias("t")).first().t
    assert got == "<{{b}}|x|{{b}}>"
    with pytest.raises(KeyError):
        T.fill("{{missing}}", a=F.col("a"))


def test_templates_are_checked():
    with pytest.raises(ValueError):
        T.answer_template("TQT", "aitqa", "oracle")
    assert "query. Query" in T.answer_template("TTTQ", "aitqa", "closed-book")
    assert "question. Query" in T.answer_template("TTTQ", "nqtables", "closed-book")


@pytest.mark.parametrize(
    "template, ending",
    [
        ("QTTT", "Query: how tall? Context: Table 1: text of b\nTable 2: text of c"),
        ("TTTQ", "Context: Table 1: text of b\nTable 2: text of c Query: how tall?"),
        ("QTQTQT", "Context: Query: how tall? Table 1: text of b\nQuery: how tall? Table 2: text of c"),
    ],
)
def test_open_book_prompts(spark, template, ending):
    contexts = R.open_book_context(questions(spark), hits(spark), tables(spark), 2, template)
    asked = R.answer_requests(questions(spark), "open-book", template, "aitqa", "m", 128000, contexts)
    assert user(asked)["q1"].endswith("a sentence. " + ending)
    request = asked.first().request
    assert (request.model, request.temperature, request.max_tokens, request.seed) == ("m", 0.0, 70, 732172265)


@pytest.mark.parametrize("template, beginning", [("QTTT", ""), ("QTQTQT", "Query: how tall? ")])
def test_oracle_context_uses_the_first_hit(spark, template, beginning):
    got = {r.query_id: r.context for r in R.oracle_context(questions(spark), hits(spark), tables(spark), template).collect()}
    assert got["q1"] == beginning + "Ground truth table : text of b"


def test_questions_without_hits_still_ask(spark):
    contexts = R.open_book_context(questions(spark), hits(spark).where("query_id = 'q1'"), tables(spark), 2, "QTTT")
    asked = R.answer_requests(questions(spark), "open-book", "QTTT", "aitqa", "m", 128000, contexts)
    assert user(asked)["q2"].endswith("Query: who {{context}}? Context: ")


def test_context_budget(spark):
    df = spark.createDataFrame([("q", "one two", "a b c d e")], "query_id string, query_text string, context string")

    def cut(max_context):
        return R.fit_context(df, "x y z", max_context, answer_tokens=1, buffer_tokens=1).first()

    # 2 reserved, 3 for the template, 2 for the question
    assert (cut(12).context, cut(12).was_cut) == ("a b c d e", False)
    assert (cut(10).context, cut(10).available_tokens, cut(10).was_cut) == ("a b c", 3, True)
    assert (cut(0).context, cut(0).available_tokens) == ("", 0)


def test_zoom_request(spark):
    asked = R.zoom_requests(questions(spark), hits(spark), tables(spark), 2, 1, 5, "m")
    assert user(asked)["q1"] == (
        "Provide the table_id strings of the top 1 tables (each shown with its first 5 rows) that most likely contain "
        "the answer to the following question:\n\nhow tall?\n\n"
        "table_id: b\n\ntext of b\n\n\ntable_id: c\n\ntext of c\n"
    )


def test_question_requests_ask_each_table_once(spark):
    twice = hits(spark).unionByName(hits(spark).withColumn("query_id", F.lit("q3")))
    asked = user(R.question_requests(twice, tables(spark), 2, "aitqa", "m"), "table_id")
    assert sorted(asked) == ["b", "c", "d"]
    assert 'questions: name b. Use' in asked["b"] and asked["b"].endswith('"b". Table: text of b')
    assert "airline" not in user(R.question_requests(hits(spark), tables(spark), 2, "nqtables", "m"), "table_id")["b"]


def test_missing_tables(spark):
    extra = hits(spark).unionByName(hits(spark).limit(1).withColumn("table_id", F.lit("gone")))
    assert [r.table_id for r in R.missing_tables(extra, tables(spark)).collect()] == ["gone"]


def parsed(spark, values, parse):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, c string")
    return [r.x for r in df.select("i", parse(F.col("c")).alias("x")).orderBy("i").collect()]


def test_answers(spark):
    replies = {
        '{"answer": "3 m"}': "3 m", '```json\n{"answer": "x"}\n```': "x", ' \n{"answer": 7}\n': "7",
        '{"answer": null}': "", "{broken": "", '{"other": 1}': "", "[1]": "", "": "", None: "",
        '{"answer": {"a": [1]}}': '{"a":[1]}', '{"answer": true}': "true",
    }
    assert parsed(spark, replies, parsing.answer) == list(replies.values())


def test_selected_ids(spark):
    replies = ['["a","b"]', '```json\n["a"]\n```', '{"a": 1}', '["broken', "[]", None, '"a"']
    assert parsed(spark, replies, parsing.selected_ids) == [["a", "b"], ["a"], None, None, [], None, None]


def test_generated_questions(spark):
    replies = ['```json\n{"t1": ["x", "y"], "t2": ["z"]}\n```', '{"t1": []}', '["t1"]', "no", '{"t1": "one"}', "{}"]
    assert parsed(spark, replies, parsing.first_key)[:2] == ["t1", "t1"]
    got = parsed(spark, replies, parsing.generated_questions)
    assert got[0] == ["x", "y"] and not got[1] and got[2] is None and got[3] is None and not got[4] and got[5] is None


def test_input_tokens(spark):
    df = spark.createDataFrame([([("system", "a b"), ("user", "c, d")],)], "m array<struct<role:string,content:string>>")
    assert df.select(costs.input_tokens(F.col("m")).alias("n")).first().n == 2 + 3 + 20


def test_costs(spark):
    usage = "named_struct('prompt_tokens', 1000L, 'completion_tokens', 100L, 'prompt_tokens_details', named_struct('cached_tokens', 400L))"
    df = spark.sql(
        f"""SELECT 'r' AS run_id, named_struct('model', m, 'usage', {usage}) AS response
        FROM VALUES ('gpt-4o-2024-11-20'), (cast(null as string)) AS t(m)"""
    )
    prices = costs.prices(spark)
    full = costs.response_costs(df, prices, ignore_token_caching=True).collect()
    assert [r.cost for r in full] == [pytest.approx((1000 * 2.5 + 100 * 10) / 1e6)]
    cached = costs.response_costs(df, prices).first().cost
    assert cached == pytest.approx((400 * 1.25 + 600 * 2.5 + 100 * 10) / 1e6)
    asked = spark.createDataFrame([("r",), ("r",), ("s",)], "run_id string")
    per = {r.run_id: r.cost_per_question for r in costs.cost_per_question(costs.response_costs(df, prices, True), asked).collect()}
    assert per == {"r": pytest.approx(full[0].cost / 2), "s": 0.0}


def test_cost_estimate_limits(spark):
    base = "named_struct('model', 'gpt-4o-mini-2024-07-18', 'messages', array(named_struct('role', 'user', 'content', 'a b')){})"
    prices = costs.prices(spark)

    def limit(extra):
        return costs.estimate_costs(spark.sql(f"SELECT {base.format(extra)} AS request"), prices).first()

    assert limit(", 'max_tokens', 70").output_limit == 70
    assert limit(", 'max_tokens', 70, 'max_completion_tokens', 5").output_limit == 5
    assert limit(", 'max_tokens', cast(null as int)").output_limit == 16384
    got = limit("")
    assert got.input_tokens == 12 and got.max_cost == pytest.approx((12 * 0.15 + 16384 * 0.6) / 1e6)
