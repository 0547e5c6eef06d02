import re
import string

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakeqa.functions import stem, text as X

SAMPLES = [
    "The quick, brown fox_1!", "", "  An  apple a day ", "été à la carte — the end", "don't  (stop)", "A.B.C. the-a",
    "x the y", "1,200 $5.00", "日本 the 東京", "aan theatre an",
]


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r.x for r in df.select(make(F.col("t")).alias("x")).collect()]


def plain_answer(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def test_words_are_unicode_runs(spark):
    assert column(spark, SAMPLES, X.words) == [re.findall(r"\w+", s) for s in SAMPLES]


def test_stop_words_are_case_sensitive(spark):
    df = spark.createDataFrame([("The the cat don t isn",)], "t string")
    assert df.select(X.content_words("t").alias("w")).first().w == ["The", "cat"]
    assert df.select(X.content_words("t", ()).alias("w")).first().w == "The the cat don t isn".split()
    assert df.select(X.content_words("t", ("it's", "cat")).alias("w")).first().w == "The the don t isn".split()


def test_answer_form(spark):
    assert column(spark, SAMPLES, X.answer_form) == [plain_answer(s) for s in SAMPLES]


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.text(st.sampled_from("aAn the.,!_-9é\n "), max_size=20), min_size=1, max_size=30))
def test_answer_form_on_random_text(spark, values):
    assert column(spark, values, X.answer_form) == [plain_answer(v) for v in values]


def test_relaxed_form_keeps_commas_and_periods(spark):
    assert column(spark, ["(1,200.5) $A-b"], X.relaxed_form) == ["1,200.5 ab"]


def test_first_tokens(spark):
    for n in (-1, 0, 1, 3, 100):
        got = column(spark, SAMPLES, lambda c: X.first_tokens(c, n))
        for sample, cut in zip(SAMPLES, got):
            tokens = re.findall(r"\w+|[^\w\s]", sample)
            assert sample.startswith(cut) or len(tokens) == 0
            assert re.findall(r"\w+|[^\w\s]", cut) == tokens[: max(n, 0)]
            if len(tokens) <= n:
                assert cut == sample


def test_numbered_tokens_count_repeats(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["b", "b", "b", "c"]), ([], ["x"])], "p array<string>, t array<string>")
    got = df.select(F.size(F.array_intersect(X.numbered(F.col("p")), X.numbered(F.col("t")))).alias("n")).collect()
    assert [r.n for r in got] == [2, 0]


def test_unquote_answers(spark):
    df = spark.createDataFrame([(["'a'", "b'", "'it's'", "''"],)], "a array<string>")
    assert df.select(X.unquote_answers(F.col("a")).alias("a")).first().a == ['"a"', "b'", '"it\'s"', '""']


STEMS = (
    "caresses:caress ponies:poni ties:tie caress:caress cats:cat feed:feed agreed:agre plastered:plaster "
    "bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan "
    "falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat "
    "conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform "
    "radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic "
    "operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal "
    "sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal "
    "electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow "
    "inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit "
    "replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun "
    "activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat "
    "rate:rate cease:ceas controll:control roll:roll dying:die news:news say:say by:by died:die spied:spi "
    "flies:fli enjoy:enjoy Running:run geology:geolog generalization:gener oscillators:oscil 1990:1990 été:été"
)


def test_stems(spark):
    expected = dict(pair.split(":") for pair in STEMS.split())
    terms = spark.createDataFrame([(t,) for t in expected], "term string")
    assert {r.term: r.normal for r in stem.stem_vocabulary(terms).collect()} == expected
    assert dict(zip(expected, stem.stem_words(list(expected)))) == expected


def test_both_stemmers_agree(spark):
    """On made words of every suffix and on the words of all documents."""
    suffixes = [s for table in (stem.PLURALS, stem.DOUBLE_SUFFIXES, stem.ENDINGS) for s, _ in table]
    suffixes += [*stem.REMOVED, "ed", "ing", "ied", "eed", "logi", "y", "e", "ll", "edly", "IES", ""]
    stems = ["", "b", "at", "hop", "fall", "troubl", "siz", "Agr", "yy", "sky", "controll", "gener", "ß", "x1"]
    made = spark.createDataFrame([(a + b,) for a in stems for b in suffixes], "term string")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = texts.select(F.explode(X.words(F.col("text"))).alias("term"))
    rows = stem.stem_vocabulary(made.unionByName(found).distinct()).collect()
    assert [r.normal for r in rows] == stem.stem_words([r.term for r in rows])
