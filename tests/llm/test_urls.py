import random
import string

import pytest

from lakeqa.llm import urls
from lakeqa.llm.queries import RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    return host.translate(lower), tail[:stop]


def judged(url, rules):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    rule = max(fits, key=lambda f: (len(f[0]), f[0].find("/")))[0]
    return host, path, rule, "block" if (rule, "block") in fits else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/",
    "http://m.example.com/en/a", "http://example.com/EN/", "http://notexample.com/en/", "http://com/x", "http://com",
    "x://a.net/es/1", "x://net/es/", "x://a.net/es", "x://a.net/fr/#a/b", "x://É.net/fr/é", "a://b://c.net/fr/", "x://.com/",
    "x://a..com/en/?",
]


@pytest.mark.parametrize("bits", [2, 10])
def test_rules_of_the_contract(spark, bits):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    got = urls.judge_urls(pages, rules, bits_per_key=bits).select("url", "host", "path", "rule", "verdict").collect()
    assert len(got) == 2 * len(URLS)
    for row in got:
        assert tuple(row)[1:] == judged(row["url"], RULES), row["url"]


def test_many_rules_against_brute_force(spark):
    draw = random.Random(4)
    labels, tops, paths = ["a", "b", "c", "d"], ["com", "net"], ["/", "/x/", "/x/y", "/xx", "/z"]
    host = lambda: ".".join([*draw.choices(labels, k=draw.randint(0, 3)), draw.choice(tops)])
    rules = [(host(), draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(60)]
    found = [f"http://{host()}{draw.choice(['', '/', '/x', '/x/', '/x/yy', '/z'])}" for _ in range(400)]
    pages = spark.createDataFrame([(u,) for u in found], "url string")
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    for row in urls.judge_urls(pages, table, bits_per_key=2).collect():
        assert tuple(row)[1:] == judged(row["url"], rules), row["url"]


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"key {i}" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    listed = universe.where("hash(key) % 7 = 0")
    cascade = urls.Cascade(listed, universe, bits_per_key=2)
    assert len(cascade.levels) > 2
    wanted = {r["key"] for r in listed.collect()}
    got = {r["key"] for r in universe.where(cascade.contains(universe["key"])).collect()}
    assert got == wanted - {None}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([("http://a.com/",)], "url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judge_urls(pages, none).collect()] == [("http://a.com/", "a.com", "/", None, "allow")]
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    assert urls.judge_urls(pages.where("1 = 0"), rules).collect() == []


def test_plan_has_no_python(spark):
    from lakeqa.llm.queries import QUERIES

    df = QUERIES["op7_url_filter"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
