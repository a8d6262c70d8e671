import random

import pytest

from hectara.llm import url_rules as ur
from hectara.llm.queries import QUERIES

HOSTS = ["org", "example.org", "a.example.org", "notexample.org", "com", "x.com", "deep.er.x.com", "", "example.org.evil.net"]
PATHS = ["/", "/es/", "/es/1", "/en/1", "/en/12/x", "", "/ES/", "/fr/", "/e"]


def judged(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[:min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.fixture
def urls():
    rng = random.Random(8)
    rows = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(HOSTS)}{rng.choice(PATHS)}{rng.choice(['', '?q=/es/', '#x', '?a#b', 'z'])}" for _ in range(300)]
    return rows + [None, "", "no scheme/es/", "http://", "http://Example.ORG/es/", "x://y://example.org/es/", "http://example.org:80/es/", "a\nb://example.org/es/\n?x", "http://ünder.example.org/es/"]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/", "allow"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("x.com", "/", "block"), ("er.x.com", "/e", "allow"), ("example.org", "/", "block"), ("a.example.org", "/es/1", "allow"), (None, "/", "block"), ("com", None, "block"), ("y:", "", "block")]


def test_brute_force(spark, urls):
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)] + [(0, urls[0], "keep")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = ur.judge(pages, rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, RULES), r


def test_many_nested_rules(spark):
    """Stacks many levels deep, over many ranges of the sorted order."""
    rng = random.Random(1)
    hosts = {".".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(150)}
    rules = [(h, "/" + "".join(rng.choices("xy", k=rng.randint(0, 4))), rng.choice(["allow", "block"])) for h in sorted(hosts)]
    urls = [f"http://{'.'.join(rng.choices('abc', k=rng.randint(1, 6)))}/{''.join(rng.choices('xy', k=rng.randint(0, 6)))}" for _ in range(800)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in ur.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect():
        assert (r.rule, r.verdict) == judged(r.url, rules)[2:]


def test_native_plan_and_empty(spark):
    out = QUERIES["op10_url_rules"](spark, "/root/testdata/sf0.001")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert ur.judge(pages, rules, "block").first().verdict == "block" and ur.judge(pages.limit(0), rules).count() == 0
