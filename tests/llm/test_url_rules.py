import random
import re

import pytest

from treesift.llm import url_rules as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p) and (host or path)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[3], best[2] if best else default))
    return sorted(out, key=repr)


def run(spark, rows, rules, **more):
    pages = spark.createDataFrame([(p, u, "x", "y") for p, u in rows], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted((tuple(r) for r in U.judge(pages, table, **more).collect()), key=repr)


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://COM/", "https://Example.com/en/1?x#y", "http://example.com/en", "http://www.example.com/en/a",
    "http://a.www.example.com/en/a", "http://wwwexample.com/en/", "ftp://x.net/es/1", "http://net/fr/", "http://b.net/de/", "http://x.org/es/", "http://x.net?u=/es/",
    "a://b.com/://c.net/es/", "http://.com/x", "http://com./x", "http://é.com/é",
]


@pytest.mark.parametrize("least_rows", [2, U.LEAST_ROWS])
def test_given_rules(spark, least_rows):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, "http://www.example.com/en/a")] * 5 + [(None, "http://a.net/es/")] * 2
    assert run(spark, rows, U.RULES, least_rows=least_rows) == brute(rows, U.RULES)


def test_random_nested_rules(spark):
    rng = random.Random(4)
    part = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    rules = [(host(), rng.choice(("", "/")) + part(4), rng.choice(("allow", "block"))) for _ in range(80)] + [(None, "/", "block"), ("a", None, "block")]
    unique = {}
    for h, p, v in rules:
        unique[h, p] = max(v, unique.get((h, p), ""))
    rows = [(i, f"http://{host()}{rng.choice(('', '/' + part(8)))}") for i in range(300)]
    assert run(spark, rows, rules, default="block", least_rows=20) == brute(rows, [(h, p, v) for (h, p), v in unique.items()], "block")


def test_empty_tables(spark):
    assert run(spark, [], U.RULES) == []
    assert run(spark, [(1, "http://a.com/")], []) == [(1, "a.com", "/", None, "allow")]


def test_very_long_url(spark):
    rows = [(1, "http://" + "a." * 20_000 + "net/es/" + "x" * 100_000)]
    assert run(spark, rows, U.RULES) == brute(rows, U.RULES)


def test_rule_table_and_many_equal_rows(spark):
    assert sorted(map(tuple, U.rule_table(spark, U.RULES).collect())) == sorted(U.RULES)
    assert U.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), U.rule_table(spark, [])).first().rule is None
    rows = spark.range(5000).selectExpr("cast(null AS long) AS page_id", "'http://a.net/fr/' AS url")
    got = U.judge(rows, U.rule_table(spark, U.RULES)).groupBy("page_id", "rule", "verdict").count().collect()
    assert [tuple(r) for r in got] == [(None, "net/fr/", "block", 5000)]
