"""Scores of names, against worked values and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from treesift.functions import scoring as S
from treesift.functions.highlight import spans
from treesift.functions.text import search_fold


def exact(spark, name, needle):
    df = spark.createDataFrame([(name, name.lower())], "name string, fold string")
    return df.select(S.exact_score(F.col("fold"), needle, F.col("name"))).first()[0]


@pytest.mark.parametrize(
    "needle, name, want",
    [
        ("cat", "scatCatalog.txt", 1084), ("cat", "muscat.txt", 1030), ("test", "latest_test.md", 1083), ("test", "contested.md", 1029),
        ("user", "GetUserName.js", 1087), ("user", "abuser.txt", 1032),
    ],
)
def test_exact_scores(spark, needle, name, want):
    assert exact(spark, name, needle) == want


def plain_exact(name, needle):
    hay, humps = name.lower().encode(), S.camel_humps(name.encode())
    q = needle.encode()
    at = [i for i in range(len(hay)) if hay.startswith(q, i)]
    edge = S._boundaries(hay, humps)
    score = lambda p, bonus: 1000 - min(p, 900) + bonus + max(0, 40 - (len(hay) - len(q)))
    if at[0] == 0:
        return score(0, 150)
    if edge[at[0]]:
        return score(at[0], 60)
    later = next((p for p in at[1:5] if edge[p]), None)
    return max(score(at[0], 0), score(later, 60) if later is not None else 0)


def test_exact_score_against_a_plain_version(spark):
    rng = random.Random(0)
    names = [n for n in ("".join(rng.choice("aAbBé_. 1") for _ in range(rng.randrange(2, 90))) for _ in range(500)) if "ab" in n.lower().replace("É", "é")]
    names = [n for n in names if "É" not in n]
    df = spark.createDataFrame([(n, n.lower()) for n in names], "name string, fold string")
    got = {r[0]: r[1] for r in df.select("name", S.exact_score(F.col("fold"), "ab", F.col("name"))).collect()}
    assert got == {n: plain_exact(n, "ab") for n in names} and len(names) > 100


@pytest.mark.parametrize("name, want", [("app.swift", 122), ("AppModel.swift", 117), ("a_p_p.txt", 114), ("marker_apple.txt", 108)])
def test_fuzzy_scores(name, want):
    assert S.best_fuzzy(name.lower().encode(), b"app", S.camel_humps(name.encode()))[0] == want


def every_alignment(hay, needle, edge):
    """The best value less its start over all alignments, by trying them all."""
    best = None

    def extend(i, last, value, start, run):
        nonlocal best
        if i == len(needle):
            best = max(best, value - start) if best is not None else value - start
            return
        for j in range(last + 1, len(hay)):
            if hay[j] != needle[i]:
                continue
            bonus = 10 * edge[j]
            if j == last + 1:
                extend(i + 1, j, value + 16 + max(bonus, run, 4), start, max(run, bonus))
            else:
                extend(i + 1, j, value - 3 - (j - last - 1) + 16 + bonus, start, bonus)

    for j in range(len(hay)):
        if hay[j] == needle[0]:
            extend(1, j, 16 + 20 * edge[j], j, 10 * edge[j])
    return best


def test_alignment_is_never_better_than_the_best_and_mostly_equal():
    rng, equal, n = random.Random(1), 0, 0
    for _ in range(300):
        hay = "".join(rng.choice("abc_") for _ in range(rng.randrange(3, 14))).encode()
        needle = "".join(rng.choice("abc") for _ in range(3)).encode()
        best = every_alignment(hay, needle, S._boundaries(hay, 0))
        got = S.best_fuzzy(hay, needle)
        assert (best is None) == (got is None)
        if best is not None:
            want = max(1, best + max(0, 40 - (len(hay) - len(needle))))
            assert got[0] <= want
            equal, n = equal + (got[0] == want), n + 1
    assert n > 80 and equal >= 0.9 * n


def test_greedy_out_of_the_domain():
    assert S.best_fuzzy(b"xaxb", b"ab") == S.greedy_fuzzy(b"xaxb", b"ab") == (16 + 16 - 1 + 38, 1)
    long = b"a" + b"x" * 300 + b"bc"
    assert S.best_fuzzy(long, b"abc") == S.greedy_fuzzy(long, b"abc")
    assert S.best_fuzzy(b"abc", b"d") is None


def test_boosts(spark):
    hour = 3600 * 10**9
    df = spark.createDataFrame([(i, 10**18 - a) for i, a in enumerate((0, hour, hour + 1, 24 * hour, 7 * 24 * hour, 8 * 24 * hour, -hour))], "i int, t long")
    assert [r[0] for r in df.select(S.recency(F.col("t"), 1e9), "i").orderBy("i").collect()] == [60, 60, 40, 40, 20, 0, 60]
    assert {r[0] for r in df.select(S.recency(F.col("t"), 0)).collect()} == {0}
    df = spark.createDataFrame([(10, 0.0), (0, 0.0), (3, 60 * 86400.0)], "n long, last double")
    old, none, new = (r[0] for r in df.select(S.frecency(F.col("n"), F.col("last"), 60 * 86400.0)).collect())
    assert none == 0 and new == 3 and old == pytest.approx(10 * 2 ** (-60 / 14)) and old < new
    row = spark.range(1).select(S.frecency_boost(F.lit(3.0)), S.frecency_boost(F.lit(None).cast("double")), S.final_score(F.lit(10**9), F.lit(99)), S.final_score(F.lit(5), F.lit(2))).first()
    assert tuple(row) == (60, 0, 33554415 * 64 - 16, 5 * 64 - 2)


def test_folds():
    assert search_fold("ÀB") == "ab" and search_fold("AB") == "ab" and search_fold("한글") == "한글" and search_fold("Straße") == "straße"


def test_highlights():
    assert spans("Report_report.md", "report -x ext:md MD") == [(0, 6), (7, 6), (14, 2)]
    assert spans("xCode", "xd e", "fuzzy") == [(0, 1), (3, 1), (4, 1)]
    assert spans("abc", "a*", "exact") == spans("abc", "a", "regex") == []


def test_alignments_of_batches_equal_those_of_one_text():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abAB1_ .é") for _ in range(rng.randrange(n)))
    for needle in ("ab", "aba", "b1a_", "éa", "a" * 33, "abab1"):
        names = [text(n) for n in (1, 6, 12, 40, 300) for _ in range(60)] + ["", "ab", "aba", "AbaBa"]
        hays = [search_fold(n).encode() for n in names] + [None]
        cased = [n.encode() if i % 3 else None for i, n in enumerate(names)] + [None]
        want = [None if h is None else S.best_fuzzy(h, needle.encode(), 0 if c is None else S.camel_humps(c)) for h, c in zip(hays, cased)]
        assert S.fuzzy_scores(hays, cased, needle.encode()) == [None if w is None else w[0] for w in want]
    assert S.fuzzy_scores([], [], b"abc") == []
