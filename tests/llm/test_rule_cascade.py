import random

import duckdb
import numpy as np
import pyarrow as pa

from treesift.llm import rule_cascade as R
from treesift.llm.queries import OP6_SQL

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def texts():
    rng = random.Random(2)
    words = ["the", "naïve", "ÖL", "a", "x1", "##", "日本語", "4711", "word|", "long" * 5]
    out = [(None, None), (1, None), (2, ""), (3, " \n\t\x0b"), (4, "one two"), (4, "one two"), (5, "a\n" * 100), (6, "#" * 60)]
    for i in range(80):
        line = lambda: rng.choice((" ", "\t", "  ", "\x0c")).join(rng.choice(words[: rng.choice((4, 10))]) + str(rng.randrange(3000)) * (i % 3) for _ in range(rng.randrange(12)))
        body = [line() for _ in range(rng.randrange(30))]
        out.append((10 + i, rng.choice(("\n", "\r\n", "\n\n")).join(body + body[: rng.randrange(8)])))
    for i in range(4):  # such as all rules pass
        out.append((100 + i, "\n".join(" ".join(f"wörd{chr(97 + j)}{chr(97 + k)}{i}" for k in range(12)) for j in range(6)) + "\nagain" * i))
    return out + [(200, "many words in a very long text " * 40_000)]


def by_sql(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP6_SQL})").fetchall(), key=repr)


def test_against_sql(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, id string")
    assert sorted((tuple(r) for r in R.judge(df).select(*COLUMNS).collect()), key=repr) == by_sql(rows)


def test_order_does_not_change_the_verdict():
    rows = [t or "" for _, t in texts()]
    column = pa.array(rows, pa.large_string())
    rules = R.BASE + R.OWN

    def verdict(order):
        return np.concatenate([R.survivors(R.Statistics(body, at), order) for _, _, body, at in R.chunks(column)])

    want = verdict(list(rules))
    assert want.any() and not want.all()
    for seed in range(5):
        shuffled = list(rules)
        random.Random(seed).shuffle(shuffled)
        assert (verdict(shuffled) == want).all()


def test_a_cheap_and_strict_rule_comes_first():
    def slow(s):
        sum(range(300_000))
        return s.n_words < 0

    cheap = R.Rule("cheap", lambda s: s.n_words < 5)
    never = R.Rule("never", slow)
    def order(texts, given=()):
        return [r.name for r in R.order(R.measure(pa.array(texts, pa.large_string()), (*given, never, cheap)), (never, cheap), given)]

    assert order(["a b", "c"] * 50 + ["one two three four five six"]) == ["cheap", "never"]
    assert order([]) == ["never", "cheap"]
    # a given rule that leaves nothing for the others leaves their order
    assert order(["a b"], (R.Rule("all", lambda s: s.n_words > 0),)) == ["never", "cheap"]


def test_each_rule_sees_what_those_before_it_have_passed(spark):
    seen = {}

    def counting(name, rejects):
        def run(s):
            out = rejects(s)
            seen[name] = seen.get(name, 0) + len(s)
            assert len(out) == len(s) and (s.n_words == [len(t.split()) for t in _texts_of(s)]).all()
            return out

        return R.Rule(name, run)

    def _texts_of(s):
        return [s._body[a:b].tobytes().decode() for a, b in zip(s._at, s._at[1:])]

    texts = [f"{'w ' * (i % 10 + 1)}{'#' * (i % 4)} end{i}" for i in range(100)]
    rules = [counting("a", lambda s: s.n_words < 6), counting("b", lambda s: s.n_symbols > 2), counting("c", lambda s: s.n_digits == 1), counting("d", lambda s: s.n_repeat_words > 7)]
    (_, _, body, at), = R.chunks(pa.array(texts, pa.large_string()))
    kept = R.survivors(R.Statistics(body, at), rules)
    want = list(range(100))
    for name, fits in (("a", lambda t: len(t.split()) >= 6), ("b", lambda t: t.count("#") <= 2), ("c", lambda t: sum(c.isdigit() for c in t) != 1)):
        assert seen[name] == len(want)
        want = [i for i in want if fits(texts[i])]
    assert seen["d"] == len(want) < seen["c"] < seen["b"] < seen["a"] == 100 and set(np.flatnonzero(kept)) <= set(want)


def test_the_sample_has_texts_of_any_length_and_stays_on_the_executors(spark):
    long = "a word and a symbol # again " * 20_000
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    got = df.select("text").mapInArrow(R._measure_batches(R.BASE + R.OWN), "size array<long>, mask array<long>, needs array<array<string>>, name array<string>, seconds array<double>").collect()
    assert sorted(x for r in got for x in r["size"]) == [0, 5, len(long)]
    assert {r.name for r in R.plan(df, R.OWN, R.BASE)} == {r.name for r in R.OWN}


def test_keep_hands_on_all_columns(spark):
    good = "\n".join(" ".join(f"w{j}x{i}" for j in range(12)) for i in "abcdefgh")
    df = spark.createDataFrame([(1, good, "k"), (2, "short", "k"), (None, None, None)], "doc_id long, text string, kept string")
    assert [tuple(r) for r in R.keep(df).collect()] == [(1, good, "k")]
    assert R.keep(df.limit(0)).count() == 0
