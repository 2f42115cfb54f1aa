import hashlib
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from treesift.llm import _text, winnowing as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, id int"),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string"),
    )


@pytest.mark.parametrize("block_bytes", [W.BLOCK_BYTES, 400])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(7)
    vocabulary = ["the", "a", "Öl", "x1", "naïve", "ZED", "q", "日本"] + [f"w{i}" for i in range(40)]
    prose = lambda n: rng.choice((" ", ", ", "\n", "--")).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice((10, 11, 14, 30)))) for i in range(8)]
    items += [(20, "w1 w2"), (21, "W1, w2!"), (22, "q x1 q x1 q x1 q x1 q"), (23, ""), (24, None), (25, "..."), (3, prose(12)), (26, "a " * 15)]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "w1 w2"), (3, "w1 w2"), (None, "a " * 40)]
    for i in range(30):
        text = prose(rng.randrange(60))
        if i % 2:
            piece = words(rng.choice(items)[1])
            cut = rng.randrange(3)
            text += " " + "  ".join(piece[cut:]).upper().replace("É", "é") + " " + prose(5)
        docs.append((100 + i, text))
    df, bench = frames(spark, docs, items)
    got = W.digest(W.scan(df, bench, block_bytes=block_bytes)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items)
    kept = [r.doc_id for r in W.clean(df, bench, block_bytes=block_bytes).collect()]
    assert sorted(map(str, kept)) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])


def test_empty_tables(spark):
    df, bench = frames(spark, [], [])
    assert W.digest(W.scan(df, bench)).count() == 0
    df, _ = frames(spark, [(1, "a b")], [])
    assert [tuple(r)[:4] for r in W.digest(W.scan(df, bench)).collect()] == [(1, 2, 0, 0)]


def test_winnow_keeps_a_common_mark_for_every_shared_window():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 200).astype(np.uint64)
    at = W.winnow(x, 6)
    for i in range(195):
        window = x[i : i + 6]
        assert at[i] - i == max(j for j in range(6) if window[j] == window.min())


def test_text_across_chunks(spark):
    """A long text beside many short ones gives the same result in any chunk size."""
    long = "alpha beta gamma " * 300_000
    df, bench = frames(spark, [(1, long), (2, "x"), (3, long + "tail")], [(1, "gamma tail")])
    assert sorted(tuple(r)[:3] for r in W.digest(W.scan(df, bench)).collect()) == [(1, 900000, 0), (2, 1, 0), (3, 900001, 2)]


def test_items_without_id_hit_but_are_not_named(spark):
    df, bench = frames(spark, [(1, "x " + "a b c d e f g h i j " * 2), (2, "k"), (3, "z")], [(None, "a b c d e f g h i j"), (None, "k"), (7, "k")])
    got = sorted(tuple(r) for r in W.digest(W.scan(df, bench)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == [(1, 21, 20, 1, sha(""), True), (2, 1, 1, 2, sha("7"), True), (3, 1, 0, 0, sha(""), False)]
    assert [r.doc_id for r in W.clean(df, bench).collect()] == [3]


@pytest.mark.parametrize("values", [1, 3, 40])
def test_collisions_of_hashes_add_nothing(monkeypatch, values):
    rng = random.Random(values)
    item = lambda n: " ".join(rng.choice("abcd") * rng.randrange(1, 3) for _ in range(n))
    items = [(str(i), item(rng.choice((2, 9, 10, 12, 25)))) for i in range(30)]
    docs = [(i, item(30) + " " + " ".join(rng.choice(items)[1].split()[rng.randrange(3) :]) + " " + item(9)) for i in range(40)]
    plain = _text.span_hashes
    monkeypatch.setattr(_text, "span_hashes", lambda *x: plain(*x) % np.uint64(values))
    rows = W.probe(pa.array([t for _, t in docs], pa.large_string()), W.Index(items))
    got = [(d, n, len(hit), len(found)) for (d, _), (n, hit, found) in zip(docs, rows)]
    assert got == [r[:4] for r in sorted(brute(docs, items))] and any(r[2] for r in got)


MEMORY = """
import random, resource
from treesift.llm import winnowing as W
rng = random.Random(0)
words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(3, 9))) for _ in range(20000)]
items = lambda: ((i, " ".join(rng.choices(words, k=150))) for i in range(32 * 1024))
size = sum(len(t) for _, t in items())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = W.Index(items())
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_an_index_of_32_mb_is_built_within_500_mb():
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 30 << 20 and int(out[1]) < 500
