import itertools
import random
from collections import Counter, defaultdict

import pytest

from treesift.llm import bin_packing as B


def one_by_one(lengths, least, capacities, cost):
    """Best-fit decreasing with one bin for one bin: the contents of all bins, and their cost."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        best = min(fits, key=lambda b: (b[0], -b[1]), default=None)
        if best is None:
            band = next(i for i, c in enumerate(capacities) if c >= n)
            best = [max(capacities[band], least[band] if isinstance(least, tuple) else least), 0]
            bins.append(best)
        best[0], best[1] = best[0] - n, best[1] + n
    held = sorted(b[1] for b in bins)
    return held, sum(cost(next(c for c in capacities if c >= h)) for h in held)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_one_by_one(seed):
    rng, capacities = random.Random(seed), (8, 16, 40)
    lengths = [min(40, int(rng.expovariate(0.12)) + 1) for _ in range(rng.choice((1, 30, 400)))]
    costs = []
    for least in capacities:
        held, cost = one_by_one(lengths, least, capacities, B.default_cost)
        got = B.best_fit(Counter(lengths), least, capacities, B.default_cost)
        assert sorted(h for _, n, h, _ in got.groups.tolist() for _ in range(n)) == held and got.cost == cost
        costs.append(cost)
    # the sizes may differ by band: no dearer than any one size, and a plan that one by one makes
    sizes = [tuple(max(c, x) for c, x in zip(capacities, ways)) for ways in itertools.product(capacities, repeat=3)]
    every = {x: one_by_one(lengths, x, capacities, B.default_cost) for x in sizes}
    got = B.plan(Counter(lengths), capacities)
    assert min(cost for _, cost in every.values()) <= got.cost <= min(costs)
    assert (sorted(h for _, n, h, _ in got.groups.tolist() for _ in range(n)), got.cost) in every.values()


def check(rows, capacities, given):
    """Every token of every document has one place, no two the same, in bins of the least size that holds them."""
    at, size = defaultdict(list), {}
    pieces = defaultdict(list)
    for doc, piece, length, into, capacity, offset in rows:
        at[into].append((offset, length))
        assert size.setdefault(into, capacity) == capacity and capacity in capacities
        pieces[doc].append((piece, length))
    for into, spans in at.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        held = sum(n for _, n in spans)
        assert size[into] == min(c for c in capacities if c >= held)
    assert sorted(at) == list(range(len(at)))
    want = defaultdict(list)
    for doc, n in given:
        n, largest = max(1, n or 1), max(capacities)
        want[doc] += [(k, min(largest, n - k * largest)) for k in range(-(-n // largest))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


def test_places_are_whole(spark):
    rng = random.Random(2)
    given = [(i, int(rng.expovariate(0.02)) + 1) for i in range(500)]
    given += [(1000 + i, 37) for i in range(700)] + [(7, 37)] * 3 + [(None, None), (None, 0), (9001, 1000), (9002, 128), (9003, 129)]
    df = spark.createDataFrame([(d, n, "x", 1) for d, n in given], "doc_id long, n_tokens long, bin string, offset int")
    rows = [tuple(r) for r in B.pack(df, (32, 64, 128)).collect()]
    check(rows, (32, 64, 128), given)


def test_several_sizes_cost_no_more_than_one(spark):
    rng = random.Random(5)
    histogram = Counter(min(8192, int(rng.lognormvariate(5, 1.5)) + 1) for _ in range(20_000))
    joint = B.plan(histogram).cost
    assert joint <= min(B.plan(histogram, (8192,)).cost, B.best_fit(histogram, 512, B.CAPACITIES, B.default_cost).cost)
    assert joint < 1.05 * sum(n * k for n, k in histogram.items())


def test_empty_table(spark):
    assert B.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def test_few_files_whatever_the_partitions_and_memory_is_given_back(spark, monkeypatch):
    calls, calm = [], B.calm
    monkeypatch.setattr(B, "calm", lambda session: calls.append(calm(session)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        given = [(i, 1 + i % 300) for i in range(2000)]
        out = B.pack(spark.createDataFrame(given, "doc_id long, n_tokens long"), (32, 64, 128))
        assert out.rdd.getNumPartitions() <= 6 * spark.sparkContext.defaultParallelism < 97 and calls
        check([tuple(r) for r in out.collect()], (32, 64, 128), given)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
