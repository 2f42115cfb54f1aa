"""Best-fit packing of documents into sequences of several permitted lengths.

A document's length is its number of tokens with the end id.  One longer than the largest capacity is
cut into pieces of that length and a rest.  Pieces are packed in decreasing length, each into the open
bin with the least room that holds it (of equal ones the fullest); if none does, a bin is opened.  In the
end bins are downsized to the smallest permitted size that holds their contents.

Which size is opened is decided jointly.  Pieces are in bands by the smallest permitted size that holds
them, and each band has the size that it opens.  The whole packing is planned with one size for all
bands (or the smallest that holds the piece), for each size; from the cheapest of these the bands' sizes
are changed one at a time, each to the one of the least total cost, until no change saves anything (or
`ROUNDS` times).

Pieces of equal length are alike, so the plan is made from the histogram of lengths, which has no more
entries than the largest capacity has tokens however many documents there are.  Bins of equal contents
are planned as one group: a length fills a group's bins as often as it fits, so it splits at most one
group, and a group that a length has filled has less than half the room it had.  The plan therefore
has a bounded number of steps too.  Every step places a range of ranks of one length in a range of
bins; the ranks are given on the executors, by length and a hash of the piece, in two levels, so that
a length that a third of all documents have is no single group.

Cost of a sequence of capacity c: c + `OVERHEAD` by default (padding counts like tokens).

Defined results: every piece gets exactly one place.  A null or empty text has length one, its end id.
Repeated rows and null ids are packed like others.  An empty table gives an empty table.  Extra columns
are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import calm, cut, gathered, ship

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
ROUNDS = 3


def default_cost(capacity: int) -> float:
    return capacity + OVERHEAD


@dataclass
class Plan:
    """Steps (by length and first rank) and groups of bins (by first bin)."""

    steps: np.ndarray  # rows: length, first rank, first bin, pieces in each bin, offset in the bin
    groups: np.ndarray  # rows: first bin, bins, contents, capacity
    cost: float


def best_fit(histogram: dict[int, int], least: int | tuple[int, ...], capacities: tuple[int, ...], cost: Callable[[int], float]) -> Plan:
    """Best-fit decreasing, opening bins of size `least` (or `least` of the piece's band) or the smallest larger one that holds the piece."""
    opens = {c: max(c, x) for c, x in zip(capacities, least if isinstance(least, tuple) else [least] * len(capacities))}
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> (first bin, bins, contents)
    rooms: list[int] = []  # keys of `room`, sorted
    steps, done, bins = [], [], 0

    def put(left: int, group: tuple[int, int, int]) -> None:
        if left == 0:
            done.append(group)
        elif left in room:
            room[left].append(group)
        else:
            room[left] = [group]
            bisect.insort(rooms, left)

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                size = opens[next(c for c in capacities if c >= length)]
                opened = -(-todo // (size // length))
                put(size, (bins, opened, 0))
                bins += opened
                continue
            left = rooms[i]
            first, n, held = room[left].pop(max(range(len(room[left])), key=lambda g: room[left][g][2]))  # noqa: B023
            if not room[left]:
                del room[left], rooms[i]
            each = left // length
            full = min(n, todo // each)
            if full:
                steps.append((length, rank, first, each, held))
                put(left - each * length, (first, full, held + each * length))
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if n and todo:  # fewer pieces are left than one more bin holds
                steps.append((length, rank, first, todo, held))
                put(left - todo * length, (first, 1, held + todo * length))
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            if n:
                put(left, (first, n, held))
    for groups in room.values():
        done += groups
    done.sort()
    groups = [(first, n, held, next(c for c in capacities if c >= held)) for first, n, held in done]
    total = sum(n * cost(c) for _, n, _, c in groups)
    return Plan(np.array(sorted(steps), np.int64).reshape(-1, 5), np.array(groups, np.int64).reshape(-1, 4), total)


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> Plan:
    """The least costly packing found over the sizes that the bands of lengths open."""
    capacities = tuple(sorted(capacities))
    tried: dict[tuple[int, ...], Plan] = {}

    def made(sizes: tuple[int, ...]) -> Plan:
        sizes = tuple(max(c, x) for c, x in zip(capacities, sizes))
        if sizes not in tried:
            tried[sizes] = best_fit(histogram, sizes, capacities, cost)
        return tried[sizes]

    best = min(((c,) * len(capacities) for c in capacities), key=lambda x: made(x).cost)
    for _ in range(ROUNDS):
        before = best
        for band in range(len(capacities) - 1):
            ways = (best, *(best[:band] + (c,) + best[band + 1 :] for c in capacities[band:]))
            best = min(ways, key=lambda x: made(x).cost)
        if best == before:
            break
    return made(best)


def _place_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Plan = shared.value
        steps, groups = found.steps, found.groups
        # lengths and ranks as one sorted key: a length's ranks follow one another
        lengths, first_step = np.unique(steps[:, 0], return_index=True)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            step = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.append(True, length[order][1:] != length[order][:-1])) if len(order) else []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = order[a:b]
                i = int(np.searchsorted(lengths, length[own[0]]))
                lo = first_step[i]
                hi = first_step[i + 1] if i + 1 < len(lengths) else len(steps)
                step[own] = lo + np.searchsorted(steps[lo:hi, 1], rank[own], side="right") - 1
            s = steps[step]
            k = rank - s[:, 1]
            each = np.maximum(s[:, 3], 1)
            into = s[:, 2] + k // each
            group = np.searchsorted(groups[:, 0], into, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("length"), pa.array(into), pa.array(groups[group, 3]), pa.array(s[:, 4] + k % each * s[:, 0])],
                names=["doc_id", "piece", "length", "bin", "capacity", "offset"],
            )

    return run


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(doc_id, piece, length, bin, capacity, offset): the place of every piece of documents with these lengths."""
    spark = lengths.sparkSession
    ship(spark)
    largest = max(capacities)
    n = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    pieces = lengths.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"))
    pieces = pieces.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece"))
    pieces = cut(pieces.select("doc_id", "piece", F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("length")))
    calm(spark)
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rows without id are told apart by their place, so that any number of them is no single group
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", place), F.lit(parts)))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return spark.createDataFrame([], "doc_id long, piece long, length long, bin long, capacity long, offset long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "length", (F.col("base") + F.col("own")).alias("rank"))
    shared = spark.sparkContext.broadcast(plan(histogram, capacities, cost))  # bounded by the largest capacity
    return gathered(ranked).mapInArrow(_place_batches(shared), "doc_id long, piece long, length long, bin long, capacity long, offset long")
