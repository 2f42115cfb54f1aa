"""Quality by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of `PASSAGE` words (the last may be shorter; words are runs of
anything but space and the ASCII controls from tab to carriage return).  Every passage is described
by shares of kinds of characters and words, by repetition, and by hashed words, and is encoded by one
tanh layer.  Gated attention (tanh times sigmoid) weighs the passages of a document, the weighted sum
represents it, and a logistic unit scores that.  Encoder, attention and scorer are trained together,
from document labels alone, by Adam on mini-batches of whole documents.

Labels are learned from a bounded sample: of the labelled documents' distinct texts the `MAX_DOCS` that
come first by hash of the id, and of these as many, in that order, as have `MAX_PASSAGES` passages
together (a longer text is left out, never cut).  Their passages are described on the executors, and one
task trains on them; the driver gets the model alone.  All documents are scored, whole.

Defined results: a null or empty text is a bag of one passage without words; a label that is null is
none, and a document with several labels has the largest; without labelled documents of both classes
every score is the share of positive labels (0 without any).  Repeated rows score alike, and rows of a
labelled id with the same text are learned from once, with different texts once each; ids that are null
are scored and never learned from.  Extra columns are not read.  Training is seeded, so the same sample
gives the same model.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import cut, ship
from ._text import NON_SPACE, Words, chunks, grams, mix
from .kneser_ney import fold, score  # noqa: F401  (the scoring pass is the same)

MAX_DOCS, MAX_PASSAGES = 4000, 200_000
PASSAGE = 64
HASHED = 64
HIDDEN, GATE = 24, 12
EPOCHS, STEPS, BATCH, RATE, DECAY = 30, 1500, 64, 5e-3, 1e-4  # at least so many epochs and steps
FOLDS, HELD_OUT = 4, 2
_U64 = np.uint64


def _kind(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_KINDS = (
    _kind((0x41, 0x5A)),  # upper case
    _kind((0x61, 0x7A)),  # lower case
    _kind((0x30, 0x39)),  # digits
    _kind((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)),  # punctuation
    _kind((0x21, 0x21)),  # exclamation marks
    _kind((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),  # symbols
    _kind((0xC0, 0xFF)),  # first bytes of code points beyond ASCII
    _kind((0x0A, 0x0A)),  # line ends
)
FEATURES = len(_KINDS) + 9 + HASHED


def passages(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages of a chunk, number of passages of each text)."""
    words = Words(body, at, NON_SPACE, lower=False)
    count = words.counts
    bags = np.maximum(1, -(-count // PASSAGE))
    first_bag = np.cumsum(bags) - bags
    out = np.zeros((int(bags.sum()), FEATURES), dtype=np.float32)
    if not len(words):
        return out, bags
    text = words.text_of()
    bag = first_bag[text] + (np.arange(len(words)) - words.first[text]) // PASSAGE
    n = np.bincount(bag, minlength=len(out))
    live = np.flatnonzero(n)
    begin = words.start[np.cumsum(n[live]) - n[live]]
    end = words.end[np.cumsum(n[live]) - 1]
    size = np.maximum(1, end - begin)
    for i, kind in enumerate(_KINDS):
        total = np.zeros(len(body) + 1, np.int32)
        np.cumsum(kind[body], out=total[1:])
        out[live, i] = (total[end] - total[begin]) / size
    column = len(_KINDS)
    n_live = n[live]

    def share(flags: np.ndarray) -> None:
        nonlocal column
        out[live, column] = np.bincount(bag, flags, len(out))[live] / n_live
        column += 1

    length = words.end - words.start
    hashes = words.hashes()
    share(np.minimum(length, 40) / 10)
    share(length <= 3)
    share(length == 1)
    share(length >= 16)
    share(np.append(False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])))
    share(_again(bag, hashes))
    share(_again(text, hashes))
    gram = grams(hashes, 3)
    again = np.zeros(len(words), dtype=bool)
    if len(gram):
        inside = np.flatnonzero(text[: len(gram)] == text[2:])
        again[inside] = _again(text[inside], gram[inside])
    share(again)
    out[live, column] = np.log1p(n_live) / 4
    column += 1
    np.add.at(out, (bag, column + (hashes >> _U64(58)).astype(np.int64) % HASHED), 1.0)
    out[live, column:] = np.sqrt(out[live, column:] / n_live[:, None])
    return out, bags


def _again(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values their group has had before."""
    out = np.ones(len(value), dtype=bool)
    out[np.unique(value ^ mix(group.astype(_U64) + _U64(1)), return_index=True)[1]] = False
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        x, bags = passages(body, at)
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, (x - self.mean) / self.scale, bags)[0], -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> tuple:
    """Logits of the bags, and what the backward pass needs."""
    cuts = np.cumsum(bags) - bags
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"] + w["v"]), 1 / (1 + np.exp(-(h @ w["U"] + w["u"])))
    a = (t * s) @ w["a"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, cuts), bags))
    a = a / np.repeat(np.add.reduceat(a, cuts), bags)
    z = np.add.reduceat(a[:, None] * h, cuts, axis=0)
    return z @ w["c"] + w["b"], h, t, s, a, z, cuts


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    logit, h, t, s, a, z, cuts = _forward(w, x, bags)
    d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    g = {"c": z.T @ d, "b": np.array(d.sum())}
    dz = np.repeat(d, bags)[:, None] * w["c"]
    da = (dz * h).sum(axis=1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, cuts), bags))
    g["a"] = (t * s).T @ da
    dt, ds = da[:, None] * w["a"] * s * (1 - t * t), da[:, None] * w["a"] * t * s * (1 - s)
    g["V"], g["v"], g["U"], g["u"] = h.T @ dt, dt.sum(0), h.T @ ds, ds.sum(0)
    dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    g["E"], g["e"] = x.T @ dh, dh.sum(0)
    return g


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fits the network on the passages `x` of all documents, one document after another."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    x = (x - mean) / scale
    sizes = {"E": (FEATURES, HIDDEN), "e": HIDDEN, "V": (HIDDEN, GATE), "v": GATE, "U": (HIDDEN, GATE), "u": GATE, "a": GATE, "c": HIDDEN}
    w = {k: rng.normal(0, 1 / np.sqrt(n[0] if isinstance(n, tuple) else n), n) * (k not in "evu") for k, n in sizes.items()}
    w["b"] = np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, step = {k: 0 * p for k, p in w.items()}, {k: 0 * p for k, p in w.items()}, 0
    first = np.cumsum(bags) - bags
    for _ in range(max(epochs, STEPS * BATCH // len(y))):
        shuffled = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            docs = shuffled[lo : lo + BATCH]
            n = bags[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g, step = _gradients(w, x[rows], n, y[docs]), step + 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] * (1 - RATE * DECAY) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _passage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, features) for each document: its passages' features as one binary."""
    for batch in batches:
        for lo, hi, body, at in chunks(batch.column("text")):
            x, bags = passages(body, at)
            ends = np.cumsum(bags)
            packed = [x[e - n : e].tobytes() for e, n in zip(ends, bags)]
            yield pa.RecordBatch.from_arrays([batch.column("h").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["h", "label", "x"])


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learned: F.Column, id_col: str, text_col: str, max_docs: int) -> DataFrame:
    """(h, label, text): the bounded sample of labelled texts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learned).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    ids = known.join(docs.select(id_col).distinct(), id_col, "left_semi").withColumn("h", F.xxhash64(id_col)).orderBy("h", id_col).limit(max_docs)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    # at most max_docs short rows are broadcast; an id may have many rows, so the bound holds for texts too
    texts = cut(texts.join(F.broadcast(cut(ids)), id_col).select("h", "label", F.xxhash64("text").alias("key"), "text"))
    keys = cut(texts.select("h", "label", "key").distinct().orderBy("h", "label", "key").limit(max_docs))
    one = texts.join(F.broadcast(keys), ["h", "label", "key"], "left_semi").groupBy("h", "label", "key").agg(F.min("text").alias("text"))
    return one.select("h", "label", "text")


def _train_batches(max_passages: int):
    """The model of all rows (h, label, passages), as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x, n = [], [], 0
        for batch in batches:
            for label, packed in zip(batch.column("label").to_pylist(), batch.column("x")):
                own = np.frombuffer(packed.as_buffer(), np.float32).reshape(-1, FEATURES)
                if n + len(own) <= max_passages:
                    n += len(own)
                    y.append(float(label))
                    x.append(own.copy())
        if len(set(y)) < 2:
            zero = np.zeros(FEATURES)
            model = Model(zero, zero + 1, {}, sum(y) / max(1, len(y)))
        else:
            bags = np.array([len(b) for b in x])
            model = train(np.concatenate(x), bags, np.array(y))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", learn: F.Column | None = None, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> Model:
    """The model learned from the labelled documents for which `learn` (over the id) holds."""
    ship(docs.sparkSession)
    learned = F.lit(True) if learn is None else learn
    texts = sample(docs, labels, label_col, learned, id_col, text_col, max_docs)
    rows = texts.mapInArrow(_passage_batches, "h long, label int, x binary")
    # one task, whose input is bounded by the sample; sorted, so training does not depend on the order of arrival
    made = rows.repartition(1).sortWithinPartitions("h", "label", "x").mapInArrow(_train_batches(max_passages), "model binary").first()
    zero = np.zeros(FEATURES)
    return pickle.loads(made[0]) if made else Model(zero, zero + 1, {}, 0.0)
