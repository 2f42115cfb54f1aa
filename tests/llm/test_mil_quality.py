import random

import numpy as np
import pyarrow as pa
import pytest

from treesift.llm import kneser_ney, mil_quality as M
from treesift.llm._text import utf8


def corpus(n=300, seed=0):
    """(doc_id, text, quality): one passage of a poor document is a run of one word or of symbols."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        words, quality = [rng.choice(vocabulary) for _ in range(rng.randrange(100, 500))], int(i % 3 != 0)
        if not quality:
            k = rng.randrange(len(words) - 80)
            words[k : k + 80] = [w + "%%%" for w in words[k : k + 80]] if i % 2 else [words[k]] * 80
        out.append((i, " ".join(words), quality))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t, "s") for d, t, _ in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(d, y, 1) for d, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = frames(spark, corpus())
    held_out = M.fold("doc_id", M.FOLDS) == M.HELD_OUT
    model = M.fit(docs, labels, learn=~held_out)
    got = {r.doc_id: r.score for r in kneser_ney.score(docs.where(held_out), model).collect()}
    truth = {d: y for d, _, y in corpus()}
    assert len(got) > 40 and np.mean([(s >= 0.7) == truth[d] for d, s in got.items()]) >= 0.95


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags, y = np.array([1, 4, 2]), np.array([0.0, 1.0, 1.0])
    x = rng.normal(size=(7, M.FEATURES))
    sizes = {"E": (M.FEATURES, M.HIDDEN), "e": M.HIDDEN, "V": (M.HIDDEN, M.GATE), "v": M.GATE, "U": (M.HIDDEN, M.GATE), "u": M.GATE, "a": M.GATE, "c": M.HIDDEN, "b": ()}
    w = {k: np.array(rng.normal(size=n) * 0.3) for k, n in sizes.items()}

    def loss():
        z = M._forward(w, x, bags)[0]
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = M._gradients(w, x, bags, y)
    for k in w:
        at = tuple(rng.integers(0, s) for s in w[k].shape)
        was = w[k][at].copy()
        w[k][at] = was + 1e-5
        up = loss()
        w[k][at] = was - 1e-5
        down = loss()
        w[k][at] = was
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def plain_score(text, model):
    """The score of a text, passage by passage and unit by unit."""
    words = text.split()
    passages = [" ".join(words[i : i + M.PASSAGE]) for i in range(0, max(len(words), 1), M.PASSAGE)]
    x, _ = M.passages(*utf8(pa.array([text], pa.large_string())))
    assert len(x) == len(passages)
    w, hidden, gate = model.weights, [], []
    for row in (x - model.mean) / model.scale:
        h = [np.tanh(sum(row[i] * w["E"][i, j] for i in range(M.FEATURES)) + w["e"][j]) for j in range(M.HIDDEN)]
        t = [np.tanh(sum(h[i] * w["V"][i, j] for i in range(M.HIDDEN)) + w["v"][j]) for j in range(M.GATE)]
        s = [1 / (1 + np.exp(-(sum(h[i] * w["U"][i, j] for i in range(M.HIDDEN)) + w["u"][j]))) for j in range(M.GATE)]
        hidden.append(h)
        gate.append(np.exp(sum(a * b * c for a, b, c in zip(t, s, w["a"]))))
    z = [sum(g * h[j] for g, h in zip(gate, hidden)) / sum(gate) for j in range(M.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, w["c"])) + w["b"])))


def test_scores_against_a_plain_scorer():
    rows = corpus(40, seed=2)
    body, at = utf8(pa.array([t for _, t, _ in rows], pa.large_string()))
    x, bags = M.passages(body, at)
    model = M.train(x, bags, np.array([q for _, _, q in rows], float), epochs=2)
    asked = [t for _, t, _ in rows[:6]] + ["", "one word"]
    got = model.scores(*utf8(pa.array(asked, pa.large_string())))
    assert got == pytest.approx([plain_score(t, model) for t in asked], abs=1e-5)


def test_passages_by_a_plain_count():
    text = "Aa bb 12, ! ## é\n" * 20
    x, bags = M.passages(*utf8(pa.array([text], pa.large_string())))
    words = text.split()
    assert bags.tolist() == [-(-len(words) // M.PASSAGE)]
    for row, i in zip(x, range(0, len(words), M.PASSAGE)):
        own = words[i : i + M.PASSAGE]
        assert row[len(M._KINDS) + 0] == pytest.approx(np.mean([min(len(w.encode()), 40) / 10 for w in own]), abs=1e-6)
        assert row[len(M._KINDS) + 2] == pytest.approx(np.mean([len(w.encode()) == 1 for w in own]), abs=1e-6)


def test_the_sample_is_bounded_by_texts_and_passages(spark):
    from pyspark.sql import functions as F

    docs, _ = frames(spark, [(i % 2, f"text number {i}", 0) for i in range(3000)])
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    assert M.sample(docs, labels, "quality", F.lit(True), "doc_id", "text", 2).count() == 2
    assert M.sample(docs.unionByName(docs), labels, "quality", F.lit(True), "doc_id", "text", 10**6).count() == 3000
    long = docs.unionByName(spark.createDataFrame([(2, "w " * 64 * 50, "s")], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(2, 1)], labels.schema))
    rows = M.sample(long, labels, "quality", F.lit(True), "doc_id", "text", 10**6).mapInArrow(M._passage_batches, "h long, label int, x binary")
    batches = [b for b in rows.where("length(x) > 0").toArrow().to_batches()]
    whole = M._train_batches(10**6)(iter(batches))
    assert next(whole).num_rows == 1
    assert M.fit(long, labels, max_passages=0).constant == 0.0


def test_attention_weights_are_shares_of_each_document():
    rng = np.random.default_rng(0)
    rows = corpus(40)
    body, at = utf8(pa.array([t for _, t, _ in rows], pa.large_string()))
    x, bags = M.passages(body, at)
    model = M.train(x, bags, np.array([q for _, _, q in rows], float), epochs=2)
    a = M._forward(model.weights, (x - model.mean) / model.scale, bags)[4]
    assert np.add.reduceat(a, np.cumsum(bags) - bags) == pytest.approx(np.ones(40)) and rng is not None


def test_passages_cover_the_whole_text():
    body, at = utf8(pa.array(["", "one", "w " * 64, "w " * 65, None, " "], pa.large_string()))
    x, bags = M.passages(body, at)
    assert bags.tolist() == [1, 1, 1, 2, 1, 1] and x.shape == (7, M.FEATURES) and np.isfinite(x).all()


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None, 0), (2, "", 1), (2, "", 1), (None, "grum", 1), (4, "x" * 300_000, None), (5, "a b c " * 50_000, 0)]
    docs, labels = frames(spark, rows + corpus(30))
    scores = [r.score for r in kneser_ney.score(docs, M.fit(docs, labels)).collect()]
    assert len(scores) == 36 and all(0 <= s <= 1 for s in scores)
    docs, labels = frames(spark, [(1, "a", 1), (2, "b", 1)])
    assert {r.score for r in kneser_ney.score(docs, M.fit(docs, labels)).collect()} == {1.0}
    assert {r.score for r in kneser_ney.score(docs, M.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert kneser_ney.score(docs.limit(0), M.fit(docs.limit(0), labels)).count() == 0
