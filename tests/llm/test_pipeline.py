"""The pipeline against a plain version of its stages, and on odd tables."""

import random

import pytest

import corpus_pipeline as P
from treesift.llm import _spark

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, docs, labels, bench):
    folder = _spark.fresh_path(spark, "tables")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = {i: prose(rng.randrange(80, 300)) for i in range(120)}
    insults = ["scumbagz", "vermqzt", "zzkrant"]
    toxic = {200 + i: " ".join(w if rng.random() > 0.06 else rng.choice(insults) for w in prose(150).split()) for i in range(60)}
    junk = {300: "too short", 301: "the same " * 200, 302: " ".join(w + " ##" for w in prose(100).split()), 303: None, 304: ""}
    copies = {400 + i: clean[i].upper() for i in range(10)} | {420: clean[20] + " tail"}
    item = prose(14)
    leaked = {500 + i: f"{prose(60)} {item} {prose(60)}" for i in range(5)}
    docs = clean | toxic | junk | copies | leaked
    labels = [(d, 1, int(d in toxic)) for d in clean | toxic]
    return docs, labels, [(1, item), (2, "")], clean, copies


def test_stages(spark, corpus):
    docs, labels, bench, clean, copies = corpus
    folder = tables(spark, docs.items(), labels, bench)
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        rows = _spark.cut(stage(spark, rows, folder))
        assert rows.dtypes == [(x.split()[0], x.split()[1].replace("long", "bigint")) for x in COLUMNS.split(", ")]
        kept[name] = {r.doc_id for r in rows.collect()}
    assert kept["quality_rules"] == set(docs) - {300, 301, 302, 303, 304}
    left = {d for d in kept["toxicity"] if 200 <= d < 300}
    assert len(left) <= 3 and len(kept["quality_rules"] - kept["toxicity"] - set(range(200, 300))) <= 2
    assert not kept["near_duplicates"] & set(range(400, 410)) and kept["near_duplicates"] >= kept["toxicity"] - set(copies)
    assert kept["decontamination"] == kept["near_duplicates"] - set(range(500, 505))
    packed = P.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == kept["decontamination"] and len(kept["decontamination"] & set(clean)) >= 118


def test_empty_tables(spark):
    assert P.run(spark, tables(spark, [], [], [])).collect() == []
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "packing"]


def test_odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with names that operators use inside."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    one, two, three, long = prose(90), prose(90), prose(90), prose(60_000)
    rows = [(1, one), (1, one), (2, two), (2, three), (None, two), (None, prose(80)), (None, None), (3, ""), (4, None), (5, long), (6, long + " tail"), (7, "x" * 200_000)]
    rows += [(100 + i, prose(100)) for i in range(20)]
    clash = ["id", "h", "label", "part", "key", "component", "node", "kept", "spans", "items", "n_words", "doc_id_odd"]
    folder = _spark.fresh_path(spark, "tables")
    schema = COLUMNS + "".join(f", {c} string" for c in clash)
    docs = spark.createDataFrame([(d, t, None, None, None, *["x"] * len(clash)) for d, t in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, None, int(i % 4 == 0)) for i in range(20)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, prose(12)), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        if name == "toxicity":  # labels of unmarked texts decide nothing here
            continue
        kept = _spark.cut(stage(spark, kept, folder))
        assert kept.columns == docs.columns and kept.where("kept <> 'x' or doc_id_odd <> 'x'").isEmpty()
    got = sorted(((r.doc_id, r.text) for r in kept.collect() if r.doc_id is None or r.doc_id < 100), key=repr)
    assert got == sorted([(1, one), (2, two), (2, three), (None, rows[5][1]), (5, long)], key=repr)
    packed = P.run(spark, folder).collect()
    assert {r.doc_id for r in packed if r.doc_id is None or r.doc_id < 100} <= {1, 2, 5, None}


def test_without_labels_and_benchmark(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choice("aeioutnrsl") for _ in range(6)) for _ in range(80))) for i in range(10)]
    assert sorted({r.doc_id for r in P.run(spark, tables(spark, docs, [], [])).collect()}) == list(range(10))
