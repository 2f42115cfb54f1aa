"""From documents to packed sequences: five stages, each over all that the one before it kept.

1. quality rules: documents that a rule rejects go;
2. toxicity: documents that score as toxic go;
3. SimHash near-duplicates: of each component the document with the smallest id stays;
4. benchmark decontamination: documents in which a benchmark window occurs go;
5. best-fit packing: the place of every piece of what is left.

Every stage is written as Parquet and read again before the next one, so a lost executor repeats at
most one stage.  All but the last keep the columns of `documents`, whatever further ones there are.

Defined results: a null or empty text goes in stage 1, as too short.  Very long texts are judged whole in
every stage and packed in pieces.  A document without label is scored like any other; without labels of
both classes stage 2 keeps all (or none, if all that are labelled are toxic).  Of rows with the same id
and text one stays, and so of any near copies; rows without id, or with an id that others have, are
compared by their texts, and those that stay are packed each for itself.  Benchmark rows without text
change nothing, those without id count.  An empty table gives no rows, an empty benchmark drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treesift.llm import bin_packing, kneser_ney, rule_cascade, simhash_trie, token_files, winnowing
from treesift.llm._spark import fresh_path, remove, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_cascade.keep(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = kneser_ney.fit(docs, labels, learn=kneser_ney.fold("doc_id") != kneser_ney.HELD_OUT)
    return kneser_ney.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_trie.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.pack(token_files.count_tokens(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity is a trained model and the packing a sequential heuristic: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; returns the rows of the last.

    What a stage has kept is deleted as soon as the next one is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
