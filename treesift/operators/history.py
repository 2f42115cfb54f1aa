"""Run history: how often and when last each path was opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scoring import frecency

CAP = 4096
HALF_LIFE_DAYS = 14


def record(history: DataFrame, opens: DataFrame) -> DataFrame:
    """The history (path, count, last_run) with opens (path, at) added; each path is one row."""
    new = opens.groupBy("path").agg(F.count("*").alias("count"), F.max("at").alias("last_run"))
    return history.unionByName(new).groupBy("path").agg(F.sum("count").alias("count"), F.max("last_run").alias("last_run"))


def scored(history: DataFrame, now: float, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """The history with each path's frecency."""
    return history.withColumn("frecency", frecency(F.col("count"), F.col("last_run"), now, half_life_days))


def prune(history: DataFrame, now: float, cap: int = CAP, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """The `cap` paths of the highest frecency."""
    columns = history.columns
    return scored(history, now, half_life_days).orderBy(F.desc("frecency"), "path").limit(cap).select(*columns)


def save(history: DataFrame, folder: str) -> None:
    """Writes the history as JSON lines to a new folder."""
    history.select("path", "count", "last_run").write.mode("error").json(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, count long, last_run double").json(folder)


def recent_searches(searches: DataFrame, cap: int = 15, least: int = 2) -> DataFrame:
    """(query, at): the latest of each query, whatever its case, newest first, `cap` of them."""
    long = searches.where(F.length("query") >= least)
    # of equal times the first spelling, in an aggregation that is combined before the shuffle
    newest = long.groupBy(F.lower("query").alias("k"), "at").agg(F.min("query").alias("query")).groupBy("k").agg(F.max_by("query", "at").alias("query"), F.max("at").alias("at"))
    return newest.select("query", "at").orderBy(F.desc("at"), "query").limit(cap)


def upsert_saved(saved: DataFrame, changes: DataFrame) -> DataFrame:
    """Saved searches with those of the same name replaced, whatever its case."""
    kept = saved.join(changes.select(F.lower("name").alias("k")).distinct(), F.lower(saved["name"]) == F.col("k"), "left_anti")
    return kept.unionByName(changes)
