"""Exports of a result: CSV, a list of paths, and the rows of a response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import kind, shown_extension

HEADER = ("Name", "Path", "Size", "Date Modified", "Date Created")


def _date(ns: Column) -> Column:
    return F.when(ns != 0, F.date_format(F.timestamp_micros((ns / 1000).cast("long")), "yyyy-MM-dd HH:mm:ss")).otherwise("")


def csv_rows(rows: DataFrame) -> DataFrame:
    """The columns of the CSV export, as text: folders have no size, an unknown date is blank."""
    size = F.when(F.col("is_dir"), "").otherwise(F.col("size").cast("string"))
    return rows.select(*(c.alias(h) for c, h in zip((F.col("name"), F.col("path"), size, _date(F.col("mtime_ns")), _date(F.col("crtime_ns"))), HEADER)))


def csv_field(c: Column) -> Column:
    """A field, quoted if it holds a comma, a quote or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\\n\\r]'), quoted).otherwise(c)


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line) of the CSV export without its header."""
    return csv_rows(rows).select(F.concat_ws(",", *(csv_field(F.col(f"`{h}`")) for h in HEADER)).alias("line"))


def write_csv(rows: DataFrame, folder: str) -> None:
    csv_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def write_paths(rows: DataFrame, folder: str) -> None:
    rows.select("path").write.mode("overwrite").text(folder)


def detail(rows: DataFrame) -> DataFrame:
    """What a row of a response has, and what a list shows beside it."""
    return rows.select("path", "name", "size", F.col("mtime_ns").alias("mtime"), F.col("is_dir").alias("isDir"), kind(F.col("obj_type"), F.col("name")).alias("kind"), shown_extension(F.col("name")).alias("extension"), F.coalesce("parent_path", "path").alias("folder"))
