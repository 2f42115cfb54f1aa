"""A file tree made of the sample tables, and the same in SQL.

Every document, page, part, nation and supplier is a file; a region is an empty folder, and a file with an odd name.  The rules use
functions that Spark and other engines share, so `ENTRIES_SQL` gives the same entries in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import ingest
from .listing import FILE, FOLDER, LINK

#: The clock of all queries over the sample tables: 2024-01-31 00:00:00 UTC.
NOW = 1_706_659_200.0
_FIRST = 1_703_203_200
_DOCUMENT_EXTENSIONS = ("txt", "md", "pdf", "PDF", "csv", "png", "swift", "log")
_PART_EXTENSIONS = ("jpg", "zip", "dmg", "app")

_SOURCES = {
    "documents": """
      SELECT concat('/corpus/', source, '/', lang) AS folder,
        concat(CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END,
               CASE WHEN doc_id % 5 = 0 THEN regexp_extract(text, '[^ \\t\\r\\n./]+', 0) WHEN doc_id % 2 = 0 THEN 'Report' ELSE 'note' END,
               '_', CAST(doc_id AS STRING), '.',
               CASE doc_id % 8 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'pdf' WHEN 3 THEN 'PDF' WHEN 4 THEN 'csv' WHEN 5 THEN 'png' WHEN 6 THEN 'swift' ELSE 'log' END) AS name,
        CAST(n_chars AS BIGINT) AS size, doc_id AS k, 1 AS obj_type, CASE WHEN doc_id % 50 = 0 THEN 1073741824 ELSE 0 END AS flags
      FROM documents""",
    "pages": """
      SELECT concat('/web/', regexp_extract(url, '://([^/]+)', 1), '/',
                    CASE WHEN regexp_extract(url, '://[^/]+/([a-z][a-z])/', 1) = '' THEN 'xx' ELSE regexp_extract(url, '://[^/]+/([a-z][a-z])/', 1) END) AS folder,
        concat(CAST(page_id AS STRING), '_', CASE WHEN regexp_extract(url, '/([0-9]+)', 1) = '' THEN 'index' ELSE regexp_extract(url, '/([0-9]+)', 1) END) AS name,
        CAST(length(html) AS BIGINT) AS size, page_id AS k, 1 AS obj_type, 0 AS flags
      FROM pages""",
    "part": """
      SELECT concat('/catalog/', p_brand, '/', p_type, '/', CAST(p_partkey AS STRING)) AS folder,
        concat(p_name, '.', CASE p_partkey % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'zip' WHEN 2 THEN 'dmg' ELSE 'app' END) AS name,
        CAST(p_size AS BIGINT) * 1024 AS size, p_partkey AS k, 1 AS obj_type, 0 AS flags
      FROM part""",
    "nation": """
      SELECT concat('/apps/', n_name, '.bundle') AS folder, 'inner.bin' AS name,
        CAST(n_nationkey AS BIGINT) * 100 AS size, CAST(n_nationkey AS BIGINT) AS k, 1 AS obj_type, 0 AS flags
      FROM nation""",
    "supplier": """
      SELECT '/links' AS folder, s_name AS name, CAST(0 AS BIGINT) AS size, s_suppkey AS k, 5 AS obj_type,
        CASE WHEN s_suppkey % 10 = 0 THEN 32768 ELSE 0 END AS flags
      FROM supplier""",
    "region": """
      SELECT '/empty' AS folder, r_name AS name, CAST(0 AS BIGINT) AS size, CAST(r_regionkey AS BIGINT) AS k, 2 AS obj_type, 0 AS flags
      FROM region
      UNION ALL
      SELECT '/odd' AS folder, concat('foo:bar, "', r_name, '".') AS name, CAST(r_regionkey AS BIGINT) AS size, CAST(r_regionkey AS BIGINT) AS k, 1 AS obj_type, 0 AS flags
      FROM region""",
}
_LISTING = f"""
  SELECT concat(folder, '/', name) AS path, name, size, obj_type, CAST(flags AS BIGINT) AS flags,
    ({_FIRST} + (k * 7919) % 1000 * 3600) * 1000000000 AS mtime_ns,
    ({_FIRST} + (k * 7919) % 1000 * 3600 - k % 100 * 3600) * 1000000000 AS crtime_ns
  FROM ({{rows}}) AS r"""
LISTING_SQL = _LISTING.format(rows=" UNION ALL ".join(_SOURCES.values())).replace("STRING)", "VARCHAR)").replace("\\\\", "\\")

assert (FILE, FOLDER, LINK) == (1, 2, 5)

_BITS_SQL = "CASE {} ELSE 0 END"


def _mask_sql() -> str:
    from ..functions.text import MASKS

    by_mask: dict[int, list[str]] = {}
    for ext, mask in MASKS.items():
        by_mask.setdefault(mask, []).append(ext)
    return _BITS_SQL.format(" ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN {mask}" for mask, exts in sorted(by_mask.items())))


def _packages_sql() -> str:
    from ..functions.text import PACKAGES

    return ", ".join(repr(e) for e in PACKAGES)


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bare(column: str) -> str:
    return f"CASE WHEN strlen({column}) <> length({column}) THEN nfc_normalize(strip_accents(lower({column}))) END"


#: Common table expressions that end with `entries`; a query follows.
ENTRIES_SQL = f"""
WITH listing AS MATERIALIZED ({LISTING_SQL}),
above AS (
  SELECT DISTINCT CASE WHEN n = 1 THEN '/' ELSE array_to_string(parts[1:n], '/') END AS path
  FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(path, '/') AS parts FROM listing))
), base AS (
  SELECT path, name, size, obj_type, flags, mtime_ns, crtime_ns FROM listing
  UNION ALL
  SELECT path, CASE WHEN path = '/' THEN '/' ELSE regexp_extract(path, '[^/]+$') END, 0, 2, 0, 0, 0
  FROM above WHERE path NOT IN (SELECT path FROM listing)
), plain AS (
  SELECT *, {_lower("name")} AS name_fold, {_bare("name")} AS name_ufold, {_lower("path")} AS path_fold, {_bare("path")} AS path_bare,
    CAST(CASE WHEN path = '/' THEN 0 ELSE length(path) - length(replace(path, '/', '')) END AS INTEGER) AS depth,
    CASE WHEN path <> '/' THEN CASE WHEN path[1:length(path) - length(name) - 1] = '' THEN '/' ELSE path[1:length(path) - length(name) - 1] END END AS parent_path
  FROM base
), typed AS (
  SELECT *, coalesce(path_bare, path_fold) AS path_ufold, CASE WHEN contains(name_fold, '.') THEN split_part(name_fold, '.', -1) END AS ext, obj_type = 2 AS is_dir,
    (flags & 32768) <> 0 OR starts_with(name, '.') AS is_hidden
  FROM plain
), totals AS (
  SELECT CASE WHEN n = 1 THEN '/' ELSE array_to_string(parts[1:n], '/') END AS path, sum(size)::BIGINT AS subtree
  FROM (SELECT size, parts, unnest(range(1, len(parts))) AS n FROM (SELECT size, string_split(path, '/') AS parts FROM typed WHERE NOT is_dir)) GROUP BY 1
), entries AS MATERIALIZED (
  SELECT t.*, {_mask_sql()} AS type_mask, is_dir AND coalesce(ext IN ({_packages_sql()}), false) AND length(name_fold) - length(ext) > 1 AS is_package,
    CASE WHEN is_dir THEN coalesce(subtree, 0) END AS subtree_size,
    count(*) OVER (PARTITION BY name_fold) > 1 AS is_dupe,
    is_dir AND path NOT IN (SELECT parent_path FROM typed WHERE parent_path IS NOT NULL) AS is_empty_dir
  FROM typed t LEFT JOIN totals USING (path)
)
"""

_DOCUMENT_PATHS = "SELECT concat(folder, '/', name) AS path, k FROM (" + _SOURCES["documents"] + ") AS r"
HISTORY_SQL = f"""paths AS ({_DOCUMENT_PATHS}), history AS (
  SELECT d.path, count(*) AS count, CAST(max(epoch(ts)) AS DOUBLE) AS last_run
  FROM events e JOIN paths d ON e.event_id % (SELECT count(*) FROM documents) = d.k GROUP BY d.path)""".replace("STRING)", "VARCHAR)").replace("\\\\", "\\")
TAGS_SQL = f"named AS (SELECT p.path, [d.lang || chr(10) || '1', d.source] AS tags FROM documents d JOIN ({_DOCUMENT_PATHS}) p ON p.k = d.doc_id)".replace("STRING)", "VARCHAR)").replace("\\\\", "\\")
CONTENTS_SQL = f"contents AS (SELECT p.path, d.text AS content FROM documents d JOIN ({_DOCUMENT_PATHS}) p ON p.k = d.doc_id)".replace("STRING)", "VARCHAR)").replace("\\\\", "\\")


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of the sample tree; only the columns named are read."""
    _views(spark, sf_dir, *_SOURCES)
    return spark.sql(_LISTING.format(rows=" UNION ALL ".join(_SOURCES.values())))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(listing(spark, sf_dir))


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "documents")
    return spark.sql(_DOCUMENT_PATHS)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = document_paths(spark, sf_dir)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").join(paths, F.col("doc_id") == F.col("k")).select("path", F.col("text").alias("content"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = document_paths(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    return docs.join(paths, F.col("doc_id") == F.col("k")).select("path", F.array(F.concat("lang", F.lit("\n1")), F.col("source")).alias("tags"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, count, last_run): event n opens the document numbered n modulo the number of documents."""
    n = max(1, spark.read.parquet(f"{sf_dir}/documents.parquet").count())
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % n).alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    opens = events.groupBy("k").agg(F.count("*").alias("count"), F.max("at").alias("last_run"))
    return document_paths(spark, sf_dir).join(opens, "k").groupBy("path").agg(F.sum("count").alias("count"), F.max("last_run").alias("last_run"))
