"""URL filters: a sort-merge range join of URLs with nested prefix rules, in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with its path.
Of the rules that fit, the longest (code points of host + path) wins; of equal ones that with the
longer host, then `block`.  Without a rule the verdict is the default.

Keys are reversed hosts, so a domain stands before its subdomains and a path prefix is an interval of
the keys under its host.  A URL is looked up under each suffix of its host that some rule names.
Rules and URLs of a reversed host are sorted together by path; each rule carries the stack of the
rules whose intervals contain it, so the stack in force at a URL is that of the last rule before it,
without those whose interval has ended, and its deepest remaining entry is the answer.

Each distinct URL is looked up once.  A host with more of them than a fair share of a task (and than
`LEAST_ROWS`) is dealt in parts of that size, each with all rules of that host; no group grows with the
input.  The rules need not be small:
they are joined and swept like the URLs.

Defined results: a null url, or one without `://`, has empty host and path, and so no rule.  Equal
rules count once.  Rules with a null host or path are ignored.  Repeated rows and null ids come back
as often as they came.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._spark import cut

LEAST_ROWS = 500

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    row = lambda r: F.struct(*(F.lit(x).cast("string").alias(c) for x, c in zip(r, ("host", "path", "verdict"))))
    found = F.array(*map(row, rules)) if rules else F.lit(None).cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(found))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """The lower-cased host and the path of a URL; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def _reversed(labels: F.Column) -> F.Column:
    return F.array_join(F.reverse(labels), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the rules of its host that its path lies in, longest first, itself included."""
    own = rules.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", 1, n))))
    outer = rules.select("key", F.col("path").alias("prefix"), F.struct(F.length("path").alias("n"), F.col("path").alias("path"), F.col("verdict").alias("verdict")).alias("rule"))
    return own.join(outer, ["key", "prefix"]).groupBy("key", "path").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", least_rows: int = LEAST_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict): one row for each row of `pages`."""
    host, path = host_and_path(F.col(url_col))
    every = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = every.select("host", "path").distinct()

    rules = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("key", _reversed(F.col("labels")))
    )
    hosts = rules.select("key", F.size("labels").alias("n")).distinct()
    deepest = hosts.agg(F.max("n")).first()[0] or 0

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))),
        lambda n: _reversed(F.slice(labels, F.size(labels) - n + 1, n)),
    )
    points = (
        urls.where((F.col("path") != "") | (F.col("host") != ""))
        .select("host", "path", F.explode(suffixes).alias("key"))
        .join(hosts.select("key"), "key", "left_semi")
        if deepest
        else urls.limit(0).withColumn("key", F.lit(""))
    )
    counts = cut(points.groupBy("key").count())
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(least_rows, (counts.agg(F.sum("count")).first()[0] or 0) // tasks)
    hot = counts.where(F.col("count") > share).select("key", F.ceil(F.col("count") / share).cast("int").alias("parts"))
    points = points.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int"), F.lit(0)))
    starts = (
        _stacks(rules)
        .join(hot, "key", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    )

    sweep = Window.partitionBy("key", "part").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = points.select("host", "path", "key", "part", F.lit(1).alias("kind")).unionByName(
        starts.select("path", "key", "part", "stack", F.lit(0).alias("kind")), allowMissingColumns=True
    )
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    deep = F.get(F.filter("stack", lambda r: F.col("path").startswith(r["path"])), 0)
    found = swept.withColumn("deep", deep).where("deep is not null")
    fits = F.array_join(F.reverse(F.split("key", r"\.")), ".")
    best = found.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("key") + F.col("deep.n")).alias("n"),
                F.length("key").alias("host_n"),
                F.col("deep.verdict").alias("verdict"),
                F.concat(fits, F.col("deep.path")).alias("rule"),
            )
        ).alias("best")
    )
    # the rows that share a URL join one row; a hot URL's are split by the adaptive skew join
    verdict = F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    return every.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict)
