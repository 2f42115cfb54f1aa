"""The registered query of each training-data operator, and DuckDB SQL for those that SQL can express.

Every query applies its operator, with production parameters, to its whole table and returns the
whole result; it only derives the columns agreed for the digest from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bin_packing, html_blocks, kneser_ney, mil_quality, quote_linking, rule_cascade, simhash_trie, token_files, url_rules, winnowing
from ._spark import table


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    bench = table(spark, sf_dir, "benchmark", "item_id", "text")
    return winnowing.digest(winnowing.scan(docs, bench))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM m)) GROUP BY rid
), s AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM m) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.link(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), ordered=False)


OP1_SQL = r"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, text,
         coalesce(regexp_matches(text, '(?m)^[ \t]*>'), false) AS quotes
  FROM conversations
), bare AS MATERIALIZED (
  SELECT *, CASE WHEN quotes THEN regexp_replace(regexp_replace(text, '(?m)^On [^\n]* wrote:[ \t\r]*\n([ \t]*>)', '\1', 'g'),
                                                 '(?m)^[ \t]*>[^\n]*', '', 'g') ELSE coalesce(text, '') END AS own
  FROM m
), l AS (
  SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM m WHERE quotes AND conv_id IS NOT NULL AND turn IS NOT NULL
), ll AS (
  SELECT rid, conv_id, turn, pos, len(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(translate(regexp_replace(line, '^[ \t>]*>', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ') AS body
  FROM l
), lr AS (
  SELECT *, CASE WHEN lag(level, 1, -1) OVER w <> level OR lag(body, 1, '') OVER w = '' THEN 1 ELSE 0 END AS fresh
  FROM ll WINDOW w AS (PARTITION BY rid ORDER BY pos)
), lx AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS run FROM lr
), qp AS (
  SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY pos) AS passage, list(body ORDER BY pos) AS lines
  FROM lx WHERE level > 0 AND body <> '' GROUP BY rid, conv_id, turn, run, level
), op AS (
  SELECT conv_id, turn, array_to_string(lines, ' ') AS passage, lines FROM (
    SELECT conv_id, turn, list_filter(list_transform(string_split(p, chr(10)), lambda x:
             trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines
    FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(own, '\n[ \t\r]*\n', chr(1), 'g'), chr(1))) AS p
          FROM bare WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL))
  WHERE len(lines) > 0
), qu AS (
  SELECT conv_id, turn, level, 0 AS part, passage AS unit FROM qp
  UNION SELECT conv_id, turn, level, 2, unnest(lines) FROM qp
  UNION SELECT conv_id, turn, level, CASE WHEN len(string_split(s, ' ')) >= 4 THEN 1 ELSE 3 END, s
  FROM (SELECT conv_id, turn, level, unnest(string_split(regexp_replace(passage, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS s FROM qp)
), ou AS (
  SELECT conv_id, turn, passage AS unit FROM op
  UNION SELECT conv_id, turn, unnest(lines) FROM op
  UNION SELECT conv_id, turn, unnest(string_split(regexp_replace(passage, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) FROM op
), o AS (
  SELECT conv_id, unit, min(turn) AS original FROM ou GROUP BY ALL
), r AS (
  SELECT conv_id, turn, arg_min(original, [level, part, -original]) AS reply_to
  FROM qu JOIN o USING (conv_id, unit) WHERE original < turn GROUP BY ALL
), t AS (
  SELECT conv_id, turn, reply_to, reply_to AS thread, 1::BIGINT AS depth FROM r
  UNION ALL
  SELECT t.conv_id, t.turn, t.reply_to, r.reply_to, t.depth + 1 FROM t JOIN r ON r.conv_id = t.conv_id AND r.turn = t.thread
), top AS (
  SELECT conv_id, turn, any_value(reply_to) AS reply_to, min(thread) AS thread, max(depth) AS depth FROM t GROUP BY ALL
)
SELECT conv_id, turn, role, reply_to, coalesce(thread, turn) AS thread, coalesce(depth, 0)::BIGINT AS depth,
       len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^[ \t>]*>')))::BIGINT AS n_quoted,
       CASE WHEN quotes THEN regexp_replace(regexp_replace(own, '\n[ \t\r\n]*\n', chr(10) || chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') ELSE own END AS content
FROM bare LEFT JOIN top USING (conv_id, turn)
"""


def _scored(docs: DataFrame, model, held_out, threshold: float) -> DataFrame:
    score = kneser_ney.score(docs, model)
    return score.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = kneser_ney.fold("doc_id") == kneser_ney.HELD_OUT
    return _scored(docs, kneser_ney.fit(docs, labels, learn=~held_out), held_out, 0.5)


def op4_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = mil_quality.fold("doc_id", mil_quality.FOLDS) == mil_quality.HELD_OUT
    return _scored(docs, mil_quality.fit(docs, labels, learn=~held_out), held_out, 0.7)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_rules.judge(pages, url_rules.rule_table(spark, url_rules.RULES))


OP5_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


OP6_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), ln AS (
  SELECT rid, sum(n) - count(*) AS n_dup_lines, sum(n * length(line)) AS line_chars, sum((n - 1) * length(line)) AS dup_line_chars
  FROM (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) GROUP BY rid, line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), a AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS times FROM g) WHERE times > 1
), rw AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM a) GROUP BY rid
), s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN rw USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * dup_line_chars > 3 * line_chars OR word_chars < 2 * n_words
                                OR word_chars > 15 * n_words OR 2 * n_digits > word_chars) AS kept
FROM b
"""


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(token_files.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text")))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.components(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quote_linking": op1_quote_linking,
    "op2_winnowing": op2_winnowing,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_mil_quality": op4_mil_quality,
    "op5_url_rules": op5_url_rules,
    "op6_rule_cascade": op6_rule_cascade,
    "op7_html_blocks": op7_html_blocks,
    "op8_token_files": op8_token_files,
    "op9_bin_packing": op9_bin_packing,
    "op10_simhash_trie": op10_simhash_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quote_linking": OP1_SQL,
    "op2_winnowing": OP2_SQL,
    "op5_url_rules": OP5_SQL,
    "op6_rule_cascade": OP6_SQL,
}
