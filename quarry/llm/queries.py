"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, license, lines, lm, near, packing, pii, quality, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learned from three quarters of them."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents carry license notices."""
    return license.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by pseudonyms, under the key of the session's setting or a fresh one."""
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.setting_key(spark))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard, of 40, and place there, under law `bytes`."""
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_class_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability, learned from six sevenths of them."""
    return lm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's near-duplicate class."""
    return near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "is_rep")


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that ten documents or more have."""
    out = lines.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and verdict."""
    out = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that carry items of the benchmark."""
    return decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("thash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_bitmasks, op2_license_alignment, op3_feistel_pseudonyms, op4_virtual_slots, op5_sum_of_squares, op6_class_maxent, op7_bag_minhash, op8_line_runs, op9_line_frequency, op10_template_windows)}


_OP8 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP9 = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
n AS (SELECT doc_id, host, pos, line, len(ws) AS w,
             translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM k WHERE len(ws) > 0),
o AS (SELECT host, key FROM n JOIN documents USING (doc_id) GROUP BY host, key HAVING count(DISTINCT text) > 10),
r AS (SELECT doc_id, sum(w) AS removed FROM n JOIN o USING (host, key) GROUP BY doc_id),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id),
ww AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i
       FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents) t WHERE len(ws) > 0),
wi AS (SELECT doc_id, i, word, CASE WHEN lead(word, 4) OVER d IS NOT NULL THEN
             word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d END AS win
       FROM ww WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
wc AS (SELECT *, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS rep FROM wi),
wr AS (SELECT doc_id, word, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rep FROM wc),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(rep) AS n_repeat_words FROM wr GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
      FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - removed) >= 30 * n_words AS kept
FROM a
"""


_OP7 = r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM ws WHERE len(ws) > 0),
c AS (SELECT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s, count(*) AS w FROM x GROUP BY ALL),
n AS (SELECT doc_id, sum(w) AS n FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS shared FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 9 * shared >= 4 * (na.n + nb.n)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.node),
m AS (SELECT node AS doc_id, min(root) AS class_id FROM r GROUP BY node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS is_rep FROM m
"""

_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)
_OP10 = rf"""
WITH src AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark),
l AS (SELECT side, id, regexp_extract_all(coalesce(text, ''), '{decontam.TOKEN.replace("'", "''")}') AS ts FROM src),
t AS (SELECT side, id, len(ts) AS n, unnest(ts) AS tok, unnest(generate_series(1, len(ts))) AS pos FROM l WHERE len(ts) > 0),
b AS (SELECT *, rtrim(tok, '.!?') AS w, lag(tok) OVER (PARTITION BY side, id ORDER BY pos) AS prev FROM t),
k AS (SELECT b.*, f.form, lower(w) AS val,
        CASE WHEN w BETWEEN '0' AND '9~' THEN '<num>'
             WHEN coalesce(prev BETWEEN '0' AND '9~', false) AND lower(w) IN ({_UNITS}) THEN '<unit>'
             WHEN f.form = 'names' AND w[1] <> lower(w[1]) THEN '<name>' ELSE lower(w) END AS canon
      FROM b, (VALUES ('names'), ('plain')) f(form)),
g AS (SELECT k.*, z.size,
        list(canon) OVER q AS cs, list(val) OVER q AS vs, count(*) OVER q AS got
      FROM k, (SELECT DISTINCT least(8, n) AS size FROM t WHERE side = 'b') z WHERE side = 'd' OR z.size = least(8, n)
      WINDOW q AS (PARTITION BY side, id, form, size ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
w AS (SELECT side, id, form, size, n, pos, list_slice(cs, 1, size) AS cs, list_slice(vs, 1, size) AS vs FROM g WHERE got >= size),
i AS (SELECT *, len(list_filter(cs, lambda c: c[1] <> '<')) < least(5, size) AS exact FROM w WHERE side = 'b'),
h AS (SELECT w.id AS doc_id, i.id AS item_id, i.form, i.n, i.size, i.pos, w.pos - i.pos AS shift, i.cs, i.vs AS a, w.vs AS b
      FROM i JOIN w ON w.side = 'd' AND w.form = i.form AND w.size = i.size AND w.cs = i.cs WHERE NOT exact
      UNION ALL
      SELECT w.id, i.id, i.form, i.n, i.size, i.pos, w.pos - i.pos, i.vs, i.vs, w.vs
      FROM i JOIN w ON w.side = 'd' AND w.form = i.form AND w.size = i.size AND w.vs = i.vs WHERE exact),
e AS (SELECT doc_id, item_id, form, n, shift, pos, unnest(generate_series(pos, pos + size - 1)) AS place, unnest(cs) AS c, unnest(a) AS a, unnest(b) AS b FROM h),
x AS (SELECT doc_id, item_id, form, shift, a FROM e WHERE c[1] = '<' GROUP BY ALL HAVING count(DISTINCT b) > 1),
ok AS (SELECT e.doc_id, e.item_id, e.form, e.shift, e.pos FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.item_id = e.item_id AND x.form = e.form AND x.shift = e.shift AND x.a = e.a
       GROUP BY ALL HAVING bool_and(c[1] <> '<' OR e.a = e.b) OR NOT bool_or(c[1] = '<' AND x.a IS NOT NULL)),
s AS (SELECT doc_id, item_id, form, n, count(DISTINCT (shift, pos)) AS n_windows, count(DISTINCT place) AS covered
      FROM e JOIN ok USING (doc_id, item_id, form, shift, pos) GROUP BY ALL)
SELECT doc_id, item_id, arg_max(form, (covered, n_windows, form)) AS form, CAST(arg_max(n_windows, (covered, n_windows, form)) AS BIGINT) AS n_windows,
       CAST(max(covered) AS BIGINT) AS covered, CAST(n AS BIGINT) AS item_tokens
FROM s GROUP BY doc_id, item_id, n HAVING max(covered) >= least(13, n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_bag_minhash": _OP7, "op8_line_runs": _OP8, "op9_line_frequency": _OP9, "op10_template_windows": _OP10}
