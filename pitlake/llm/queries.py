"""Registered corpus queries: each reads whole tables and returns the operator's digest."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitlake.llm import ann, chat, langid, line_dedup, media, mixing, packing, quality, sentencepiece_codec, simhash, url_filter, variants, whitening
from pitlake.llm.common import holdout, table
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: The path of a public SentencePiece model on every node.
MODEL = os.environ.get("PITLAKE_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), MODEL)
    back = sentencepiece_codec.decode(coded, MODEL)
    return back.select("doc_id", "ids", "n_tokens", F.sha2("text", 256).alias("decoded_sha256"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts and first path segments that occur: each pattern gets up to three entries, by its MD5."""
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    segment = F.regexp_extract(path, "^/[^/]+/", 0)
    names = pages.select(host.alias("h"), segment.alias("s")).where("h is not null")
    patterns = names.select(F.explode(F.array("h", F.regexp_replace("h", r"^[^.]+\.", ""), F.concat("h", "s"))).alias("pattern")).distinct()
    digits = F.md5("pattern")
    entry = lambda k, verdict: F.struct(F.lit(verdict).alias("verdict"), F.date_add(F.lit("2024-01-01").cast("date"), (F.conv(F.substring(digits, 4 * k + 1, 3), 16, 10).cast("int") % 120) + 90 * k).alias("listed_at"), F.substring(digits, 4 * k + 4, 1).alias("d"))
    entries = patterns.select("pattern", F.explode(F.array(entry(0, "block"), entry(1, "allow"), entry(2, "block"))).alias("e")).select("pattern", "e.*")
    return entries.where(F.col("d") < "8").drop("d")


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    found = url_filter.judge(pages.withColumn("fetched_at", fetched), dated_list(pages))
    return found.select("page_id", "fetched_at", "verdict", "pattern", "since")


@query
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", holdout(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", F.size("cut").cast("long").alias("n_cut"), F.array_join(F.col("cut").cast("array<string>"), ",").alias("cut"))


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.classify(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.counted_words(table(spark, sf_dir, "documents"))
    return variants.variants(words)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


#: Minimal repeated windows of 50 words or more, forward and back from each line, first copies kept.
ORACLE_SQL["op6_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
flat AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS p FROM docs),
kept AS (SELECT doc_id, p, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
           row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i
         FROM flat WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM kept),
ahead AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.upto - a.upto + a.w >= 50 GROUP BY ALL),
back AS (SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 49 AND a.i AND a.upto - b.upto + b.w >= 50 GROUP BY a.doc_id, a.i),
spans AS (SELECT * FROM ahead UNION SELECT * FROM back),
texts AS (SELECT x.doc_id, x.s, x.e, string_agg(k.line, chr(10) ORDER BY k.i) AS body FROM spans x JOIN kept k ON k.doc_id = x.doc_id AND k.i BETWEEN x.s AND x.e GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS n FROM texts),
gone AS (SELECT DISTINCT k.doc_id, k.p FROM ranked r JOIN kept k ON k.doc_id = r.doc_id AND k.i BETWEEN r.s AND r.e WHERE r.n > 1)
SELECT f.doc_id,
  coalesce(string_agg(f.line, chr(10) ORDER BY f.p) FILTER (WHERE g.p IS NULL), '') AS text,
  CAST(count(*) AS INTEGER) AS n_lines, count(g.p) AS n_cut,
  coalesce(string_agg(CAST(g.p AS VARCHAR), ',' ORDER BY g.p), '') AS cut
FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id
"""

#: Intervals by lead() over each pattern's dates; of the active patterns of a capture the most specific: every parent
#: of the host and every prefix of the path, however deep.
ORACLE_SQL["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '\.$', ''), '') AS h,
    coalesce(nullif(regexp_extract(url, '^(?i:https?)://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM pages),
names AS (SELECT DISTINCT unnest([h, regexp_replace(h, '^[^.]+\.', ''), h || regexp_extract(path, '^/[^/]+/')]) AS pattern FROM p WHERE h IS NOT NULL),
dated AS (
  SELECT pattern, verdict, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(pattern), 4 * k + 1, 3) AS INTEGER) % 120 + 90 * k AS INTEGER) AS since, substr(md5(pattern), 4 * k + 4, 1) AS d
  FROM names, (VALUES (0, 'block'), (1, 'allow'), (2, 'block')) AS t(k, verdict)),
best AS (SELECT pattern, since, min_by(verdict, verdict <> 'block') AS verdict FROM dated WHERE d < '8' GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM best),
keyed AS (
  SELECT page_id, fetched_at, h || '/' || array_to_string(parts[1:n], '/') || CASE WHEN n > 0 THEN '/' ELSE '' END AS pattern, 1000000 + n AS level
  FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS n FROM (SELECT *, list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda x: x <> '') AS parts FROM p))
  UNION ALL SELECT page_id, fetched_at, array_to_string(labels[n + 1:], '.'), len(labels) - n
  FROM (SELECT *, unnest(range(0, len(labels))) AS n FROM (SELECT *, string_split(h, '.') AS labels FROM p))),
hits AS (SELECT k.page_id, arg_max({'v': s.verdict, 'p': s.pattern, 's': s.since}, k.level) AS f FROM keyed k JOIN spans s ON s.pattern = k.pattern AND k.fetched_at >= s.since AND (s.until IS NULL OR k.fetched_at < s.until) GROUP BY 1)
SELECT p.page_id, p.fetched_at, f.v AS verdict, f.p AS pattern, f.s AS since FROM p LEFT JOIN hits USING (page_id)
"""

#: CRC-32 byte by byte from a table made of its polynomial; near words by equal remainders after one deletion; chains by recursion.
ORACLE_SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE
steps(i, c, k) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w
  FROM documents),
each_run AS (SELECT d, w, count(*) AS m FROM runs GROUP BY ALL),
bytes AS (
  SELECT d, w, m, flatten(list_transform(string_split(d || ':' || w, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 | (unicode(ch) >> 6) AS BIGINT), CAST(128 | (unicode(ch) & 63) AS BIGINT)] END)) AS b
  FROM each_run),
hashed AS (
  SELECT w, m, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, tab),
cutting AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, m FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM cutting WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
named AS (SELECT b.word, b.n_near, b.top, min(p.near) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.n = b.top GROUP BY ALL),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN near END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN named USING (word)),
chain(word, here) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.here AND e.form IS NULL
"""

#: Water-filling by prefix sums over caps per weight; slots by exact whole numbers; what a document gives by its place on the line.
ORACLE_SQL["op13_source_mix"] = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank, 3 * source_size AS cap FROM sources),
weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM ranked),
filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open, sum(source_size) OVER () AS whole
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((whole - capped) / open, cap / weight) AS share FROM filled WHERE cap >= weight * ((whole - capped) / open)),
aims AS (
  SELECT f.source, f.source_size, f.rank, f.whole, CASE WHEN cap < weight * share THEN CAST(cap AS DOUBLE) ELSE weight * share END AS target FROM filled f, level),
widths AS (SELECT *, CAST(round(target / greatest(whole, 1) * 1099511627776.0) AS BIGINT) AS width FROM aims),
starts AS (SELECT source, rank, sum(width) OVER (ORDER BY rank) - width AS start, width FROM widths QUALIFY width > 0),
slots AS (
  SELECT CAST(CAST(i AS HUGEINT) * 679535556991 % 1099511627776 AS BIGINT) AS point
  FROM range(CAST(ceil((SELECT coalesce(sum(size), 0) FROM docs) / 64) AS BIGINT)) t(i)),
turns AS (SELECT s.rank, 64 * count(*) AS got FROM slots ASOF JOIN starts s ON slots.point >= s.start GROUP BY s.rank),
lines AS (
  SELECT d.*, a.rank, a.source_size, a.target, row_number() OVER (PARTITION BY d.doc_id, d.source, d.size) - 1 AS copy
  FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
keyed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || copy), 1, 15) AS BIGINT) AS key FROM lines),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id NULLS FIRST, copy ROWS UNBOUNDED PRECEDING) - size AS start FROM keyed)
SELECT doc_id, size, p.source_size, target,
  CAST(coalesce(greatest(0, least(size, got - start)) + greatest(0, least(size, got - start - p.source_size))
    + greatest(0, least(size, got - start - 2 * p.source_size)), 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN turns t ON t.rank = p.rank
"""
