"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, html_extract, kneser_ney, language_id, line_dedup, mixing, near_dedup, quality_knn, quality_rules, token_counts
from .common import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, "byte_bpe_50k.json").drop("text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    model = kneser_ney.fit(docs.where(~held_out))
    return kneser_ney.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out))
    return quality_knn.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_mix_sources, op3_html_text, op4_token_counts, op5_language_id,
        op6_quality_rules, op7_kneser_ney, op8_near_dedup, op9_line_dedup, op10_quality_knn,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
r AS (SELECT *, 'd' || (('0x' || substr(md5(source), 1, 8))::BIGINT % 4) AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, sum(n) * 3.0::DOUBLE AS cap, 1.0::DOUBLE AS w FROM r GROUP BY ALL),
ln AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaf GROUP BY ALL),
dm AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM ln GROUP BY domain),
b0 AS (SELECT floor(sum(n) * 0.5)::DOUBLE AS b FROM r),
a1 AS (SELECT dm.*, (b - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h FROM dm, b0),
b1 AS (SELECT domain, least(cap, w * greatest(0, max(h) OVER ())) AS b FROM a1),
a2 AS (SELECT ln.*, (b - coalesce(sum(cap) OVER (PARTITION BY ln.domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY ln.domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h FROM ln JOIN b1 USING (domain)),
b2 AS (SELECT domain, lang, least(cap, w * greatest(0, max(h) OVER (PARTITION BY domain))) AS b FROM a2),
a3 AS (SELECT leaf.*, (b - coalesce(sum(cap) OVER (PARTITION BY leaf.domain, leaf.lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY leaf.domain, leaf.lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h
    FROM leaf JOIN b2 ON leaf.domain = b2.domain AND leaf.lang = b2.lang),
b3 AS (SELECT domain, lang, source, tokens, floor(round(least(cap, w * greatest(0, max(h) OVER (PARTITION BY domain, lang))), 3))::BIGINT AS b FROM a3),
f AS (SELECT *, b // tokens AS whole, b % tokens AS rest FROM b3 WHERE b > 0 AND tokens > 0),
o AS (SELECT r.*, whole, rest, sum(n) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY md5('mix-1:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM r JOIN f ON r.domain = f.domain AND r.lang = f.lang AND r.source = f.source),
t AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(times)) AS epoch FROM t WHERE times > 0""",
    "op6_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[!?|_~^=]', '', 'g')) AS n_marks
    FROM w LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
x AS (SELECT doc_id, stratum, base_failed, unnest([
    {'m': 'symbol_ratio', 'x': n_symbols::DOUBLE / greatest(n_words, 1)}, {'m': 'mark_ratio', 'x': n_marks::DOUBLE / greatest(n_words, 1)},
    {'m': 'upper_ratio', 'x': n_upper::DOUBLE / greatest(word_chars, 1)}, {'m': 'dup_line_ratio', 'x': n_dup_lines::DOUBLE / greatest(n_lines, 1)},
    {'m': 'word_length', 'x': word_chars::DOUBLE / greatest(n_words, 1)}], recursive := true) FROM b),
c AS (SELECT m, unnest(c) AS c FROM (VALUES
    ('symbol_ratio', [2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05]::DOUBLE[]), ('mark_ratio', [2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05]::DOUBLE[]),
    ('upper_ratio', [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15]::DOUBLE[]), ('dup_line_ratio', [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]::DOUBLE[]),
    ('word_length', [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]::DOUBLE[])) v(m, c)),
k AS (SELECT stratum, x.m, c, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND x > c) AS k,
    count(*) FILTER (WHERE quality = 0) AS nb, count(*) FILTER (WHERE quality = 0 AND x > c) AS kb
    FROM x JOIN labels USING (doc_id) JOIN c ON x.m = c.m WHERE NOT base_failed AND quality IS NOT NULL GROUP BY ALL),
p AS (SELECT *, CASE WHEN n = 0 OR k > n * 0.004 THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - lgamma(n - j + 1) + j * ln(0.004) + (n - j) * ln(0.996)) FOR j IN range(k + 1)]) END AS p FROM k),
s AS (SELECT count(DISTINCT stratum) AS s FROM b),
o AS (SELECT p.*, bool_and(p <= 0.05 / (s * 5)) OVER (PARTITION BY stratum, m ORDER BY c DESC) AS ok FROM p, s),
z AS (SELECT stratum, m, min(c) AS c FROM o WHERE ok AND nb > 0 AND kb > 0 AND kb * n >= 10.0 * k * nb GROUP BY ALL),
j AS (SELECT doc_id, bool_or(z.c IS NOT NULL AND x > z.c) AS out FROM x LEFT JOIN z ON x.stratum = z.stratum AND x.m = z.m GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT j.out AS kept FROM b JOIN j USING (doc_id)""",
    "op8_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * shared >= 80 * (na + nb - shared)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON s.doc_id = m.a""",
    "op9_line_dedup": rf"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id""",
}
