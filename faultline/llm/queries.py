"""The operators over the standard tables: one query each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, langid, linedup, lm, mixing, quality, simhash, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "inline(array(struct(0L, 'user'), struct(1L, 'assistant'))) as (turn, role)"
    probe = spark.range(1).selectExpr("-1L as conv_id", probe).withColumn("text", F.lit("</s>[INST] ok [/INST]"))
    return chat.formatted_digest(given.unionByName(probe))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_ann": op4_ann,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_langid": op8_langid,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {}

ORACLES["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT DISTINCT doc_id, md5(text) AS mark, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), win AS (
  SELECT doc_id, mark, i - 1 AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k
  FROM lines, LATERAL (SELECT unnest(range(1, len(ls) - 1)) AS i)
  WHERE trim(ls[i], ' ') <> '' OR trim(ls[i + 1], ' ') <> '' OR trim(ls[i + 2], ' ') <> ''
), ranked AS (
  SELECT doc_id, mark, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, mark, pos) AS r FROM win
), gone AS (
  SELECT DISTINCT doc_id, mark, pos + o AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS o) WHERE r > 1
), kept AS (
  SELECT l.doc_id, l.mark, l.i, l.line, g.pos IS NOT NULL AS cut
  FROM (SELECT doc_id, mark, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM lines) l
  LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.mark = l.mark AND g.pos = l.i
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, mark, string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut) AS text,
         count(*) AS n_lines, count(*) FILTER (cut) AS n_removed
  FROM kept GROUP BY doc_id, mark) k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.mark = md5(d.text)
"""

ORACLES["op9_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap,
         sum(source_size) OVER ()::BIGINT AS total FROM per
), rising AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_weight
  FROM weighted
), level AS (
  SELECT (arg_min(rest::DOUBLE / rest_weight, (ratio, place))) AS line FROM rising WHERE rest::DOUBLE / rest_weight * weight <= cap
), goals AS (
  SELECT source, source_size, cap, place, total, least(cap::DOUBLE, coalesce(line * weight, cap::DOUBLE)) AS target FROM rising, level
), block AS (
  SELECT greatest(1, ceil(max(total) / {mixing.SLOTS}.0))::BIGINT AS block FROM goals
), cum AS (
  SELECT *, sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_to FROM goals
), shares AS (
  SELECT *, CASE WHEN run_to < max(run_to) OVER () THEN run_to / max(run_to) OVER () ELSE 1.0::DOUBLE END AS hi FROM cum
), bounds AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY place), 0.0::DOUBLE) AS lo FROM shares
), slots AS (
  SELECT b.place, count(*) AS slots
  FROM (SELECT i * {mixing.GOLDEN}::DOUBLE - floor(i * {mixing.GOLDEN}::DOUBLE) AS point
        FROM range((SELECT ceil(max(total) / any_value(block))::BIGINT FROM goals, block)) t(i)) p
  JOIN bounds b ON p.point >= b.lo AND p.point < b.hi GROUP BY b.place
), words AS (
  SELECT b.*, least(cap, coalesce(slots, 0) * block)::BIGINT AS words FROM bounds b LEFT JOIN slots USING (place), block
), placed AS (
  SELECT doc_id, s.source, size, w.source_size, target, words,
    coalesce(sum(size) OVER (PARTITION BY place ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN words w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN source_size > 0 THEN (words // source_size) * size + greatest(0, least(words % source_size, start + size) - start) ELSE 0 END::BIGINT AS taken
FROM placed
"""
