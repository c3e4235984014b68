"""Queries of text operators: tables, chunks, citations, histories, intents, prompts and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import datasets, text
from ..session import table
from .registry import query


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as failure-mode rows: every field is made from a part's columns."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS key", "concat('TE-', 300 + p_partkey % 12) AS tag", "p_brand AS system", "p_type AS failure_mode", "p_name AS cause",
        "p_size % 12 AS severity", "p_partkey % 10 + 1 AS occurrence", "p_size % 9 + 1 AS detection",
    )


PARTS = """SELECT p_partkey AS key, 'TE-' || (300 + p_partkey % 12) AS tag, p_brand AS system, p_type AS failure_mode, p_name AS cause,
  (p_size % 12)::INT AS severity, (p_partkey % 10 + 1)::INT AS occurrence, (p_size % 9 + 1)::INT AS detection FROM part"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document per part: text, a table with header, separator, one full and one short row."""
    row = "concat('| ', tag, ' | ', system, ' | ', failure_mode, ' | ', cause, ' | ', severity, '.7 | ', occurrence, ' | x', detection, ' |')"
    doc = f"concat('# Part\\n\\nSome text | with pipe\\n| Tag | System | failure_mode | cause | Severity | occurrence | detection |\\n|---|---|---|---|---|---|---|\\n', {row}, '\\n| short | row |\\n')"
    return parts(spark, sf_dir).selectExpr("key", f"{doc} AS text")


SENTENCE = fixed.ROW_SENTENCE.replace("'", "''")


def sentence(**fields: str) -> str:
    """SQL for the row sentence."""
    order = ("system", "tag", "failure_mode", "effect", "severity", "cause", "controls", "detection", "rpn")
    pieces = SENTENCE.replace("%d", "%s").split("%s")
    out = f"'{pieces[0]}'"
    for name, piece in zip(order, pieces[1:]):
        out += f" || {fields[name]} || '{piece}'"
    return out


@query(
    f"""WITH p AS ({PARTS}) SELECT key, {sentence(system="system", tag="tag", failure_mode="failure_mode", effect="'N/A'", severity="severity", cause="cause", controls="'N/A'", detection="0", rpn="0")} AS page_content,
  tag, system, severity, occurrence, 0 AS detection, 0 AS rpn FROM p"""
)
def md_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01 to TXT-04, WIN-12: a severity of ``5.7`` is cut to 5, a detection of ``x3`` counts as 0."""
    rows = text.table_rows(tables(spark, sf_dir), "key", "text")
    return text.rewritten(rows).select("key", "page_content", "tag", "system", "severity", "occurrence", "detection", "rpn")


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts rewritten as sentences, from parsed rows."""
    names = ("tag", "system", "failure_mode", "cause", "severity", "occurrence", "detection")
    row = F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string"))))
    return text.rewritten(parts(spark, sf_dir).select("key", row.alias("row"))).drop("row")


@query(
    f"""WITH p AS ({PARTS}) SELECT key, {sentence(system="system", tag="tag", failure_mode="failure_mode", effect="'N/A'", severity="severity", cause="cause", controls="'N/A'", detection="detection", rpn="(severity * occurrence * detection)")} AS page_content, severity * occurrence * detection AS rpn FROM p"""
)
def rewrite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03 to TXT-05."""
    return declared(spark, sf_dir).select("key", "page_content", "rpn")


@query(
    """SELECT doc_id, i::INT AS piece, CASE WHEN length(text) <= 1500 THEN text ELSE substr(text, i * 1400 + 1, 1500) END AS text
FROM documents, LATERAL (SELECT unnest(range(CASE WHEN length(text) <= 1500 THEN 1 ELSE (length(text) - 1) // 1400 + 1 END)) AS i)"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-06."""
    return text.split_long(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "piece", "text")


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading of level 1 to 4 put before every third line."""
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 1, F.concat(F.repeat(F.lit("#"), i % 4 + 1), F.lit(" H"), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))


@query(
    """WITH l AS (SELECT doc_id, i, x FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS (SELECT doc_id, i * 2 + 1 AS i, x FROM l UNION ALL SELECT doc_id, i * 2, repeat('#', (i % 4 + 1)::INT) || ' H' || i FROM l WHERE i % 3 = 1),
h AS (SELECT *, length(regexp_extract(trim(x, ' '), '^(#*)', 1)) IN (1, 2, 3) AS head FROM m),
c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk FROM h)
SELECT doc_id, chunk, coalesce(max(CASE WHEN head THEN trim(regexp_replace(trim(x, ' '), '^#+', ''), ' ') END), '') AS heading, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS page_content FROM c GROUP BY doc_id, chunk"""
)
def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-07, WIN-11."""
    return text.heading_chunks(headed(spark, sf_dir), "doc_id", "text")


@query(f"SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM benchmark) AS n, (SELECT count(*) FROM part) AS declarative")
def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-08: sentences of parts and narrative items together."""
    narrative = text.heading_chunks(table(spark, sf_dir, "benchmark"), "item_id", "text").select("page_content", "heading")
    both = text.all_chunks(declared(spark, sf_dir).select("page_content", "tag", "system"), narrative)
    return both.agg(F.count("*").alias("n"), F.count("tag").alias("declarative"))


CITED = """SELECT conv_id, turn, text || CASE conv_id % 6 WHEN 0 THEN ' [Source: fmea_' || turn || '] TE-301 reads 85.0.' WHEN 1 THEN ' [FMEA #' || (conv_id % 50) || '] (source: doc a ).' WHEN 2 THEN ' [ref: R-1] [REF: R-1] 3 bars' WHEN 3 THEN ' Manual inspection of XX-999 and YY-123. [Source: bad]' WHEN 4 THEN ' Shutdown now! severity, occurrence, detection' ELSE '' END AS t FROM conversations"""


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with citations, tags and claims put in by conversation."""
    end = """CASE conv_id % 6 WHEN 0 THEN concat(' [Source: fmea_', turn, '] TE-301 reads 85.0.') WHEN 1 THEN concat(' [FMEA #', conv_id % 50, '] (source: doc a ).')
      WHEN 2 THEN ' [ref: R-1] [REF: R-1] 3 bars' WHEN 3 THEN ' Manual inspection of XX-999 and YY-123. [Source: bad]' WHEN 4 THEN ' Shutdown now! severity, occurrence, detection' ELSE '' END"""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"concat(text, {end}) AS t")


AUDIT = f"""
WITH c AS ({CITED}), e AS (SELECT *, list_sort(list_distinct(list_transform(
    regexp_extract_all(t, '(?i)\\[Source:\\s*([^\\]]+)\\]', 1) || regexp_extract_all(t, '(?i)\\[FMEA\\s*#([0-9]+)\\]', 1) || regexp_extract_all(t, '(?i)\\(Source:\\s*([^)]+)\\)', 1) || regexp_extract_all(t, '(?i)\\[Ref:\\s*([^\\]]+)\\]', 1), lambda x: trim(x)))) AS cited,
  len(list_filter(regexp_split_to_array(t, '[.!?\\n]+'), lambda s: trim(s) <> '' AND regexp_matches(s, '[A-Z]{{2,}}-[0-9]{{3}}|[0-9]')))::BIGINT AS n_claims FROM c),
f AS (SELECT *, list_filter(cited, lambda x: NOT list_contains(['fmea_0', 'fmea_1', 'fmea_2', 'R-1', 'doc a'], x)) AS invalid FROM e)
"""


@query(f"{AUDIT} SELECT conv_id, turn, n_claims, array_to_string(cited, '|') AS cited, array_to_string(invalid, '|') AS invalid, greatest(0, n_claims - len(cited)) AS uncited, greatest(0, n_claims - len(cited)) = 0 AND len(invalid) = 0 AS fully_cited FROM f")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-10 to TXT-12, JOI-04."""
    known = F.array(*map(F.lit, ("fmea_0", "fmea_1", "fmea_2", "R-1", "doc a")))
    out = text.citation_audit(cited(spark, sf_dir), "t", known)
    return out.select("conv_id", "turn", "n_claims", F.array_join("cited", "|").alias("cited"), F.array_join("invalid", "|").alias("invalid"), "uncited", "fully_cited")


@query(f"{AUDIT} SELECT conv_id, turn, round(CASE WHEN n_claims = 0 THEN 1 ELSE least(1, (len(cited) - len(invalid)) / n_claims::DOUBLE) END, 6)::DOUBLE AS citation_score FROM f")
def citation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13."""
    known = F.array(*map(F.lit, ("fmea_0", "fmea_1", "fmea_2", "R-1", "doc a")))
    return text.citation_audit(cited(spark, sf_dir), "t", known).select("conv_id", "turn", F.round("citation_score", 6).alias("citation_score"))


@query(
    """SELECT conv_id, turn, floor(c / 2.0 + (length(t) - c) / 4.0)::BIGINT AS tokens, CASE WHEN length(t) <= 240 THEN t ELSE '…[trimmed]…' || chr(10) || right(t, 240) END AS trimmed
FROM (SELECT conv_id, turn, t, length(t) - length(regexp_replace(t, '[\\x{4e00}-\\x{9fff}]', '', 'g')) AS c FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '温度报警' || text ELSE text END AS t FROM conversations))"""
)
def token_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-14, TXT-15, with a budget of 60 tokens."""
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("温度报警"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_estimate(t).alias("tokens"), text.trimmed_text(t, 60).alias("trimmed"))


@query(
    """WITH b AS (SELECT conv_id, turn, floor(length(text) / 4.0) AS own, length(role || ': ' || text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT *, floor((sum(len) OVER p + n - 1) / 4.0) AS total, 300 - floor((sum(CASE WHEN back <= 2 THEN len ELSE 0 END) OVER p + least(2, n) - 1) / 4.0) AS remaining,
  sum(CASE WHEN back > 2 THEN own ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM b WINDOW p AS (PARTITION BY conv_id))
SELECT conv_id, turn FROM w WHERE total <= 300 OR n <= 2 OR back <= 2 OR spent <= remaining"""
)
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16, WIN-09, with a budget of 300 tokens and two messages always kept."""
    return text.trim_history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 300, 2).select("conv_id", "turn")


@query(
    """WITH s AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(replace(text, chr(10), '. '), '. '), lambda x: trim(x, ' ')), lambda x: x <> '' AND (contains(lower(x), 'heron') OR contains(lower(x), 'edth') OR contains(lower(x), 'tion que'))) AS k FROM conversations),
g AS (SELECT conv_id, flatten(list(k ORDER BY turn)) AS ks, list(left(text, 200) ORDER BY turn) AS heads FROM s GROUP BY conv_id),
d AS (SELECT conv_id, array_to_string(CASE WHEN len(ks) > 0 THEN ks ELSE heads[greatest(len(heads) - 2, 1):] END, ' | ') AS digest FROM g)
SELECT conv_id, CASE WHEN length(digest) > 800 THEN left(digest, 797) || '…' ELSE digest END AS digest FROM d"""
)
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17, with words that occur here as keywords."""
    return text.summaries(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ("heron", "edth", "tion que"))


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(t), '{w.lower()}')::INT" for w in words)


ASKED = "SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Alarm high on TE-301: show status' WHEN 1 THEN 'what is the current value?' WHEN 2 THEN 'how to follow the SOP manual' WHEN 3 THEN text ELSE '' END AS t FROM conversations"
SHARES = f"WITH a AS ({ASKED}), h AS (SELECT *, {_hits(fixed.INTENTS['fmea_query'])} AS f, {_hits(fixed.INTENTS['status_check'])} AS s, {_hits(fixed.INTENTS['knowledge_query'])} AS k FROM a)"


@query(
    f"""{SHARES} SELECT conv_id, turn, CASE WHEN f + s + k = 0 THEN 'unknown' WHEN f = greatest(f, s, k) THEN 'fmea_query' WHEN s = greatest(f, s, k) THEN 'status_check' ELSE 'knowledge_query' END AS intent,
  round(CASE WHEN f + s + k = 0 THEN 0 ELSE greatest(f, s, k) / (f + s + k)::DOUBLE END, 6)::DOUBLE AS share FROM h"""
)
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19, AGG-09."""
    asked = F.when(F.col("conv_id") % 5 == 0, "Alarm high on TE-301: show status").when(F.col("conv_id") % 5 == 1, "what is the current value?").when(F.col("conv_id") % 5 == 2, "how to follow the SOP manual").when(F.col("conv_id") % 5 == 3, F.col("text")).otherwise("")
    label, share = text.intent(asked)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("intent"), F.round(share, 6).alias("share"))


@query(
    f"""WITH c AS ({CITED}), u AS (SELECT *, lower(t) AS l, list_distinct(regexp_extract_all(t, '[A-Z]{{2,}}-[0-9]{{3}}')) AS tags FROM c)
SELECT conv_id, turn, round(greatest(-2, least(2, CASE WHEN contains(t, '[Source:') OR contains(t, '[FMEA #') THEN 1 ELSE 0 END + CASE WHEN contains(l, 'manual inspection') THEN 0.5 ELSE 0 END
  + CASE WHEN {" OR ".join(f"contains(t, '{x}')" for x in fixed.TAGS)} THEN 0.3 ELSE -len(tags) END
  - CASE WHEN {" OR ".join(f"contains(l, '{x.lower()}')" for x in fixed.IRREVERSIBLE)} THEN 2 ELSE 0 END
  + CASE WHEN contains(l, 'severity') AND contains(l, 'occurrence') AND contains(l, 'detection') THEN 0.3 ELSE 0 END)), 6)::DOUBLE AS reward FROM u"""
)
def reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-22."""
    return cited(spark, sf_dir).select("conv_id", "turn", F.round(text.reward(F.col("t")), 6).alias("reward"))


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS n_terms FROM documents")
def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-09."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_terms"))


_EMPTY = text.few_shot(2).replace("'", "''")
_READ = "'{0}PT-301{1}1.5' || chr(10) || '{0}TE-301{1}' || severity::DOUBLE || chr(10)"


@query(
    f"""WITH p AS ({PARTS}) SELECT key,
  '{fixed.REFUSAL_SYSTEM.replace("'", "''")}' || chr(10) || '---' || chr(10) || '{_EMPTY}' || chr(10) || '---' || chr(10) || '## Current Situation' || chr(10) || 'Alarm tag: ' || tag || chr(10) || 'Current PLC readings:' || chr(10) || {_READ.format("  ", " = ")}
  || chr(10) || '## Retrieved FMEA Knowledge' || chr(10) || cause || chr(10) || chr(10) || '## Your Diagnostic Report (JSON format, with [Source:] citations)' || chr(10) AS refusal,
  '{fixed.TOPOLOGY_PREAMBLE.replace("'", "''")}' || '## Column Topology (relevant neighbors)' || chr(10) || '- (a) --[b]--> (c)' || chr(10) || chr(10) || 'Upstream equipment: ' || system || chr(10) || chr(10) || '## Current PLC Readings' || chr(10) || {_READ.format("- ", ": ")}
  || chr(10) || '## Retrieved FMEA Knowledge (MUST cite sources)' || chr(10) || cause || '{fixed.TOPOLOGY_INSTRUCTIONS.replace("'", "''")}' AS topology FROM p"""
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-20: refusal and topology prompts of each part's tag."""
    rows = parts(spark, sf_dir)
    readings = F.create_map(F.lit("TE-301"), F.col("severity").cast("double"), F.lit("PT-301"), F.lit(1.5))
    none = F.array().cast("array<string>")
    return rows.select("key", text.refusal_prompt(F.col("cause"), F.col("tag"), readings).alias("refusal"), text.topology_prompt(F.array("system"), none, F.array(F.lit("- (a) --[b]--> (c)")), F.col("cause"), readings).alias("topology"))


@query(f"SELECT {len(text.triples_text().splitlines())}::BIGINT AS lines, {len(text.few_shot(2))}::BIGINT AS few_shot_chars")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-20: fixed blocks."""
    return spark.range(1).select(F.size(F.split(F.lit(text.triples_text()), "\n")).cast("long").alias("lines"), F.length(F.lit(text.few_shot(2))).cast("long").alias("few_shot_chars"))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _fmt(template: str, *values: str) -> str:
    pieces = _q(template).replace("%%", "%").split("%s")
    return " || ".join([f"'{pieces[0]}'", *(x for v, p in zip(values, pieces[1:]) for x in (v, f"'{p}'"))])


_SENT = sentence(system="system", tag="tag", failure_mode="failure_mode", effect="'N/A'", severity="severity", cause="cause", controls="'N/A'", detection="detection", rpn="(severity * occurrence * detection)")


@query(
    f"""WITH p AS ({PARTS}), a AS (SELECT 0 AS part, key, {_fmt(fixed.SFT_INPUT, "tag", "system")} AS input, {_SENT} AS output FROM p
  UNION ALL SELECT 2, 0, {_fmt(fixed.SFT_REFUSAL_INPUT, "'FV-999'")}, {_fmt(fixed.SFT_REFUSAL, "'FV-999'", "'Tag not in asset dictionary'")})
SELECT '{_q(fixed.SFT_INSTRUCTION)}' AS instruction, input, output FROM (SELECT * FROM a ORDER BY part, key LIMIT 5000)"""
)
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-23: the first 5000 examples, the cap being the feature."""
    refusals = spark.createDataFrame([(0, "FV-999", "Tag not in asset dictionary")], "key long, tag string, reason string")
    return datasets.sft_rows(declared(spark, sf_dir), refusals=refusals, order="key")


@query(
    f"""WITH p AS ({PARTS}), a AS (SELECT 0 AS part, key, {_fmt(fixed.DPO_PROMPT, "tag", "system")} AS prompt,
  {_fmt(fixed.DPO_CHOSEN.replace("%.2f", "%s"), "'fmea_' || key", _SENT, "'Check ' || tag", "'0.75'")} AS chosen, {_fmt(fixed.DPO_REJECTED, "tag")} AS rejected FROM p
  UNION ALL SELECT 1, 0, {_fmt(fixed.DPO_REFUSAL_PROMPT, f"'{_q(fixed.DPO_REFUSAL[0])}'", f"'{_q(fixed.DPO_REFUSAL[1])}'")}, '{_q(fixed.DPO_REFUSAL[2])}', '{_q(fixed.DPO_REFUSAL[3])}')
SELECT prompt, chosen, rejected FROM (SELECT * FROM a ORDER BY part, key LIMIT 2000)"""
)
def dpo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-24: the first 2000 pairs, the cap being the feature."""
    chunks = declared(spark, sf_dir).withColumns({"source": F.concat(F.lit("fmea_"), "key"), "recommended_action": F.concat(F.lit("Check "), "tag"), "confidence": F.lit(None).cast("double")})
    return datasets.dpo_rows(chunks, order="key")
