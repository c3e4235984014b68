"""Queries of retrieval and of the causal graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import graph, retrieval
from ..session import table
from .registry import query


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of keyword search: every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of vector search: every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def asked_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of hybrid search: every benchmark item that has a vector of the same id."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return asked(spark, sf_dir).join(vectors, "query_id")


def bm25_sql(condition: str = "true") -> str:
    return f"""
t AS (SELECT doc_id, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS term FROM benchmark WHERE {condition}) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, sum(qtf * greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN d USING (term) JOIN q USING (term), n GROUP BY ALL HAVING score > 0),
sparse AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank0 FROM s QUALIFY rank0 < 50)
"""


def dense_sql(condition: str) -> str:
    return f"""
v AS (SELECT a.vec_id AS doc_id, b.vec_id AS query_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS score FROM embeddings a, embeddings b WHERE {condition}),
dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank0 FROM v WHERE score > 0 QUALIFY rank0 < 50)
"""


ALL_BM25, BM25, DENSE = bm25_sql(), bm25_sql("item_id IN (SELECT vec_id FROM embeddings)"), dense_sql("b.vec_id IN (SELECT item_id FROM benchmark)")
FUSED = "f AS (SELECT query_id, doc_id, sum(w / (60 + rank0 + 1)) AS score FROM (SELECT *, 0.6::DOUBLE AS w FROM dense UNION ALL SELECT *, 0.4::DOUBLE FROM sparse) GROUP BY ALL)"


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.withColumn("score", F.round("score", digits)).withColumn("rank0", F.col("rank0").cast("long"))


@query(f"WITH {ALL_BM25} SELECT query_id, doc_id, round(score, 8) AS score, rank0 FROM sparse")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-01, RET-02, AGG-04, AGG-12, WIN-10."""
    return _rounded(retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", asked(spark, sf_dir)))


@query(f"WITH {dense_sql('b.vec_id % 50 = 0')} SELECT query_id, doc_id, round(score, 8) AS score, rank0 FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-03."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return _rounded(retrieval.dense(vectors, "doc_id", "embedding", asked_vectors(spark, sf_dir)))


def _hybrid(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _rounded(retrieval.hybrid(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "embeddings"), "vec_id", "embedding", asked_both(spark, sf_dir), **options))


@query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, doc_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank0 FROM f QUALIFY rank0 < 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-04, RET-06, JOI-06."""
    return _hybrid(spark, sf_dir)


@query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, doc_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank0 FROM f JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY rank0 < 10")
def rrf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-05: the condition holds after fusion, before the limit."""
    return _hybrid(spark, sf_dir, condition=F.col("lang") == "en")


PRE_BM25 = BM25.replace("FROM documents)", "FROM documents WHERE lang = 'en')", 1)


@query(
    f"""WITH {PRE_BM25}, {DENSE}, kept AS (SELECT dense.* FROM dense JOIN documents USING (doc_id) WHERE lang = 'en'), {FUSED.replace("FROM dense", "FROM kept")}
SELECT query_id, doc_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank0 FROM f QUALIFY rank0 < 10"""
)
def rrf_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-05, with the condition before the search."""
    return _hybrid(spark, sf_dir, condition=F.col("lang") == "en", prefilter=True)


WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"


@query(
    f"""WITH {ALL_BM25}, r AS (SELECT sparse.query_id, sparse.doc_id, rank0, {WORDS.format("b.text")} AS a, {WORDS.format("d.text")} AS t FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = sparse.query_id WHERE rank0 < 20),
o AS (SELECT query_id, doc_id, rank0, len(list_intersect(a, t)) / len(a)::DOUBLE AS s FROM r)
SELECT query_id, doc_id, round(s, 6) AS rerank_score FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank0, doc_id) <= 5"""
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-08, with the lexical scorer."""
    hits = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", asked(spark, sf_dir))
    texts = hits.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(asked(spark, sf_dir).select("query_id", "query"), "query_id")
    return retrieval.rerank(texts, "doc_id", "query", "text").select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("SELECT item_id, length(t) - length(replace(t, 'a', '')) AS a, length(t) - length(replace(t, 'u', '')) AS u FROM (SELECT item_id, 'query: ' || text AS t FROM benchmark)")
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-09, with a hook that counts vowels."""
    def letters(texts):
        return texts.map(lambda t: [float((t or "").count(c)) for c in "aeiou"])
    return retrieval.embed(table(spark, sf_dir, "benchmark"), "text", letters, prefix="query: ").select("item_id", F.get("embedding", F.lit(0)).cast("long").alias("a"), F.get("embedding", F.lit(4)).cast("long").alias("u"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def meta_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-07."""
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return table(spark, sf_dir, "documents").filter(retrieval.matches(meta, {"lang": "en", "source": "src1"})).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src1'")
def meta_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-07."""
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return table(spark, sf_dir, "documents").filter(retrieval.matches(meta, {"lang": "de", "source": "src1"}, every=False)).select("doc_id")


@query("SELECT DISTINCT source FROM documents WHERE source <> '' AND source <> 'N/A'")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06."""
    return graph.distinct_names(table(spark, sf_dir, "documents"), "source")


def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as failure-mode rows: tag, system by nation, mode by balance, cause by key, action by nation."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS at", "s_name AS tag", "concat('N', s_nationkey) AS system", "concat('FM', cast(abs(s_acctbal) as bigint) % 5) AS failure_mode",
        "IF(s_suppkey % 4 = 0, '', concat('RC', s_suppkey % 7)) AS root_cause", "IF(s_suppkey % 3 = 0, null, concat('MT', s_nationkey % 3)) AS mitigation",
        "cast(s_suppkey % 10 + 1 as int) AS severity", "cast(s_suppkey % 100 as int) AS rpn",
    )


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.load(failure_rows(spark, sf_dir), "at")


ROWS = """r AS (SELECT s_suppkey AS id, s_name AS tag, 'N' || s_nationkey AS system, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'RC' || (s_suppkey % 7) END AS root_cause,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'MT' || (s_nationkey % 3) END AS mitigation, s_suppkey % 10 + 1 AS severity FROM supplier),
m AS (SELECT id, tag, system, 'FM' || (floor(abs(s_acctbal))::BIGINT % 5) AS fm, root_cause, mitigation, severity FROM r JOIN supplier ON s_suppkey = id),
e AS (SELECT 'sensor|' || tag || '|' || system AS src, 'failure_mode|' || fm || '|' || system AS dst, severity / 10.0::DOUBLE AS weight FROM m
  UNION ALL SELECT 'failure_mode|' || fm || '|' || system, 'root_cause|' || root_cause || '|' || system, 0.9 FROM m WHERE root_cause <> ''
  UNION ALL SELECT 'root_cause|' || root_cause || '|' || system, 'mitigation|' || mitigation || '|' || system, 0.8 FROM m WHERE root_cause <> '' AND mitigation IS NOT NULL),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"""


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.concat_ws("|", "node_type", "tag", "system").alias("node"))


@query(f"WITH {ROWS} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-02, AGG-13."""
    return graph.counts(*built(spark, sf_dir))


@query(f"WITH {ROWS} SELECT src, dst, round(weight, 6) AS weight, count(*) AS n FROM b GROUP BY ALL")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-01: links in both directions."""
    nodes, edges = built(spark, sf_dir)
    names = _named(nodes)
    both = graph.paired(graph.checked(edges, nodes))
    out = both.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return out.groupBy(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {ROWS}, w AS (SELECT DISTINCT src, dst FROM b WHERE weight >= 0.3),
s AS (SELECT node AS seed, node, 0 AS depth FROM n WHERE node LIKE 'sensor|%' UNION SELECT s.seed, w.dst, s.depth + 1 FROM s JOIN w ON w.src = s.node WHERE s.depth < 3)
SELECT seed, node, min(depth)::INT AS depth FROM s WHERE node <> seed GROUP BY ALL"""
)
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-03, GRA-04: from every sensor at once."""
    nodes, edges = built(spark, sf_dir)
    seeds = nodes.filter("node_type = 'sensor'").select(F.col("node_id").alias("seed"))
    found = graph.search(graph.paired(edges), seeds, 3, 0.3)
    names = _named(nodes)
    return found.join(names, "node_id").join(names.toDF("seed", "s"), "seed").select(F.col("s").alias("seed"), "node", "depth")


@query(
    f"""WITH RECURSIVE {ROWS}, s AS (SELECT node AS root, node FROM n UNION SELECT s.root, b.dst FROM s JOIN b ON b.src = s.node)
SELECT size, count(*) AS components FROM (SELECT least_node, count(*) AS size FROM (SELECT root, min(node) AS least_node FROM s GROUP BY root) GROUP BY least_node) GROUP BY size"""
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-05, AGG-14: how many components there are of each size."""
    nodes, edges = built(spark, sf_dir)
    sizes = graph.components(spark, nodes, edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


_LINES = "string_agg('    - ' || tag || ' [S=' || sev || '] (' || system || ')', chr(10) ORDER BY depth, tag, system) FILTER (kind = '{0}')"
_BLOCKS = " || ".join(f"coalesce(chr(10) || chr(10) || '  {label}:' || chr(10) || {_LINES.format(kind)}, '')" for kind, label in fixed.CAUSAL_LABELS)


@query(
    f"""WITH RECURSIVE {ROWS}, w AS (SELECT DISTINCT src, dst FROM b),
s AS (SELECT node AS seed, node, 0 AS depth FROM n WHERE node LIKE 'sensor|%' UNION SELECT s.seed, w.dst, s.depth + 1 FROM s JOIN w ON w.src = s.node WHERE s.depth < 3),
f AS (SELECT seed, node, min(depth) AS depth FROM s WHERE node <> seed GROUP BY ALL),
o AS (SELECT id, severity, 'sensor|' || tag || '|' || system AS node FROM m UNION ALL SELECT id, severity, 'failure_mode|' || fm || '|' || system FROM m UNION ALL SELECT id, severity, 'root_cause|' || root_cause || '|' || system FROM m WHERE root_cause <> ''
  UNION ALL SELECT id, severity, 'mitigation|' || mitigation || '|' || system FROM m WHERE root_cause <> '' AND mitigation IS NOT NULL),
v AS (SELECT node, arg_min(severity, id) AS sev FROM o GROUP BY node),
x AS (SELECT seed, depth, sev, split_part(node, '|', 1) AS kind, split_part(node, '|', 2) AS tag, split_part(node, '|', 3) AS system FROM f JOIN v USING (node))
SELECT split_part(seed, '|', 2) AS seed_tag, '[FMEA Bilinks Causal Retrieval] Seed, BFS depth <= 3:' || {_BLOCKS} AS context FROM x GROUP BY seed"""
)
def causal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-21, AGG-05."""
    nodes, edges = built(spark, sf_dir)
    seeds = nodes.filter("node_type = 'sensor'").select(F.col("node_id").alias("seed"))
    found = graph.search(graph.paired(edges), seeds, 3)
    names = nodes.select(F.col("node_id").alias("seed"), F.col("tag").alias("seed_tag"))
    return graph.context_text(found, nodes).join(names, "seed").select("seed_tag", F.regexp_replace("context", "Seed: -?[0-9]+", "Seed").alias("context"))


@query(f"WITH {ROWS} SELECT DISTINCT doc_id FROM documents WHERE 'Supplier#' || lpad((doc_id % 200)::VARCHAR, 9, '0') IN (SELECT tag FROM m) OR ('Supplier_' || (doc_id % 200)) IN (SELECT tag FROM m)")
def valid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-03: documents whose tag is in the causal graph."""
    nodes, _ = built(spark, sf_dir)
    one = F.concat(F.lit("Supplier#"), F.lpad((F.col("doc_id") % 200).cast("string"), 9, "0"))
    two = F.concat(F.lit("Supplier_"), (F.col("doc_id") % 200).cast("string"))
    hits = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(one, two)).alias("tag"))
    return retrieval.valid_hits(hits, nodes.filter("node_type = 'sensor'"), "tag").select("doc_id").distinct()
