"""Causal property graph: nodes, paired edges, breadth-first search, components (GRA, AGG-05, AGG-13, AGG-14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def reverse_relation(relation: Column) -> Column:
    """The name of a relation read backwards."""
    known = reduce(lambda c, kv: c.when(relation == kv[0], F.lit(kv[1])), fixed.REVERSE_RELATIONS.items(), F)
    return known.otherwise(F.concat(F.lit("reverse_"), relation))


def paired(edges: DataFrame) -> DataFrame:
    """GRA-01: every edge ``(src, dst, relation, weight)`` and its reverse."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), reverse_relation(F.col("relation")).alias("relation"), "weight")
    return edges.select("src", "dst", "relation", "weight").unionByName(back)


def checked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA-01: fails on an edge whose end is no node."""
    ids = nodes.select("node_id")
    met = edges.join(ids.withColumnRenamed("node_id", "__a"), F.col("src") == F.col("__a"), "left").join(ids.withColumnRenamed("node_id", "__b"), F.col("dst") == F.col("__b"), "left")
    fine = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("edge to an unknown node")).cast("long")).otherwise(F.col("src"))
    return met.withColumn("src", fine).drop("__a", "__b")


def load(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """GRA-02: nodes and directed links of ``(tag, system, failure_mode, root_cause, mitigation, severity, ...)`` rows.

    Rows without tag or failure mode are skipped.  A node is one (type, tag, system); it keeps the fields of the
    first row in ``order``.  Ids are 64-bit hashes of that identity, so no global numbering is needed.  Links
    are not deduplicated.
    """
    rows = rows.filter((F.coalesce("tag", F.lit("")) != "") & (F.coalesce("failure_mode", F.lit("")) != ""))
    rows = rows.withColumn("system", F.coalesce("system", F.lit("Unknown")))
    named = lambda kind, c: (F.lit(kind).alias("node_type"), F.col(c).alias("tag"))
    node = lambda kind, c: F.xxhash64(*named(kind, c), "system")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kinds = (("sensor", "tag", F.lit(True)), ("failure_mode", "failure_mode", F.lit(True)), ("root_cause", "root_cause", has("root_cause")), ("mitigation", "mitigation", has("root_cause") & has("mitigation")))
    every = F.filter(F.array(*(F.when(on, F.struct(node(k, c).alias("node_id"), *named(k, c))) for k, c, on in kinds)), lambda x: x.isNotNull())
    meta = F.struct(F.col("severity"), F.col("rpn"))
    spread = rows.select(order, "system", meta.alias("metadata"), F.inline(every))
    nodes = spread.groupBy("node_id").agg(F.min_by(F.struct("node_type", "tag", "system", "metadata"), order).alias("n")).select("node_id", "n.*")
    link = lambda a, b, rel, w, on: F.when(on, F.struct(a.alias("src"), b.alias("dst"), F.lit(rel).alias("relation"), w.cast("double").alias("weight")))
    links = F.array(
        link(node("sensor", "tag"), node("failure_mode", "failure_mode"), "observes", F.coalesce("severity", F.lit(1)) / 10.0, F.lit(True)),
        link(node("failure_mode", "failure_mode"), node("root_cause", "root_cause"), "caused_by", F.lit(0.9), has("root_cause")),
        link(node("root_cause", "root_cause"), node("mitigation", "mitigation"), "mitigated_by", F.lit(0.8), has("root_cause") & has("mitigation")),
    )
    return nodes, rows.select(F.inline(F.filter(links, lambda x: x.isNotNull())))


def search(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, min_weight: float = 0.0) -> DataFrame:
    """GRA-03, GRA-04: ``seed, node_id, depth``: nodes within ``max_depth`` hops, seeds left out, fewest hops.

    ``edges`` holds both directions (:func:`paired`) or one, to go forward only.  ``seeds(seed)``: all searches
    advance together, one join a hop; weak edges are dropped before.
    """
    strong = edges.filter(F.col("weight") >= min_weight).select("src", "dst").distinct()
    front = seeds.select("seed", F.col("seed").alias("node_id")).distinct()
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        reached = front.join(strong, front["node_id"] == strong["src"]).select("seed", F.col("dst").alias("node_id")).distinct()
        front = reached.join(seen, ["seed", "node_id"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.filter("depth > 0")


def components(spark, nodes: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """GRA-05, AGG-14: ``node_id, component``, the smallest node id that can be reached over edges in any direction.

    Every round joins labels to edges once and jumps to the label's label; labels are checkpointed to the
    configured folder, and rounds end when no label changes.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    reliable = spark.sparkContext.getCheckpointDir() is not None
    if not reliable and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    labels = nodes.select("node_id", F.col("node_id").alias("component"))
    for _ in range(max_rounds):
        near = both.join(labels, both["src"] == labels["node_id"]).groupBy("dst").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node_id"] == near["dst"], "left").select("node_id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = lower.select(F.col("node_id").alias("__n"), F.col("low").alias("__low"))
        fresh = lower.join(jump, lower["low"] == jump["__n"], "left").select("node_id", "component", F.least("low", F.coalesce("__low", "low")).alias("fresh"))
        held = fresh.persist()  # else the checkpoint would compute the round a second time
        fresh = held.checkpoint() if reliable else held
        moved = fresh.filter("fresh <> component").limit(1).count()
        if reliable:
            held.unpersist()
        labels = fresh.select("node_id", F.col("fresh").alias("component"))
        if not moved:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-13: ``nodes, edges``."""
    both = nodes.agg(F.count("*").alias("nodes")).unionByName(edges.agg(F.count("*").alias("edges")), allowMissingColumns=True)
    return both.agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))


def context_text(found: DataFrame, nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """TXT-21, AGG-05: ``seed, context``: reached nodes by type, in order of depth and name."""
    met = found.join(nodes, "node_id")
    severity = F.col("metadata")["severity"]
    line = F.concat(F.lit("    - "), "tag", F.when(severity.isNotNull(), F.format_string(" [S=%d]", severity)).otherwise(""), F.lit(" ("), "system", F.lit(")"))
    per = met.withColumn("line", line).groupBy("seed")
    blocks = [F.array_sort(F.collect_list(F.when(F.col("node_type") == kind, F.struct("depth", "tag", "system", "line")))).alias(kind) for kind, _ in fixed.CAUSAL_LABELS]
    lines = per.agg(*blocks)
    block = lambda kind, label: F.when(F.size(kind) > 0, F.concat(F.lit(f"\n\n  {label}:\n"), F.array_join(F.transform(kind, lambda x: x["line"]), "\n"))).otherwise("")
    head = F.format_string(fixed.CAUSAL_HEAD, F.col("seed").cast("string"), F.lit(max_depth))
    return lines.select("seed", F.concat(head, *(block(k, label) for k, label in fixed.CAUSAL_LABELS)).alias("context"))


def no_context(seed: Column) -> Column:
    """TXT-21: the text for a seed without entries."""
    return F.format_string(fixed.NO_CAUSAL_ENTRY, seed)


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """AGG-06: sorted distinct values, without empty ones and N/A."""
    return df.select(column).filter((F.coalesce(F.col(column), F.lit("")) != "") & (F.col(column) != "N/A")).distinct().orderBy(column)


def first_where(nodes: DataFrame, tag: str, order: str) -> DataFrame:
    """The first node in ``order`` with a tag, as a seed."""
    return nodes.filter(F.col("tag") == tag).withColumn("__r", F.row_number().over(Window.partitionBy("tag").orderBy(order))).filter("__r = 1").select(F.col("node_id").alias("seed"))
