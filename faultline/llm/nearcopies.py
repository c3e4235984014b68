"""Near copies by word shingles: SimHash balls and min-hash bands propose pairs, the shingles themselves decide.

Texts are sets of five-word shingles; two are near copies if their Jaccard similarity is 4/5 or more.  Equal sets
are one node.  Pairs are proposed in three steps, each looking only at what the ones before left in different components:

* SimHash by meet-in-the-middle balls, as in :mod:`simhash`: neighbours among the fingerprints around a variant;
* ``BANDS`` bands of ``ROWS`` min-hashes, because a ball of a radius that can be emitted holds few pairs at 4/5; neighbours in a bucket.
  A pair at the bound shares no bucket about 26 times in a million;
* nodes of a bucket that still holds several components: an exact similarity join by prefixes in order of
  rarity, so a group of texts that are alike, but by less than 4/5, is not compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import rows_of, small_side, stash, stash_texts, text_key, without, words_of
from .components import components

SHINGLE_WORDS, BANDS, ROWS, SEED, _CHUNK = 5, 20, 4, 42, 2048
#: Nodes up to which a list of them is broadcast to find their texts.
SMALL_NODES = 100_000
#: Shingle hashes that a verifying task remembers from batch to batch.
REMEMBERED = 1 << 22
#: Cells by which the sets of a pair are compared before the pair is proposed.
CELLS = 128
#: Growth of set sizes from one class of the similarity join to the next.
CLASS_STEP = 1.05
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's five-word shingles; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` min-hashes of 32 bits."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), _CHUNK):
        spread = short[at : at + _CHUNK] * _FACTORS
        spread += _SHIFTS
        np.minimum(low, spread.min(axis=1), out=low)
    return low


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 9 * both >= 4 * (len(a) + len(b))


def signed(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, node, fp, bands)``: a hash of the text; its shingle set, 0 without words; its SimHash; bucket keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, bands = [], [], []
            for (text,) in rows_of([batch], "text"):
                hashes = shingle_hashes(text)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0)
                prints.append(simhash.majority(hashes))
                rows = signature(hashes).reshape(BANDS, ROWS) if len(hashes) else []
                bands.append(np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64))
            found = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *found, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "node", "fp", "bands"])

    narrow = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return narrow.mapInArrow(run, f"doc_id {kind}, key long, node long, fp long, bands array<long>")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes(node, key)`` with a text of each: equal keys have equal texts, so any will do."""
    met = docs.select(text_key(F.col("text")).alias("__key"), "text").join(small_side(nodes, SMALL_NODES), F.col("__key") == F.col("key"))
    return met.groupBy("node").agg(F.min("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle sets are similar enough, by the texts themselves."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = stash(_texts(docs, nodes.select("node", "key").join(used, "node", "left_semi")), "near-texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def hashes(node: int, text: str) -> np.ndarray:
            if node not in known:
                known[node] = shingle_hashes(text)
            return known[node]

        for batch in batches:
            keep = [similar(hashes(a, x), hashes(b, y)) for a, b, x, y in rows_of([batch], "a", "b", "ta", "tb")]
            if sum(map(len, known.values())) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stash_texts(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "near-edges")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes with the same or a linked SimHash; a fingerprint stands for its smallest node."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = simhash.links(first.select("fp")).join(first.toDF("a", "na"), "a").join(first.toDF("b", "nb"), "b")
    return same.union(met.select("na", "nb"))


def _by_prefix(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``members(node, key, root)`` of different roots that may be similar: no similar pair is missing.

    In an order of all shingles, rarest first, the first shingle that a similar pair shares lies so early in both sets that
    the rest can hold the overlap: in the first ninth of the smaller set, and in a place of the larger one that bounds the
    sizes it can be paired with.  Sizes meet by classes, so shingles that a whole group shares late in its order pair nothing.
    Of pairs that meet, those go whose shingles, counted in ``CELLS`` cells by hash, differ in more places than a ninth of both
    sizes: the sets themselves then differ in more.
    """
    texts = _texts(docs, members.select("node", "key")).join(members.select("node", "root"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t) for (t,) in rows_of([batch], "text")]
            cells = [np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) for h in found]
            arrays = [pa.array([len(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), *arrays], ["node", "root", "n", "hashes", "cells"])

    sets = stash_texts(texts.select("node", "root", "text").mapInArrow(run, "node long, root long, n long, hashes array<bigint>, cells array<int>"), "near-shingles")
    each = sets.select("node", "n", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("often"))
    ranked = each.join(often, "h").withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("often", "h")))
    ranked = ranked.filter("often > 1 and i <= n - (4 * n + 4) div 5 + 1").select("node", "h", "i")
    ranked = stash(ranked.join(sets.select("node", "root", "n", "cells"), "node"), "near-prefixes")
    size_class = lambda size: F.floor(F.log(size) / F.lit(float(np.log(CLASS_STEP)))).cast("int")
    small = ranked.filter("i <= n - (8 * n + 8) div 9 + 1").select("h", size_class(F.col("n")).alias("class"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    large = ranked.withColumns({"least": F.expr("(4 * n + 4) div 5"), "most": F.least("n", F.expr("(9 * (n - i + 1) - 4 * n) div 4"))}).filter("least <= most")
    classes = F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most"))))
    large = large.select("h", classes.alias("class"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), "least", "most", F.col("cells").alias("cb"))
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    near = (F.col("ra") != F.col("rb")) & F.col("na").between(F.col("least"), F.col("most")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b"))) & (apart * 9 <= F.col("na") + F.col("nb"))
    met = small.withColumnsRenamed({"h": "h1", "class": "class1"}).join(large, (F.col("h") == F.col("h1")) & (F.col("class") == F.col("class1")) & near)
    return met.select("a", "b").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, key, component_id``: a hash of its text, and the smallest id reachable over pairs of near copies.

    Texts without words are copies of each other.  Whole texts count, of any length.  Repeated rows each give a
    row; rows that share an id but not the text are nodes of their own; a null id is ignored as a smallest id and is
    null only where its whole component has no other; no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    prints = stash_texts(signed(docs), "near-prints")
    nodes = stash(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("node")
    shared = banded.withColumns({"before": F.lag("node").over(order), "after": F.lead("node").over(order)})
    shared = stash(shared.filter("before is not null or after is not null").select("node", "bucket", "before"), "near-buckets")
    beside = shared.filter("before is not null").select(F.col("before").alias("a"), F.col("node").alias("b"))
    tried = stash(beside.union(_by_simhash(nodes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-tried")
    edges = _verified(tried, docs, nodes)
    rooted = shared.select("node", "bucket").join(components(edges), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    span = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    mixed = rooted.join(span.filter("lo < hi and n > 2").select("bucket"), "bucket", "left_semi").select("node", "root").distinct()
    members = stash(mixed.join(nodes.select("node", "key"), "node"), "near-mixed")
    rest = stash(_by_prefix(docs, members).join(tried, ["a", "b"], "left_anti"), "near-rest")
    edges = edges.union(_verified(rest, docs, nodes))
    named = nodes.select("node", "low").join(components(edges), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.select("doc_id", "key", "node").join(named.join(lowest, "root").select("node", "component_id"), "node").select("doc_id", "key", "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns.

    Null ids stay, and so do equal rows of a kept id; of rows that share an id, only those go whose own text is a copy.
    """
    return without(docs, near_copies(docs).filter("doc_id > component_id"))
