"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that lies within ``radius / 2`` of both.  Each distinct
fingerprint emits its whole ball of that half radius; equal variants meet in a shuffle.  A variant's bucket
holds distinct fingerprints of one small ball (65 at most for radius 2), so buckets are bounded by geometry, and
exact copies, which share a fingerprint, never multiply.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, stash, stash_texts, text_key, without, words_of
from .components import components

SHINGLE_WORDS, RADIUS, SEED, _CHUNK = 3, 2, 42, 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half the shingles' XXH64 hashes; no words give 0."""
    words = words_of(text)
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, count))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of unsigned 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, key, fp)``: one row per input row, a hash of its text and the fingerprint as a signed long.  Null text counts as empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t, shingle) for (t,) in rows_of([batch], "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(got.view(np.int64))], ["doc_id", "key", "fp"])

    narrow = docs.select(F.col(id_column).alias("doc_id"), text_key(F.col(text_column)).alias("key"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, key long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp)`` distinct -> edges ``(a, b)`` that keep every component of the "``radius`` or fewer bits" graph.

    Within a bucket, neighbours in sorted order are linked: all members lie within ``radius`` of each other, so
    the chain spans the bucket, and no bucket is gathered or squared.
    """
    masks = [0] + [sum(1 << i for i in bits) for k in range(1, radius // 2 + 1) for bits in combinations(range(64), k)]
    if radius % 2:
        raise ValueError("the radius must be even: the ball is halved")
    ball = F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(m)).cast("long")) for m in masks))
    met = distinct.select("fp", F.explode(ball).alias("variant"))
    near = met.withColumn("a", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    return (
        near.filter(F.col("a").isNotNull() & (F.col("a") != F.col("fp")))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius)
        .select("a", F.col("fp").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """One row per document: ``doc_id, key, fingerprint, component_id``; ``key`` is a hash of its text.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id reachable over links of
    ``radius`` or fewer differing bits, itself included.  Null and empty texts have fingerprint zero and link
    like any other; repeated rows and ids each give a row; a null id is ignored as a smallest id and is null
    only where its whole component has no other; whole texts count, of any length; no rows give no rows.
    Other columns are not read.
    """
    prints = stash_texts(fingerprints(docs, id_column, text_column, shingle), "simhash")
    first = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    root = components(links(first.select("fp"), radius))
    rooted = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns.

    Null ids stay, and so do equal rows of a kept id; of rows that share an id, only those go whose own text is a copy.
    """
    return without(docs, near_duplicates(docs).filter("doc_id > component_id"))
