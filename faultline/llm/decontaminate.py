"""Benchmark decontamination: a BM25 inverted index of test items searched with block-max WAND.

Every passage of every document is a query against the items.  Impacts are divided by each item's own
threshold, so "above threshold" is 1 for all.  The threshold is safe: it is the score that is left when the item
loses its most telling terms, as many as a shingle overlap of ``OVERLAP`` allows to be missing.  Retrieved pairs
are verified by the share of the item's five-word shingles found in the passage.  Passages follow the item alone: its
reach is the smallest power of two that its words fit in, and a passage is two reaches long, a reach apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import rows_of, stash_texts, text_key, without

SHINGLE, OVERLAP = 5, 0.8
K1, B, BLOCK = 1.2, 0.75, 64
#: Items of one index shard, which is built on the driver and broadcast; larger benchmarks take several shards.
SHARD_ITEMS = 20_000
#: ASCII letters and digits, and all bytes beyond ASCII, make words; the other ASCII bytes part them.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks around or inside words do not hide a match."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split() if text else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct five-word shingles; a shorter sequence is one shingle, an empty one has none."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE))))


def found_share(wanted: set, words: list[bytes], length: int) -> float:
    """Share of ``wanted`` shingles (of an item of ``length`` words) that occur in ``words``."""
    if not wanted:
        return 0.0
    size = min(length, SHINGLE)
    return len(wanted & set(zip(*(words[k:] for k in range(size))))) / len(wanted)


@dataclass
class Index:
    """Postings by term: item numbers in order, impacts, and the largest impact of each block of ``BLOCK``."""

    ids: list = field(default_factory=list)
    parts: list = field(default_factory=list)  # per item: [(shingles, words), ...], all of which must be found
    postings: dict = field(default_factory=dict)
    peak: dict = field(default_factory=dict)
    arrays: dict = field(default_factory=dict)
    reach: int = 1

    @classmethod
    def by_reach(cls, items: list[tuple], df: dict[bytes, int], total: int, mean: float) -> list[Index]:
        """An index for each reach among ``items``: (id, question, answer); ``df``, ``total``, ``mean``: over the whole benchmark."""
        groups: dict[int, list[tuple]] = {}
        for item, question, answer in items:
            words = len(tokens(question)) + len(tokens(answer))
            if words:
                groups.setdefault(1 << (words - 1).bit_length(), []).append((item, question, answer))
        return [cls.build(group, df, total, mean, reach) for reach, group in sorted(groups.items())]

    @classmethod
    def build(cls, items: list[tuple], df: dict[bytes, int], total: int, mean: float, reach: int = 1) -> Index:
        index = cls(reach=reach)
        lists: dict[bytes, list] = {}
        for item, question, answer in items:
            parts = [tokens(question), tokens(answer)]
            words = parts[0] + parts[1]
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {t: log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(words).items()}
            may_miss = sum(int((1 - OVERLAP) * max(1, len(p) - SHINGLE + 1) + 1e-9) for p in parts if p)  # 1 - 0.8 is below 0.2
            least = sum(sorted(impact.values(), reverse=True)[may_miss:]) or max(impact.values()) * 1e-9
            number = len(index.ids)
            index.ids.append(item)
            index.parts.append([(shingles(p), len(p)) for p in parts if p])
            for term, x in impact.items():
                lists.setdefault(term, []).append((number, x / least))
        for term, got in lists.items():
            numbers, values = [n for n, _ in got], [x for _, x in got]
            blocks = [max(values[k : k + BLOCK]) for k in range(0, len(values), BLOCK)]
            index.postings[term] = (numbers, values, blocks)
            index.peak[term] = max(blocks)
            index.arrays[term] = (np.array(numbers), np.array(values))
        return index

    def search(self, terms: list[bytes]) -> list[tuple[int, float]]:
        """Items with a normalised score of 1 or more, by block-max WAND."""
        slack = 1 - 1e-9
        lists = [[*self.postings[t], self.peak[t], 0] for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == at:
                pivot += 1
            # shallow moves: which block of each list could hold the pivot item, and what it adds at most
            places = [bisect_left(x[0], at, x[4]) for x in lists[: pivot + 1]]
            if sum(x[2][p // BLOCK] for x, p in zip(lists, places) if p < len(x[0])) < slack:
                ends = [x[0][min((p // BLOCK + 1) * BLOCK, len(x[0])) - 1] + 1 for x, p in zip(lists, places) if p < len(x[0])]
                ends += [lists[pivot + 1][0][lists[pivot + 1][4]]] if pivot + 1 < len(lists) else []
                target = max(at + 1, min(ends, default=at + 1))
            else:
                score = sum(x[1][p] for x, p in zip(lists, places) if p < len(x[0]) and x[0][p] == at)
                if score >= slack:
                    out.append((at, score))
                target = at + 1
            for x in lists[: pivot + 1]:
                x[4] = bisect_left(x[0], target, x[4])
            lists = [x for x in lists if x[4] < len(x[0])]
        return out

    def may_hold(self, hits: set[bytes]) -> bool:
        """Whether a whole text with these terms scores 1 for any item: no passage of it scores more."""
        if len(hits) < 1 or sum(map(self.peak.__getitem__, hits)) < 1 - 1e-9:
            return False
        numbers, values = zip(*map(self.arrays.__getitem__, hits))
        return bool(np.bincount(np.concatenate(numbers), np.concatenate(values)).max() >= 1 - 1e-9)

    def matches(self, words: list[bytes], present: set[bytes]) -> dict[int, tuple[float, float]]:
        """Verified items in the ``words`` of a whole text: number -> (normalised score, overlap), each the largest over its passages.

        ``present``: the distinct words.  Any occurrence of an item lies whole in one of the passages.
        """
        best: dict[int, tuple[float, float]] = {}
        known, peak, step = self.peak.keys(), self.peak.__getitem__, self.reach
        if not self.may_hold(known & present):
            return best
        for start in range(0, max(1, len(words) - step), step):
            passage = words[start : start + 2 * step]
            hits = known & set(passage)
            if not hits or sum(map(peak, hits)) < 1 - 1e-9:
                continue
            for number, score in self.search(sorted(hits)):
                share = min(found_share(want, passage, n) for want, n in self.parts[number])
                if share >= OVERLAP:
                    before = best.get(number, (0.0, 0.0))
                    best[number] = (max(before[0], score), max(before[1], share))
        return best


def leaks(indexes: list[Index], text: str | None) -> list[tuple]:
    """``(item id, score, overlap)`` of the items that a whole text holds."""
    words = tokens(text)
    present = set(words)
    return [(index.ids[n], *x) for index in indexes for n, x in index.matches(words, present).items()]


def _indexes(benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> Iterator[list[Index]]:
    """Index shards, each by reach, of at most about ``shard_items`` items, built one after the other; statistics are global."""
    has_answer = "answer" in benchmark.columns
    answer = F.col("answer").cast("string") if has_answer else F.lit("")
    items = benchmark.select("item_id", F.col("text").alias("question"), F.coalesce(answer, F.lit("")).alias("answer"))
    shards = -(-items.count() // shard_items)
    if shards == 0:
        return
    kind = items.schema["item_id"].dataType.simpleString()

    def terms(batches):
        for batch in batches:
            rows = [(i, tokens(q) + tokens(a)) for i, q, a in rows_of([batch], "item_id", "question", "answer")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], batch.schema.field("item_id").type), pa.array([len(w) for _, w in rows], pa.int64()), pa.array([sorted(set(w)) for _, w in rows], pa.list_(pa.binary()))],
                ["item_id", "words", "terms"],
            )

    split = items.mapInArrow(terms, f"item_id {kind}, words long, terms array<binary>")
    total, mean = split.filter("words > 0").agg(F.count("*"), F.avg("words")).first()
    if not total:
        return
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    df = split.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for k in range(shards):
        rows = items.filter(shard == k).select("item_id", "question", "answer").collect()
        used = split.filter(shard == k).select(F.explode("terms").alias("term")).distinct() if shards > 1 else None
        counts = dict((bytes(t), n) for t, n in (df.join(used, "term", "left_semi") if used is not None else df).collect())
        yield Index.by_reach(sorted(map(tuple, rows), key=repr), counts, total, mean)


def contaminated(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Leaks: ``doc_id, item_id, score, overlap``, a row per document and item that one of its passages holds.

    ``score`` is BM25 over the item's threshold (1 or more), ``overlap`` the share of the item's five-word
    shingles in the passage (0.8 or more; items under five words must occur whole).  With an ``answer`` column,
    question (``text``) and answer must both reach it and ``overlap`` is the smaller share.  Both figures are the
    largest over the passages; whether an item is found depends on that item and the text alone, not on other items
    or on ``shard_items``.  Whole texts are searched, of any length.  Null and empty texts or items never match;
    repeated rows of an id, equal or not, count as one document; no rows give no rows.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, overlap double"
    narrow, item_type = docs.select("doc_id", "text"), to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for indexes in _indexes(benchmark, shard_items):
        sent = spark.sparkContext.broadcast(indexes)

        def run(batches, sent=sent):
            indexes = sent.value
            for batch in batches:
                rows = [(d, *x) for d, text in rows_of([batch], "doc_id", "text") for x in leaks(indexes, text)]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (batch.schema.field("doc_id").type, item_type, pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "score", "overlap"])

        part = stash_texts(narrow.mapInArrow(run, schema), "decontaminate")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("overlap").alias("overlap"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item; null ids stay; rows that share an id are judged by their own texts."""
    keyed = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("key")).alias("doc_id"), "text")
    return without(docs, contaminated(keyed, benchmark).select("doc_id.*"))
