"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the texts.  A term weighs its inverse document frequency in the labelled sample times how well
it tells toxic examples from others (``FLOOR`` for words that do not tell, so none is left out): a text's few telling
words are not drowned by hundreds of others, and texts without one still have a direction and neighbours.  The
nearest examples vote with class weight times squared cosine; a logistic curve, fitted on labelled documents that
are not in the index, turns votes into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, stash, stash_texts, text_key, without

#: Labelled examples taken of each class (smallest hash of the id first), and characters of their texts: the documented bounds of the fit.
EXAMPLES, EXAMPLE_CHARS = 4000, 1 << 25
NEIGHBOURS, FOLDS, HELD, REJECT = 15, 3, 1, 0.7
#: Weight of a word that does not tell classes apart; normal quantile of the bound by which words tell, wide because a great many are tried.
FLOOR, SURE = 0.1, 2.5
#: Examples of a block; share of the examples (and number) above which a word that does not tell is read last, for the examples that it can still raise.
BLOCK, SHARE, COMMON = 64, 0.25, 128
#: Votes of the prior beside the neighbours'; one in so many sampled labels calibrates; strength of the curve's pull to the identity.
SMOOTH, CALIBRATE, PULL = 0.05, 5, 1.0
_TOKEN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def term_weights(hits: np.ndarray, n: np.ndarray, every: float, base: float) -> np.ndarray:
    """Inverse document frequency times relevance, of terms in ``n`` (weighted) examples of ``every``, ``hits`` of them toxic.

    Relevance is how far the lower bound of a term's toxic share lies above the ``base`` share, from ``FLOOR`` to 1.
    """
    share, z2 = hits / n, SURE**2
    lower = (share + z2 / (2 * n) - SURE * np.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return np.log((every + 1) / (n + 1)) * np.maximum(FLOOR, (lower - base) / max(1 - base, 1e-9))


def fit_curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the votes' logits, pulled to (1, 0) where rows are few; by Newton's method."""
    x, theta = logit(votes), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(theta[0] * x + theta[1])))
        slope = np.array([np.sum(weight * (p - toxic) * x), np.sum(weight * (p - toxic))]) + PULL * (theta - np.array([1.0, 0.0]))
        v = weight * p * (1 - p)
        bend = np.array([[np.sum(v * x * x), np.sum(v * x)], [np.sum(v * x), np.sum(v)]]) + PULL * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


class Index:
    """Unit TF-IDF vectors of the examples, as postings by term in example order, with the peaks of common terms by block.

    Examples are put in the order of their most frequent word, so that blocks hold texts of a kind and their bounds are tight.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: list[str], example: np.ndarray, code: np.ndarray, counts: np.ndarray, weights: tuple[float, float]) -> None:
        """Example ``k`` is document ``ids[k]``; posting ``j`` says that it holds ``terms[code[j]]`` ``counts[j]`` times.

        ``weights``: how many labelled documents an example of class 0 and of class 1 stands for.
        """
        self.weights, self.curve = weights, (1.0, 0.0)
        mass = np.where(labels == 1, weights[1], weights[0])
        every, toxic = float(mass.sum()), float(mass[labels == 1].sum())
        self.base = toxic / every if every else 0.0
        n = np.bincount(code, weights=mass[example], minlength=len(terms))
        hits = np.bincount(code, weights=(mass * (labels == 1))[example], minlength=len(terms))
        self.weight = term_weights(hits, np.maximum(n, 1e-9), every, self.base)
        self.code = {t: k for k, t in enumerate(terms)}
        values = (1 + np.log(counts)) * self.weight[code]
        norms = np.sqrt(np.bincount(example, weights=values * values, minlength=len(ids)))
        idle = norms <= 0
        self.idle = (float(mass[idle & (labels == 1)].sum()) + self.base) / (float(mass[idle].sum()) + 1)
        values = values / np.where(norms > 0, norms, 1)[example]
        # most frequent word of each example, the more common one where several are
        order = np.lexsort((-n[code], -counts, example))
        firsts = np.full(len(ids), -1, np.int64)
        firsts[example[order][::-1]] = code[order][::-1]
        rank = np.lexsort((ids, firsts))
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        self.ids, self.labels = ids[rank], labels[rank]
        numbers = place[example]
        order = np.lexsort((numbers, code))
        order = order[values[order] > 0]
        self.numbers, self.values = numbers[order].astype(np.int32), values[order]
        self.cuts = np.searchsorted(code[order], np.arange(len(terms) + 1))
        blocks = -(-len(ids) // BLOCK)
        plain = self.weight <= FLOOR * np.log((every + 1) / (np.maximum(n, 1e-9) + 1)) + 1e-12
        common = np.flatnonzero((np.diff(self.cuts) > max(COMMON, SHARE * len(ids))) & plain)
        self.row = np.full(len(terms), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.peaks = np.zeros((len(common), blocks))
        # at most a few dozen columns: a text of usual length has few words that a quarter of all texts have
        self.dense = np.zeros((len(ids), len(common)))
        for k, t in enumerate(common.tolist()):
            part = slice(self.cuts[t], self.cuts[t + 1])
            np.maximum.at(self.peaks[k], self.numbers[part] // BLOCK, self.values[part])
            self.dense[self.numbers[part], k] = self.values[part]

    def ready(self) -> Index:
        """Widens the postings' numbers once per worker, as ``np.bincount`` takes them without a copy."""
        self.numbers = self.numbers.astype(np.intp, copy=False)
        return self

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term codes and unit weights of a whole text."""
        counts = Counter(words(text))
        absent = len(self.code)
        codes = np.fromiter(map(self.code.get, counts, repeat(absent)), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))[codes < absent]
        codes = codes[codes < absent]
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0)
        x = (1 + np.log(n)) * self.weight[codes]
        norm = float(np.sqrt(np.sum(x * x)))
        return (codes, x / norm) if norm > 0 else (codes[:0], x[:0])

    def _add(self, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        pieces = list(zip(lo.tolist(), hi.tolist()))
        if not pieces:
            return np.zeros(len(self.ids))
        numbers = np.concatenate([self.numbers[a:b] for a, b in pieces])
        values = np.concatenate([self.values[a:b] for a, b in pieces])
        values *= np.repeat(weights, hi - lo)
        return np.bincount(numbers, weights=values, minlength=len(self.ids))

    def nearest(self, text: str | None, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
        """Numbers and cosines of the ``k`` examples of largest cosine over 0, ties (to nine digits) to the smaller id; exact.

        Rare and telling terms come first.  An example is alive if its score so far and its block's bound on the common terms reach
        the ``k``-th best score so far; the common terms are added for the examples alive only.
        """
        codes, x = self.vector(text)
        size = len(self.ids)
        if not len(codes) or not size:
            return []
        rows = self.row[codes]
        late = rows >= 0
        early = ~late
        scores = self._add(self.cuts[codes[early]], self.cuts[codes[early] + 1], x[early])
        if late.any():
            rows, y = rows[late], x[late]
            least = float(np.partition(scores, size - k)[size - k]) if size > k else 0.0
            reach = scores + np.repeat(y @ self.peaks[rows], BLOCK)[:size]
            alive = np.flatnonzero(reach >= least - 1e-9)
            weights = np.zeros(self.dense.shape[1])
            weights[rows] = y
            if 2 * len(alive) > size:
                scores += self.dense @ weights
            else:
                scores[alive] += self.dense[alive] @ weights
        scores = np.round(scores, 9)
        least = max(float(np.partition(scores, size - k)[size - k]) if size > k else 0.0, 1e-9)
        found = np.flatnonzero(scores >= least)
        found = found[np.lexsort((self.ids[found], -scores[found]))][:k]
        return list(zip(found.tolist(), scores[found].tolist()))

    def vote(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """The neighbours' vote, before the curve, and the evidence (example id, cosine, label), the nearest first."""
        found = self.nearest(text)
        if not found:
            return self.idle, []
        numbers, cosines = np.array([n for n, _ in found]), np.array([s for _, s in found])
        labels = self.labels[numbers]
        votes = np.where(labels == 1, self.weights[1], self.weights[0]) * cosines * cosines
        share = (float(votes[labels == 1].sum()) + SMOOTH * self.base) / (float(votes.sum()) + SMOOTH)
        return share, list(zip(self.ids[numbers].tolist(), cosines.tolist(), labels.tolist()))

    def calibrated(self, shares: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 from votes; 0 where there are no examples."""
        return 1 / (1 + np.exp(-(self.curve[0] * logit(shares) + self.curve[1]))) if len(self.ids) else np.zeros(len(shares))


def _counted(texts: DataFrame) -> DataFrame:
    """``(doc_id, toxic, terms, counts)`` of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words(t)) for (t,) in rows_of([batch], "text")]
            terms, counts = pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), terms, counts], ["doc_id", "toxic", "terms", "counts"])

    return texts.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms array<string>, counts array<int>")


def _index(texts: DataFrame, weights: tuple[float, float]) -> Index:
    """An index of the bounded sample's ``(doc_id, toxic, text)``."""
    table = stash_texts(_counted(texts), "toxicity-counts").orderBy("doc_id").toArrow()
    terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
    lengths = np.diff(np.asarray(terms.offsets)) if len(terms) else np.zeros(0, np.int64)
    coded = terms.flatten().dictionary_encode()
    example = np.repeat(np.arange(len(lengths)), lengths)
    return Index(np.asarray(table.column("doc_id")), np.asarray(table.column("toxic")), coded.dictionary.to_pylist(), example, np.asarray(coded.indices, dtype=np.int64), np.asarray(counts.flatten(), dtype=np.float64), weights)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Index:
    """An index over a sample of the labelled documents (``labels.toxic`` 0 or 1), and the curve of its votes.

    The sample has at most ``examples`` documents of each class and ``chars`` characters of their texts; its ids are
    broadcast to find the texts; class totals cover all labels given.  A document labelled twice counts as toxic if one of its
    labels does; of an id that repeats with different texts, the smallest text counts; equal texts are one example, which has
    the smallest id, and is toxic if one of them is.  One in ``CALIBRATE`` of the sample is kept from the index and fits the curve.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stash(known.select("doc_id", "toxic"), "toxicity-labels")
    totals = dict(map(tuple, known.groupBy("toxic").count().collect()))
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    sample = picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = texts.groupBy(F.md5(F.col("text").cast("binary")).alias("same")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    texts = stash(texts.withColumn("chars", F.sum(F.length("text")).over(upto)).filter(F.col("chars") <= chars).select("doc_id", "toxic", "text"), "toxicity-examples")
    taken = dict(map(tuple, texts.groupBy("toxic").count().collect()))
    shares = [totals.get(y, 0) / taken[y] if taken.get(y) else 0.0 for y in (0, 1)]
    weights = (shares[0] / shares[1], 1.0) if shares[1] else (1.0, 1.0)
    aside = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CALIBRATE)) == 0
    index = _index(texts.filter(~aside), weights)
    voted = score(texts.filter(aside).select("toxic", "text"), index).select("toxic", "vote").toArrow()
    toxic = np.asarray(voted.column("toxic"), dtype=np.float64)
    index.curve = fit_curve(np.asarray(voted.column("vote"), dtype=np.float64), toxic, np.where(toxic == 1, weights[1], weights[0]))
    return index


def score(docs: DataFrame, index: Index, reject: float = REJECT) -> DataFrame:
    """``docs`` (columns but ``text`` pass through) -> plus ``score double, predicted int, vote double, evidence``.

    ``vote`` is the neighbours' vote before calibration; ``evidence`` up to three of the nearest examples, as (doc_id, cosine, toxic).
    """
    added = ["score", "predicted", "vote", "evidence"]
    kept = [c for c in docs.columns if c != "text" and c not in added]
    sent = docs.sparkSession.sparkContext.broadcast(index)
    shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.ready()
        for batch in batches:
            votes, proofs = [], []
            for (text,) in rows_of([batch], "text"):
                share, proof = index.vote(text)
                votes.append(share)
                proofs.append([{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in proof[:3]])
            shares = np.array(votes, np.float64)
            scores = index.calibrated(shares)
            predicted = pa.array((scores >= reject).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores), predicted, pa.array(shares), pa.array(proofs, shape)], [*kept, *added])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{fields}{', ' if fields else ''}score double, predicted int, vote double, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>"
    return stash_texts(docs.select(*kept, "text").mapInArrow(run, schema), "toxicity")


def held_out(doc_id) -> F.Column:
    """Whether ``crc32(doc_id as text) mod 3`` is 1; a null id counts as an empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, vote, evidence``.

    Only labels of documents that are not held out are learned from.  Null and empty texts, and texts without a word of the
    sample, get the vote of such examples (0 without labels).  Whole texts count, of any length.  Repeated rows each give a row;
    ties among neighbours go to the smaller example id; no rows give no rows.
    """
    index = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), index)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not predicted toxic; null ids stay; rows that share an id are judged by their own texts."""
    index = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return without(docs, score(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text"), index).filter("predicted = 1"))
