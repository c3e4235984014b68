"""Language identification by hyperdimensional profiles.

Every letter has a random +-1 vector, drawn by a hash of its code point.  An n-gram vector binds its letters' vectors, each
permuted by its place, by element-wise product (of signs held as bits: exclusive or); a text bundles its n-grams' vectors by
sum; so does a language over its training texts.  A text goes to the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stash_texts

DIMENSIONS, GRAM, SEED, FOLDS, UNKNOWN = 1024, 3, 42, 5, "und"
#: Languages that can be learned: the bound of what is sent to every task (8 KB each).
LANGUAGES = 10_000
#: Texts of a group that are bundled together, and their characters at most (one longer text is a group); n-grams whose vectors are held at a time.
_TEXTS, _CHARS, _GRAMS = 128, 1 << 20, 4096
_POINTS = 0x110000


def letter_bits(points: np.ndarray) -> np.ndarray:
    """``(len(points), DIMENSIONS / 64)`` random words for code points: the signs of their vectors, by a mixing hash."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED << 32)
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def signs(bits: np.ndarray) -> np.ndarray:
    """+-1 vectors of packed signs."""
    return 1.0 - 2.0 * np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)


class Profiler:
    """Turns groups of texts into bundled vectors; holds the tables of one worker."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(c).isalpha() for c in range(_POINTS)), bool, _POINTS)
        self.place = np.zeros(_POINTS, np.int32)

    def points(self, text: str | None) -> np.ndarray:
        """Code points of a text's lower-cased letters; a run of others is one boundary (0), as are the ends.  Empty without a letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        held = self.letter[points]
        if not held.any():
            return np.zeros(0, np.uint32)
        keep = held.copy()
        keep[1:] |= held[:-1]  # one boundary after each word
        kept = np.where(held, points, 0)[keep]
        return np.concatenate(([0], kept, [0])).astype(np.uint32)

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(len(texts), DIMENSIONS)`` sums of n-gram vectors, and whether each text has a letter."""
        found = [self.points(t) for t in texts]
        known = np.array([len(p) > 0 for p in found], bool)
        out = np.zeros((len(texts), DIMENSIONS))
        if not known.any():
            return out, known
        alphabet = np.unique(np.concatenate([np.unique(p) for p in found]))
        self.place[alphabet] = np.arange(len(alphabet))
        size, kind = len(alphabet), np.int32 if len(alphabet) ** GRAM < 1 << 31 else np.int64
        owners, grams, counts = [], [], []
        for k, points in enumerate(found):
            if not len(points):
                continue
            codes = self.place[points].astype(kind)
            ends = len(codes) - GRAM + 1
            numbers, n = np.unique((codes[:ends] * kind(size) + codes[1 : ends + 1]) * kind(size) + codes[2 : ends + 2], return_counts=True)
            owners.append(np.full(len(numbers), k))
            grams.append(numbers)
            counts.append(n)
        owner, gram, count = (np.concatenate(x) for x in (owners, grams, counts))
        seen, column = np.unique(gram, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column, count = owner[order], column[order], count[order]
        bits = letter_bits(alphabet)
        turned = [np.roll(bits, k, axis=1) for k in range(GRAM)]
        for lo in range(0, len(seen), _GRAMS):
            part = seen[lo : lo + _GRAMS].astype(np.int64)
            bound = turned[0][part // (size * size)] ^ turned[1][part // size % size] ^ turned[2][part % size]
            a, b = np.searchsorted(column, (lo, lo + _GRAMS))
            dense = np.zeros((len(texts), len(part)), np.float32)
            dense[owner[a:b], column[a:b] - lo] = count[a:b]
            out += dense @ signs(bound)
        return out, known


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """Rows in groups of a bounded number of texts and characters; the first column is the text."""
    group, chars = [], 0
    for row in rows_of(batches, *columns):
        group.append(row)
        chars += len(row[0] or "")
        if len(group) >= _TEXTS or chars >= _CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """``docs(text, lang)`` -> languages in order and their unit prototypes.

    Bundling is a sum, so every task sends one vector of whole numbers per language, and these are added up by dimension.
    What reaches the driver is a vector per language, of which there are ``LANGUAGES`` at most; more are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(), {}
        for group in _groups(batches, "text", "lang"):
            for (_, lang), vector in zip(group, profiler.bundles([t for t, _ in group])[0]):
                sums[lang] = sums.get(lang, 0) + np.rint(vector).astype(np.int64)
            if len(sums) > LANGUAGES:
                raise ValueError(f"over {LANGUAGES} languages")
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([total], pa.list_(pa.int64()))], ["lang", "bundle"])

    sent = docs.filter("lang is not null").select("text", "lang").mapInArrow(run, "lang string, bundle array<bigint>")
    added = stash_texts(sent.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")), "langid-bundles")
    whole = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("bundle"))
    rows = whole.orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    bundles = np.array([r.bundle for r in rows], np.float64).reshape(len(rows), DIMENSIONS)
    norms = np.linalg.norm(bundles, axis=1, keepdims=True)
    return [r.lang for r in rows], bundles / np.where(norms > 0, norms, 1)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """``docs`` (any columns but ``text`` pass through) -> plus ``lang_pred string, score double``."""
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    model = docs.sparkSession.sparkContext.broadcast((languages, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prototypes = model.value
        profiler = Profiler()
        for batch in batches:
            names, scores = [], []
            for group in _groups(iter([batch]), "text"):
                texts, known = profiler.bundles([t for (t,) in group])
                norms = np.linalg.norm(texts, axis=1)
                cosines = np.round((texts @ prototypes.T) / np.where(norms > 0, norms, 1)[:, None], 9) if languages else np.zeros((len(group), 1))
                best = np.argmax(cosines, axis=1)
                good = known & (len(languages) > 0)
                names += [languages[b] if g else UNKNOWN for b, g in zip(best.tolist(), good.tolist())]
                scores.append(np.where(good, np.clip(cosines[np.arange(len(group)), best], 0.0, 1.0), 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], [*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return stash_texts(docs.select(*kept, "text").mapInArrow(run, f"{fields}{', ' if fields else ''}lang_pred string, score double"), "langid")


def identify(docs: DataFrame, folds: int = FOLDS, held: int = 0) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from texts and non-null ``lang`` of the documents whose ``crc32(doc_id as text) mod folds`` is not
    ``held``; the others have ``held_out`` true.  ``score`` is the cosine with the winning prototype, cut to
    0-1; ties (to nine digits) go to the first language in order.  Null texts, texts without a letter and an empty training
    set give ``und`` and 0.  Whole texts count, of any length, in one pass.  A null id counts as an empty string; repeated
    rows each give a row; no rows give no rows.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    languages, prototypes = train(docs.filter(fold != held))
    return predict(docs.select("doc_id", (fold == held).alias("held_out"), "text"), languages, prototypes)
