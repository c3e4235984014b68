"""Language-model scoring by deleted interpolation over corpus-wide counts.

The model mixes maximum-likelihood bigram and unigram estimates with a uniform floor.  The mixture weights depend
on the bucket of the context's frequency; expectation-maximisation learns them on held-out events: each position of
every block, with the counts of its own document deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unstash
from .exchange import BLOCK_TOKENS, Block, answers, blocks, mapped, merged, totals

FOLDS, HELD = 7, 2
#: Buckets of the context frequency (powers of two); EM steps; steps per power of two by which events are gathered in cells
#: for EM (a cell keeps the exact sums of its logarithms, so it stands for its events' mean); steps per unit of a logarithm.
BUCKETS, EM_STEPS, GRID, FINE = 40, 60, 4, 1 << 20
#: Grid places, more than the 64 powers of two of a count take.
PLACES = 64 * GRID + 2


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)), 0)


def _bits(share: np.ndarray) -> np.ndarray:
    """Negative binary logarithm of a probability in steps of ``1 / FINE``, -1 for 0: integers, so sums do not depend on their order."""
    return np.where(share > 0, np.round(-np.log2(np.maximum(share, 1e-300)) * FINE), -1).astype(np.int64)


def _own(group: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
    """How often each position's item occurs in its own group."""
    _, place, counts = np.unique(group * size + item, return_inverse=True, return_counts=True)
    return counts[place]


_CELLS = "bucket long, p2 long, p1 long, n long, bits2 long, bits1 long"


def events(block: Block, words: np.ndarray, pairs: np.ndarray, total: int) -> pa.Table:
    """Counts and sums of logarithms of (bucket, bigram share, unigram share) cells over a block, own documents deleted."""
    use = block.learned[block.doc]
    doc, token, before, pair = block.doc[use], block.tokens[use].astype(np.int64), block.previous[use].astype(np.int64), block.pair[use]
    own_word = _own(doc, token, len(words))
    # the contexts of a document are its tokens, the end first: each position's context is the token before it
    first = np.diff(doc, prepend=-1) > 0
    own_before = np.roll(own_word, 1)
    own_before[first] = own_word[np.append(np.flatnonzero(first)[1:], len(doc))[: first.sum()] - 1]
    own_pair = _own(doc, pair, len(pairs))
    context = words[before] - own_before
    p2 = np.where(context > 0, (pairs[pair] - own_pair) / np.maximum(context, 1), 0.0)
    p1 = (words[token] - own_word) / np.maximum(total - block.lengths[doc], 1)
    bits2, bits1 = _bits(p2), _bits(p1)
    # one number per cell: the bucket and both grid places, from 0 for a share of 0
    cells = (_bucket(context) * PLACES + np.where(bits2 < 0, 0, bits2 * GRID // FINE + 1)) * PLACES + np.where(bits1 < 0, 0, bits1 * GRID // FINE + 1)
    counts = np.bincount(cells, minlength=1)
    found = np.flatnonzero(counts)
    # sums of whole numbers far below 2 ** 53 are exact
    sums = [np.bincount(cells, weights=np.maximum(x, 0))[found].astype(np.int64) for x in (bits2, bits1)]
    columns = [found // PLACES**2, found // PLACES % PLACES - 1, found % PLACES - 1, counts[found], *sums]
    return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [c.split()[0] for c in _CELLS.split(", ")])


def learn_weights(cells: np.ndarray, floor: float) -> np.ndarray:
    """``(BUCKETS, 3)`` weights of bigram, unigram and uniform from sorted rows of cells (:data:`_CELLS`), by EM.

    A bucket without events takes the weights of all; bucket 0 (an unseen context) has no bigram part.
    """
    mean = lambda at: np.where(cells[:, at] >= 0, 2.0 ** (-cells[:, at + 3] / (np.maximum(cells[:, 3], 1) * FINE)), 0.0)
    shares = np.stack((mean(1), mean(2), np.full(len(cells), floor)), axis=1)

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights, n = start, cells[rows, 3].astype(float)
        for _ in range(EM_STEPS):
            parts = shares[rows] * weights
            parts *= (n / parts.sum(axis=1))[:, None]
            weights = parts.sum(axis=0) / n.sum()
            weights = np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum()
        return weights

    start = np.array([0.4, 0.5, 0.1])
    every = fit(np.ones(len(cells), bool), start) if len(cells) else start
    out = np.tile(every, (BUCKETS, 1))
    for k in np.unique(cells[:, 0]) if len(cells) else []:
        out[int(k)] = fit(cells[:, 0] == k, every)
    out[0, 1:] += out[0, 0] * out[0, 1:] / out[0, 1:].sum()
    out[0, 0] = 0.0
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(block: Block, words: np.ndarray, pairs: np.ndarray, total: int, distinct: int, weights: np.ndarray) -> pa.Table:
    count, context = words[block.tokens], words[block.previous]
    base = np.log10((count + 1) / (total + distinct + 1))
    mix = weights[_bucket(context)]
    p2 = pairs[block.pair] / np.maximum(context, 1)
    p = mix[:, 0] * p2 + mix[:, 1] * (count / max(total, 1)) + mix[:, 2] / (distinct + 1)
    add = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  every text has an end token, so no run is empty
    columns = [block.ids, ~block.learned, block.lengths, add((count > 0).astype(np.int64)), np.full(len(block.ids), total), add(base), add(np.log10(p))]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _SCORES.split(", ")])


def lm_scores(docs: DataFrame, folds: int = FOLDS, held: int = HELD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Counts cover all documents whose ``crc32(doc_id as text) mod folds`` is not ``held``.  A text is its words and
    one end token, so a null or empty text has one token.  ``base_score`` is the add-one unigram's log10
    probability, ``score`` the interpolated model's; both spread what is unseen over one unknown word.  With
    nothing to learn from, both are those of an empty vocabulary.  A null id counts as an empty string; repeated
    rows each count and each give a row; no rows give no rows.  Whole texts count, of any length.  Weights come from all
    blocks, in sums of integers: neither the blocks nor the input's partitions change a score.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    stored = blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold != held).alias("learned"), "text"), block_tokens)
    answered = answers(stored)
    distinct, total = totals(answered)
    whole = merged(stored, answered)
    unstash(stored)
    unstash(answered)
    cells = mapped(whole, lambda b, w, p: events(b, w, p, total), _CELLS)
    cells = cells.groupBy("bucket", "p2", "p1").agg(*(F.sum(c).alias(c) for c in ("n", "bits2", "bits1"))).collect()
    weights = learn_weights(np.array(sorted(map(tuple, cells)), np.int64).reshape(-1, 6), 1 / (distinct + 1))
    return mapped(whole, lambda b, w, p: scores(b, w, p, total, distinct, weights), _SCORES)
