"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

The model is integers by hashed n-gram (counts, continuation counts, totals of contexts and their followers' counts), added up in
key-range shards from packed messages of blocks of texts; discounts are four numbers of each order.  Blocks of documents send each
distinct n-gram once, sorted and packed, to the shards, which answer in the same order, and probabilities are put together where
the document is, so no task holds the model.  Both go in rounds, whose messages are deleted before the next one: a round of
learning takes a range of keys, a round of scoring a share of the documents.  A model of few texts (:func:`train`) fits in a task
and scores documents where they lie (:func:`perplexities`).  A document is kept if its perplexity is within its language's
quantile, which is taken over trusted documents that the model was not trained on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, shuffles_deleted, small_side, stash, stash_texts, unstash, words_of
from .exchange import BLOCK_TOKENS, END, SHARD_ENTRIES, pack, pack_sorted, pair_keys, unpack, unpack_sorted, word_key

#: Ids up to which the trusted documents are broadcast to find their texts.
MANY_IDS = 500_000
#: Share of trusted documents of a language within its threshold; fewer than LEAST take the threshold of all languages.
QUANTILE, LEAST, SMALL_ROWS = 0.99, 20, 10_000
#: Words that a task remembers before it starts anew.
VOCABULARY = 500_000
#: Tokens of a round of learning or scoring, until there are MOST_ROUNDS: from there on rounds grow with the table.
ROUND_TOKENS, MOST_ROUNDS = 8_000_000, 8
START = b"\n\n"  # stands before a text; no word can hold a line feed


def _trigrams(texts: DataFrame) -> DataFrame:
    """``(a, b, c, n)``: trigrams of word keys of all texts, padded by two starts and one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (text,) in rows_of([batch], "text"):
                keys = np.array([word_key(w) for w in (START, START, *words_of(text), END)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-2]), pa.array(keys[1:-1]), pa.array(keys[2:])], ["a", "b", "c"])

    return texts.select("text").mapInArrow(run, "a long, b long, c long").groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def _cuts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of the counts one, two and over two, by the counts of counts one to four (zero where they say nothing)."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    return [min(k, max(0.0, k - (k + 1) * y * more / some)) if some else 0.0 for k, some, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _discount(counts: DataFrame) -> Column:
    """The discount of a count ``n``."""
    d = _cuts(*counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first())
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _level(counts: DataFrame, context: list[str], lower: DataFrame | None, on: list[str], vocabulary: int) -> tuple[DataFrame, DataFrame]:
    """Interpolated probabilities ``p`` of one order, and the contexts' back-off weights ``g``.

    ``counts`` has the n-gram's columns and ``n``; ``lower`` the next order's columns ``on`` and ``p``.
    """
    cut = counts.withColumn("d", _discount(counts))
    if context:
        about = cut.groupBy(*context).agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("g"))
        cut = cut.join(about, context)
    else:
        about = cut.agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("g"))
        total, g = about.first()
        cut = cut.withColumn("total", F.lit(total)).withColumn("g", F.lit(g))
    if lower is None:
        below = F.lit(1.0 / (vocabulary + 1))
    else:
        cut, below = cut.join(lower.select(*on, F.col("p").alias("below")), on), F.col("below")
    scored = cut.withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + F.col("g") * below)
    return scored, about


class Table:
    """An open-addressing hash table of 64-bit keys to rows of float32 values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.row = np.full(int(self.mask) + 1, -1, np.int32)
        self.values = np.asarray(values, np.float32)
        spot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = self.row[spot[left]] < 0
            self.row[spot[left[free]]] = left[free]  # of rivals for a place, the last one stays
            self.keys[spot[left[free]]] = keys[left[free]]
            left = left[self.row[spot[left]] != left]
            spot[left] = (spot[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is not held."""
        spot = keys & self.mask
        rows = self.row[spot]
        left = np.flatnonzero((rows >= 0) & (self.keys[spot] != keys))
        while len(left):
            spot[left] = (spot[left] + np.uint64(1)) & self.mask
            rows[left] = self.row[spot[left]]
            left = left[(rows[left] >= 0) & (self.keys[spot[left]] != keys[left])]
        return rows


class Model:
    """Log10 probabilities of n-grams, and back-off weights of contexts, beside the n-grams that they extend.

    ``words`` hold (p1, weight), ``pairs`` (p2 or NaN, weight), ``triples`` (p3).
    """

    def __init__(self, words: Table, pairs: Table, triples: Table, floor: float) -> None:
        self.words, self.pairs, self.triples, self.floor = words, pairs, triples, floor

    def of_words(self, keys: np.ndarray) -> np.ndarray:
        """(p1, back-off weight) of distinct words; unknown ones have the floor and weight 1."""
        rows = self.words.find(keys)
        out = np.tile(np.array([self.floor, 0.0], np.float32), (len(keys), 1))
        out[rows >= 0] = self.words.values[rows[rows >= 0]]
        return out

    def log10(self, keys: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Log10 probability of each position but the first two of padded word keys; ``single``: rows of their words."""
        pair = pair_keys(keys[:-1], keys[1:])
        rows = self.pairs.find(pair)
        held = rows >= 0
        two = np.zeros((len(pair), 2), np.float32)
        two[held] = self.pairs.values[rows[held]]
        p2 = np.where(held, two[:, 0], np.nan)
        seen = ~np.isnan(p2)
        p2 = np.where(seen, p2, single[1:, 0] + single[:-1, 1])[1:]
        p = p2 + two[:-1, 1]
        # a trigram can only be held if both of its pairs are
        may = np.flatnonzero(held[:-1] & seen[1:])
        found = self.triples.find(pair_keys(pair[:-1][may], keys[2:][may]))
        hit = found >= 0
        p[may[hit]] = self.triples.values[found[hit], 0]
        return p


def levels(texts: DataFrame) -> tuple[dict[str, DataFrame], float] | None:
    """Probabilities ``p`` of n-grams (``p1, p2, p3``) and back-off weights ``g`` over 0 of contexts (``g2, g3``), and an unknown word's
    log10 probability; None without texts."""
    three = stash(_trigrams(texts), "quality-trigrams")
    two = stash(three.groupBy("b", "c").agg(F.count("*").alias("n")), "quality-bigrams")
    one = stash(two.groupBy("c").agg(F.count("*").alias("n")), "quality-words")
    vocabulary = one.count()
    if not vocabulary:
        return None
    p1, _ = _level(one, [], None, [], vocabulary)
    p1 = stash(p1.select("c", "p", "g"), "quality-p1")
    p2, about2 = _level(two, ["b"], p1, ["c"], vocabulary)
    p2 = stash(p2.select("b", "c", "p"), "quality-p2")
    p3, about3 = _level(three, ["a", "b"], p2, ["b", "c"], vocabulary)
    floor = float(np.log10(max(p1.first()["g"], 1e-9) / (vocabulary + 1)))
    weights = {"g2": about2.filter("g > 0").select("b", "g"), "g3": about3.filter("g > 0").select("a", "b", "g")}
    return {"p1": p1.select("c", "p"), "p2": p2, "p3": p3.select("a", "b", "c", "p"), **weights}, floor


def train(texts: DataFrame) -> Model:
    """A model, in memory, of a bounded set of trusted texts; an empty set gives a uniform model of one unknown word."""
    made = levels(texts)
    if made is None:
        empty = np.zeros(0, np.uint64)
        return Model(Table(empty, np.zeros((0, 2))), Table(empty, np.zeros((0, 2))), Table(empty, np.zeros((0, 1))), 0.0)
    frames, floor = made

    def arrays(df: DataFrame, value: str) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns of a bounded table, batch by batch."""
        table = df.withColumn(value, F.log10(value).cast("float")).toArrow()
        names = [c for c in df.columns if c != value]
        return [np.asarray(table.column(c)).view(np.uint64) for c in names], np.asarray(table.column(value))

    def beside(keys: np.ndarray, values: np.ndarray, contexts: np.ndarray, weights: np.ndarray, none: float) -> Table:
        """N-grams' probabilities (``none`` for a context only) beside the same n-grams' back-off weights."""
        every = np.union1d(keys, contexts)
        out = np.tile(np.array([none, 0.0], np.float32), (len(every), 1))
        out[np.searchsorted(every, keys), 0] = values
        out[np.searchsorted(every, contexts), 1] = weights
        return Table(every, out)

    (c,), v1 = arrays(frames["p1"], "p")
    (b2, c2), v2 = arrays(frames["p2"], "p")
    (a3, b3, c3), v3 = arrays(frames["p3"], "p")
    (b,), g2 = arrays(frames["g2"], "g")
    (a, ab), g3 = arrays(frames["g3"], "g")
    triples = Table(pair_keys(pair_keys(a3, b3), c3), v3[:, None])
    return Model(beside(c, v1, b, g2, floor), beside(pair_keys(b2, c2), v2, pair_keys(a, ab), g3, np.nan), triples, floor)


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (columns but ``text`` pass through) -> plus ``n_tokens long, log10_ppl double`` (per token)."""
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "log10_ppl")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        keys, single = np.zeros(0, np.uint64), np.zeros((0, 2), np.float32)
        for batch in batches:
            if len(number) > VOCABULARY:
                number.clear()
                keys, single = keys[:0], single[:0]
            numbers, lengths = [], []
            for (text,) in rows_of([batch], "text"):
                words = [START, START, *words_of(text), END]
                numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                lengths.append(len(words))
            if len(number) > len(keys):
                fresh = np.fromiter(map(word_key, islice(number, len(keys), None)), np.uint64, len(number) - len(keys))
                keys, single = np.concatenate((keys, fresh)), np.concatenate((single, model.of_words(fresh)))
            counts, values = [], []
            for each in numbers:
                counts.append(len(each) - 2)
                values.append(-float(model.log10(keys[each], single[each]).sum()) / (len(each) - 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(values, pa.float64())], [*kept, "n_tokens", "log10_ppl"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return stash_texts(docs.select(*kept, "text").mapInArrow(run, f"{fields}, n_tokens long, log10_ppl double"), "quality-scores")


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary())])
_BLOCK_DDL = "block long, doc_ids array<bigint>, langs array<string>, lengths array<bigint>, tokens binary, words binary"


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """``docs(doc_id, lang, text)`` -> stored blocks of token numbers (int32 planes) into ``words`` (keys); texts are padded by two starts and one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, langs, lengths, parts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, number), np.uint64, len(number))
            row = {"block": task << 32 | count, "doc_ids": ids, "langs": langs, "lengths": lengths, "tokens": pack(np.concatenate(parts)), "words": keys.tobytes()}
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for doc, lang, text in rows_of(batches, "doc_id", "lang", "text"):
            words = [START, START, *words_of(text), END]
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            ids.append(doc)
            langs.append(lang)
            lengths.append(len(words))
            held += len(words)
            if held >= block_tokens:
                yield flush()
                number.clear()
                ids, langs, lengths, parts, held, count = [], [], [], [], 0, count + 1
        if ids:
            yield flush()

    return stash_texts(docs.select("doc_id", "lang", "text").mapInArrow(run, _BLOCK_DDL), "quality-blocks")


#: Bits of a pair's key that its triples share, so that they lie in the same shard.
_SHARED = np.uint64(0xFFFFFF << 40)
_LOW = 5  # bytes of a key below them


def _triple_keys(pair: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of triples, in the shard of the pair that they begin with."""
    return (pair & _SHARED) | (pair_keys(pair, last) & ~_SHARED)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Key ranges of equal width, from the bits of a key that triples share with their pair."""
    return (((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def _pack_counts(values: np.ndarray) -> bytes:
    """Counts as a byte each, then those over 254 as 64 bits, compressed: most are one, which shuffles' own codec uses little."""
    data = np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.int64).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    data = pa.decompress(data[8:], size, "zstd", asbytes=True)
    small = np.frombuffer(data, np.uint8, n)
    out = small.astype(np.int64)
    if size > n:
        out[small == 255] = np.frombuffer(data, np.int64, offset=n)
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, and where in it each distinct key starts."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


class _Grams:
    """A stored block's keys: ``known`` words at each position, ``pair`` and ``triple`` that start there and stay within a text (``two``, ``three``)."""

    def __init__(self, row: dict) -> None:
        self.lengths = np.array(row["lengths"], np.int64)
        self.tokens, self.words = unpack(row["tokens"], np.int32), np.frombuffer(row["words"], np.uint64)
        ends = np.cumsum(self.lengths)
        self.two = np.ones(len(self.tokens) - 1, bool)
        self.two[ends[:-1] - 1] = False
        self.three = self.two[:-1] & self.two[1:]
        self.known = self.words[self.tokens]
        pair = pair_keys(self.known[:-1], self.known[1:])
        self.triple = _triple_keys(pair[:-1], self.known[2:])[self.three]
        self.pair = pair[self.two]

    def all(self) -> np.ndarray:
        return np.concatenate((self.words, self.pair, self.triple))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _ranges(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(shard, from, to)`` of the runs of a sorted array."""
    starts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(shard)]):
        yield int(shard[a]), a, b


_PIECE = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), *((f"t{k}", pa.int64()) for k in range(6))])
_PIECE_DDL = "shard long, n long, keys binary, counts binary, " + ", ".join(f"t{k} long" for k in range(6))


def _pieces(keys: np.ndarray, columns: list, tally: list[int], shards: int) -> list[tuple]:
    """Rows of sorted ``keys`` and their five ``columns`` (0: all zero), by shard; the first one has the ``tally``."""
    out = []
    for shard, a, b in _ranges(_shard(keys, shards)):
        values = np.concatenate([np.zeros(b - a, np.int64) if isinstance(c, int) else c[a:b] for c in columns])
        out.append((shard, b - a, pack_sorted(keys[a:b]), _pack_counts(values), *(tally if not out else [0] * 6)))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


def _tally(n: np.ndarray) -> list[int]:
    """Counts of the counts one to four, how many and their sum."""
    return [*np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist(), len(n), int(n.sum())]


def _of_count(n: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """By group: the sum, and how many are one, two, more."""
    return [_sums(n, starts), *(_sums(x, starts) for x in (n == 1, n == 2, n > 2))]


class Counts(NamedTuple):
    """A model in shards: ``tables(shard, n, keys, counts)`` by range of them, discounts by order, words, their total and the first order's weight."""

    tables: list[DataFrame]
    shards: int
    cuts: list[list[float]]
    vocabulary: int
    total: int
    spare: float


def _rounds(tokens: int, round_tokens: int) -> int:
    return min(MOST_ROUNDS, max(1, -(-tokens // round_tokens)))


def _about(texts: DataFrame) -> int:
    """Tokens of all texts, about."""
    rows, size = texts.select(F.count("*"), F.sum(F.octet_length("text"))).first()
    return 3 * rows + (size or 0) // 4


def learn(texts: DataFrame, asking: int = 0, block_tokens: int = BLOCK_TOKENS, shard_entries: int = SHARD_ENTRIES, round_tokens: int = ROUND_TOKENS, read: Callable[[], None] | None = None) -> Counts | None:
    """The counts of all ``texts``, for documents of about ``asking`` tokens a round; None without texts.  ``read`` is called when
    ``texts`` are no longer read.

    A shard's entries have five counts: of a word, the total of the distinct pairs' counts that it begins, how many of these are one,
    two and more, and the words that it follows; of a pair, its total, how many of its triples' counts are one, two and more, and the
    words that it follows; of a triple, its count.
    """
    stored = _blocks(texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "text"), block_tokens)
    tokens = int(stored.select(F.sum(F.length("tokens") / 4)).first()[0] or 0)
    if read:
        read()
    if not tokens:
        unstash(stored)
        return None
    shards = max(1, -(-2 * max(tokens, asking) // shard_entries))
    rounds = min(shards, _rounds(tokens, round_tokens))

    def send(first: int, last: int, following: bool):
        """Distinct triples with a pair in shards ``first`` to ``last``: the one that they begin with, or the one ``following``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                g = _Grams(row)
                a, b, c = (g.known[k : len(g.known) - 2 + k][g.three] for k in range(3))
                pair = pair_keys(b, c) if following else pair_keys(a, b)
                shard = _shard(pair, shards)
                here = np.flatnonzero((shard >= first) & (shard < last))
                order, starts = _groups(g.triple[here])
                n, at = np.diff(starts, append=len(order)), here[order[starts]]
                again = np.argsort(pair[at], kind="stable")
                n, at = n[again], at[again]
                out = []
                for k, x, y in _ranges(shard[at]):
                    part = at[x:y]
                    keys, runs = np.unique(pair[part], return_counts=True)
                    if following:
                        start = part[np.cumsum(runs) - runs]
                        said = (b[start].tobytes(), c[start].tobytes(), (a[part] >> np.uint64(1)).view(np.uint8).reshape(-1, 8)[:, :_LOW].tobytes())
                    else:
                        said = (pack_sorted(keys), b"", g.triple[part].view(np.uint8).reshape(-1, 8)[:, :_LOW].tobytes())
                    out.append((k, len(keys), len(part), *said, _pack_counts(runs), b"" if following else _pack_counts(n[x:y])))
                yield _batch(out, _SENT)

        return run

    def low(data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // _LOW, 8), np.uint8)
        out[:, :_LOW] = np.frombuffer(data, np.uint8).reshape(-1, _LOW)
        return out.reshape(-1).view(np.uint64)

    def begun(sent: pa.Table) -> pa.Table:
        """Triples' counts, and pairs as contexts."""
        pairs, ends, counts = [], [], []
        for n_pairs, n, first, third, runs, times in zip(*(sent.column(c).to_pylist() for c in ("pairs", "n", "first", "third", "runs", "times")), strict=True):
            pairs.append(np.repeat(unpack_sorted(first), _unpack_counts(runs, n_pairs)))
            ends.append(low(third))
            counts.append(_unpack_counts(times, n))
        pair = np.concatenate(pairs)
        triple = (pair & _SHARED) | np.concatenate(ends)
        order, starts = _groups(triple)
        n, at = _sums(np.concatenate(counts)[order], starts), order[starts]
        contexts, first = _groups(pair[at])
        out = _pieces(triple[at], [n, 0, 0, 0, 0], _tally(n), shards)
        return _rows(out + _pieces(pair[at][contexts[first]], [*_of_count(n[contexts], first), 0], [0] * 6, shards), _PIECE)

    def followed(sent: pa.Table) -> pa.Table:
        """Pairs' continuation counts, and what they add to their words."""
        firsts, seconds, befores = [], [], []
        for n_pairs, first, second, third, runs in zip(*(sent.column(c).to_pylist() for c in ("pairs", "first", "second", "third", "runs")), strict=True):
            times = _unpack_counts(runs, n_pairs)
            firsts.append(np.repeat(np.frombuffer(first, np.uint64), times))
            seconds.append(np.repeat(np.frombuffer(second, np.uint64), times))
            befores.append(low(third))
        b, c = np.concatenate(firsts), np.concatenate(seconds)
        pair = pair_keys(b, c)
        order, starts = _groups(_triple_keys(pair, np.concatenate(befores)))
        at = order[starts]
        order, starts = _groups(pair[at])
        n, at = np.diff(starts, append=len(order)), at[order[starts]]
        out = _pieces(pair[at], [0, 0, 0, 0, n], _tally(n), shards)
        order, starts = _groups(b[at])
        out += _pieces(b[at][order[starts]], [*_of_count(n[order], starts), 0], [0] * 6, shards)
        order, starts = _groups(c[at])
        return _rows(out + _pieces(c[at][order[starts]], [0, 0, 0, 0, np.diff(starts, append=len(order))], [0] * 6, shards), _PIECE)

    def add(pieces: pa.Table) -> pa.Table:
        """All entries of a shard, once; the tally is that of its words."""
        keys, counts = _entries(pieces)
        order, starts = _groups(keys)
        keys = keys[order[starts]]
        counts = [_sums(c[order], starts) for c in counts]
        return _rows(_pieces(keys, counts, _tally(counts[4][(keys & np.uint64(1) == 0) & (counts[4] > 0)]), shards), _PIECE)

    found, tallies = [], []
    ranges = [(k * shards // rounds, (k + 1) * shards // rounds) for k in range(rounds)]
    for work, following in ((begun, False), (followed, True)):
        parts = []
        for first, last in ranges:
            sent = stored.mapInArrow(send(first, last, following), _SENT_DDL).repartition(last - first, "shard")
            parts.append(stash(sent.groupBy("shard").applyInArrow(work, _PIECE_DDL), "quality-counts"))
        found.append(parts)
        tallies.append(_added(parts))
    unstash(stored)
    (contexts, rest), tables = found, []
    for (first, last), part in zip(ranges, contexts):  # what follows adds to words of every shard
        pieces = _union([part, *rest]).filter(F.col("shard").between(first, last - 1)).select("shard", "n", "keys", "counts")
        tables.append(stash(pieces.repartition(last - first, "shard").groupBy("shard").applyInArrow(add, _PIECE_DDL), "quality-model"))
        unstash(part)
    for part in rest:
        unstash(part)
    *n, vocabulary, total = words = _added(tables)
    cuts = [_cuts(*x[:4]) for x in (words, tallies[1], tallies[0])]
    spare = (cuts[0][0] * n[0] + cuts[0][1] * n[1] + cuts[0][2] * (vocabulary - n[0] - n[1])) / total
    return Counts([t.select("shard", "n", "keys", "counts") for t in tables], shards, cuts, vocabulary, total, spare)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _added(parts: list[DataFrame]) -> list[int]:
    """Sum of the tallies."""
    rows = [part.select(*(F.sum(f"t{k}") for k in range(6))).first() for part in parts]
    return [sum(x or 0 for x in column) for column in zip(*rows)]


def _entries(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and five rows of counts of all pieces, one after the other."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros((5, 0), np.int64)]
    for n, packed, values in zip(*(pieces.column(c).to_pylist() for c in ("n", "keys", "counts")), strict=True):
        keys.append(unpack_sorted(packed))
        counts.append(_unpack_counts(values, 5 * n).reshape(5, n))
    return np.concatenate(keys), np.concatenate(counts, axis=1)


_SENT = pa.schema([("shard", pa.int64()), ("pairs", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("first", "second", "third", "runs", "times"))])
_SENT_DDL = "shard long, pairs long, n long, first binary, second binary, third binary, runs binary, times binary"
_ASK = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary())])
_ASK_DDL = "block long, shard long, keys binary"
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("held", pa.binary()), ("counts", pa.binary())])
_ANSWER_DDL = "block long, shard long, n long, held binary, counts binary"
_SCORES = "doc_id long, lang string, n_tokens long, log10_ppl double"


def _log10(g: _Grams, place: np.ndarray, held: np.ndarray, counts: np.ndarray, model: Counts) -> np.ndarray:
    """Log10 probability of each triple of a block, from the answers: ``place`` of each of its n-grams in the asked keys."""
    cut1, cut2, cut3 = (np.array([0.0, *c]) for c in model.cuts)
    off = lambda n, cut: n - cut[np.minimum(n, 3)]

    def weights(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts: total, the share left over, and the weight that backs off (1 where nothing is left)."""
        total = np.maximum(counts[0], 1)
        share = (cut[1] * counts[1] + cut[2] * counts[2] + cut[3] * counts[3]) / total
        return total, share, np.where(share > 0, share, 1.0)

    entry = np.where(held, np.cumsum(held, dtype=np.int32) - 1, np.int32(len(counts[0])))[place]  # row of a held key; the last one is zeros: not held
    counts = np.concatenate((counts, np.zeros((5, 1), np.int64)), axis=1)
    word, pair, triple = np.split(entry, [len(g.words), len(g.words) + len(g.pair)])
    n1 = counts[4][word]
    p1 = np.where(n1 > 0, off(n1, cut1) / model.total + model.spare / (model.vocabulary + 1), max(model.spare, 1e-9) / (model.vocabulary + 1))[g.tokens]
    total, share, back = (x[word][g.tokens][:-1][g.two] for x in weights(cut2))
    n2, below = counts[4][pair], p1[1:][g.two]
    p2 = np.zeros(len(g.two))
    p2[g.two] = np.where(n2 > 0, off(n2, cut2) / total + share * below, back * below)
    context = np.zeros(len(g.two), np.int64)
    context[g.two] = pair
    context = context[:-1][g.three]
    total, share, back = (x[context] for x in weights(cut3))
    n3, below = counts[0][triple], p2[1:][g.three]
    return np.log10(np.where(n3 > 0, off(n3, cut3) / total + share * below, back * below))


def scores(docs: DataFrame, model: Counts, rounds: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, lang, n_tokens, log10_ppl`` (per token) of ``docs``, a share of them in each round."""
    shards = model.shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            keys = np.sort(_Grams(row).all())
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
            yield _batch([(row["block"], shard, pack_sorted(keys[a:b])) for shard, a, b in _ranges(_shard(keys, shards))], _ASK)

    def answer(asked: pa.Table, pieces: pa.Table) -> pa.Table:
        every, counts = _entries(pieces)
        out = []
        for block, shard, data in zip(*(asked.column(c).to_pylist() for c in ("block", "shard", "keys")), strict=True):
            keys = unpack_sorted(data)
            at = np.minimum(np.searchsorted(every, keys), max(0, len(every) - 1))
            held = every[at] == keys if len(every) else np.zeros(len(keys), bool)
            out.append((block, shard, len(keys), np.packbits(held).tobytes(), _pack_counts(counts[:, at[held]].reshape(-1) if len(every) else counts.reshape(-1))))
        return _rows(out, _ANSWER)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c.split()[0]: pa.array([], k) for c, k in zip(_SCORES.split(", "), (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)})
        row = left.to_pylist()[0]
        g = _Grams(row)
        keys = g.all()
        order = np.argsort(keys)
        ordered, place = keys[order], np.empty(len(keys), np.int32)
        place[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])), dtype=np.int32)
        held, counts = [], []
        for _, n, bits, values in sorted(zip(*(right.column(c).to_pylist() for c in ("shard", "n", "held", "counts")), strict=True)):
            held.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool))
            some = int(held[-1].sum())
            counts.append(_unpack_counts(values, 5 * some).reshape(5, some))
        p3 = _log10(g, place, np.concatenate(held), np.concatenate(counts, axis=1), model)
        tokens = g.lengths - 2
        sums = np.add.reduceat(p3, np.cumsum(tokens) - tokens)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "n_tokens": tokens, "log10_ppl": -sums / tokens})

    table, model, out = _union(model.tables), model._replace(tables=[]), []
    for k in range(rounds):
        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.lit("round")), F.lit(rounds)) == k) if rounds > 1 else docs
        stored = _blocks(part, block_tokens)
        tasks = max(1, stored.count())
        asked = stored.mapInArrow(ask, _ASK_DDL).repartition(shards, "shard").groupBy("shard")
        answered = stash(asked.cogroup(table.repartition(shards, "shard").groupBy("shard")).applyInArrow(answer, _ANSWER_DDL), "quality-answers")
        left, right = stored.repartition(tasks, "block"), answered.repartition(tasks, "block")
        out.append(stash(left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(score, _SCORES), "quality-scores"))
        unstash(stored)
        unstash(answered)
    return _union(out)


def whole_perplexities(docs: DataFrame, texts: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_entries: int = SHARD_ENTRIES, round_tokens: int = ROUND_TOKENS, read: Callable[[], None] | None = None) -> DataFrame:
    """``doc_id, lang, n_tokens, log10_ppl`` (per token) of ``docs``, by a model of any size of all ``texts``: what
    :func:`perplexities` gives with :func:`train`, through shards.  ``read`` is called when ``texts`` are no longer read."""
    with shuffles_deleted(docs.sparkSession):
        tokens = _about(docs)
        rounds = _rounds(tokens, round_tokens)
        model = learn(texts, tokens // rounds, block_tokens, shard_entries, round_tokens, read)
        if model is None:
            stored = _blocks(docs, block_tokens)
            ids = stored.select(F.inline(F.arrays_zip("doc_ids", "langs", "lengths")))
            return ids.select(F.col("doc_ids").alias("doc_id"), F.col("langs").alias("lang"), (F.col("lengths") - 2).alias("n_tokens"), F.lit(0.0).alias("log10_ppl"))
        out = scores(docs, model, rounds, block_tokens)
        for table in model.tables:
            unstash(table)
        return out


def classify(docs: DataFrame, labels: DataFrame, trusted: int | None = None, quantile: float = QUANTILE, chars: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, lang, n_tokens, perplexity, threshold, keep``.

    Trusted documents are those labelled ``quality = 1`` and not also 0.  All of one half of them (by the parity of
    the id's hash) train the model, the smallest text of an id that repeats; a caller may ask for at most ``trusted`` (smallest hash)
    with at most ``chars`` characters.  All others set the thresholds: per language the ``quantile`` of log perplexity, over all languages where a
    language (or a null one) has fewer than ``LEAST``.  Whole texts are scored, of any length.  A null or empty text is an end
    token alone.  Without trusted documents there is no threshold and every document is kept.  Repeated rows each
    give a row; ties with the threshold are kept; labels without a document have no effect.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"))
    marks = stash(marks.filter("low = 1").select("doc_id"), "quality-trusted")
    half = lambda df: df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    sample = half(marks) if trusted is None else half(marks).orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = half(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small_side(sample, MANY_IDS), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    if chars is not None:
        upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        texts = texts.withColumn("chars", F.sum(F.length("text")).over(upto)).filter(F.col("chars") <= chars)
    with shuffles_deleted(docs.sparkSession):
        texts = stash(texts.select("doc_id", "text"), "quality-texts")
    chosen = stash(texts.select("doc_id"), "quality-chosen")
    scored = whole_perplexities(docs, texts, read=lambda: unstash(texts))
    rest = marks.join(chosen, "doc_id", "left_anti")
    fresh = scored.join(rest, "doc_id", "left_semi")
    rank = F.percentile_approx("log10_ppl", F.lit(quantile), F.lit(100_000))
    every = fresh.agg(rank.alias("every")).first()["every"]
    per = small_side(fresh.groupBy(F.col("lang").alias("__lang")).agg(rank.alias("own"), F.count("*").alias("n")).filter((F.col("n") >= LEAST) & F.col("__lang").isNotNull()).drop("n"), SMALL_ROWS)
    met = scored.join(per, F.col("lang") == F.col("__lang"), "left")
    limit = F.coalesce("own", F.lit(every).cast("double"))
    power = lambda x: F.pow(F.lit(10.0), x)
    return met.select("doc_id", "lang", "n_tokens", power(F.col("log10_ppl")).alias("perplexity"), power(limit).alias("threshold"), F.coalesce(F.col("log10_ppl") <= limit, F.lit(True)).alias("keep"))
