"""Sharded count joins between blocks of documents and corpus-wide n-gram counts.

A block is a bounded run of documents with its own small vocabulary.  For each of its distinct n-grams it sends
one (key, local count) entry; entries travel sorted and packed, by key range, so a frequent n-gram has at most an
entry per block, wherever it is common.  A shard adds the counts of equal keys and answers every block in the
order in which it asked.  No n-gram is cut off, and memory is bounded by a block or a shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stash, stash_texts, words_of

#: Tokens after which a block ends, about 250 bytes of arrays each in the task that counts or scores it; entries that a shard is meant to hold.
BLOCK_TOKENS, SHARD_ENTRIES = 500_000, 1_000_000
END = b"\n"  # the end of a text: no word can hold a line feed
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Fixed-width integers as byte planes, which compress well where high bytes are mostly equal."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as gaps, in byte planes."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def word_key(word: bytes) -> int:
    """Key of a word: even, while keys of pairs are odd."""
    return xxhash.xxh64_intdigest(word, 7) & ~1


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of ordered pairs (of words, or of a pair and a word) from the parts' keys."""
    mixed = (first ^ (first >> np.uint64(29))) * _MIX + (second ^ np.uint64(0x5851F42D4C957F2D))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29)) | np.uint64(1)


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learned", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary())])
_BLOCK_DDL = "block long, doc_ids array<bigint>, learned array<boolean>, lengths array<bigint>, tokens binary, words binary"


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs(doc_id, learned, text)`` -> stored blocks of token numbers; every text ends with one end token.

    ``tokens`` are numbers (int32 planes) into ``words`` (keys).  A text longer than a block is a block of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, learned, lengths, parts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, number), np.uint64, len(number))
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            row = {"block": task << 32 | count, "doc_ids": ids, "learned": learned, "lengths": lengths, "tokens": pack(tokens), "words": keys.tobytes()}
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for doc, learn, text in rows_of(batches, "doc_id", "learned", "text"):
            words = words_of(text)
            words.append(END)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            ids.append(doc)
            learned.append(learn)
            lengths.append(len(words))
            held += len(words)
            if held >= block_tokens:
                yield flush()
                number.clear()
                ids, learned, lengths, parts, held, count = [], [], [], [], 0, count + 1
        if ids:
            yield flush()

    return stash_texts(docs.select("doc_id", "learned", "text").mapInArrow(run, _BLOCK_DDL), "lm-blocks")


class Block:
    """A block's arrays: token numbers, document of each position, and its distinct n-gram keys in order."""

    def __init__(self, row: dict) -> None:
        self.ids, self.learned = row["doc_ids"], np.array(row["learned"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.tokens, self.words = unpack(row["tokens"], np.int32), np.frombuffer(row["words"], np.uint64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        known = self.words[self.tokens]
        # the word before: at a text's start, the end token stands for "no word yet"
        before = np.empty_like(known)
        before[1:] = known[:-1]
        before[self.starts] = np.uint64(word_key(END))
        self.previous = np.empty_like(self.tokens)
        self.previous[1:] = self.tokens[:-1]
        ends = self.tokens[self.starts + self.lengths - 1]
        self.previous[self.starts] = ends
        self.pairs, self.pair = np.unique(pair_keys(before, known), return_inverse=True)
        self.order = np.argsort(self.words, kind="stable")

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (words, then pairs, merged) and their counts in the documents to learn from."""
        use = self.learned[self.doc]
        singles = np.bincount(self.tokens[use], minlength=len(self.words))
        doubles = np.bincount(self.pair[use], minlength=len(self.pairs))
        keys = np.concatenate((self.words, self.pairs))
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate((singles, doubles))[order]

    def counts(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of words and of pairs from the answers to :meth:`entries`."""
        keys = np.concatenate((self.words, self.pairs))
        back = np.empty(len(keys), np.int64)
        back[np.argsort(keys, kind="stable")] = answers
        return back[: len(self.words)], back[len(self.words) :]


_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64()), ("tokens", pa.int64())])
_ANSWER_DDL = "block long, shard long, counts binary, n long, distinct long, tokens long"


def answers(stored: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Corpus-wide counts of the ``n`` keys of a block in a shard's range, in its order.

    ``distinct`` and ``tokens`` sum up to those of the corpus: a shard's first row has its words, the others 0.
    """
    size = stored.select(F.sum(F.length("tokens") / 4)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_entries))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                keys, counts = Block(row).entries()
                # key ranges of equal width: key * shards / 2**64, from the upper half of the key
                shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                # a message for each shard that the block has a key of: never more messages than entries
                starts = np.flatnonzero(np.diff(shard, prepend=np.uint64(shards)))
                ends = np.append(starts[1:], len(keys))
                for a, b in zip(starts.tolist(), ends.tolist()):
                    data = [[row["block"]], [int(shard[a])], [pack_sorted(keys[a:b])], [pack(counts[a:b].astype(np.int32))]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "shard", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        counts = np.concatenate([unpack(x.as_py(), np.int32) for x in table.column("counts")])
        sizes = [len(k) for k in keys]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, weights=counts).astype(np.int64)
        words = sums[every & np.uint64(1) == 0]
        kind = np.int32 if sums.max() < 1 << 31 else np.int64
        total, cuts = sums.astype(kind)[place], np.cumsum([0, *sizes])
        packed = [pack(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        rest = [0] * (len(sizes) - 1)
        columns = [table.column("block"), table.column("shard"), packed, sizes, [int((words > 0).sum()), *rest], [int(words.sum()), *rest]]
        return pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(columns, _ANSWER.types, strict=True)], schema=_ANSWER)

    asked = stored.mapInArrow(ask, "block long, shard long, keys binary, counts binary").repartition(shards, "shard")
    return stash(asked.groupBy("shard").applyInArrow(answer, _ANSWER_DDL), "lm-answers")


def totals(answered: DataFrame) -> tuple[int, int]:
    """Distinct words, and tokens, among the documents to learn from."""
    return tuple(x or 0 for x in answered.agg(F.sum("distinct"), F.sum("tokens")).first())


_WHOLE_DDL = f"{_BLOCK_DDL}, counts binary, n long"


def merged(stored: DataFrame, answered: DataFrame) -> DataFrame:
    """Blocks with their answers put together, stored, so that several passes shuffle them once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(*(right.column(c).to_pylist() for c in ("shard", "n", "counts")), strict=True))
        counts = np.concatenate([unpack(x, np.int64 if len(x) == 8 * n else np.int32) for _, n, x in parts])
        return left.append_column("counts", pa.array([pack(counts)], pa.binary())).append_column("n", pa.array([len(counts)], pa.int64()))

    # as many tasks as blocks: what a task reads stays the same at any size
    tasks = max(1, stored.count())
    left, right = stored.repartition(tasks, "block"), answered.repartition(tasks, "block")
    return stash(left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, _WHOLE_DDL), "lm-merged")


def mapped(whole: DataFrame, use: Callable[[Block, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``use(block, word counts, pair counts)`` for every merged block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block, data = Block(row), row["counts"]
                yield from use(block, *block.counts(unpack(data, np.int64 if len(data) == 8 * row["n"] else np.int32))).to_batches()

    return whole.mapInArrow(run, schema)


def joined(stored: DataFrame, answered: DataFrame, use: Callable[[Block, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """:func:`mapped` over blocks and their answers."""
    return mapped(merged(stored, answered), use, schema)
