"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of equal size by a hash of their id, so copies of one vector spread evenly; shards grow
with the square root of the table, as every query meets every shard (see :func:`shard_size`).  Within a shard equal
vectors are one node with a list of ids.  A shard's graph is stored as flat arrays (one
neighbour array for all levels) in one row of a table in the shared folder.  Query blocks meet every shard in an
equi-join, and the shards' results are merged by exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

QUERY_ROWS = 1024
#: Rows of a shard in tables of up to ``ONE_SIZE`` rows, and most rows and bytes of vectors of a shard in larger ones.
SHARD_ROWS, ONE_SIZE, MOST_ROWS, MOST_BYTES = 4096, 1 << 16, 1 << 16, 1 << 27
M, EF_BUILD, EF_SEARCH, SEED = 16, 80, 96, 42


def shard_size(rows: int, dim: int) -> int:
    """Rows of a shard: ``SHARD_ROWS``, growing with the square root of the rows over ``ONE_SIZE``, bounded for one task's sake."""
    grown = math.isqrt(max(rows, ONE_SIZE) * SHARD_ROWS**2 // ONE_SIZE)
    return max(1, min(grown, MOST_ROWS, MOST_BYTES // (8 * max(1, dim))))


def width(base: int, nodes: int) -> int:
    """Candidates kept while walking a graph: ``base``, growing with the square root of the nodes, which keeps the recall of large shards."""
    return math.ceil(base * math.sqrt(max(1.0, nodes / SHARD_ROWS)))


class Graph:
    """Flat small-world graph over the rows of ``points``.

    ``slots[offset[i] + level_start(l) ...]`` holds node ``i``'s neighbours on level ``l``: ``2 * M`` places on
    level 0 and ``M`` on each higher one, -1 where empty.
    """

    def __init__(self, points: np.ndarray, levels: np.ndarray, slots: np.ndarray, entry: int) -> None:
        self.points, self.levels, self.slots, self.entry = points, levels, slots, entry
        self.offset = np.concatenate(([0], np.cumsum(2 * M + levels.astype(np.int64) * M)))
        self.stamp = np.zeros(len(points), np.int32)
        self.round = 0

    def place(self, node: int, level: int) -> slice:
        start = int(self.offset[node]) + (2 * M + (level - 1) * M if level else 0)
        return slice(start, start + (M if level else 2 * M))

    def near(self, node: int, level: int) -> np.ndarray:
        got = self.slots[self.place(node, level)]
        return got[got >= 0]

    def distances(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gap = self.points[nodes] - query
        return np.einsum("ij,ij->i", gap, gap)

    def walk(self, query: np.ndarray, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest found from ``start`` on one level, nearest first."""
        self.round += 1
        stamp, mark = self.stamp, self.round
        todo, best = list(start), [(-d, -n) for d, n in start]
        todo.sort()
        best.sort()
        for _, n in start:
            stamp[n] = mark
        while todo:
            d, node = heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            fresh = self.near(node, level)
            fresh = fresh[stamp[fresh] != mark]
            if not len(fresh):
                continue
            stamp[fresh] = mark
            for x, n in zip(self.distances(query, fresh).tolist(), fresh.tolist()):
                if len(best) < ef:
                    heappush(best, (-x, -n))
                    heappush(todo, (x, n))
                elif x < -best[0][0]:
                    heappop(best)
                    heappush(best, (-x, -n))
                    heappush(todo, (x, n))
        return sorted((-d, -n) for d, n in best)

    def choose(self, found: list[tuple[float, int]], room: int) -> list[int]:
        """Neighbours that are nearer to the centre than to a neighbour already chosen, then the nearest others."""
        if len(found) <= room:
            return [n for _, n in found]
        nodes = np.array([n for _, n in found])
        points = self.points[nodes]
        norms = np.einsum("ij,ij->i", points, points)
        between = norms[:, None] + norms[None, :] - 2 * (points @ points.T)
        reach, chosen, spare = np.full(len(found), np.inf), [], []
        for k, (d, _) in enumerate(found):
            if d < reach[k]:
                chosen.append(k)
                np.minimum(reach, between[k], out=reach)
                if len(chosen) == room:
                    break
            else:
                spare.append(k)
        chosen += spare[: room - len(chosen)]
        return nodes[chosen].tolist()

    def link(self, node: int, other: int, level: int) -> None:
        place = self.place(node, level)
        row = self.slots[place]
        empty = np.flatnonzero(row < 0)
        if len(empty):
            row[empty[0]] = other
            return
        all_ = np.append(row, other)
        d = self.distances(self.points[node], all_)
        order = np.argsort(d, kind="stable")
        row[:] = -1
        kept = self.choose(list(zip(d[order].tolist(), all_[order].tolist())), len(row))
        row[: len(kept)] = kept

    @classmethod
    def build(cls, points: np.ndarray, ef: int | None = None, seed: int = SEED) -> Graph:
        ef = ef or width(EF_BUILD, len(points))
        random = np.random.default_rng(seed)
        levels = np.minimum(12, (-np.log(1 - random.random(len(points))) / np.log(M)).astype(np.int64)).astype(np.int8)
        graph = cls(points, levels, np.zeros(0, np.int32), 0)
        graph.slots = np.full(int(graph.offset[-1]), -1, np.int32)
        for node in range(1, len(points)):
            query, top, own = points[node], int(levels[graph.entry]), int(levels[node])
            at = [(float(graph.distances(query, np.array([graph.entry]))[0]), graph.entry)]
            for level in range(top, own, -1):
                at = graph.walk(query, at, 1, level)
            for level in range(min(top, own), -1, -1):
                at = graph.walk(query, at, ef, level)
                chosen = graph.choose(at, M)
                place = graph.place(node, level)
                graph.slots[place.start : place.start + len(chosen)] = chosen
                for other in chosen:
                    graph.link(other, node, level)
            if own > top:
                graph.entry = node
        return graph

    def search(self, query: np.ndarray, k: int, ef: int | None = None) -> list[int]:
        """About the ``k`` nearest nodes; exact where the shard has ``ef`` nodes or fewer."""
        ef = ef or width(EF_SEARCH, len(self.points))
        if len(self.points) <= max(k, ef):
            return np.argsort(self.distances(query, np.arange(len(self.points))), kind="stable")[:k].tolist()
        at = [(float(self.distances(query, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self.walk(query, at, 1, level)
        return [n for _, n in self.walk(query, at, max(k, ef), 0)[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector array<double>, dim)`` of the rows that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    plain = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & plain & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


_INDEX = "shard long, dim int, points binary, levels binary, slots binary, entry int, first binary, ids binary"


def build_index(vectors: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """Index every usable row: one row per shard and dimension, as flat little-endian arrays.

    ``points`` float64, ``levels`` int8, ``slots`` int32, ``ids`` int64 with ``first[i]..first[i + 1]`` the ids of
    node ``i``.  Shards have about ``shard_rows`` rows, or :func:`shard_size` of the table's rows and longest vector.
    """
    rows = usable(vectors)
    count, dim = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    shards = max(1, -(-count // (shard_rows or shard_size(count, dim))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        flat = np.asarray(table.column("vector").combine_chunks().flatten())
        every = flat.reshape(-1, dim)
        ids = np.asarray(table.column("vec_id"))
        order = np.argsort(ids, kind="stable")
        every, ids = every[order] + 0.0, ids[order]  # -0.0 becomes 0.0
        points, node = np.unique(every, axis=0, return_inverse=True)
        shuffle = np.random.default_rng(SEED).permutation(len(points))
        points, rank = points[shuffle], np.argsort(shuffle)[node.reshape(-1)]
        members = np.argsort(rank, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(points))))).astype(np.int64)
        graph = Graph.build(points)
        row = [table.column("shard")[0].as_py(), dim, points.tobytes(), graph.levels.tobytes(), graph.slots.tobytes(), graph.entry, first.tobytes(), ids[members].astype(np.int64).tobytes()]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["shard", "dim", "points", "levels", "slots", "entry", "first", "ids"])

    parts = dealt.repartitionById(shards, "shard")  # a shard is a task of its own
    return stash(parts.groupBy("shard", "dim").applyInArrow(build, _INDEX), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` nearest found, by exact Euclidean distance.

    A query's own id is no candidate.  Queries and shards meet as blocks: (query block, shard) pairs are joined
    on the shard, so neither side is broadcast and no task holds more than a block and a shard.
    """
    asked = usable(queries).dropDuplicates(["vec_id", "vector"])
    shards = [r[0] for r in index.agg(F.max("shard")).collect()][0]
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).groupBy("block", "dim")
    packed = packed.agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    spread = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards or 0).cast("long"))))
    met = spread.join(index, ["shard", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                row = whole.slice(at, 1)
                got = {c: row.column(c)[0] for c in row.schema.names}
                binary = {c: got[c].as_buffer() for c in ("points", "levels", "slots", "first", "ids")}
                points = np.frombuffer(binary["points"], np.float64).reshape(-1, got["dim"].as_py())
                graph = Graph(points, np.frombuffer(binary["levels"], np.int8), np.frombuffer(binary["slots"], np.int32), got["entry"].as_py())
                first, ids = np.frombuffer(binary["first"], np.int64), np.frombuffer(binary["ids"], np.int64)
                out: list[tuple[int, int, float]] = []
                for asked in got["queries"].as_py():
                    query, own, best = np.array(asked["vector"]), asked["vec_id"], []
                    for node in graph.search(query, k + 1):
                        gap = points[node] - query
                        distance = float(np.sqrt(np.sum(gap * gap)))
                        # ids are in order: the k + 1 smallest of a node hold all that can be in the result
                        best += [(distance, int(i)) for i in ids[first[node] : first[node + 1]][: k + 1] if i != own]
                    out += [(own, i, d) for d, i in sorted(best)[:k]]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """The rows whose ``vec_id`` is divisible by ``every`` searched among all rows: see :func:`search`.

    Every usable row is indexed.  Rows with a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component, take no part; vectors of another length than the query's are no candidates; ties go to
    the smaller id; rows that repeat a query give its result once, and the copies of its id are no candidates;
    a table without usable rows gives no rows.
    """
    index = build_index(vectors, shard_rows)
    return search(index, vectors.filter(F.col("vec_id") % every == 0), k)
