"""Approximate nearest neighbours by one small-world graph per shard.

Vectors that take part are grouped first: equal vectors are one point with the
smallest ids that hold it (as many as a result can need), so that a vector which
a third of all rows share cannot tie the graph up in itself.  Points are dealt to
shards by a hash of their content; each shard's task builds a hierarchical
navigable small-world graph and keeps it as flat arrays: one neighbour array per
level with a fixed number of slots per point.  The shards are a table of their
own, staged, so a lost executor reloads and does not rebuild.  Queries go to every
shard in blocks; each shard returns its nearest points, and the shards' results
are merged by distance.

Distances are Euclidean in double precision on the original vectors.

Contract: vectors that are null, empty, zero or hold null or non-finite components
take no part, as candidates or queries; null ids take no part; vectors of
different lengths are never compared (they are in shards of their own); a query's
own row is no candidate but its copies are; ties go to the smaller id; fewer
candidates than k give fewer rows; an empty table gives none; other columns are
ignored.  Rows that repeat id and vector are one row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Points of a shard.
SHARD_POINTS = 2048
#: Links per point and level (twice as many on the lowest), and list sizes.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 80, 96
#: Queries of a block.
BLOCK = 256
#: A shard's id is its vectors' length in the upper half and its number in the lower.
_NUMBER = 0xFFFFFFFF
SHARD_SCHEMA = ("shard long, size int, points int, vectors binary, "
                "entry int, top int, levels binary, links binary, ids array<array<long>>")


class Graph:
    """A small-world graph in flat arrays.

    ``links[l]`` has a row of slots per point for level l, -1 where empty.
    """

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, entry: int,
                 links: list[np.ndarray]):
        self.vectors, self.levels, self.entry, self.links = vectors, levels, entry, links

    def distances(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        gap = self.vectors[at] - query
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, query: np.ndarray, entries: list[tuple[float, int]], width: int,
                level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest points found on a level, nearest first."""
        links = self.links[level]
        seen = np.zeros(len(self.vectors), bool)
        seen[[p for _, p in entries]] = True
        open_ = list(entries)
        heapq.heapify(open_)
        best = [(-d, p) for d, p in entries]
        heapq.heapify(best)
        while open_:
            d, point = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[point]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            far = self.distances(near, query)
            if len(best) >= width:
                close = far < -best[0][0]
                near, far = near[close], far[close]
            for x, p in zip(far.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-x, p))
                    heapq.heappush(open_, (x, p))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, p))
                    heapq.heappush(open_, (x, p))
        return sorted((-d, p) for d, p in best)

    def search(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        start = [(float(self.distances(np.array([self.entry]), query)[0]), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            start = self.nearest(query, start, 1, level)
        return self.nearest(query, start, width, 0)


def _spread(graph: Graph, found: list[tuple[float, int]], count: int) -> list[int]:
    """Links that point in different directions, then the nearest of the rest."""
    if len(found) <= count:
        return [p for _, p in found]
    points = np.array([p for _, p in found])
    vectors = graph.vectors[points]
    square = np.einsum("ij,ij->i", vectors, vectors)
    apart = square[:, None] + square[None, :] - 2 * vectors @ vectors.T
    kept: list[int] = []
    closest = np.full(len(found), np.inf)
    for i, (d, _) in enumerate(found):
        if d < closest[i]:
            kept.append(i)
            np.minimum(closest, apart[i], out=closest)
            if len(kept) == count:
                break
    taken = set(kept)
    kept += [i for i in range(len(found)) if i not in taken][:count - len(kept)]
    return points[kept].tolist()


def build(vectors: np.ndarray, seed: int) -> Graph:
    """The graph of ``vectors`` (points by row), inserted in order."""
    count = len(vectors)
    random = np.random.default_rng(seed)
    levels = np.floor(-np.log(1 - random.random(count)) / math.log(LINKS)).astype(np.int8)
    slots = [2 * LINKS if level == 0 else LINKS for level in range(int(levels.max()) + 1)]
    links = [np.full((count, s), -1, np.int32) for s in slots]
    used = [np.zeros(count, np.int32) for _ in slots]
    graph = Graph(vectors, levels, 0, links)
    for point in range(1, count):
        query, high = vectors[point], int(levels[graph.entry])
        found = [(float(graph.distances(np.array([graph.entry]), query)[0]), graph.entry)]
        for level in range(high, int(levels[point]), -1):
            found = graph.nearest(query, found, 1, level)
        for level in range(min(high, int(levels[point])), -1, -1):
            found = graph.nearest(query, found, BUILD_WIDTH, level)
            own = _spread(graph, found, LINKS)
            links[level][point, :len(own)] = own
            used[level][point] = len(own)
            for other in own:
                n = used[level][other]
                if n < slots[level]:
                    links[level][other, n] = point
                    used[level][other] = n + 1
                    continue
                near = np.append(links[level][other], point)
                far = graph.distances(near, vectors[other])
                order = np.argsort(far, kind="stable")
                keep = _spread(graph, list(zip(far[order].tolist(), near[order].tolist())),
                               slots[level])
                links[level][other, :len(keep)] = keep
        if levels[point] > high:
            graph.entry = point
    return graph


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part; vectors as doubles."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return (table.select(F.col(key).cast("long").alias("id"),
                         F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"))
            .where(F.col("id").isNotNull() & F.col("vector").isNotNull())
            .where(fine & F.exists("vector", lambda x: x != 0)).distinct())


def points(table: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vector, size, ids): each vector that takes part with its k + 1 smallest ids."""
    rows = usable(table, key, vector)
    # The rank limit is applied before the shuffle as well, so a vector that very
    # many rows share sends k + 1 rows per task.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return (rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
            .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select("vector", F.size("vector").alias("size"), "ids"))


def index(distinct: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row per shard: its points and its graph as flat arrays."""
    sizes = distinct.groupBy("size").count()
    shards = sizes.select("size", F.ceil(F.col("count") / shard_points).alias("shards"))
    dealt = distinct.join(shards, "size").withColumn(
        "shard", F.col("size") * F.lit(1 << 32) + F.pmod(F.xxhash64("vector"), F.col("shards")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vectors, ids = None, [], []

        def made() -> pa.RecordBatch:
            graph = build(np.array(vectors), current & _NUMBER)
            return pa.RecordBatch.from_pylist([{
                "shard": current, "size": graph.vectors.shape[1], "points": len(ids),
                "vectors": graph.vectors.tobytes(), "entry": graph.entry,
                "top": len(graph.links) - 1, "levels": graph.levels.tobytes(),
                "links": b"".join(x.tobytes() for x in graph.links), "ids": ids}], schema)

        schema = pa.schema([("shard", pa.int64()), ("size", pa.int32()), ("points", pa.int32()),
                            ("vectors", pa.binary()), ("entry", pa.int32()), ("top", pa.int32()),
                            ("levels", pa.binary()), ("links", pa.binary()),
                            ("ids", pa.list_(pa.list_(pa.int64())))])
        for batch in rows:
            for shard, vector, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if shard != current and vectors:
                    yield made()
                    vectors, ids = [], []
                current = shard
                vectors.append(vector)
                ids.append(own)
        if vectors:
            yield made()

    count = max(1, dealt.select("shard").distinct().count())
    return (dealt.select("shard", "vector", "ids").repartitionByRange(count, "shard")
            .sortWithinPartitions("shard", "vector").mapInArrow(run, SHARD_SCHEMA))


def _graph(row: dict) -> Graph:
    vectors = np.frombuffer(row["vectors"]).reshape(row["points"], row["size"])
    flat, links, at = np.frombuffer(row["links"], np.int32), [], 0
    for level in range(row["top"] + 1):
        slots = 2 * LINKS if level == 0 else LINKS
        links.append(flat[at:at + row["points"] * slots].reshape(row["points"], slots))
        at += row["points"] * slots
    return Graph(vectors, np.frombuffer(row["levels"], np.int8), row["entry"], links)


def _search(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                graph = _graph(row)
                ids, query_ids, found, far = row["ids"], [], [], []
                queries = np.frombuffer(row["queries"]).reshape(-1, row["size"])
                for query_id, query in zip(row["query_ids"], queries):
                    hits = np.array([p for _, p in graph.search(query, max(width, k + 1))][:k + 1])
                    gap = graph.vectors[hits] - query
                    for d, p in zip(np.sqrt((gap * gap).sum(1)).tolist(), hits.tolist()):
                        for other in ids[p]:
                            if other != query_id:
                                query_ids.append(query_id)
                                found.append(other)
                                far.append(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids, pa.int64()), pa.array(found, pa.int64()),
                     pa.array(far, pa.float64())], ["query_id", "vec_id", "score"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries of one size: (size, query_ids, queries)."""
    held: dict[int, tuple[list, list]] = {}

    def block(size: int) -> pa.RecordBatch:
        ids, vectors = held.pop(size)
        return pa.RecordBatch.from_arrays(
            [pa.array([size], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([np.array(vectors, float).tobytes()], pa.binary())],
            ["size", "query_ids", "queries"])

    for batch in batches:
        for query_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, vectors = held.setdefault(len(vector), ([], []))
            ids.append(query_id)
            vectors.append(vector)
            if len(ids) == BLOCK:
                yield block(len(vector))
    for size in list(held):
        yield block(size)


def search(shards: DataFrame, queries: DataFrame, k: int = 10,
           width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found over all shards.

    ``queries``: (query_id, vector of doubles).  A block of queries meets each
    shard of its vector length.
    """
    blocks = stage(queries.mapInArrow(
        _pack, "size int, query_ids array<long>, queries binary"), "queries")
    # A few rows, one per vector length: the shards' numbers run from 0.
    counts = shards.groupBy("size").agg((F.max(F.col("shard").bitwiseAND(F.lit(_NUMBER))) + 1)
                                        .alias("shards"))
    sent = (blocks.join(counts, "size")
            .withColumn("number", F.explode(F.expr("sequence(0L, shards - 1)")))
            .select((F.col("size") * F.lit(1 << 32) + F.col("number")).alias("shard"),
                    "query_ids", "queries"))
    hits = (shards.join(sent, "shard").select("size", "points", "vectors", "entry", "top", "levels", "links", "ids",
                       "query_ids", "queries")
            .mapInArrow(_search(k, width), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (hits.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
