"""Exact n-gram Jaccard join by blocked sparse products.

1. Every text becomes the set of its word n-grams (64-bit hashes).  Documents
   with equal sets are one class; only classes are compared.
2. Blocks.  Two sets whose Jaccard similarity reaches the threshold differ in at
   most m elements, m following from their sizes.  The hash space is cut into
   more than m + s segments, so more than s of those that are not empty are the same in
   both: classes that agree on as many are candidates.  Sets of similar size share a
   number of segments (size levels); a set also enters the level below if a
   partner could be there.  Equal segments meet in a range-partitioned, sorted
   stream that counts the pairs of a segment of few classes.  A segment of ``HOT``
   classes or more (a phrase of many unlike texts, or many copies) is spread over
   tasks and not paired: a class may have s / 2 of them in a level, which its pairs
   then need not share; one that has more is linked with all such classes of its
   segments.  So chance phrases, which a larger corpus has more of, tie no classes
   together.  The connected components of these links are the blocks; no similar
   pair lies across blocks.
   A block of more than ``TILE`` elements is split by the components of what
   small sketches of its sets allow, which again parts no similar pair.
3. Product.  In each block the class by n-gram incidence matrix is multiplied by
   its transpose row by row: overlap counts are accumulated over the columns of
   a row, rows out of the size bounds and rows already linked are discarded.  A
   block of more than ``TILE`` elements is cut into tiles by size band and hash,
   and pairs of tiles are multiplied.
4. Links that reach the threshold give the components.  Nothing else is delivered:
   pairs that earlier links already join are skipped, so neither the links nor their
   number comes out.

Contract: words are runs outside [\\x20\\x09-\\x0D], A-Z in lower case; a text with
fewer words than n has its whole sequence as its one n-gram; a null or empty
text has none and links with nothing.  Keys are long integers; rows that repeat
a key are separate rows with the same id; a null key is linked through equal sets
only.  Other columns of the input are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, contract
from .staging import stage, unstage
from .words import mix, slices

#: Ratio of the bounds of a size level.
RATIO = 1.5
#: Levels at most, a power of two: sizes up to a thousand million.
LEVELS = 64
#: Classes that make a segment a common one.
HOT = 16
#: Elements (shingles) of a tile: some 150 MB in its task.
TILE = 3 << 20
#: Parts of the hash space that a sketch counts at least, and elements a part at most.
PARTS, PER_PART = 128, 8
#: Least sketches of a tile, when large blocks are split; wider ones weigh more.
SKETCH_ROWS = 4096


@lru_cache(maxsize=None)
def _level(level: int, percent: int) -> tuple[int, int, int, int]:
    """(largest size, most differing elements of a pair, segments, those of them to spare)
    of a level: a pair shares more segments than there are to spare."""
    high = math.ceil(RATIO ** (level + 1)) - 1
    most = high * (100 - percent) // percent
    if most == 0:
        return high, 0, 0, 0
    spare = 1 + most // 8
    # Segments that happen to be empty in a set prove nothing: add as many as may be.
    low, segments = RATIO ** level, most + 1 + spare
    for _ in range(4):
        empty = segments * math.exp(-low / segments)
        segments = most + 1 + spare + math.ceil(empty + 4 * math.sqrt(empty) + 1)
    return high, most, segments, spare


def _levels(sizes: np.ndarray) -> np.ndarray:
    level = np.floor(np.log(np.maximum(sizes, 1)) / math.log(RATIO)).astype(np.int64)
    level += (np.ceil(RATIO ** (level + 1)) <= sizes)
    return level - (np.ceil(RATIO ** level) > sizes)


def _sets(texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, sorted and distinct per text; size per text; bounds)."""
    hashes, text, _ = texts.shingles(size)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    sizes = np.bincount(text[fresh], minlength=texts.count)
    return hashes[fresh], sizes, np.concatenate([[0], np.cumsum(sizes)])


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (mix(_sum(mix(hashes + np.uint64(11)), bounds)).view(np.int64),
            mix(_sum(mix(hashes ^ np.uint64(0x5555555555555555)), bounds)).view(np.int64))


def _signatures(hashes: np.ndarray, level: int, percent: int) -> np.ndarray:
    """Hashes of the segments of one set, for one level, which the lowest bits tell."""
    _, most, segments, spare = _level(level, percent)
    where = (mix(hashes + np.uint64(level)) % np.uint64(segments)).astype(np.int64)
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, where, mix(hashes ^ np.uint64(0x3333333333333333)))
    number = np.arange(segments, dtype=np.uint64) + np.uint64(level << 40)
    keys = mix(sums + mix(number)) & ~np.uint64(LEVELS - 1) | np.uint64(level)
    full = np.bincount(where, minlength=segments) > 0
    # Too many empty segments for the argument above: let them count as well.
    return keys if segments - full.sum() > segments - 1 - most - spare else keys[full]


def _sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per text how many of its elements fall into each part of the hash space.

    Two sets differ in no fewer elements than their counts do.  The number of parts, a
    power of two, grows with the set: counts of unlike sets differ by chance in about the
    root of a part's elements, which must not get lost in what the threshold allows.  Parts
    are nested: neighbours of a finer sketch add up to a coarser one's part.
    """
    parts = PARTS << np.ceil(np.log2(np.maximum(sizes / (PARTS * PER_PART), 1))).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(parts)])
    shift = np.uint64(64) - np.log2(parts).astype(np.uint64)
    part = (mix(hashes + np.uint64(29)) >> np.repeat(shift, sizes)).astype(np.int64)
    counts = np.bincount(np.repeat(starts[:-1], sizes) + part, minlength=starts[-1])
    data = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return [data[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _describe(size: int, percent: int, text: str):
    """Per row its size, fingerprints, sketch and, once per task and set, its signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for row, texts in slices(batch.column(text), fold=True):
                hashes, sizes, bounds = _sets(texts, size)
                one, two = _fingerprints(hashes, bounds)
                levels = _levels(sizes)
                found = []
                for i, (n, level, f) in enumerate(zip(sizes.tolist(), levels.tolist(),
                                                      one.tolist())):
                    if n == 0 or f in seen:
                        found.append(None)
                        continue
                    seen.add(f)
                    own = hashes[bounds[i]:bounds[i + 1]]
                    at = [level] if _level(level, percent)[2] else []
                    if level and _level(level - 1, percent)[2] and (
                            n * percent <= 100 * _level(level - 1, percent)[0]):
                        at.append(level - 1)
                    keys = [_signatures(own, x, percent) for x in at]
                    found.append(np.concatenate(keys).view(np.int64) if keys else None)
                lengths = [0 if k is None else len(k) for k in found]
                flat = [k for k in found if k is not None]
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                keys = pa.ListArray.from_arrays(
                    offsets, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(row, texts.count), pa.array(sizes.astype(np.int64)),
                     pa.array(one), pa.array(two),
                     pa.array(_sketches(hashes, sizes), pa.binary()), keys],
                    ["key", "n", "f1", "f2", "sketch", "segments"])
    return run


def _pairs(segment: np.ndarray, node: np.ndarray) -> np.ndarray:
    """(node, later node, level) of rows that share a segment; rows come sorted."""
    out = [np.zeros((3, 0), np.int64)]
    for step in range(1, HOT):
        same = segment[step:] == segment[:-step]
        if not same.any():
            break
        out.append(np.stack([node[:-step][same], node[step:][same],
                             segment[step:][same] & (LEVELS - 1)]))
    return np.concatenate(out, 1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, node, root, level, n): how many segments of few classes two nodes share
    (kind 0); (node, segment) of common segments (2) and of the part's first and last one,
    which may go on in another part (1, or 3 if the last one is common)."""
    first, kind = None, 0               # the part's first segment; kind of the rows held back
    held = np.zeros((2, 0), np.int64)   # the last run so far: (segment, node)
    pairs, count = [], 0

    def rows(kind: int, node: np.ndarray, root: np.ndarray, level: np.ndarray, n: np.ndarray):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(node), kind, np.int32)), pa.array(node), pa.array(root),
             pa.array(level.astype(np.int32)), pa.array(n)], ["kind", "node", "root", "level", "n"])

    def ends(kind: int, run: np.ndarray):
        return rows(kind, run[1], run[0], run[0] & (LEVELS - 1), np.ones(run.shape[1], np.int64))

    def counted():
        found = np.concatenate([np.zeros((3, 0), np.int64), *pairs], 1)
        found = found[:, np.lexsort(found)]
        at = np.flatnonzero(np.concatenate(
            [np.ones(min(1, found.shape[1]), bool), (found[:, 1:] != found[:, :-1]).any(0)]))
        return rows(0, *found[:, at], np.diff(at, append=found.shape[1]))

    for batch in batches:
        if not batch.num_rows:
            continue
        run = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in (0, 1)])], 1)
        fresh = np.ones(run.shape[1], bool)
        fresh[1:] = (run[:, 1:] != run[:, :-1]).any(0)
        run = run[:, fresh]
        starts = np.flatnonzero(np.concatenate([[True], run[0, 1:] != run[0, :-1]]))
        first = run[0, 0] if first is None else first
        lengths = np.diff(starts, append=run.shape[1])
        kinds = np.where(lengths >= HOT, 2, 0)
        kinds[0] = max(kinds[0], kind)  # held rows that were common before
        kinds[run[0, starts] == first] = 1
        kind = int(kinds[-1])
        # The last run waits for its end; of a common one, the last row tells repeats.
        last = starts[-1] if kind == 0 else run.shape[1] - 1
        done, of_row, held = run[:, :last], np.repeat(kinds, lengths)[:last], run[:, last:]
        for k in (1, 2):
            if (of_row == k).any():
                yield ends(k, done[:, of_row == k])
        pairs.append(_pairs(*done[:, of_row == 0]))
        count += pairs[-1].shape[1]
        if count > 1 << 20:
            yield counted()
            pairs, count = [], 0
    yield ends(3 if kind == 2 else 1, held)
    yield counted()


def _links(linked: DataFrame, percent: int) -> DataFrame:
    """Links of nodes that share enough segments, and of nodes with segments that are not
    counted: common ones, where the node has more of them in the level than its pairs can
    spare, and those at the ends of parts that are not common."""
    level = F.col("level")
    spare = F.get(F.array(*[F.lit(_level(i, percent)[3]) for i in range(LEVELS)]), level)
    uncounted = F.floor(spare / 2)
    near = (linked.where("kind = 0").groupBy("node", "root", "level").agg(F.sum("n").alias("n"))
            .where(F.col("n") > spare - uncounted))
    ends = linked.where("kind in (1, 3)")
    # Two segments a part at most.
    hot = (F.count(F.lit(1)) >= HOT) | (F.max("kind") == 3)
    ends = ends.join(F.broadcast(ends.groupBy("root").agg(hot.alias("hot"))), "root")
    common = (linked.where("kind = 2").unionByName(ends.where("hot").drop("hot"))
              .select("node", "root", "level"))
    many = (common.groupBy("node", "level").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > uncounted).select("node", "level"))
    held = common.join(many.hint("merge"), ["node", "level"], "left_semi")
    # A segment stands for itself here: if one equals a class, blocks only grow.
    return (near.select("node", "root").unionByName(held.select("node", "root"))
            .unionByName(ends.where("not hot").select("node", "root")))


def _blocks(described: DataFrame, percent: int) -> DataFrame:
    """(f1, block) of the classes that share enough segments with another class."""
    keys = described.select(F.explode("segments").alias("segment"), "f1")
    linked = stage(keys.repartitionByRange("segment", "f1").sortWithinPartitions("segment", "f1")
                   .mapInArrow(_neighbours, "kind int, node long, root long, level int, n long"),
                   "neighbours")
    stars = connected_components(_links(linked, percent))
    blocks = stage(stars.select(F.col("node").alias("f1"), F.col("root").alias("block"))
                   .union(stars.select("root", "root").distinct()), "blocks")
    unstage(linked, stars)
    return blocks


def _product(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the rows of a tile, by rows of the sparse product.

    ``sides`` 0: pairs among all rows; else only pairs of side 1 with side 2.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes, sides = [sets[i] for i in order], sizes[order], sides[order]
    count = len(sets)
    label = np.arange(count)
    columns = np.concatenate(sets)
    row_of = np.repeat(np.arange(count), sizes)
    by_column = np.argsort(columns, kind="stable")
    distinct, first, degree = np.unique(columns[by_column], return_index=True, return_counts=True)
    rows_of = row_of[by_column]
    links = []
    for i in range(count):
        # Later rows are as large or larger: up to the size bound.
        to = np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")
        near = slice(i + 1, to)
        open_ = label[near] != label[i]
        if sides[i]:
            open_ &= sides[near] != sides[i]
        if not open_.any():
            continue
        at = np.searchsorted(distinct, sets[i])
        length = degree[at]
        ends = np.cumsum(length)
        pick = np.arange(ends[-1]) + np.repeat(first[at] - ends + length, length)
        overlap = np.bincount(rows_of[pick], minlength=count)[near]
        union = sizes[i] + sizes[near] - overlap
        for j in np.flatnonzero(open_ & (100 * overlap >= percent * union)) + i + 1:
            if label[j] != label[i]:
                links.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return links


def _multiply(percent: int):
    """Links of the tiles of a part; rows come sorted by tile."""
    def links(nodes, sets, sides):
        if len(nodes) > 1:
            for i, j in _product(sets, np.array(sides), percent):
                yield nodes[i], nodes[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, sets, sides = None, [], [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for tile, side, node, grams in zip(*(batch.column(c).to_pylist() for c in
                                                 ("tile", "side", "node", "grams"))):
                if tile != current:
                    out.extend(links(nodes, sets, sides))
                    current, nodes, sets, sides = tile, [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(np.frombuffer(grams, np.uint64))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                                 ["a", "b"])
                out = []
        out.extend(links(nodes, sets, sides))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
    return run


def _grams(size: int):
    """The set of each text, if it is still the one that was described."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in slices(batch.column("text"), fold=True):
                hashes, _, bounds = _sets(texts, size)
                one, _ = _fingerprints(hashes, bounds)
                part = batch.slice(row, texts.count)
                same = one == part.column("f1").to_numpy()
                data = [hashes[a:b].tobytes() if ok else None
                        for a, b, ok in zip(bounds[:-1], bounds[1:], same)]
                part = part.set_column(part.schema.get_field_index("text"), "grams",
                                       pa.array(data, pa.binary()))
                yield part.filter(pa.array(same)).select(["node", "tiles", "grams"])
    return run


def _large(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """The blocks that weigh more than ``limit``."""
    return (members.groupBy("block").agg(F.sum(weight).alias("whole"))
            .where(F.col("whole") > limit).select("block"))


def _tiles(members: DataFrame, weight: Column, limit: int, *payload: str) -> DataFrame:
    """``members`` with the (tile, side) pairs each class takes part in.

    A block of at most ``limit`` weight is one tile.  A larger one is cut by size
    band (``level``) and hash into chunks of about half a tile; chunks of the same and of
    neighbouring bands are paired, which is where partners can be.
    """
    large = _large(members, weight, limit)
    counts = (members.join(large, "block", "left_semi").groupBy("block", "level")
              .agg(F.ceil(F.sum(weight) / (limit // 2)).alias("chunks")))
    by_level = F.map_from_entries(F.collect_list(F.struct("level", "chunks"))).alias("chunks")
    per_block = counts.groupBy("block").agg(by_level)  # a few dozen levels
    joined = members.join(per_block, "block", "left")
    one = F.array(F.struct(F.concat_ws(":", "block").alias("tile"), F.lit(0).alias("side")))
    many = F.expr("""
      transform(
        concat(
          transform(sequence(0L, chunks[level] - 1), j ->
            struct(level as l1, least(mine, j) as c1, level as l2, greatest(mine, j) as c2,
                   if(j = mine, 0, if(mine < j, 1, 2)) as side)),
          if(chunks[level + 1] is null, array(),
             transform(sequence(0L, chunks[level + 1] - 1), j ->
               struct(level as l1, mine as c1, level + 1 as l2, j as c2, 1 as side))),
          if(chunks[level - 1] is null, array(),
             transform(sequence(0L, chunks[level - 1] - 1), j ->
               struct(level - 1 as l1, j as c1, level as l2, mine as c2, 2 as side)))),
        t -> struct(concat_ws(':', block, t.l1, t.c1, t.l2, t.c2) as tile, t.side as side))""")
    mine = F.when(F.col("chunks").isNotNull(),
                  F.pmod(F.xxhash64("node"), F.col("chunks")[F.col("level")]))
    return (joined.withColumn("mine", mine)
            .withColumn("tiles", F.when(F.col("chunks").isNull(), one).otherwise(many))
            .select("node", "f1", "tiles", *payload))


def _by_width(rows: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sketches, the same at half their width) of rows that widen in order."""
    width = np.array([len(r) for r in rows])
    starts = np.flatnonzero(np.diff(width, prepend=0))
    groups = []
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        own = np.frombuffer(b"".join(rows[a:b]), np.uint8).reshape(b - a, -1).astype(np.int16)
        groups.append((int(a), own, own[:, ::2] + own[:, 1::2]))
    return groups


def _near_sketches(percent: int):
    """Links of tile rows whose sketches allow the similarity; rows sorted by tile."""
    def links(nodes, rows, sizes, sides):
        order = np.argsort(sizes, kind="stable")
        size, side, label = np.array(sizes)[order], np.array(sides)[order], np.arange(len(order))
        groups = _by_width([rows[i] for i in order])
        for (first, own, _), later in zip(groups, [*groups[1:], None]):
            past = first + len(own)
            for i in range(first, past):
                to = np.searchsorted(size, size[i] * 100 // percent, side="right")
                open_ = label[i + 1:to] != label[i]
                if side[i]:
                    open_ &= side[i + 1:to] != side[i]
                at = np.flatnonzero(open_) + i + 1
                if not len(at):
                    continue
                mine, wider = own[i - first], at[at >= past]
                apart = np.abs(own[at[at < past] - first] - mine).sum(1, dtype=np.int64)
                if len(wider):  # less than twice the size, so twice the width
                    more = np.abs(later[2][wider - past] - mine).sum(1, dtype=np.int64)
                    apart = np.concatenate([apart, more])
                for j in at[apart * (100 + percent) <= (size[at] + size[i]) * (100 - percent)]:
                    if label[j] != label[i]:
                        yield nodes[order[i]], nodes[order[j]]
                        label[label == label[j]] = label[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [], [], [])
        out: list[tuple[int, int]] = []
        for batch in batches:
            for tile, *row in zip(*(batch.column(c).to_pylist() for c in
                                    ("tile", "node", "sketch", "n", "side"))):
                if tile != current:
                    out.extend(links(*held))
                    current, held = tile, ([], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        out.extend(links(*held) if held[0] else ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
    return run


def _refine(members: DataFrame, percent: int) -> DataFrame:
    """``members`` with the large blocks split by what sketches allow.

    Passages that many documents share can tie unlike documents into one block.
    Sketches are small, so a large block's tiles can hold them; rows whose sketches
    are too far apart are not similar, and components of the rest are the blocks.
    """
    large = _large(members, F.col("n"), TILE)
    own = stage(members.join(large, "block", "left_semi"), "large")
    weight = F.expr(f"length(sketch) div {PARTS}")
    tiles = _tiles(own, weight, SKETCH_ROWS, "n", "sketch")
    links = (tiles.select("node", "n", "sketch", F.explode("tiles").alias("t"))
             .select("t.tile", "t.side", "node", "n", "sketch")
             .repartition("tile").sortWithinPartitions("tile", "node")
             .mapInArrow(_near_sketches(percent), "a long, b long"))
    roots = connected_components(stage(links, "sketch-links"))
    label = roots.select("node", "root").union(roots.select("root", "root").distinct())
    split = (own.drop("block").join(label.withColumnRenamed("root", "block"), "node"))
    return (members.join(large, "block", "left_anti")
            .unionByName(split.select(*members.columns)))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Documents link when 100 * intersection >= percent * union of their sets;
    ``component_id`` is the smallest key reachable over links.
    """
    if percent * RATIO < 100:
        raise ValueError("partners would lie more than one size level apart")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    described = stage(rows.mapInArrow(
        _describe(size, percent, "text"),
        "key long, n long, f1 long, f2 long, sketch binary, segments array<long>"), "described")
    blocks = _blocks(described, percent)
    slim = stage(described.drop("segments"), "sets")
    unstage(described)
    classes = (slim.where("n > 0").groupBy("f1", "f2")
               .agg(F.min("key").alias("node"), F.first("n").alias("n"),
                    F.first("sketch").alias("sketch")))
    classes = stage(classes, "classes")
    # Bands as wide as the size bound (and a little more, for rounding): partners lie at most
    # one band apart, and no tile holds sizes that cannot meet.
    band = math.log(100 / percent * 1.01)
    level = F.floor(F.log(F.col("n").cast("double")) / band).cast("long")
    members = (classes.where(F.col("node").isNotNull()).join(blocks, "f1")
               .withColumn("level", level))
    members = stage(members, "members")
    refined = stage(_refine(members, percent).drop("sketch"), "refined")
    tiles = stage(_tiles(refined, F.col("n"), TILE), "tiles")
    unstage(members, refined, blocks)
    # The tiles grow with the data: never broadcast, the same plan at every size.
    sets = (rows.join(tiles.hint("merge"), rows["key"] == tiles["node"])
            .select("node", "f1", "tiles", "text")
            .mapInArrow(_grams(size),
                        "node long, tiles array<struct<tile:string,side:int>>, grams binary"))
    links = (sets.select("node", "grams", F.explode("tiles").alias("t"))
             .select("t.tile", "t.side", "node", "grams")
             .repartition("tile").sortWithinPartitions("tile", "node")
             .mapInArrow(_multiply(percent), "a long, b long"))
    links = stage(links, "links")
    roots = connected_components(links)
    unstage(links, tiles)
    final = (classes.join(roots, "node", "left")
             .select("f1", "f2", F.coalesce("root", "node").alias("component_id")))
    return (slim.select("key", "n", "f1", "f2").join(final, ["f1", "f2"], "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
                    .alias("component_id")))
