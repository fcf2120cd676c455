"""Ranked lexical search by pipelined term partitioning.

The index holds one posting row per (term, block of documents).  Terms have owners:
owner 0 the heaviest quarter of the query terms by weight, owner 3 the lightest.
Items travel in bundles.  A bundle starts at every block with empty accumulators and
passes the owners one after the other; each stage cogroups the accumulators of
(bundle, block) with that owner's postings and adds their integer contributions.
The last stage keeps the best of each block, a ranking per item joins the blocks.

Accumulators are sparse.  Between stages one is dropped only if its score, with all
that the later owners could add (weight x 10**6 bounds a term's contribution), stays
below the k-th best score that its block has already: such a document cannot be
among the k best, so results are those of the full sums.

What grows: blocks, posting rows and accumulators with the documents, bundles with the
items.  A block has at most ``BLOCK_DOCS`` texts and about ``BLOCK_BYTES`` (a longer
text is a block of its own and is read in slices, cut between terms).  Nothing but
two totals, three weights and a bitmap of fixed size reaches the driver; the bitmap
spares postings of most terms that no item has, the exact join follows.

Null or empty texts have no terms: such documents are not ranked, such items find
nothing.  Rows of documents are ranked one by one, also rows that repeat an id; a null
id ranks after the others of its score.  Rows of items that repeat an id are one item
with the terms of all.  No documents or no items: no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, unstage
from .words import Texts

#: Term owners, which is the number of stages.
OWNERS = 4
#: Items of a bundle, texts and bytes of a block.
BUNDLE_ITEMS = 512
BLOCK_DOCS = 4096
BLOCK_BYTES = 4 << 20
#: Bytes of text in work at once.
SLICE_BYTES = 1 << 20
#: Bits of the map of query terms.
MAP_BITS = 1 << 23

_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_INDEX = ("block long, term long, docs array<int>, tfs array<int>, "
          "ids array<long>, lengths array<long>")
_BUNDLE = ("bundle int, block long, ids array<long>, m array<long>, items array<long>, "
           "loads array<long>, places array<int>, scores array<long>")


def _text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), bounds


def _pieces(data: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the pieces of a text: cut before a gap, so no term is cut."""
    ends = []
    while end - start > SLICE_BYTES:
        cut = start + SLICE_BYTES
        while cut < end:  # the next gap, looked for a slice at a time
            gaps = np.flatnonzero(_GAP[data[cut:min(cut + SLICE_BYTES, end)]])
            if len(gaps):
                cut += int(gaps[0])
                break
            cut = min(cut + SLICE_BYTES, end)
        ends.append(cut)
        start = cut
    return [*ends, end] if end > start or not ends else ends


def _term_runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash of term) of all terms of some texts, a slice at a time."""
    cuts, owner = [int(bounds[0])], []
    for i in range(len(bounds) - 1):
        ends = _pieces(data, int(bounds[i]), int(bounds[i + 1]))
        cuts += ends
        owner += [i] * len(ends)
    cuts, owner = np.array(cuts, np.int64), np.array(owner, np.int64)
    at = 0
    while at < len(owner):
        last = int(np.searchsorted(cuts, cuts[at] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, at + 1), len(owner))
        texts = Texts(data[cuts[at]:cuts[last]], cuts[at:last + 1] - cuts[at], True, _GAP)
        yield owner[at + texts.word_text], texts.word_hashes()
        at = last


def _blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    row, rows = 0, len(bounds) - 1
    while row < rows:
        last = int(np.searchsorted(bounds, bounds[row] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, row + 1), row + BLOCK_DOCS, rows)
        yield row, last
        row = last


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _indexer(wanted: bytes):
    bits = np.frombuffer(wanted, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = _text_column(batch.column(1))
            for first, last in _blocks(bounds):
                docs = last - first
                lengths = np.zeros(docs, np.int64)
                kept = []
                for text, term in _term_runs(data, bounds[first:last + 1]):
                    lengths += np.bincount(text, minlength=docs)
                    slot = term % np.uint64(MAP_BITS)
                    asked = bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
                    asked = asked.astype(bool)
                    kept.append((text[asked], term[asked]))
                text = np.concatenate([t for t, _ in kept])
                term = np.concatenate([t for _, t in kept]).view(np.int64)
                order = np.lexsort((text, term))
                text, term = text[order], term[order]
                new = np.ones(len(term), bool)
                new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(term)))
                text, term = text[at], term[at]
                edge = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(at) else at
                offsets = np.append(edge, len(at))
                rows = len(edge)
                none = pa.nulls(rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, block)), pa.array(term[edge]),
                     _lists(text, offsets, pa.int32()), _lists(tf, offsets, pa.int32()),
                     none, none], ["block", "term", "docs", "tfs", "ids", "lengths"])
                one = np.array([0, docs])
                ids = pa.ListArray.from_arrays(
                    pa.array(one, pa.int32()),
                    batch.column(0).slice(first, docs).cast(pa.int64()))
                none = pa.nulls(1, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.nulls(1, pa.int64()), none, none, ids,
                     _lists(lengths, one, pa.int64())],
                    ["block", "term", "docs", "tfs", "ids", "lengths"])
                block += 1
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = _text_column(batch.column(1))
        for text, term in _term_runs(data, bounds):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)).cast(pa.int64()),
                 pa.array(term.view(np.int64))], ["item_id", "term"])


def _term_map(terms: DataFrame) -> bytes:
    """A bit for each term's hash: as large for any number of terms."""
    slot = F.col("term").bitwiseAND(MAP_BITS - 1)
    words = (terms.select(slot.alias("slot"))
             .groupBy(F.expr("slot div 64").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.tobytes()


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Posting rows of (term, block), and one row per block (term null) with its
    documents' ids and lengths.  Terms that hash like none of ``terms`` are left out."""
    return (documents.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(_indexer(_term_map(terms)), _INDEX))


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _add(left: pa.Table, right: pa.Table, number: int, k: int):
    """The bundle's grid (items x documents) after one owner, and what may still count."""
    m = left["m"].combine_chunks().values.to_numpy()
    items = len(left["items"].combine_chunks().values)
    grid = np.zeros((items, len(m)), np.int64)
    grid.ravel()[left["places"].combine_chunks().values.to_numpy()] = \
        left["scores"].combine_chunks().values.to_numpy()
    if right.num_rows:
        weights = right["w"].to_numpy()
        (asking, a), (docs, d) = _flat(right["asking"]), _flat(right["docs"])
        tfs, _ = _flat(right["tfs"])
        tfs = tfs.astype(np.int64)
        part = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs])
        for r in range(right.num_rows):
            grid[asking[a[r]:a[r + 1], None], docs[d[r]:d[r + 1]]] += weights[r] * part[d[r]:d[r + 1]]
    loads = left["loads"].combine_chunks().values.to_numpy().reshape(items, OWNERS)
    later = loads[:, number + 1:].sum(axis=1) * 1_000_000
    if grid.shape[1] > k:
        bar = np.partition(grid, grid.shape[1] - k, axis=1)[:, -k]
    else:
        bar = np.zeros(items, np.int64)
    return grid, (grid > 0) & (grid + later[:, None] >= bar[:, None])


def _owner_stage(number: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        grid, alive = _add(left, right, number, k)
        places = np.flatnonzero(alive.ravel())
        bounds = np.array([0, len(places)])
        kept = {c: left[c].combine_chunks() for c in left.column_names}
        kept["places"] = _lists(places, bounds, pa.int32())
        kept["scores"] = _lists(grid.ravel()[places], bounds, pa.int64())
        return pa.table(kept)
    return run


def _last_stage(number: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items, docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows:
            grid, alive = _add(left, right, number, k)
            items, docs = np.nonzero(alive)  # the k best with all their ties
            scores = grid[items, docs]
            names = left["items"].combine_chunks().values.take(pa.array(items))
            ids = left["ids"].combine_chunks().values.take(pa.array(docs))
        else:
            names = ids = pa.array([], pa.int64())
        return pa.table({"item_id": names, "doc_id": ids, "score": pa.array(scores)})
    return run


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each of
    ``items`` (item_id, text)."""
    terms = stage(items.select(F.col("item_id").cast("long"), "text")
                  .mapInArrow(_item_terms, "item_id long, term long").distinct(), "item-terms")
    index = stage(build_index(documents, terms), "term-index")
    blocks = index.where(F.col("term").isNull()).select("block", "ids", "lengths")
    total = blocks.agg(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("n"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)).alias("l")).first()
    n, length = int(total.n or 0), max(int(total.l or 0), 1)

    postings = index.where(F.col("term").isNotNull()).select("block", "term", "docs", "tfs")
    held = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weighted = stage(
        terms.join(held, "term").withColumn(
            "w", F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))), "weights")
    cuts = weighted.select("term", "w").distinct().agg(F.percentile_approx(
        "w", [1 - i / OWNERS for i in range(1, OWNERS)], 10_000)).first()[0] or [0] * (OWNERS - 1)
    owner = sum((F.col("w") < c).cast("int") for c in cuts)

    per_item = weighted.withColumn("owner", owner).groupBy("item_id").agg(
        F.collect_list(F.struct("term", "w", "owner")).alias("terms"),
        *[F.coalesce(F.sum(F.when(F.col("owner") == i, F.col("w"))), F.lit(0)).cast("long")
          .alias(f"load_{i}") for i in range(OWNERS)])
    bundles_needed = max(1, math.ceil(per_item.count() / BUNDLE_ITEMS))
    placed = stage(per_item.withColumn(
        "bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles_needed)).cast("int"))
        .withColumn("place", F.row_number().over(
            Window.partitionBy("bundle").orderBy("item_id")) - 1), "bundles")
    bundles = placed.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct(
        "place", "item_id", F.array(*[f"load_{i}" for i in range(OWNERS)]).alias("loads"))))
        .alias("all")).select("bundle", F.col("all.item_id").alias("items"),
                              F.flatten("all.loads").alias("loads"))
    asked = (placed.select("bundle", "place", F.explode("terms").alias("t"))
             .groupBy("bundle", F.col("t.term").alias("term"), F.col("t.w").alias("w"),
                      F.col("t.owner").alias("owner"))
             .agg(F.collect_list("place").alias("asking")))

    m = F.expr(f"transform(lengths, x -> 10 + (90 * x * {n}) div {length})")
    travelling = (blocks.select("block", "ids", m.alias("m"), F.explode(
        F.sequence(F.lit(0), F.lit(bundles_needed - 1))).alias("bundle"))
        .join(bundles, "bundle")
        .select("bundle", "block", "ids", "m", "items", "loads",
                F.array().cast("array<int>").alias("places"),
                F.array().cast("array<long>").alias("scores")))
    for number in range(OWNERS):
        owned = (postings.join(asked.where(F.col("owner") == number), "term")
                 .select(F.col("bundle").alias("to_bundle"), F.col("block").alias("to_block"),
                         "w", "asking", "docs", "tfs"))
        pair = (travelling.groupBy("bundle", "block")
                .cogroup(owned.groupBy("to_bundle", "to_block")))
        travelling = (pair.applyInArrow(_owner_stage(number, k), _BUNDLE) if number < OWNERS - 1
                      else pair.applyInArrow(_last_stage(number, k),
                                             "item_id long, doc_id long, score long"))
    best = Window.partitionBy("item_id").orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = stage(travelling.withColumn("rank", F.row_number().over(best))
                   .where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    unstage(terms, index, weighted, placed)
    return ranked
