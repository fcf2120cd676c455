"""Repeated byte strings across a corpus: a suffix array's runs, built block by block.

A byte goes if a string of ``min_length`` bytes over it also starts earlier (in a text of
smaller id, or before in the same text).  In a suffix array the suffixes that share
such a string stand together; all but the earliest start a repeat.  The array is never
held: only suffixes that can repeat are sorted, one bucket at a time.

* Equal texts are one text: later copies of at least ``min_length`` bytes go whole.
* Texts form blocks, in id order inside, compressed and staged as a table bucketed by
  block: no text is ever shuffled, the later steps' small answers come to the blocks.
* Cover sample: offsets of a text that lie in a difference cover modulo v.  For any two
  positions some d < v takes both to sampled ones, so two equal strings share a sampled
  string of min_length - v + 1 bytes at the same distance.  The sample suffixes are
  ranked first, bucket by bucket, by that many leading bytes; ranks that occur once
  are dropped.  They settle long ties beforehand: a suffix without a repeated rank
  among its next v sample places cannot tie with another over min_length bytes.
* The remaining suffixes go to buckets and one bucket is sorted at a time.

Suffixes are ordered by 64-bit fingerprints of their leading bytes, not by the bytes
themselves: any order in which equal leading bytes stand together serves here, and a
bucket then needs 8 bytes for a suffix.  The chance that any two different strings
among 10**8 candidates share a fingerprint is 3 in 10,000.

A block sends a string once, however often it holds it, and learns by a bit whether an
earlier text has it too, so a string that a third of all texts share costs a bucket one
entry per block.  A long text is a block of its own, read in slices.

Null texts are empty.  Rows that repeat id and text are one text, and each gets its
result; texts of one id are ordered by their digest, a null id comes last.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import new_folder, stage

#: Difference covers by period (perfect difference sets; fixed values).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18),
          57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}
#: Bytes of text in a block, and in work at once.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
#: Sample suffixes, or bytes of text, for each bucket.
BUCKET_SAMPLES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Bytes of text in a file bucket of the staged blocks, and the most such buckets.
FILE_BYTES = 24 << 20
MAX_FILES = 100_000

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20250611).integers(1, 1 << 63, 256, dtype=np.uint64)
_LAST = (1 << 63) - 1
_BLOCKS = "block long, orders array<long>, digests array<binary>, bounds array<long>, packed binary"
_SENT = "block long, bucket long, names binary, orders binary, ties binary"
_TOLD = "block long, bucket long, bits binary"


def cover(min_length: int) -> tuple[int, np.ndarray]:
    """(period v, flags of the cover) for strings of so many bytes."""
    period = max((v for v in COVERS if 5 * v <= 3 * min_length), default=0)
    if not period:
        raise ValueError("min_length must be 12 or more")
    flags = np.zeros(period, bool)
    flags[list(COVERS[period])] = True
    return period, flags


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)
    return of(_ODD), of(pow(_ODD, -1, 1 << 64))


class _Slice:
    """Fingerprints of strings that start in data[first:last]."""

    def __init__(self, data: np.ndarray, first: int, last: int, reach: int):
        part = data[first:min(last + reach, len(data))]
        powers, self._inverse = _powers(SLICE_BYTES + reach + 1)
        self._sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * powers[:len(part)], out=self._sums[1:])
        self._first = first

    def names(self, at: np.ndarray, width: int) -> np.ndarray:
        at = at - self._first
        x = (self._sums[at + width] - self._sums[at]) * self._inverse[at]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _slices(data: np.ndarray, reach: int) -> Iterator[tuple[int, int, _Slice]]:
    for first in range(0, len(data), SLICE_BYTES):
        last = min(first + SLICE_BYTES, len(data))
        yield first, last, _Slice(data, first, last, reach)


def _pack(values: np.ndarray) -> bytes:
    """Ascending or clustered integers, as compressed planes of the differences' bytes."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    width = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


class _Block:
    """Texts in id order as one byte array, with what the exchanges need of them."""

    def __init__(self, row: dict, min_length: int):
        self.data = np.frombuffer(zstandard.decompress(row["packed"]), np.uint8) \
            if row["packed"] else np.zeros(0, np.uint8)
        self.number, self.bounds = row["block"], np.array(row["bounds"], np.int64)
        self.orders, self.digests = np.array(row["orders"], np.int64), row["digests"]
        self.ties = np.zeros(len(self.orders), np.int64)
        copies = np.zeros(len(self.orders), bool)
        for note in row["notes"] or []:
            copies[note["place"]] = note["is_copy"]
            self.ties[note["place"]] = int.from_bytes(self.digests[note["place"]][:7], "big")
        if copies.any():
            self._leave_out(copies)
        self.width = min_length
        self.period, self.flags = cover(min_length)
        self.sizes = np.diff(self.bounds)

    def _leave_out(self, copies: np.ndarray) -> None:
        sizes = np.diff(self.bounds)
        self.data = self.data[np.repeat(~copies, sizes)]
        self.bounds = np.concatenate([[0], np.cumsum(sizes[~copies])])
        self.orders, self.ties = self.orders[~copies], self.ties[~copies]
        self.digests = [d for d, copy in zip(self.digests, copies) if not copy]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, fingerprint) of the sample suffixes."""
        width = self.width - self.period + 1
        at, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first, last, part in _slices(self.data, self.width):
            here = np.arange(first, last)
            text = self.text_of(here[[0, -1]])
            spread = np.repeat(np.arange(text[0], text[1] + 1), np.diff(np.clip(
                self.bounds[text[0]:text[1] + 2], first, last)))
            begin, end = self.bounds[spread], self.bounds[spread + 1]
            here = here[self.flags[(here - begin) % self.period] & (end - here >= width)
                        & (end - begin >= self.width)]
            at.append(here)
            names.append(part.names(here, width))
        return np.concatenate(at), np.concatenate(names)

    def sample_sets(self, buckets: int):
        """Sorted distinct sample names by bucket, and how to tell the suffixes of them."""
        at, names = self.samples()
        distinct, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
        return at, inverse, count > 1, distinct, _bucket(distinct, buckets)

    def candidates(self, buckets: int, told: dict[int, bytes]) -> np.ndarray:
        """Suffixes with a repeated rank among their next v sample places."""
        at, inverse, again, distinct, bucket = self.sample_sets(buckets)
        again = again | _told(bucket, told)
        repeated = at[again[inverse]]
        text = self.text_of(repeated)
        low = np.maximum(repeated - self.period + 1, self.bounds[text])
        high = np.minimum(repeated, self.bounds[text + 1] - self.width)
        ok = low <= high
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, low[ok], 1)
        np.add.at(edge, high[ok] + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    def leaders(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, is the first of it here) of each candidate."""
        names = [np.zeros(0, np.uint64)]
        for first, last, part in _slices(self.data, self.width):
            a, b = np.searchsorted(candidates, [first, last])
            names.append(part.names(candidates[a:b], self.width))
        names = np.concatenate(names)
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        return names, first


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the order of names."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _told(bucket: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
    """Answers, in each bucket in the order the names were sent in."""
    out = np.zeros(len(bucket), bool)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) \
        if len(order) else order
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        bits = np.unpackbits(np.frombuffer(told[int(bucket[order[a]])], np.uint8), count=b - a)
        out[order[a:b]] = bits.astype(bool)
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else order
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def _builder():
    """Blocks of texts in id order; of equal texts the one of the smallest id."""
    def block(number: int, rows: list) -> pa.RecordBatch:
        texts: dict = {}
        for row in sorted(rows, key=lambda r: r[:2]):
            texts.setdefault(row[1], row)
        rows = list(texts.values())
        raw = [r[2].encode() for r in rows]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        return pa.RecordBatch.from_pylist([{
            "block": number, "orders": [r[0] for r in rows], "digests": [r[1] for r in rows],
            "bounds": bounds.tolist(), "packed": zstandard.compress(b"".join(raw), 3)}],
            schema=pa.schema([("block", pa.int64()), ("orders", pa.list_(pa.int64())),
                              ("digests", pa.list_(pa.binary())),
                              ("bounds", pa.list_(pa.int64())), ("packed", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield block(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield block(number, rows)
    return run


def _sample_sender(min_length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, min_length)
                *_, distinct, bucket = block.sample_sets(buckets)
                out = [(block.number, b, _pack(distinct[i].astype(np.uint32)), b"", b"")
                       for b, i in _by_bucket(bucket)]
                if out:
                    yield _rows(out, _SENT)
    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _rank_samples(table: pa.Table) -> pa.Table:
    """One bucket: which sample names come from several blocks."""
    rows = [_unpack(x.as_py(), np.uint32) for x in table["names"]]
    sizes = [len(x) for x in rows]
    _, inverse, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    return _answers(table, (count > 1)[inverse], sizes)


def _answers(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.table({"block": table["block"], "bucket": table["bucket"],
                     "bits": pa.array(bits, pa.binary())})


def _heard(told: list | None) -> dict[int, bytes]:
    return {x["bucket"]: x["bits"] for x in told or []}


def _suffix_sender(min_length: int, sample_buckets: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, min_length)
                at = block.candidates(sample_buckets, _heard(row["samples"]))
                names, first = block.leaders(at)
                names, text = names[first], block.text_of(at[first])
                out = [(block.number, b, names[i].tobytes(), _pack(block.orders[text[i]]),
                        _pack(block.ties[text[i]])) for b, i in _by_bucket(_bucket(names, buckets))]
                if out:
                    yield _rows(out, _SENT)
    return run


def _sort_suffixes(table: pa.Table) -> pa.Table:
    """One bucket: which suffixes have an equal one in an earlier text."""
    rows = [np.frombuffer(x.as_py(), np.uint64) for x in table["names"]]
    sizes = [len(x) for x in rows]
    names = np.concatenate(rows)
    orders = np.concatenate([_unpack(x.as_py(), np.int64) for x in table["orders"]])
    ties = np.concatenate([_unpack(x.as_py(), np.int64) for x in table["ties"]])
    sort = np.lexsort((ties, orders, names) if ties.any() else (orders, names))
    names, orders, ties = names[sort], orders[sort], ties[sort]
    new = np.append(True, names[1:] != names[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = np.empty(len(new), bool)
    later[sort] = (orders != orders[lead]) | (ties != ties[lead])
    return _answers(table, later, sizes)


def _finisher(min_length: int, sample_buckets: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, min_length)
                at = block.candidates(sample_buckets, _heard(row["samples"]))
                names, first = block.leaders(at)
                repeat = ~first
                repeat[first] = _told(_bucket(names[first], buckets), _heard(row["suffixes"]))
                edge = np.zeros(len(block.data) + 1, np.int32)
                edge[at[repeat]] += 1
                edge[at[repeat] + min_length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                yield _results(block, gone)
    return run


def _results(block: _Block, gone: np.ndarray) -> pa.RecordBatch:
    """(digest, n_bytes, starts, ends, kept) of a block's texts."""
    digests = block.digests
    step = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    starts, ends = step[::2], step[1::2]
    # a run that crosses into the next text is cut there
    inner = block.bounds[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(gone))])
    cut = inner[gone[inner - 1] & gone[inner]] if len(inner) else inner
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    text = block.text_of(starts)
    offsets = np.searchsorted(text, np.arange(len(digests) + 1))
    kept = np.concatenate([[0], np.cumsum(~gone)])[block.bounds]
    left = block.data[~gone]
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(block.sizes),
         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(starts - block.bounds[text])),
         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends - block.bounds[text])),
         pa.array([left[a:b].tobytes() for a, b in zip(kept[:-1], kept[1:])], pa.binary())],
        ["digest", "n_bytes", "starts", "ends", "kept"])


def _digested(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
        .alias("order"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def _answered(told: DataFrame, name: str) -> DataFrame:
    """Answers by block; staged, so that in the join with the blocks only they move."""
    return stage(told.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)),
                 name)


def repeated_substrings(documents: DataFrame, min_length: int = 100) -> tuple[DataFrame, DataFrame]:
    """(texts, rows) of ``documents`` (doc_id, text).

    ``texts``: (digest, n_bytes, starts, ends, kept) of each distinct text as its earliest
    row has it: the removed runs in bytes and the bytes that stay (a text whose row is
    repeated may come again, equal).  ``rows``: (doc_id, digest, is_copy) of each row; a
    copy of min_length bytes or more goes whole.
    """
    spark = documents.sparkSession
    found = _digested(documents)
    path, table = new_folder(spark, "blocks"), f"llm_blocks_{uuid.uuid4().hex}"
    rows = stage(found.select("doc_id", "order", "digest", F.octet_length("text").alias("size")),
                 "digests")
    total = rows.agg(F.sum("size")).first()[0] or 0
    files = int(min(max(1, -(-total // FILE_BYTES)), MAX_FILES))
    (found.select("order", "digest", "text").mapInArrow(_builder(), _BLOCKS)
     .write.bucketBy(files, "block").option("path", path).saveAsTable(table))

    firsts = stage(rows.groupBy("digest").agg(F.min("order").alias("first")), "firsts")
    shared = (firsts.groupBy(F.col("first").alias("order")).agg(F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("order", F.lit(True).alias("shared")))
    held = spark.table(table).select("block", F.posexplode(
        F.arrays_zip("orders", "digests")).alias("place", "text")).select(
        "block", "place", F.col("text.orders").alias("order"), F.col("text.digests").alias("digest"))
    copy = F.col("order") > F.col("first")
    notes = stage(held.join(firsts, "digest").join(shared, "order", "left")
                  .where(copy | F.col("shared")).groupBy("block")
                  .agg(F.collect_list(F.struct("place", copy.alias("is_copy"))).alias("notes")), "notes")
    blocks = spark.table(table).join(notes.hint("shuffle_hash"), "block", "left")

    period, flags = cover(min_length)
    sample_buckets = max(1, int(total * flags.sum() / period / BUCKET_SAMPLES))
    buckets = max(1, -(-total // BUCKET_BYTES))
    ranked = stage(blocks.mapInArrow(_sample_sender(min_length, sample_buckets), _SENT)
                   .groupBy("bucket").applyInArrow(_rank_samples, _TOLD), "ranks")
    known = blocks.join(_answered(ranked, "samples").hint("shuffle_hash"), "block", "left")
    later = stage(known.mapInArrow(_suffix_sender(min_length, sample_buckets, buckets), _SENT)
                  .groupBy("bucket").applyInArrow(_sort_suffixes, _TOLD), "suffixes")
    told = known.join(_answered(later, "suffixes").hint("shuffle_hash"), "block", "left")
    texts = told.mapInArrow(_finisher(min_length, sample_buckets, buckets),
                            "digest binary, n_bytes long, starts array<long>, ends array<long>, "
                            "kept binary")
    return texts, rows.join(firsts, "digest").select("doc_id", "digest", copy.alias("is_copy"))


def attach(texts: DataFrame, rows: DataFrame, min_length: int = 100) -> DataFrame:
    """Columns of ``texts`` (digest, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    whole = F.col("is_copy") & (F.col("n_bytes") >= min_length)
    return rows.join(texts, "digest").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
