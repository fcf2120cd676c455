"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of packets (pieces of its documents, in table order, of at
most its quantum of tokens, but no less than ``LEAST`` and no more than ``packet``).  In each round a source gains a quantum of
``window * share`` tokens, and a packet leaves once the source's deficit covers
it.  Deficits carry from round to round, so the round in which a packet leaves
has a closed form: the queue's tokens up to and with the packet, divided by the
quantum, rounded up.  Nothing is simulated: positions in the queue and in the
output are prefix sums, computed per partition with carried offsets.  Rounds in
order, sources in order within a round, make one stream that is cut every
``window`` tokens; only the last window can need padding.

Shares default to the sources' own shares of tokens, so all queues drain
together; given weights are normalised, and where a queue drains early the
others go on in proportion.  A queue's first deficit starts at a fixed fraction
of its first packet (a hash of its name), so that many small sources do not all
fall due in the same round.

Contract: a null text is empty and still has its end id; null and '' sources
are one queue; repeated rows and keys are packed as rows of their own; an empty
table gives no pieces; other columns are ignored.  Every id lies in one piece.
"""

from __future__ import annotations

import os
import string
import unicodedata
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .tokens import WordChunks, edges, grouped

#: Tokens of a packet, the unit in which queues take turns.
PACKET = 1024
#: Tokens of a packet at least, however small the share of its source.
LEAST = 32
#: Words in a generation of the tokenizing memo.
MEMO = 500_000
#: Words that the library encodes in one call.
TOGETHER = 10_000
#: Bytes of texts or ids that a task works on at once, if they are several rows'.
SLICE = 1 << 23
#: Rounds that one task orders, and groups of rounds under one carried offset.
ROUNDS, GROUPS = 64, 4096


@lru_cache(maxsize=10_000)
def _stays_letter(letter: str) -> bool:
    """Whether no combining mark, which would join the marks that follow, comes of it."""
    return unicodedata.normalize("NFC", letter.lower())[-1].isalpha()


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[WordChunks, np.dtype]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    ending = edges(tokenizer, lambda t: t.endswith("</w>"))

    def encode(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes()
                for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    ids_of = [np.array([i], kind).tobytes() for i in range(tokenizer.get_vocab_size())]
    model = tokenizer.model
    # An added token of letters would be found inside words, which the model does not do.
    whole = not any(t.content.isalpha() for t in tokenizer.get_added_tokens_decoder().values())

    def encode_letters(words: list[str]) -> list[bytes]:
        values = []
        for at in range(0, len(words), TOGETHER):
            some = words[at:at + TOGETHER]
            found = grouped(tokenizer, " ".join(some), ending, len(some), False)
            if found is None:
                values += encode(some)
                continue
            ids, ends = found
            data, cuts = ids.astype(kind).tobytes(), (ends * kind.itemsize).tolist()
            values += [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return values

    def encode_chunks(chunks: list[str]) -> list[bytes]:
        """Letters and the marks that close them are matched apart: each part is encoded once.
        Small ASCII letters are one match as they stand, which the library's model takes at once."""
        stems = [c.rstrip(string.punctuation) for c in chunks]
        parts = [(s, c[len(s):]) if s.isalpha() and (s == c or _stays_letter(s[-1])) else ("", c)
                 for c, s in zip(chunks, stems)]
        stems = {s: None for s, _ in parts if s}
        letters = [s for s in stems if not (whole and s.isascii() and s.islower())]
        others = list({t: None for _, t in parts if t})
        known = {"": b""} | dict.fromkeys(letters)
        known.update((s, b"".join([ids_of[t.id] for t in model.tokenize(s)]))
                     for s in stems if s not in known)
        known.update(zip(letters, encode_letters(letters)))
        known.update(zip(others, encode(others)))
        return [known[s] + known[t] for s, t in parts]

    return WordChunks(encode_chunks, MEMO), kind


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``SLICE`` bytes in the column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        limit = SLICE + (ends[at - 1] if at else 0)
        to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, kind = _encoder(path)
        end = pa.scalar(np.array([end_id], kind).tobytes(), pa.binary())
        nothing = pa.scalar(b"", pa.binary())
        row = TaskContext.get().partitionId() << 33
        queued: dict[str, int] = {}
        for batch in (part for whole in batches for part in _slices(whole, "text")):
            ids = pc.binary_join_element_wise(chunks.values(batch.column("text")), end, nothing)
            sizes = (pc.binary_length(ids).to_numpy() // kind.itemsize).tolist()
            before = []
            for queue, n in zip(batch.column("queue").to_pylist(), sizes):
                before.append(queued.get(queue, 0))
                queued[queue] = before[-1] + n
            rows = np.arange(row, row + len(ids))
            row += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("key"), batch.column("queue"),
                 pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), ids],
                ["row", "key", "queue", "n", "before", "ids"])
    return run


def _widen(width: int):
    """Ids of pieces, stored in ``width`` bytes each, as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()  # the worker may go on with other work: texts are tokenized
        for batch in (part for whole in batches for part in _slices(whole, "ids")):
            at = batch.schema.get_field_index("ids")
            ids = batch.column(at).cast(pa.binary())
            ends = np.cumsum(pc.binary_length(ids).to_numpy(), dtype=np.int64) * (4 // width)
            wide = np.frombuffer(b"".join(ids.to_pylist()), f"<u{width}").astype("<u4")
            yield batch.set_column(at, "ids", pa.Array.from_buffers(pa.binary(), len(ids), [
                None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(wide)]))
    return run


def _prefix(rows: DataFrame, group: str, amount: Column) -> DataFrame:
    """(group, start): the amount in all lower groups, by sums over two levels."""
    per = (rows.groupBy(group).agg(F.sum(amount).alias("total"))
           .withColumn("upper", F.expr(f"`{group}` div {GROUPS}")))
    upper = per.groupBy("upper").agg(F.sum("total").alias("upper_total"))
    below = Window.orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("upper", F.coalesce(F.sum("upper_total").over(below), F.lit(0))
                         .alias("upper_start"))
    within = Window.partitionBy("upper").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return (per.withColumn("inner", F.coalesce(F.sum("total").over(within), F.lit(0)))
            .join(upper, "upper")
            .select(group, (F.col("upper_start") + F.col("inner")).alias("start")))


def schedule(sizes: DataFrame, window: int, packet: int = PACKET,
             weights: Mapping[str, float] | None = None) -> DataFrame:
    """Pieces of documents in windows.

    ``sizes``: (row, queue, n, before, part): a document's tokens, its queue's
    tokens before it in its part, and the part (parts are in queue order).
    Returns (row, start, length, sequence_id, offset).
    """
    parts = sizes.groupBy("queue", "part").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("queue", "part",
                           F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("carried"))
    if weights is None:
        share = parts.groupBy("queue").agg(F.sum("total").cast("double").alias("weight"))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        least = min(weights.values())
        share = parts.select("queue").distinct().withColumn(
            "weight", F.coalesce(given[F.col("queue")], F.lit(least)).cast("double"))
    whole = share.agg(F.sum("weight")).first()[0] or 1.0
    quantum = share.select("queue", (F.col("weight") / whole * window).alias("quantum"))
    phase = (F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) + 1) / (1 << 20)
    packets = (sizes.join(carried, ["queue", "part"]).join(quantum, "queue")
               .withColumn("most", F.least(F.lit(packet), F.greatest(
                   F.lit(LEAST), F.ceil("quantum"))).cast("long"))
               .withColumn("start", F.explode(F.expr("sequence(0L, n - 1, most)")))
               .withColumn("length", F.least(F.col("most"), F.col("n") - F.col("start")))
               .withColumn("at", F.col("carried") + F.col("before") + F.col("start"))
               .withColumn("round", F.ceil((F.col("at") + phase * F.col("length"))
                                           / F.col("quantum")))
               .withColumn("rounds", F.expr(f"round div {ROUNDS}"))
               .select("row", "queue", "start", "length", "at", "round", "rounds"))
    packets = stage(packets, "packets")
    starts = _prefix(packets, "rounds", F.col("length")).withColumnRenamed("start", "opens")
    order = (Window.partitionBy("rounds").orderBy("round", "queue", "at", "row")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (packets.withColumn("inner", F.coalesce(F.sum("length").over(order), F.lit(0)))
              .join(starts, "rounds")
              .withColumn("place", F.col("opens") + F.col("inner")))
    cut = F.explode(F.expr(f"sequence(place div {window}, (place + length - 1) div {window})"))
    from_ = F.greatest(F.col("place"), F.col("sequence_id") * window)
    to = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return (placed.withColumn("sequence_id", cut)
            .select("row", (F.col("start") + from_ - F.col("place")).alias("start"),
                    (to - from_).alias("length"), "sequence_id",
                    (from_ - F.col("sequence_id") * window).alias("offset")))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096,
         packet: int = PACKET, weights: Mapping[str, float] | None = None,
         key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces (key, start, length, doc_tokens, sequence_id, offset, ids) of packed windows.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.
    """
    kind = docs.schema[key].dataType.simpleString()
    width = _encoder(tokenizer)[1].itemsize
    tokens = (docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                          F.coalesce(F.col(source).cast("string"), F.lit("")).alias("queue"))
              .mapInArrow(_tokenize(tokenizer, end_id),
                          f"row long, key {kind}, queue string, n long, before long, ids binary"))
    tokens = stage(tokens, "tokens", compression="zstd")
    sizes = tokens.select("row", "queue", "n", "before", F.shiftright("row", 33).alias("part"))
    pieces = schedule(sizes, window, packet, weights)
    named = (pieces.join(tokens.select("row", "key", F.col("n").alias("doc_tokens"), "ids"), "row")
             .select(F.col("key").alias(key), "start", "length", "doc_tokens", "sequence_id",
                     "offset", F.expr(f"substring(ids, int(start * {width} + 1), "
                                      f"int(length * {width}))").alias("ids")))
    return named.mapInArrow(_widen(width), named.schema)
