"""Spelling variants of the words of a corpus by PartEnum signatures.

A word's letters are a multiset, that is a binary vector over (letter, n-th occurrence).
Words one edit apart (one code point inserted, deleted or replaced) have vectors of
Hamming distance at most two.  The dimensions are dealt into three parts by hash: two
vectors that differ in at most two dimensions agree on one part at least, so "this
part of the word holds exactly these" is an exact signature.  Letters alone leave
large groups (words of the same syllables), so a signature also names where the edit
may be: of the shorter word's four quarters three are untouched and stand equally far
from the word's start or end.  Words are equi-joined on the signatures and verified by
their edit distance; no pair of near words can be missed.

Counting reads the corpus once and sends one row per distinct word of a task's part;
all later steps work on the distinct words.  A text is cut between runs, so long
texts need no more memory than short ones (a single run is held whole).
Tables of words, signatures and forms grow with the corpus, but their staged files are
small and Spark sizes them by those: joins say "merge", so none is broadcast.

Null or empty texts hold no words.  Without an id no run changes (the check value
needs the id).  Rows that repeat an id count again.  A tie between equally frequent
near words goes to the smaller in code-point order.  An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .staging import stage, unstage

#: Distinct runs that a task counts before it hands them on.
COUNTED = 200_000
#: Bytes of a text in work at once.
SLICE_BYTES = 1 << 20
#: Parts of the dimensions: one more than the Hamming distance.
PARTS = 3
#: Quarters of a word, of which an edit touches one.
SPANS = 4

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Bytes that never belong to a run, so a text may be cut before them.
_BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f\xc2\xc4-\xf4]")


def _slices(raw: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(raw):
        end = len(raw)
        if end - start > SLICE_BYTES and (cut := _BREAK.search(raw, start + SLICE_BYTES)):
            end = cut.start()
        yield raw[start:end]
        start = end


def _changed(run: bytes, check: int) -> bytes:
    word = run.decode()
    gone = check % len(word)
    return (word[:gone] + word[gone + 1:]).encode()


def _counter(rate: int):
    """Words with their counts; of the runs whose check value ``rate`` divides one
    letter goes (0: of none)."""
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode().lower()
                prefix = zlib.crc32(b"%d:" % key) if rate and key is not None else None
                for piece in _slices(raw):
                    for found, n in Counter(_RUN.findall(piece)).items():
                        if prefix is not None and (check := zlib.crc32(found, prefix)) % rate == 0:
                            found = _changed(found, check)
                        counts[found] += n
                    if len(counts) > COUNTED:
                        yield rows(counts)
                        counts.clear()
        if counts:
            yield rows(counts)
    return run


def count_words(documents: DataFrame, rate: int = 0, min_chars: int = 5,
                min_count: int = 3) -> DataFrame:
    """(word, n) of ``documents`` (doc_id, text)."""
    counts = (documents.select(F.col("doc_id").cast("long"), "text")
              .mapInArrow(_counter(rate), "word string, n long"))
    return (counts.where(F.char_length("word") >= min_chars)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def signatures(word: str) -> list[int]:
    """Signatures of a word; near words share one at least."""
    parts = [""] * PARTS
    seen: Counter = Counter()
    for letter in sorted(word):
        seen[letter] += 1
        element = f"{letter}{seen[letter]}"
        parts[_part(element)] += element
    size, out = len(word), []
    for short in (size, size - 1):
        for q in range(SPANS):
            low, high = q * short // SPANS, (q + 1) * short // SPANS
            untouched = f"{short}|{q}|{word[:low]}|{word[size - short + high:]}|"
            out += [xxh64_intdigest(f"{untouched}{number}|{part}") - (1 << 63)
                    for number, part in enumerate(parts)]
    return out


@lru_cache(maxsize=1 << 16)
def _part(element: str) -> int:
    return zlib.crc32(element.encode()) % PARTS


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    each = 2 * SPANS * PARTS
    for batch in batches:
        for start in range(0, batch.num_rows, 10_000):
            rows = batch.slice(start, 10_000)
            found = [x for w in rows.column(0).to_pylist() for x in signatures(w)]
            at = pa.array(np.repeat(np.arange(rows.num_rows), each))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), rows.column(0).take(at), rows.column(1).take(at)],
                ["signature", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): words one edit apart, a before b in code-point order."""
    signed = words.select("word", "n").mapInArrow(_signed, "signature long, word string, n long")
    a = signed.select("signature", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = signed.select("signature", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = a.join(b.hint("merge"), (a.signature == b.signature) & (F.col("a") < F.col("b"))
                 & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, by doubling: a form's count is at least
    twice its word's, so a chain has fewer than 64 links and six rounds do."""
    current = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nexts = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(current.join(nexts.hint("merge"), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "roots")
        unstage(current)
        current = moved
        if not moved.where("moved").limit(1).count():
            return moved


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all ``words`` (word, n).

    A word's form is the most frequent near word, if it is at least ``ratio`` times as
    frequent; root is the last of a chain of forms.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = stage(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")) \
        .unionAll(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    wide = -F.col("best.less") >= ratio * F.col("n")
    formed = stage(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(wide, F.col("best.near")).alias("form"),
        F.when(wide, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.where(F.col("form").isNotNull()))
    out = stage(formed.join(roots.select("word", "root").hint("merge"), "word", "left")
                .withColumn("root", F.coalesce("root", "word")), "variants")
    unstage(words, pairs, formed, roots)
    return out
