"""Line deduplication by range-partitioned line hashes.

The hashes of long enough lines are range-partitioned with a secondary sort by
document (largest first) and position, and each run of equal hashes is streamed
once: a line that is the first of its run, or opens a new document, says all
that is needed.  A run is also cut by a salt of the document, so a line that a
third of the corpus holds is spread over many tasks; the runs' summaries are
added up per hash.  What comes back is no text but, per document, a compressed
keep bitmap: only the 64-line words in which a line goes are listed.

Hashes are two independent 64-bit values (128 bits).  Everything is DataFrame
functions.

Contract: a null or empty text is one empty line; a document whose key is null
neither counts nor loses lines; rows that repeat a key are one document, and each
of them is treated alike; lines shorter than ``min_chars`` stay; other columns
of the input are kept as they are by ``apply_keep``, whatever their names but those
of its two counts, and ignored otherwise; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import free_names, stage, unstage

#: Characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that one line hash is cut into.
SALTS = 16
_HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)  # ASCII: lower() is the same, and quick
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _whole(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(_doc, _text, _salt, _pos, hashes) of every line that takes part."""
    exploded = (docs.where(F.col(key).isNotNull())
                .select(F.col(key).alias("_doc"), F.xxhash64(_whole(text)).alias("_text"),
                        F.posexplode(F.split(_whole(text), "\n", -1)).alias("_pos", "_line")))
    return (exploded.withColumn("_line", line_key(F.col("_line")))
            .where(F.length("_line") >= min_chars)
            .select("_doc", "_text", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).alias("_salt"),
                    "_pos", F.xxhash64("_line").alias("_h1"),
                    F.xxhash64(F.lit(7), "_line").alias("_h2")))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20,
                 min_docs: int = 3) -> DataFrame:
    """(_doc, _text, n_dropped, keep) of the documents that lose lines.

    ``_text`` is the hash of the text the bitmap belongs to; ``keep`` lists
    (word, bits): bit i of word w tells whether line 64 w + i stays; words that
    are not listed stay whole.
    """
    lines = stage(_lines(docs, key, text, min_chars), "lines")
    run = Window.partitionBy(*_HASH, "_salt").orderBy(F.desc("_doc"), "_pos")
    before = F.lag("_doc").over(run)
    opened = F.when(before.isNull() | (before != F.col("_doc")), 1).otherwise(0)
    streamed = (lines.select(*_HASH, "_salt", "_doc", "_pos")
                .repartitionByRange(*_HASH, "_salt").withColumn("_opens", opened))
    runs = streamed.groupBy(*_HASH, "_salt").agg(F.sum("_opens").alias("_docs"),
                                                 F.max("_doc").alias("_last"))
    shared = stage(runs.groupBy(*_HASH)
                   .agg(F.sum("_docs").alias("_docs"), F.max("_last").alias("_last"))
                   .where(F.col("_docs") >= min_docs).drop("_docs"), "shared-lines")
    salted = shared.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    dropped = (lines.join(salted, [*_HASH, "_salt"]).where(F.col("_doc") != F.col("_last"))
               .select("_doc", "_text", F.expr("_pos div 64").cast("int").alias("word"),
                       F.expr("shiftleft(1L, int(_pos % 64))").alias("bit")))
    words = dropped.groupBy("_doc", "_text", "word").agg(F.bit_or("bit").alias("gone"))
    bitmaps = stage(words.groupBy("_doc", "_text").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))
        .alias("keep")), "keep")
    unstage(lines, shared)
    return bitmaps


def apply_keep(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``docs`` with the lines that stay, and (_n_lines, _n_dropped), which replace columns
    of these names."""
    doc, same, words, dropped, whole = free_names(docs, "doc", "same", "words", "dropped", "whole")
    kept = F.expr(rf"""array_join(filter(split(`{whole}`, '\n', -1), (line, i) ->
        (shiftright(coalesce(`{words}`[int(i div 64)], -1L), int(i % 64)) & 1L) = 1L), '\n')""")
    found = bitmaps.select(F.col("_doc").alias(doc), F.col("_text").alias(same),
                           F.col("n_dropped").alias(dropped),
                           F.map_from_entries("keep").alias(words))
    joined = docs.withColumn(whole, _whole(text)).join(
        found, (F.col(f"`{key}`") == F.col(doc)) & (F.xxhash64(whole) == F.col(same)), "left")
    new_text = F.when(F.col(words).isNull(), F.col(f"`{text}`")).otherwise(kept)
    return joined.select(*[new_text.alias(c) if c == text else F.col(f"`{c}`")
                           for c in docs.columns if c.lower() not in ("_n_lines", "_n_dropped")],
                         F.size(F.split(whole, "\n", -1)).cast("long").alias("_n_lines"),
                         F.coalesce(dropped, F.lit(0)).cast("long").alias("_n_dropped"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                        min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without the lines that other documents repeat, plus the two counts."""
    return apply_keep(docs, keep_bitmaps(docs, key, text, min_chars, min_docs), key, text)
