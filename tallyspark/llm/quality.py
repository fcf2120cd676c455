"""Quality rules with adaptive thresholds.

Each whole text is measured (words, symbols, repeated lines and words).  A fixed
base rejects texts that no corpus wants.  Of the rest, each measure is held against
fences of its own language and source, which come from quartiles of mergeable KLL
sketches: upper quartile + reach x spread, lower quartile - reach x spread.

Rates that are mostly 0 have no spread of their own, so a count k of n is sketched
as ln((k + 1/2) / (n - k + 1/2)): texts without a symbol differ by their lengths,
and a group's fence follows from how sure its own texts are of having none.  Word
lengths are sketched as logarithms and have a lower fence too.

A group's quartiles are blended with its language's, and those with the corpus', by
numbers of rows: the upper level counts as ``PRIOR_ROWS`` rows.  No size switches a
group from one level to another.  Fences are staged once and joined to the measured
rows, so every task of a run applies the same ones.

Contract: a null text has no words and fails the base; null languages and
sources are groups of their own; empty tables give empty results; repeated rows
each get a verdict; a measure whose fence cannot be set (no rows) rejects nothing;
other columns of the input are ignored, whatever their names; two names in ``keep``
must differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import mix, slices

MIN_WORDS = 50
#: Bytes of text measured at once, if they are several texts'; the arrays take some 60 times that.
SLICE = 1 << 18
#: Rows of its own that weigh as much as the level above.
PRIOR_ROWS = 50
#: KLL size: rank error about 0.7 %.
SKETCH_K = 400
#: rate -> (count, out of, reach of the upper fence in spreads).  Symbols do not occur in
#: running text; repeats follow a text's form as well as its worth, so they reach farther.
RATES = {"symbol_rate": ("n_symbols", "word_chars", 3.0),
         "dup_line_rate": ("n_dup_lines", "n_lines", 4.0),
         "repeat_word_rate": ("n_repeat_words", "n_words", 5.0)}
#: Reach of both fences of the word length.
LENGTH_REACH = 4.0
#: Least spread: of log odds, and of the logarithm of a length.
LEAST_SPREAD, LEAST_LENGTH_SPREAD = 0.5, 0.05
MEASURES = [*RATES, "word_length"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _seen_before(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: whether its hash occurs earlier in its text, and elsewhere at all."""
    key = mix(hashes + mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return earlier, again


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros((len(_COUNTS), len(batch)), np.int64)
        for row, texts in slices(batch.column("text"), size=SLICE):
            part = counts[:, row:row + texts.count]
            part[0] = np.bincount(texts.word_text, minlength=texts.count)
            part[1] = texts.per_text(texts.is_word & ((texts.data & 0xC0) != 0x80))
            part[2] = texts.per_text(_SYMBOL[texts.data])
            start, end, text = texts.lines()
            spoken = np.concatenate([[0], np.cumsum(texts.is_word)])
            start, end, text = (x[spoken[end] > spoken[start]] for x in (start, end, text))
            part[3] = np.bincount(text, minlength=texts.count)
            part[4] = np.bincount(text[_seen_before(text, texts.hashes(start, end))[0]],
                                  minlength=texts.count)
            hashes, text, first = texts.shingles(3)
            full = part[0][text] >= 3
            again = _seen_before(text[full], hashes[full])[1]
            covered = np.zeros(len(texts.word_start) + 2, bool)
            for k in range(3):
                covered[first[full][again] + k] = True
            part[5] = np.bincount(texts.word_text[covered[:-2]], minlength=texts.count)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), *map(pa.array, counts)], [*names, *_COUNTS])


def _rate(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _scale(measure: str) -> Column:
    """A measure on the scale that is sketched."""
    if measure == "word_length":
        return F.ln(F.greatest(F.col(measure), F.lit(1e-9)))
    count, size, _ = RATES[measure]
    return F.ln((F.col(count) + 0.5) / (F.col(size) - F.col(count) + 0.5))


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, the counts and rates of every text, and ``base_failed``."""
    kept = docs.select(*keep, F.col(text).alias("text")).schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    counts = (docs.select(*keep, F.col(text).alias("text"))
              .mapInArrow(_measure, f"{schema}, " + ", ".join(f"{c} long" for c in _COUNTS)))
    return (counts
            .withColumns({r: _rate(count, size) for r, (count, size, _) in RATES.items()})
            .withColumn("word_length", _rate("word_chars", "n_words"))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, level, n, one KLL sketch per measure); level 0 is the finest.

    Rows that fail the base say nothing about good text and are left out.
    """
    rows = measured.where(~F.col("base_failed"))
    fine = rows.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(_scale(r), F.lit(SKETCH_K)).alias(r) for r in MEASURES])
    fine = stage(fine, "sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r).alias(r) for r in MEASURES]]
    by_lang = (fine.groupBy("lang").agg(*merged)
               .select("lang", F.lit(None).cast("string").alias("source"), "n", *MEASURES))
    whole = (fine.agg(*merged).where("n > 0")
             .select(F.lit(None).cast("string").alias("lang"),
                     F.lit(None).cast("string").alias("source"), "n", *MEASURES))
    return (fine.withColumn("level", F.lit(0))
            .unionByName(by_lang.withColumn("level", F.lit(1)))
            .unionByName(whole.withColumn("level", F.lit(2))))


def fences(sketched: DataFrame) -> DataFrame:
    """One row per (lang, source): ``fence`` has (low, high) of each measure, on its scale."""
    quartiles = F.struct(*[F.struct(*[
        F.kll_sketch_get_quantile_double(r, F.lit(q)).alias(name)
        for name, q in (("q1", 0.25), ("q3", 0.75))]).alias(r) for r in MEASURES])
    levels = sketched.select("lang", "source", "level", "n", quartiles.alias("own"))
    fine, by_lang, whole = (levels.where(F.col("level") == k) for k in range(3))
    by_lang = by_lang.select(F.col("lang").alias("lang1"), F.col("n").alias("n1"),
                             F.col("own").alias("own1"))
    whole = whole.select(F.col("own").alias("own2"), F.lit(1).alias("one"))
    joined = (fine.withColumn("one", F.lit(1))
              .join(by_lang, F.col("lang").eqNullSafe(F.col("lang1")), "left")
              .join(whole, "one", "left"))

    def blended(path: str) -> Column:
        def level(n: str, own: str, above: Column) -> Column:
            return (F.col(n) * F.col(f"{own}.{path}") + PRIOR_ROWS * above) / (
                F.col(n) + PRIOR_ROWS)
        return level("n", "own", level("n1", "own1", F.col(f"own2.{path}")))

    def fence(measure: str) -> Column:
        low, high = blended(f"{measure}.q1"), blended(f"{measure}.q3")
        length = measure == "word_length"
        least = LEAST_LENGTH_SPREAD if length else LEAST_SPREAD
        reach = LENGTH_REACH if length else RATES[measure][2]
        spread = reach * F.greatest(high - low, F.lit(least))
        bottom = low - spread if length else F.lit(None).cast("double")
        return F.struct(bottom.alias("low"), (high + spread).alias("high")).alias(measure)
    return joined.select("lang", "source", F.struct(*map(fence, MEASURES)).alias("fence"))


def quality_verdicts(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang",
                     source: str = "source") -> DataFrame:
    """``keep`` columns, counts, rates, base_failed, ``beyond`` (names of the measures outside
    their fences, of rows that pass the base) and kept, for every row.

    The rows travel under names of their own, so no name in ``keep`` can clash with
    ``lang``, ``source`` or the fences.
    """
    own = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)],
                       F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"),
                       F.col(f"`{text}`").alias("_text"))
    measured = stage(measure(rows, [*own, "_lang", "_source"], "_text"), "measured")
    limits = stage(fences(sketches(measured, "_lang", "_source")), "fences")
    joined = measured.join(limits, F.col("_lang").eqNullSafe(F.col("lang"))
                           & F.col("_source").eqNullSafe(F.col("source")), "left")

    def outside(measure: str) -> Column:
        at = _scale(measure)
        out = ((at > F.col(f"fence.{measure}.high"))
               | F.coalesce(at < F.col(f"fence.{measure}.low"), F.lit(False)))
        return F.when(~F.col("base_failed") & out, F.lit(measure))
    beyond = F.array_compact(F.array(*map(outside, MEASURES)))
    return (joined.withColumn("beyond", beyond)
            .withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0))
            .select(*[F.col(o).alias(c) for c, o in zip(keep, own)], *_COUNTS, *MEASURES,
                    "base_failed", "beyond", "kept"))
