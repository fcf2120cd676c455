"""Audit of a folder of raw files against the clean long table.

The expected cases are rebuilt from the raw files here, apart from the cleaner: one
grouped aggregate per schema counts the numbers in every column (no unpivot), then the
cells of the columns that pass become rows as doubles.

Cases are compared by checksum first.  Both sides are summed up per (file, bucket of
the case key): rows, sum of one hash and exclusive-or of another of (key, value), so
the order of rows does not matter, the sums combine on the map side and no case is
shuffled.  Only the cases of buckets that differ are joined, null-safely on the four
keys; where many rows are at fault that is nearly all of them, so they are shuffled once
and only problem rows are written.  A raw file numbers its rows, so its keys are unique;
buckets with equal sums hold no repeated key unless two raw files share their name, and
the buckets of such names are always joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import fixed
from ..sources import ingest as I
from . import reshape as R
from ._join import join_on_keys
from .quality import one_row, summary_rows
from .reconcile import CASE_KEYS, reconcile_outer

#: Buckets of case keys in each file.
BUCKETS = 1 << 12
BUCKET_KEYS = ("dataset_id", "source_file", "__bucket")
#: Most buckets that are broadcast, as one number each: some 10 MB.
BROADCAST_BUCKETS = 1 << 18


@dataclass(frozen=True)
class FolderAudit:
    """``cases``: joined keys of the buckets that differ (joined when read); ``problems``:
    rows tagged with their class; ``summary``: the nine checks; ``files``: rows per raw file."""

    cases: DataFrame
    problems: DataFrame
    summary: DataFrame
    files: DataFrame


def _wide_cases(raw: DataFrame) -> DataFrame | None:
    df = I.prepare_wide(raw)
    if I.missing_columns(df, fixed.REQUIRED_WIDE_COLUMNS):
        return None
    kept = df.where(I.valid_station_rows(df))
    known = [*fixed.STANDARD_COLUMNS, *I.PROVENANCE, "source_path"]
    names = R.candidate_value_columns(kept, known)
    if not names:
        return None
    numeric = {c: R.is_numeric_type(kept.schema[c].dataType) for c in names}
    # One row per file: which columns hold numbers in enough of its rows.
    counts = kept.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(X.is_number(f"`{c}`", numeric[c])).alias(f"__c{i}")
          for i, c in enumerate(names)])
    passed = counts.select(
        F.col("source_path").alias("__path"),
        F.array(*[F.col(f"__c{i}") / F.col("__n") >= fixed.VALUE_COLUMN_MIN_NUMERIC_RATIO
                  for i in range(len(names))]).alias("__passed"))
    cells = F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(c).alias("candidate_source_column"),
        F.coalesce(X.to_number(f"`{c}`", numeric[c]), F.lit(0.0)).alias("expected_votes"))
        for i, c in enumerate(names)])
    joined = kept.join(passed, F.col("source_path") == F.col("__path"))
    return (joined.select(*I.PROVENANCE, "source_path",
                          F.explode(F.filter(cells, lambda c: F.get("__passed", c["place"])))
                          .alias("__cell"))
            .select(*I.PROVENANCE, "source_path", "__cell.candidate_source_column",
                    "__cell.expected_votes"))


def _long_cases(raw: DataFrame) -> DataFrame | None:
    df = I.normalize_columns(raw)
    if I.missing_columns(df, fixed.REQUIRED_LONG_COLUMNS):
        return None
    df = df.withColumn("__key", X.parse_structured_key("source_bv_id")["key"])
    kept = df.where(I.valid_long_rows(df, "__key"))
    votes = X.to_number("votes", R.is_numeric_type(df.schema["votes"].dataType))
    return kept.select(*I.PROVENANCE, "source_path",
                       F.col("candidate").cast("string").alias("candidate_source_column"),
                       F.coalesce(votes, F.lit(0.0)).alias("expected_votes"))


_EXPECTED = ("source_file string, dataset_id string, raw_row_id long, source_path string, "
             "candidate_source_column string, expected_votes double")


def expected_cases(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Cases that the raw files at ``paths`` call for: (dataset_id, source_file,
    raw_row_id, source_path, candidate_source_column, expected_votes).  Files are read
    per schema; a file without a readable schema or the required columns gives none."""
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        try:
            schema = spark.read.parquet(path).schema
        except Exception:  # noqa: BLE001 - counted as a skipped file
            continue
        name = path.rstrip("/").rsplit("/", 1)[-1]
        groups.setdefault((I.is_long_shape(schema.fieldNames(), name), schema.json()),
                          []).append(path)
    out = spark.createDataFrame([], _EXPECTED)
    for (long, _), members in groups.items():
        raw = I.read_with_provenance(spark, members, "source_path")
        cases = _long_cases(raw) if long else _wide_cases(raw)
        if cases is not None:
            out = out.unionByName(cases)
    return out


def with_bucket(cases: DataFrame, keys: Sequence[str] = CASE_KEYS, buckets: int = BUCKETS
                ) -> DataFrame:
    return cases.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def checksums(cases: DataFrame, value: str, group: Sequence[str],
              keys: Sequence[str] = CASE_KEYS) -> DataFrame:
    """(group, rows, sum, parity) of the cases, whatever their order."""
    parts = [*keys, F.coalesce(F.col(value), F.lit(0.0)) + F.lit(0.0)]
    # A 64-bit sum would overflow, a decimal one is slow: the halves are summed apart.
    mixed, half = F.xxhash64(*parts), 1 << 32
    sums = cases.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.shiftright(mixed, 32)).alias("high"),
        F.sum(mixed.bitwiseAND(F.lit(half - 1))).alias("low"),
        F.bit_xor(F.xxhash64(F.lit("parity"), *parts)).alias("parity"))
    whole = (F.col("high").cast("decimal(20,0)") * F.lit(half).cast("decimal(10,0)")
             + F.col("low").cast("decimal(20,0)"))
    return sums.select(*group, "rows", whole.cast("decimal(30,0)").alias("sum"), "parity")


def _differing(expected: DataFrame, clean: DataFrame, shared_names: DataFrame) -> DataFrame:
    """Buckets whose sums differ, and all buckets of names that several files share."""
    columns = ("rows", "sum", "parity")
    left = expected.groupBy(*BUCKET_KEYS).agg(
        F.sum("rows").alias("rows"), F.sum("sum").alias("sum"),
        F.bit_xor("parity").alias("parity"))
    right = clean.select(*BUCKET_KEYS, *[F.col(c).alias(f"__r_{c}") for c in columns])
    joined = join_on_keys(left, right, BUCKET_KEYS, how="full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    joined = join_on_keys(joined, shared_names, ("dataset_id", "source_file"), how="left")
    return joined.where(~same | F.col("__shared").isNotNull()).select(*BUCKET_KEYS)


def _in_buckets(cases: DataFrame, suspects: DataFrame, few: bool) -> DataFrame:
    """The cases of ``suspects``, told by one number a bucket: two buckets that share it
    only bring more cases to the join."""
    at = F.xxhash64(*BUCKET_KEYS)
    held = suspects.select(at.alias("__at")).distinct()
    return cases.join(F.broadcast(held) if few else held, at == F.col("__at"), "left_semi")


def audit_folder(spark: SparkSession, root: str, clean: DataFrame, value: str = "votes",
                 buckets: int = BUCKETS) -> FolderAudit:
    """Audit ``clean`` (long table with the case keys and ``value``) against the raw
    files of both families under ``root``.

    Nulls in a key are a value of their own, null values count as 0.  A clean table
    without one of the needed columns raises ``ValueError``; a folder without files
    raises ``FileNotFoundError``.
    """
    needed = [*CASE_KEYS, value]
    if missing := sorted(set(needed) - set(clean.columns)):
        raise ValueError("clean table lacks audit columns: " + ", ".join(missing))
    paths = I.list_sources(spark, root)
    if not paths:
        raise FileNotFoundError(f"no source files under {root}")
    # Read for the sums and again for the cases that differ: parsed once.
    expected = I.staged(with_bucket(expected_cases(spark, paths), buckets=buckets), "expected")
    numeric = R.is_numeric_type(clean.schema[value].dataType)
    actual = with_bucket(clean.select(
        *[F.col(k).cast(t).alias(k) for k, t in zip(CASE_KEYS, ("string", "string", "long", "string"))],
        X.to_number(value, numeric).alias(value)), buckets=buckets)

    # The sums are small (files x buckets) and read three times: kept, not recomputed.
    sums = checksums(expected, "expected_votes", ["source_path", *BUCKET_KEYS]).checkpoint()
    clean_sums = checksums(actual, value, BUCKET_KEYS).checkpoint()
    files = sums.groupBy("source_path", "dataset_id", "source_file").agg(
        F.sum("rows").alias("expected_rows"))
    shared = (files.groupBy("dataset_id", "source_file").agg(F.count(F.lit(1)).alias("__shared"))
              .where(F.col("__shared") > 1))
    suspects = _differing(sums, clean_sums, shared).checkpoint()

    few = suspects.count() <= BROADCAST_BUCKETS
    cases = reconcile_outer(_in_buckets(expected, suspects, few), _in_buckets(actual, suspects, few),
                            CASE_KEYS, "expected_votes", value)
    faults = I.staged(cases.where(F.col("problem_type").isNotNull() | (F.col("clean_rows") > 1)
                                  | (F.col("expected_rows") > 1)), "faults")
    return FolderAudit(cases, problem_rows(faults), _summary(len(paths), sums, clean_sums, faults),
                       files)


def problem_rows(cases: DataFrame) -> DataFrame:
    """Problem rows of an audit, tagged; a repeated key is told by the audit's counts."""
    tags = F.filter(F.array(
        F.col("problem_type"),
        F.when(F.col("clean_rows") > 1, F.lit("duplicate_clean_case")),
        F.when(F.col("expected_rows") > 1, F.lit("duplicate_expected_case"))),
        lambda t: t.isNotNull())
    rest = [c for c in cases.columns if c != "problem_type"]
    return cases.select(F.explode(tags).alias("problem_type"), *rest)


def _summary(n_files: int, sums: DataFrame, clean_sums: DataFrame, cases: DataFrame) -> DataFrame:
    used = sums.agg(F.count_distinct("source_path").alias("used"),
                    F.coalesce(F.sum("rows"), F.lit(0)).alias("expected"))
    held = clean_sums.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("clean"))
    kind = F.col("problem_type")
    found = cases.agg(*[F.coalesce(v, F.lit(0)).alias(n) for n, v in {
        "missing_from_clean": F.sum(F.when(kind == "missing_from_clean", F.col("expected_rows"))),
        "extra_in_clean": F.sum(F.when(kind == "extra_in_clean", F.col("clean_rows"))),
        "vote_value_mismatches": F.count_if(kind == "vote_value_mismatch"),
        "duplicate_clean_cases": F.count_if(F.col("clean_rows") > 1),
        "duplicate_expected_cases": F.count_if(F.col("expected_rows") > 1)}.items()])
    row = one_row(used, held, found)
    skipped = F.lit(n_files) - F.col("used")
    status = lambda c, bad="PROBLEM": F.when(c == 0, "OK").otherwise(bad)
    checks = [
        ("raw_files_used_for_expected_cases", F.col("used"),
         F.when(F.col("used") > 0, "OK").otherwise("PROBLEM")),
        ("raw_files_skipped_for_expected_cases", skipped, status(skipped, "CHECK")),
        ("expected_raw_candidate_cases", F.col("expected"), F.lit("INFO")),
        ("clean_long_cases", F.col("clean"), F.lit("INFO"))]
    checks += [(c, F.col(c), status(F.col(c))) for c in found.columns]
    return summary_rows(row, checks)
