"""Raw <-> clean reconciliation: full outer join on the case keys with side
markers, problem classes, duplicate keys and a (check, value, status) summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import fixed
from ._join import join_on_keys
from .quality import summary_rows

CASE_KEYS = ("dataset_id", "source_file", "raw_row_id", "candidate_source_column")


def _side(df: DataFrame, keys: Sequence[str], col: str, n: str, lo: str, hi: str, s: str
          ) -> DataFrame:
    v = F.coalesce(X.to_number(col, True), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.sum(v).alias(s),
                                 F.min(v).alias(lo), F.max(v).alias(hi))


def _per_key(expected: DataFrame, clean: DataFrame, keys: Sequence[str], expected_value: str,
             value: str) -> DataFrame:
    """One row per key of either side with the columns of both ``_side``; null if absent."""
    def rows(df, col, left):
        v = F.coalesce(X.to_number(col, True), F.lit(0.0))
        return df.select(*keys, (v if left else F.lit(None).cast("double")).alias("__l"),
                         (F.lit(None).cast("double") if left else v).alias("__r"))
    both = rows(expected, expected_value, True).unionAll(rows(clean, value, False))
    out = []
    for c, n, s, lo, hi in (("__l", "expected_rows", expected_value, "__lmin", "__lmax"),
                            ("__r", "clean_rows", value, "__rmin", "__rmax")):
        out += [F.nullif(F.count(c), F.lit(0)).alias(n), F.sum(c).alias(s),
                F.min(c).alias(lo), F.max(c).alias(hi)]
    return both.groupBy(*keys).agg(*out)


def reconcile_outer(expected: DataFrame, clean: DataFrame, keys: Sequence[str] = CASE_KEYS,
                    expected_value: str = "expected_votes", value: str = "votes",
                    tolerance: float = fixed.RECONCILE_TOLERANCE) -> DataFrame:
    """Full outer join of expected and clean cases on the case keys; null keys
    match each other.  One row per key.

    Both sides are reduced together to one row per key (rows, sum, min and max
    of each side's values, missing as 0), which combines on the map side and
    shuffles once; a key repeated a and b times costs a + b input rows and one
    output row, never a·b pairs.  For a key present once on each side (the
    normal case) the row is exactly the row-level match.
    ``abs_vote_diff`` is the largest difference between any left and any
    right value of the key (max(maxR - minL, maxL - minR)); ``vote_diff`` is
    the difference of the sums.  ``_merge`` is left_only / right_only / both;
    ``problem_type`` is missing_from_clean, extra_in_clean,
    vote_value_mismatch or null.  Repeated keys are reported by
    ``duplicate_keys``.
    """
    if [expected.schema[k].dataType for k in keys] == [clean.schema[k].dataType for k in keys]:
        joined = _per_key(expected, clean, keys, expected_value, value)
    else:  # a union would make texts of numbers
        left = _side(expected, keys, expected_value, "expected_rows", "__lmin", "__lmax", expected_value)
        right = _side(clean, keys, value, "clean_rows", "__rmin", "__rmax", value)
        joined = join_on_keys(left, right, keys, how="full_outer")
    has_l, has_r = F.col("expected_rows").isNotNull(), F.col("clean_rows").isNotNull()
    spread = F.greatest(F.col("__rmax") - F.col("__lmin"), F.col("__lmax") - F.col("__rmin"))
    out = joined.withColumns({
        "_merge": F.when(has_l & has_r, "both").when(has_l, "left_only")
        .otherwise("right_only"),
        "expected_rows": F.coalesce("expected_rows", F.lit(0)),
        "clean_rows": F.coalesce("clean_rows", F.lit(0)),
        expected_value: F.coalesce(expected_value, F.lit(0.0)),
        value: F.coalesce(value, F.lit(0.0)),
        "vote_diff": F.coalesce(value, F.lit(0.0)) - F.coalesce(expected_value, F.lit(0.0)),
        "abs_vote_diff": F.when(has_l & has_r, spread).otherwise(
            F.abs(F.coalesce(value, F.lit(0.0)) - F.coalesce(expected_value, F.lit(0.0))))})
    out = out.drop("__lmin", "__lmax", "__rmin", "__rmax")
    return out.withColumn(
        "problem_type",
        F.when(F.col("_merge") == "left_only", "missing_from_clean")
        .when(F.col("_merge") == "right_only", "extra_in_clean")
        .when(F.col("abs_vote_diff") > tolerance, "vote_value_mismatch"))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = CASE_KEYS) -> DataFrame:
    """Key tuples seen more than once (null keys group), with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1))


def audit_problems(audit: DataFrame, expected: DataFrame, clean: DataFrame,
                   keys: Sequence[str] = CASE_KEYS) -> DataFrame:
    """All problem rows in one frame, tagged with ``problem_type``; columns that
    a class lacks are null."""
    rows = audit.where(F.col("problem_type").isNotNull())
    dup_clean = duplicate_keys(clean, keys).withColumn("problem_type",
                                                       F.lit("duplicate_clean_case"))
    dup_exp = duplicate_keys(expected, keys).withColumn("problem_type",
                                                        F.lit("duplicate_expected_case"))
    out = rows.unionByName(dup_clean, allowMissingColumns=True)
    out = out.unionByName(dup_exp, allowMissingColumns=True)
    first = ["problem_type", *keys]
    return out.select(*first, *[c for c in out.columns if c not in first])


def audit_counts(audit: DataFrame, expected: DataFrame, clean: DataFrame,
                 keys: Sequence[str] = CASE_KEYS) -> DataFrame:
    """One row of reconciliation counts: rows on each side, rows missing from
    the clean side and rows extra in it, keys whose values disagree, and
    repeated keys on each side.  Everything comes from the per-key audit."""
    a = audit.agg(
        F.sum("expected_rows").alias("expected_raw_candidate_cases"),
        F.sum("clean_rows").alias("clean_long_cases"),
        F.sum(F.when(F.col("problem_type") == "missing_from_clean", F.col("expected_rows"))
              .otherwise(0)).alias("missing_from_clean"),
        F.sum(F.when(F.col("problem_type") == "extra_in_clean", F.col("clean_rows"))
              .otherwise(0)).alias("extra_in_clean"),
        F.count_if(F.col("problem_type") == "vote_value_mismatch").alias("vote_value_mismatches"),
        F.count_if(F.col("clean_rows") > 1).alias("duplicate_clean_cases"),
        F.count_if(F.col("expected_rows") > 1).alias("duplicate_expected_cases"))
    return a.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                      for c in a.columns])


def audit_summary(counts: DataFrame, sources_used: int | None = None,
                  sources_skipped: int | None = None) -> DataFrame:
    """(check, value, status) rows of the reconciliation."""
    ok = lambda c: F.when(F.col(c) == 0, "OK").otherwise("PROBLEM")
    checks = []
    if sources_used is not None:
        checks.append(("raw_files_used_for_expected_cases", F.lit(sources_used),
                       F.lit("OK" if sources_used > 0 else "PROBLEM")))
    if sources_skipped is not None:
        checks.append(("raw_files_skipped_for_expected_cases", F.lit(sources_skipped),
                       F.lit("OK" if sources_skipped == 0 else "CHECK")))
    checks += [
        ("expected_raw_candidate_cases", F.col("expected_raw_candidate_cases"), F.lit("INFO")),
        ("clean_long_cases", F.col("clean_long_cases"), F.lit("INFO")),
        ("missing_from_clean", F.col("missing_from_clean"), ok("missing_from_clean")),
        ("extra_in_clean", F.col("extra_in_clean"), ok("extra_in_clean")),
        ("vote_value_mismatches", F.col("vote_value_mismatches"), ok("vote_value_mismatches")),
        ("duplicate_clean_cases", F.col("duplicate_clean_cases"), ok("duplicate_clean_cases")),
        ("duplicate_expected_cases", F.col("duplicate_expected_cases"),
         ok("duplicate_expected_cases")),
    ]
    return summary_rows(counts, checks)
