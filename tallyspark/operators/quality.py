"""Data-quality checks: station totals, row flags, wide-table ranges, row
counts per source, suspicious names, summaries as (check, value, status).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import fixed
from ._join import join_on_keys
from .reshape import is_numeric_type

STATION_CHECK_KEYS = ("dataset_id", "source_file", "raw_row_id", "id_bvote", "scrutin",
                      "annee", "tour", "date", "num_arrond", "num_bureau", "nb_inscr",
                      "nb_votant", "nb_exprim")


def station_vote_check(long: DataFrame, keys: Sequence[str] = STATION_CHECK_KEYS,
                       votes: str = "votes", candidate: str = "candidate",
                       expressed: str = "nb_exprim",
                       vote_tolerance: float = fixed.EXPRESSED_VOTE_TOLERANCE,
                       share_tolerance: float = fixed.SHARE_SUM_TOLERANCE,
                       scope: str = "source_total_check",
                       stations: DataFrame | None = None,
                       station_key: Sequence[str] | None = None) -> DataFrame:
    """Per station: sum of candidate votes against the reported total.

    Null keys form a group.  A null total fails the vote check and passes the
    share check (no share can be computed).

    When the station attributes live in their own table, pass it as
    ``stations`` with the join key ``station_key``: the candidate rows are then
    summed per station first (map-side combine) and joined to the stations
    afterwards, so the join moves one row per station instead of one per
    candidate row; ``keys`` then names the station columns to keep.
    """
    if stations is not None:
        station_key = list(station_key)
        sums = (long.groupBy(*station_key)
                .agg(F.coalesce(F.sum(X.to_number(votes, True)), F.lit(0.0))
                     .alias("candidate_votes_sum"),
                     F.countDistinct(candidate).alias("candidate_count")))
        keys = [k for k in keys if k in stations.columns]
        checks = join_on_keys(sums, stations, station_key, how="inner").select(
            *keys, "candidate_votes_sum", "candidate_count")
        return _station_metrics(checks, expressed, vote_tolerance, share_tolerance, scope)
    keys = [k for k in keys if k in long.columns]
    checks = (long.groupBy(*keys)
              .agg(F.coalesce(F.sum(X.to_number(votes, True)), F.lit(0.0))
                   .alias("candidate_votes_sum"),
                   F.countDistinct(candidate).alias("candidate_count")))
    return _station_metrics(checks, expressed, vote_tolerance, share_tolerance, scope)


def _station_metrics(checks: DataFrame, expressed: str, vote_tolerance: float,
                     share_tolerance: float, scope: str) -> DataFrame:
    total = X.to_number(expressed, True)
    diff = F.col("candidate_votes_sum") - total
    share_sum = F.try_divide(F.col("candidate_votes_sum"), F.when(total != 0, total))
    return checks.withColumns({
        "validation_scope": F.lit(scope),
        "expressed_vote_diff": diff,
        "abs_expressed_vote_diff": F.abs(diff),
        "vote_share_sum_from_votes": share_sum,
        "vote_share_sum_diff": share_sum - 1,
        "abs_vote_share_sum_diff": F.abs(share_sum - 1),
        "expressed_votes_ok": F.coalesce(F.abs(diff) <= vote_tolerance, F.lit(False)),
        "vote_share_sum_ok": F.abs(share_sum - 1).isNull()
        | (F.abs(share_sum - 1) <= share_tolerance)})


def station_mismatches(checks: DataFrame) -> DataFrame:
    """Stations failing either check, largest absolute vote difference first."""
    return (checks.where(~F.col("expressed_votes_ok") | ~F.col("vote_share_sum_ok"))
            .orderBy(F.col("abs_expressed_vote_diff").desc_nulls_last()))


def duplicate_flag(df: DataFrame, keys: Sequence[str], out: str = "is_duplicate"
                   ) -> DataFrame:
    """Mark every row whose key tuple occurs more than once (null keys equal).

    Counted with an aggregate joined back, so a hot key is combined on the
    map side instead of being buffered by one window task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__dup_n"))
    return (join_on_keys(df, counts, keys, how="left")
            .withColumn(out, F.col("__dup_n") > 1).drop("__dup_n"))


def out_of_range(c, eps: float = fixed.SHARE_RANGE_EPS):
    v = X.to_number(c, True)
    return v.isNull() | (v < -eps) | (v > 1 + eps)


ROW_PROBLEMS = ("missing_candidate", "missing_votes", "negative_votes", "missing_booth_id",
                "vote_share_exprimes_out_of_range", "vote_share_registered_out_of_range",
                "duplicate_candidate_row")


def row_problem_flags(long: DataFrame, candidate: str = "candidate", votes: str = "votes",
                      station_ids: Sequence[str] = ("id_bvote", "source_bv_id"),
                      duplicate_keys: Sequence[str] = ("dataset_id", "source_file",
                                                       "raw_row_id",
                                                       "candidate_source_column"),
                      share_expressed: str = "vote_share_exprimes",
                      share_registered: str = "vote_share_registered",
                      tokens: Sequence[str] = fixed.MISSING_TOKENS_WIDE) -> DataFrame:
    """Per-row problem flags of the long family and ``row_ok``."""
    df, dup_keys = _row_flags(long, candidate, votes, station_ids, duplicate_keys,
                              share_expressed, share_registered, tokens)
    if dup_keys:
        df = duplicate_flag(df, dup_keys, "duplicate_candidate_row")
    else:
        df = df.withColumn("duplicate_candidate_row", F.lit(True))
    any_problem = F.lit(False)
    for p in ROW_PROBLEMS:
        any_problem = any_problem | F.col(p)
    return df.withColumn("row_ok", ~any_problem)


def _row_flags(long, candidate, votes, station_ids, duplicate_keys, share_expressed,
               share_registered, tokens):
    """The six per-row flags (all but the duplicate one) and the duplicate keys."""
    df = long.withColumn("votes_numeric", X.to_number(votes, True))
    present = [c for c in station_ids if c in df.columns]
    missing_id = F.lit(True)
    for c in present:
        missing_id = missing_id & X.missing_like(c, tokens)
    df = df.withColumns({
        "missing_candidate": X.missing_like(candidate, tokens)
        if candidate in df.columns else F.lit(True),
        "missing_votes": F.col("votes_numeric").isNull(),
        "negative_votes": F.coalesce(F.col("votes_numeric") < 0, F.lit(False)),
        "missing_booth_id": missing_id,
        "vote_share_exprimes_out_of_range": out_of_range(share_expressed)
        if share_expressed in df.columns else F.lit(True),
        "vote_share_registered_out_of_range": out_of_range(share_registered)
        if share_registered in df.columns else F.lit(True)})
    dup_keys = [c for c in duplicate_keys if c in df.columns]
    if "candidate_source_column" not in dup_keys and candidate in df.columns:
        dup_keys.append(candidate)
    return df, dup_keys


def row_problem_counts_from_rows(long: DataFrame, prefix: str = "municipal_",
                                 candidate: str = "candidate", votes: str = "votes",
                                 station_ids: Sequence[str] = ("id_bvote", "source_bv_id"),
                                 duplicate_keys: Sequence[str] = ("dataset_id", "source_file",
                                                                  "raw_row_id",
                                                                  "candidate_source_column"),
                                 share_expressed: str = "vote_share_exprimes",
                                 share_registered: str = "vote_share_registered",
                                 tokens: Sequence[str] = fixed.MISSING_TOKENS_WIDE
                                 ) -> DataFrame:
    """A9 without flagging rows one by one: the same counts as
    ``row_problem_counts(row_problem_flags(long))`` from one grouped pass.

    Rows are counted per duplicate key with a map-side combine; a key with
    n > 1 rows makes n duplicate rows, all of them with a problem.  No join
    back to the rows is needed.
    """
    df, dup_keys = _row_flags(long, candidate, votes, station_ids, duplicate_keys,
                              share_expressed, share_registered, tokens)
    single = [p for p in ROW_PROBLEMS if p != "duplicate_candidate_row"]
    other = F.lit(False)
    for p in single:
        other = other | F.col(p)
    per_key = df.groupBy(*dup_keys).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(other).alias("__other"),
        *[F.count_if(F.col(p)).alias(p) for p in single])
    dup = F.col("__n") > 1
    return per_key.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias(f"{prefix}rows"),
        *[F.coalesce(F.sum(p), F.lit(0)).alias(f"{prefix}{p}") for p in single],
        F.coalesce(F.sum(F.when(dup, F.col("__n")).otherwise(0)), F.lit(0))
        .alias(f"{prefix}duplicate_candidate_rows"),
        F.coalesce(F.sum(F.when(dup, F.col("__n")).otherwise(F.col("__other"))), F.lit(0))
        .alias(f"{prefix}rows_with_any_problem"))


def row_problem_counts(flags: DataFrame, prefix: str = "municipal_") -> DataFrame:
    """One row: number of rows and number of rows with each problem."""
    return flags.agg(
        F.count(F.lit(1)).alias(f"{prefix}rows"),
        *[F.count_if(F.col(p)).alias(f"{prefix}{p}s" if p == "duplicate_candidate_row"
                                     else f"{prefix}{p}") for p in ROW_PROBLEMS],
        F.count_if(~F.col("row_ok")).alias(f"{prefix}rows_with_any_problem"))


def wide_range_check(wide: DataFrame, metadata: Sequence[str] = fixed.WIDE_METADATA_COLUMNS,
                     eps: float = fixed.SHARE_RANGE_EPS) -> DataFrame:
    """One row: size of a wide table, duplicate index rows (extra copies) and
    value cells below 0 / above 1.

    Cells are counted per index tuple first (map-side combine), then the
    tuples are counted, so the table is read once and nothing is unpivoted.
    """
    meta = set(metadata)
    index = [c for c in wide.columns if c in meta]
    values = [c for c in wide.columns if c not in meta]
    # One flat array per row (a wide table may have thousands of columns; a
    # chain of additions would nest that deep).
    cells = F.array(*[X.to_number(F.col(f"`{c}`"), is_numeric_type(wide.schema[c].dataType))
                      for c in values]) if values else F.array().cast("array<double>")
    below = F.size(F.filter(cells, lambda v: v < -eps))
    above = F.size(F.filter(cells, lambda v: v > 1 + eps))
    per_index = (wide.groupBy(*index)
                 .agg(F.count(F.lit(1)).alias("__n"), F.sum(below).alias("__lo"),
                      F.sum(above).alias("__hi")))
    return per_index.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("wide_rows"),
        F.lit(len(wide.columns)).cast("bigint").alias("wide_columns"),
        F.lit(len(values)).cast("bigint").alias("wide_candidate_columns"),
        ((F.coalesce(F.sum("__n"), F.lit(0)) - F.count(F.lit(1))) if index else F.lit(0))
        .cast("bigint").alias("wide_duplicate_index_rows"),
        F.coalesce(F.sum("__lo"), F.lit(0)).cast("bigint").alias("wide_values_below_zero"),
        F.coalesce(F.sum("__hi"), F.lit(0)).cast("bigint").alias("wide_values_above_one"))


def wide_range_check_long(long: DataFrame, index: Sequence[str], candidate: str = "candidate",
                          share: str = "vote_share_exprimes",
                          eps: float = fixed.SHARE_RANGE_EPS) -> DataFrame:
    """A10 computed on the long table, without building the wide one.

    The wide table has one row per index tuple and one cell per candidate,
    each cell the summed share (absent -> 0, which is in range).  So the cell
    counts come from the (index, candidate) sums and the shape from distinct
    counts; nothing is pivoted.  Duplicate index rows cannot occur in a
    pivot, so that count is 0.
    """
    index = [c for c in index if c in long.columns]
    src = long.where(F.col(candidate).isNotNull())
    cells = (src.groupBy(*index, candidate)
             .agg(F.coalesce(F.sum(X.finite_or_null(share)), F.lit(0.0)).alias("__s")))
    per_index = (cells.groupBy(*index)
                 .agg(F.count_if(F.col("__s") < -eps).alias("__lo"),
                      F.count_if(F.col("__s") > 1 + eps).alias("__hi")))
    shape = per_index.agg(F.count(F.lit(1)).alias("wide_rows"),
                          F.coalesce(F.sum("__lo"), F.lit(0)).alias("wide_values_below_zero"),
                          F.coalesce(F.sum("__hi"), F.lit(0)).alias("wide_values_above_one"))
    n_cand = src.agg(F.countDistinct(candidate).alias("wide_candidate_columns"))
    out = one_row(shape, n_cand)
    return out.select(
        F.col("wide_rows").cast("bigint"),
        (F.col("wide_candidate_columns") + len(index)).cast("bigint").alias("wide_columns"),
        F.col("wide_candidate_columns").cast("bigint"),
        F.lit(0).cast("bigint").alias("wide_duplicate_index_rows"),
        F.col("wide_values_below_zero").cast("bigint"),
        F.col("wide_values_above_one").cast("bigint"))


def suspicious_names(long: DataFrame, candidate: str = "candidate") -> DataFrame:
    """Distinct candidate names that look like metadata, sorted."""
    return (long.select(F.col(candidate).cast("string").alias("candidate"))
            .where(F.col("candidate").isNotNull()).distinct()
            .where(X.suspicious_name("candidate"))
            .withColumn("reason", F.lit("looks like metadata or technical column"))
            .orderBy("candidate"))


def row_count_check(report: DataFrame, long: DataFrame, strict: bool = False,
                    file_col: str = "file", source_col: str = "source_file",
                    class_columns: Sequence[str] = ("file", "source_file", "dataset_id",
                                                    "scrutin", "type_election")
                    ) -> DataFrame:
    """Per ``ok`` report row: expected long rows (wide: kept rows x value
    columns; long family: reported rows) against the report and against the
    rows actually present, matched by exact file text, then by base name.

    ``strict=False`` keeps the lenient rule that a file with no rows at all
    passes; ``strict=True`` makes it a problem.
    """
    counts_exact = (long.groupBy(F.col(source_col).cast("string").alias("__f"))
                    .agg(F.count(F.lit(1)).alias("__exact")))
    # Base names are taken once per source text, not once per row.
    counts_base = (counts_exact.groupBy(X.file_key("__f").alias("__b"))
                   .agg(F.sum("__exact").alias("__base")))
    ok = report.where(F.col("status") == "ok")
    present = [c for c in class_columns if c in ok.columns]
    ok = (ok
          .withColumn("__f", F.col(file_col).cast("string"))
          .withColumn("__b", X.file_key(file_col))
          .withColumn("is_municipal", X.class_flag(present))
          .withColumn("rows_raw", X.safe_int("rows_raw"))
          .withColumn("rows_after_key_filter",
                      X.safe_int(F.coalesce(F.col("rows_after_key_filter").cast("string"),
                                            F.col("rows_raw").cast("string"))))
          .withColumn("candidate_columns", X.safe_int("candidate_columns"))
          .withColumn("reported_clean_long_rows", X.safe_int("rows_clean_long")))
    joined = join_on_keys(ok, counts_exact, ["__f"], how="left")
    joined = join_on_keys(joined, counts_base, ["__b"], how="left")
    actual = F.coalesce(F.col("__exact"), F.col("__base"), F.lit(0)).cast("bigint")
    expected = F.when(F.col("is_municipal"), F.col("reported_clean_long_rows")).otherwise(
        F.col("rows_after_key_filter") * F.col("candidate_columns"))
    out = (joined
           .withColumn("expectation_method", F.when(F.col("is_municipal"),
                                                    "municipal_already_long")
                       .otherwise("wide_rows_x_candidate_columns"))
           .withColumn("expected_long_rows", expected)
           .withColumn("actual_long_rows_in_final_table", actual)
           .withColumn("report_count_ok", F.col("expected_long_rows")
                       == F.col("reported_clean_long_rows")))
    absent_ok = F.lit(not strict)
    out = (out
           .withColumn("actual_count_ok", F.when(F.col("actual_long_rows_in_final_table") == 0,
                                                 absent_ok)
                       .otherwise(F.col("actual_long_rows_in_final_table")
                                  == F.col("reported_clean_long_rows")))
           .withColumn("row_count_ok", F.col("report_count_ok") & F.col("actual_count_ok"))
           .withColumn("status", X.status_ok("row_count_ok")))
    return out.select(F.col(file_col).alias("file"), "is_municipal", "expectation_method",
                      "rows_raw", "rows_after_key_filter", "candidate_columns",
                      "expected_long_rows", "reported_clean_long_rows",
                      "actual_long_rows_in_final_table", "report_count_ok",
                      "actual_count_ok", "row_count_ok", "status")


def available_sets(df: DataFrame, columns: Sequence[str] = ("dataset_id", "scrutin",
                                                            "annee", "tour"),
                   order: Sequence[str] | None = None) -> DataFrame:
    """Distinct coverage tuples, sorted (nulls first, as pandas puts them last
    only on request; the order here is stated explicitly)."""
    cols = [c for c in columns if c in df.columns]
    order = order or (cols[1:] + cols[:1])
    return df.select(*cols).distinct().orderBy(*[F.col(c).asc_nulls_last() for c in order])


def clean_sample(long: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None,
                 n: int = fixed.SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows in a stated key order (the sample is the feature)."""
    cols = [c for c in (columns or long.columns) if c in long.columns]
    return long.select(*cols).orderBy(*order).limit(n)


def summary_rows(one_row: DataFrame, checks: Sequence[tuple[str, object, object]]
                 ) -> DataFrame:
    """Turn a one-row frame of metrics into (check, value, status) rows.

    ``checks`` holds (name, value Column, status Column); values become text
    so numbers, flags and name lists share one column.
    """
    structs = [F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"),
                        status.alias("status")) for name, value, status in checks]
    return (one_row.select(F.inline(F.array(*structs))))


def one_row(*frames: DataFrame) -> DataFrame:
    """Side by side, the columns of several one-row aggregates (no join: the
    rows are stacked with missing columns null and folded with ``max``)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def validation_summary(long: DataFrame, wide_check: DataFrame, report: DataFrame,
                       row_counts: DataFrame, station_checks: DataFrame,
                       long_family_counts: DataFrame, suspicious: DataFrame,
                       core_columns: Sequence[str] = fixed.CORE_LONG_COLUMNS,
                       flag: str = "is_municipal") -> DataFrame:
    """The validation checks as (check, value, status) rows.

    Every input is reduced to one row by an aggregate; the rows are combined
    without a join and unpivoted once.
    """
    missing = " | ".join(sorted(set(core_columns) - set(long.columns)))
    metrics = one_row(
        long.agg(F.count(F.lit(1)).alias("long_rows"),
                 F.count_if(~F.col(flag)).alias("non_municipal_rows")),
        wide_check,
        row_counts.agg(F.count_if(~F.col("row_count_ok")).alias("row_count_problems")),
        station_checks.agg(
            F.count_if(~F.col("expressed_votes_ok")).alias("source_expressed_vote_mismatches"),
            F.count_if(~F.col("vote_share_sum_ok")).alias("source_vote_share_sum_mismatches")),
        long_family_counts,
        suspicious.agg(F.count(F.lit(1)).alias("suspicious_candidate_columns")),
        report.agg(F.count_if(F.col("status") == "skipped").alias("skipped_files"),
                   F.count_if(F.col("status") == "error").alias("error_files")))

    def ok(name):
        return X.status_ok(F.col(name) == 0)

    info = F.lit("INFO")
    checks = [
        ("long_table_exists", F.lit("True"), F.lit("OK")),
        ("wide_table_exists", F.lit("True"), F.lit("OK")),
        ("long_rows", F.col("long_rows"), info),
        ("long_columns", F.lit(len(long.columns)), info),
        ("non_municipal_rows", F.col("non_municipal_rows"), info),
        ("municipal_rows", F.col("municipal_rows"), info),
        ("wide_rows", F.col("wide_rows"), info),
        ("wide_columns", F.col("wide_columns"), info),
        ("wide_candidate_columns", F.col("wide_candidate_columns"), info),
        ("missing_core_long_columns", F.lit(missing), F.lit("OK" if not missing else "PROBLEM")),
        ("row_count_problems", F.col("row_count_problems"), ok("row_count_problems")),
        ("source_expressed_vote_mismatches", F.col("source_expressed_vote_mismatches"),
         X.check_status("source_expressed_vote_mismatches")),
        ("source_vote_share_sum_mismatches", F.col("source_vote_share_sum_mismatches"),
         X.check_status("source_vote_share_sum_mismatches")),
    ]
    for p in ("municipal_missing_candidate", "municipal_missing_votes",
              "municipal_negative_votes", "municipal_missing_booth_id",
              "municipal_vote_share_exprimes_out_of_range",
              "municipal_vote_share_registered_out_of_range",
              "municipal_duplicate_candidate_rows", "municipal_rows_with_any_problem"):
        checks.append((p, F.col(p), ok(p)))
    checks += [
        ("suspicious_candidate_columns", F.col("suspicious_candidate_columns"),
         ok("suspicious_candidate_columns")),
        ("wide_duplicate_index_rows", F.col("wide_duplicate_index_rows"),
         ok("wide_duplicate_index_rows")),
        ("wide_values_below_zero", F.col("wide_values_below_zero"), ok("wide_values_below_zero")),
        ("wide_values_above_one", F.col("wide_values_above_one"), ok("wide_values_above_one")),
        ("skipped_files_in_cleaning_report", F.col("skipped_files"),
         F.when(F.col("skipped_files") == 0, "INFO").otherwise("CHECK")),
        ("error_files_in_cleaning_report", F.col("error_files"), ok("error_files")),
    ]
    return summary_rows(metrics, checks)


def cleaning_report(reports: Sequence[DataFrame]) -> DataFrame:
    """Union of per-family report frames (missing columns null)."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def flag_long_family(long: DataFrame, columns: Sequence[str] = fixed.LONG_FAMILY_FLAG_COLUMNS,
                     out: str = "is_municipal") -> DataFrame:
    present = [c for c in columns if c in long.columns]
    return long.withColumn(out, X.class_flag(present))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the row that is smallest in the stated column order.

    ``min_by`` over a struct is an ordinary aggregate with a map-side
    partial step, so a hot key never lands whole in one task.  Give a total
    order for a deterministic pick among ties.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]),
                            F.struct(*[F.col(f"`{c}`") for c in order])).alias("__row")))
    return picked.select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest])
