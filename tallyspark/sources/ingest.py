"""Ingest: file discovery and routing, provenance, schema normalisation,
key filters, and the two cleaners (wide files -> long, long files -> long)
with their per-file report rows.

Schemas drift from file to file, so each distinct schema is read on its own
(``mergeSchema`` fails on type conflicts); only schemas are looked at on the
driver, never rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import fixed
from ..operators import reshape as R
from ..operators import totals as TT
from . import sinks as K


# ------------------------------------------------------------ discovery
def list_sources(spark: SparkSession, root: str, pattern: str = "*.parquet",
                 recursive: bool = True) -> list[str]:
    """Source files under ``root`` (sorted), through the Hadoop file system so
    the same code lists local, HDFS or object-store folders.  A folder below ``root`` whose
    own name fits the pattern is one source, whatever the number of its part files."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    out = set()
    top = fs.makeQualified(path).toString()
    it = fs.listFiles(path, recursive)
    glob = jvm.org.apache.hadoop.fs.GlobPattern(pattern)
    while it.hasNext():
        p = it.next().getPath()
        if glob.matches(p.getName()):
            folder = p.getParent()
            parted = folder.toString() != top and glob.matches(folder.getName())
            out.add((folder if parted else p).toString())
    return sorted(out)


def is_long_shape(columns: Iterable[str], name: str = "",
                  prefix: str = fixed.LONG_FAMILY_PREFIX,
                  shape_columns: Sequence[str] = fixed.LONG_SHAPE_COLUMNS,
                  wide_columns: Sequence[str] = fixed.REQUIRED_WIDE_COLUMNS) -> bool:
    """S3: the columns decide.  Long if they hold every long-shape column, wide
    if they hold (after aliases) every required wide one; only a file with
    neither is told by the long-family prefix of its name."""
    cols = {normalize_name(c) for c in columns}
    if set(shape_columns) <= cols:
        return True
    renamed = cols | {new for old, new in fixed.COLUMN_ALIASES if old in cols}
    return not set(wide_columns) <= renamed and os.path.basename(name).startswith(prefix)


@dataclass(frozen=True)
class Source:
    path: str
    name: str
    shape: str           # "wide" or "long"
    columns: tuple[str, ...]


def route_sources(spark: SparkSession, paths: Sequence[str], **shape_args) -> list[Source]:
    """Read each file's schema (metadata only) and route it by shape."""
    out = []
    for p in paths:
        cols = tuple(spark.read.parquet(p).columns)
        name = p.rstrip("/").rsplit("/", 1)[-1]
        out.append(Source(p, name, "long" if is_long_shape(cols, name, **shape_args)
                          else "wide", cols))
    return out


PROVENANCE = ("source_file", "dataset_id", "raw_row_id")


def read_with_provenance(spark: SparkSession, path: str | Sequence[str],
                         path_column: str | None = None) -> DataFrame:
    """S1 + S4 + S5: scan with ``source_file`` (file name), ``dataset_id`` (name
    without extension) and ``raw_row_id`` (0-based row in the file, from the
    Parquet row index: stable across retries).  ``path`` may list several
    files of one schema; they are read with one scan.  ``path_column`` adds
    the whole path, which tells files of the same name apart.  Columns of the
    file that have one of these names give way.

    A folder called like a Parquet file is one source: its rows are numbered through its
    part files, taken by name."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    if folders := _part_folders(spark, paths):
        return _read_parted(spark, df, folders, path_column)
    taken = {*PROVENANCE, path_column}
    own = [F.col(f"`{c}`") for c in df.columns if normalize_name(c) not in taken]
    whole = [F.col("_metadata.file_path").alias(path_column)] if path_column else []
    return df.select(
        *own, *whole,
        F.col("_metadata.file_name").alias("source_file"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("dataset_id"),
        F.col("_metadata.row_index").alias("raw_row_id"))


def _part_folders(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Those of ``paths`` that are folders of part files, qualified."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = set()
    for p in paths:
        if not p.rstrip("/").endswith(".parquet"):
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            out.add(fs.makeQualified(path).toString())
    return out


def _read_parted(spark: SparkSession, df: DataFrame, folders: set[str],
                 path_column: str | None) -> DataFrame:
    """``read_with_provenance`` where some sources are folders: every part file's rows are
    numbered from the row count of the parts before it (read from the footers)."""
    jvm = spark.sparkContext._jvm
    part = F.col("_metadata.file_path")
    sizes = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows, done = [], {}
    for r in sorted(sizes):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["part"]))
        inside = at.getParent().toString() in folders
        source = r["part"].rsplit("/", 1)[0] if inside else r["part"]
        rows.append((r["part"], source, (at.getParent() if inside else at).getName(),
                     done.get(source, 0)))
        done[source] = done.get(source, 0) + r["n"]
    # One row per part file, known here, so it is broadcast, with what its rows share.
    parts = F.broadcast(spark.createDataFrame(
        rows, "__part string, __source string, __name string, __before long")
        .withColumn("__id", F.regexp_replace("__name", r"\.[^.]*$", "")))
    taken = {*PROVENANCE, path_column}
    own = [f"`{c}`" for c in df.columns if normalize_name(c) not in taken]
    whole = [F.col("__source").alias(path_column)] if path_column else []
    return (df.select(*own, part.alias("__at"), F.col("_metadata.row_index").alias("__row"))
            .join(parts, F.col("__at") == F.col("__part"))
            .select(*own, *whole, F.col("__name").alias("source_file"),
                    F.col("__id").alias("dataset_id"),
                    (F.col("__before") + F.col("__row")).alias("raw_row_id")))


# ------------------------------------------------------------ names
def normalize_name(name: str) -> str:
    """Trimmed, lower-case column name."""
    return str(name).strip().lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def apply_aliases(df: DataFrame, aliases: Sequence[tuple[str, str]] = fixed.COLUMN_ALIASES,
                  drop_shadowed: bool = True) -> DataFrame:
    """Rename old -> new when the old name is present and the new absent;
    the first alias of a target wins.  With ``drop_shadowed`` an old name whose
    target already exists is dropped so it cannot pass for a value column."""
    cols = list(df.columns)
    renames: dict[str, str] = {}
    drops = []
    taken = set(cols)
    for old, new in aliases:
        if old not in cols or old in renames:
            continue
        if new in taken:
            if drop_shadowed and old not in renames:
                drops.append(old)
            continue
        renames[old] = new
        taken.add(new)
    out = df.withColumnsRenamed(renames) if renames else df
    return out.drop(*drops) if drops else out


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """F8: required columns the frame lacks, sorted."""
    return sorted(set(required) - set(df.columns))


# ------------------------------------------------------------ typing
def typed_projection(df: DataFrame, strings: Iterable[str] = (), numbers: Iterable[str] = (),
                     year: str | None = None, date: str | None = None,
                     longs: Iterable[str] = ()) -> DataFrame:
    """Force output types by column name (bad values -> null)."""
    strings, numbers, longs = set(strings), set(numbers), set(longs)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == year:
            c = X.extract_year(c)
        elif f.name == date:
            c = X.parse_date_dayfirst(c) if f.dataType.simpleString() == "string" \
                else F.to_date(c)
        elif f.name in strings:
            c = c.cast("string")
        elif f.name in numbers:
            c = X.to_number(c, R.is_numeric_type(f.dataType))
        elif f.name in longs:
            c = X.to_number(c, R.is_numeric_type(f.dataType)).try_cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


LONG_NUMBERS = ("nb_procu", "nb_inscr", "nb_emarg", "nb_votant", "nb_bl", "nb_nul",
                "nb_bl_nul", "nb_exprim", "votes", "vote_share_exprimes",
                "vote_share_registered")


def long_types(df: DataFrame) -> DataFrame:
    """Output types of the long table."""
    return typed_projection(df, fixed.LONG_STRINGS, LONG_NUMBERS, "annee", "date", ("raw_row_id",))


# ------------------------------------------------------------ filters
def valid_station_rows(df: DataFrame, id_col: str = "id_bvote", total: str = "nb_exprim",
                       tokens: Sequence[str] = fixed.MISSING_TOKENS) -> object:
    """id not missing-like and total numeric."""
    num = R.is_numeric_type(df.schema[total].dataType)
    return ~X.missing_like(id_col, tokens) & X.is_number(total, num)


def valid_long_rows(df: DataFrame, id_col: str = "id_bvote", candidate: str = "candidate",
                    votes: str = "votes", tokens: Sequence[str] = fixed.MISSING_TOKENS):
    """id and candidate not missing-like, votes numeric."""
    num = R.is_numeric_type(df.schema[votes].dataType)
    return (~X.missing_like(id_col, tokens) & ~X.missing_like(candidate, tokens)
            & X.is_number(votes, num))


def drop_invalid_rows(df: DataFrame, predicate, group: Sequence[str]) -> tuple[DataFrame,
                                                                                DataFrame]:
    """Rows that pass, and per group the counts (rows_raw, rows_after_key_filter,
    rows_dropped_missing_keys) from one aggregate."""
    counts = (df.groupBy(*group)
              .agg(F.count(F.lit(1)).alias("rows_raw"),
                   F.count_if(predicate).alias("rows_after_key_filter"))
              .withColumn("rows_dropped_missing_keys",
                          F.col("rows_raw") - F.col("rows_after_key_filter")))
    return df.where(predicate), counts


def staged(df: DataFrame, name: str) -> DataFrame:
    """Rows that several jobs read, written once as Parquet to the shared folder (tightly,
    as several such tables may lie there at once): each reader takes the columns it needs."""
    spark = df.sparkSession
    with K.shuffles_dropped(spark):
        path = K.write_parquet(df, K.scratch_path(spark, name), compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove staged rows that no later step reads."""
    K.remove(df.sparkSession, df.staged_at)


# ------------------------------------------------------------ wide cleaner
def prepare_wide(df: DataFrame, aliases=fixed.COLUMN_ALIASES,
                 corrections=fixed.CATEGORY_CORRECTIONS) -> DataFrame:
    """Names, aliases, category spelling and the combined blank+null column."""
    df = apply_aliases(normalize_columns(df), aliases)
    if "scrutin" in df.columns:
        df = df.withColumn("scrutin", X.canonical_category("scrutin", corrections))
    if "nb_bl_nul" not in df.columns and {"nb_bl", "nb_nul"} <= set(df.columns):
        df = df.withColumn("nb_bl_nul", X.coalesce_sum("nb_bl", "nb_nul"))
    elif "nb_bl_nul" not in df.columns and "nb_bl" in df.columns:
        df = df.withColumn("nb_bl_nul", X.coalesce_sum("nb_bl"))
    return df


def clean_wide(df: DataFrame, group: Sequence[str] = ("dataset_id", "source_file"),
               required: Sequence[str] = fixed.REQUIRED_WIDE_COLUMNS,
               standard: Sequence[str] = fixed.STANDARD_COLUMNS,
               id_col: str = "id_bvote", total: str = "nb_exprim",
               registered: str = "nb_inscr", materialize: bool = False
               ) -> tuple[DataFrame | None, DataFrame]:
    """Wide station rows -> long candidate rows, plus one report row per group.

    Returns (long or None, report).  ``df`` holds the rows of one schema (one
    or several files with the same columns) with the ``group`` columns set.
    ``materialize`` writes the long rows (below ``spark.checkpoint.dir``)
    before they are counted for the report, so they are computed once.
    """
    group = list(group)
    df = prepare_wide(df)
    spark = df.sparkSession
    cols_raw = len([c for c in df.columns if c not in group and c != "raw_row_id"])
    missing = missing_columns(df, required)
    base = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows_raw"))
    if missing:
        report = (base.withColumn("columns_raw", F.lit(cols_raw))
                  .withColumn("status", F.lit("skipped"))
                  .withColumn("reason", F.lit(f"missing required columns: {missing}")))
        return None, report
    kept, counts = drop_invalid_rows(df, valid_station_rows(df, id_col, total), group)
    meta = [c for c in df.columns if c in set(standard) and c not in group]
    detected = (R.detect_value_columns(kept, group, meta, name_column="candidate_source_column")
                .where("is_value_column").select(*group, "candidate_source_column"))
    if materialize:
        detected = detected.checkpoint()          # one row per (file, value column)
    position = F.create_map(*[x for i, c in enumerate(df.columns)
                              for x in (F.lit(c), F.lit(i))])
    names = (detected.groupBy(*group)
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.try_element_at(position, F.col("candidate_source_column")).alias("pos"),
                 F.col("candidate_source_column").alias("name")))).alias("__c"))
             .select(*group, F.size("__c").alias("candidate_columns"),
                     F.array_join(F.transform("__c", lambda s: s["name"]), " | ")
                     .alias("candidate_column_names")))
    long = R.unpivot_detected(kept, group, meta, name_column="candidate_source_column",
                              detected=detected)
    long = long.withColumns({
        "candidate": F.col("candidate_source_column"),
        total: X.to_number(total, R.is_numeric_type(df.schema[total].dataType)),
        registered: X.to_number(registered, R.is_numeric_type(df.schema[registered].dataType))})
    long = TT.vote_shares(long, "votes", total, registered)
    long = R.union_sources([long_types(long.where(F.col("candidate").isNotNull()))])
    if materialize:
        long = staged(long, "clean-wide")
    long_counts = long.groupBy(*group).agg(F.count(F.lit(1)).alias("rows_clean_long"))
    has = F.coalesce("candidate_columns", F.lit(0)) > 0
    report = (base.join(counts.drop("rows_raw"), group, "left")
              .join(names, group, "left").join(long_counts, group, "left")
              .withColumns({
                  "columns_raw": F.lit(cols_raw),
                  "candidate_columns": F.coalesce("candidate_columns", F.lit(0)),
                  "rows_clean_long": F.coalesce("rows_clean_long", F.lit(0)),
                  "status": F.when(has, "ok").otherwise("skipped"),
                  "reason": F.when(has, "").otherwise("no candidate columns detected")}))
    return long, report


# ------------------------------------------------------------ long cleaner
def clean_long(df: DataFrame, group: Sequence[str] = ("dataset_id", "source_file"),
               required: Sequence[str] = fixed.REQUIRED_LONG_COLUMNS,
               key_pattern: str = fixed.STATION_KEY_PATTERN, materialize: bool = False
               ) -> tuple[DataFrame | None, DataFrame]:
    """Already-long rows -> long table: station key parsed, invalid rows
    dropped, expressed total rebuilt as the station's vote sum, registered
    total as the rounded median of votes / registered share, shares with the
    source value kept when finite.  ``materialize`` as in ``clean_wide``; the parsed and
    checked rows, which the counts and the totals' medians read again, are written too."""
    group = list(group)
    df = normalize_columns(df)
    cols_raw = len([c for c in df.columns if c not in group and c != "raw_row_id"])
    missing = missing_columns(df, required)
    if missing:
        base = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows_raw"))
        return None, (base.withColumn("columns_raw", F.lit(cols_raw))
                      .withColumn("status", F.lit("skipped"))
                      .withColumn("reason",
                                  F.lit(f"missing municipal required columns: {missing}")))
    key = X.parse_structured_key("source_bv_id", key_pattern)
    df = df.withColumns({"id_bvote": key["key"], "num_arrond": key["area"],
                         "num_bureau": key["unit"]})
    # Equal to other columns: set again at the end, not staged and shuffled twice.
    copies = {"source_bv_id": F.col("id_bvote"), "candidate_source_column": F.col("candidate")}
    df = df.drop(*copies).withColumn("__valid", valid_long_rows(df))
    checked = df = staged(df, "checked-long") if materialize else df
    kept, counts = drop_invalid_rows(df, F.col("__valid"), group)
    if materialize:
        counts = counts.checkpoint()              # one row per file
    kept = kept.drop("__valid")
    numeric = {c: R.is_numeric_type(df.schema[c].dataType) for c in
               ("votes", "vote_share_exprimes", "vote_share_registered") if c in df.columns}
    kept = kept.withColumns({c: X.to_number(c, n) for c, n in numeric.items()})
    keys = [g for g in group if g in ("dataset_id", "source_path")] + ["id_bvote"]
    out = TT.rebuild_station_totals(kept, keys)
    # Totals the long family does not carry, and the shares: the source share
    # when finite, else votes over the rebuilt total.
    added = copies | {c: F.lit(None).cast("double") for c in
             ("nb_votant", "nb_emarg", "nb_procu", "nb_bl", "nb_nul", "nb_bl_nul")}
    added.update({c: F.lit(None).cast("string") for c in ("num_circ", "num_quartier")})
    added["date"] = F.lit(None).cast("date")
    for share, total in (("vote_share_exprimes", "nb_exprim"),
                         ("vote_share_registered", "nb_inscr")):
        computed = X.share("votes", total)
        added[share] = (F.coalesce(X.finite_or_null(share), computed)
                        if share in out.columns else computed)
    out = R.union_sources([long_types(out.withColumns(added))])
    if materialize:
        out = staged(out, "clean-long")
        unstage(checked)
    long_counts = out.groupBy(*group).agg(F.count(F.lit(1)).alias("rows_clean_long"))
    has = F.coalesce("rows_clean_long", F.lit(0)) > 0
    report = (counts.join(long_counts, group, "left")
              .withColumns({
                  "columns_raw": F.lit(cols_raw),
                  "rows_clean_long": F.coalesce("rows_clean_long", F.lit(0)),
                  "candidate_columns": F.lit(1),
                  "candidate_column_names": F.lit("candidate"),
                  "status": F.when(has, "ok").otherwise("skipped"),
                  "reason": F.when(has, "").otherwise("no valid municipal rows after key filter")}))
    return out, report


REPORT_COLUMNS = ("file", "rows_raw", "columns_raw", "status", "reason",
                  "rows_after_key_filter", "rows_dropped_missing_keys", "rows_clean_long",
                  "candidate_columns", "candidate_column_names")


def report_frame(report: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Report rows in the published column order."""
    r = report.withColumnRenamed(file_col, "file") if file_col in report.columns else report
    for c in REPORT_COLUMNS:
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None))
    return r.select(*REPORT_COLUMNS)


def clean_folder(spark: SparkSession, root: str, materialize: bool = False
                 ) -> tuple[DataFrame | None, DataFrame]:
    """Every source under ``root``: route by shape, clean, union.

    Files are grouped by (shape, schema) from their footers, and each group is
    read with one scan and cleaned with one plan (its rows keep their file in
    ``source_path`` / ``source_file`` / ``dataset_id``; the path is the
    identity), so a folder of thousands of files with a handful of schemas
    gives a handful of plans, not thousands.  A file whose schema cannot be
    read, or that its cleaner refuses, becomes an ``error`` report row with
    the whole message.  A folder without source files raises
    ``FileNotFoundError``.
    """
    paths_found = list_sources(spark, root)
    if not paths_found:
        raise FileNotFoundError(f"no source files under {root}")
    longs, reports = [], []
    groups: dict[tuple, list[str]] = {}

    def failed(paths: Sequence[str], exc: Exception) -> None:
        reports.append(spark.createDataFrame(
            [(p.rstrip("/").rsplit("/", 1)[-1], "error", f"{type(exc).__name__}: {exc}")
             for p in paths], "source_file string, status string, reason string"))

    for path in paths_found:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        try:
            schema = spark.read.parquet(path).schema
        except Exception as exc:  # noqa: BLE001 - reported per file
            failed([path], exc)
            continue
        shape = "long" if is_long_shape(schema.fieldNames(), name) else "wide"
        groups.setdefault((shape, schema.json()), []).append(path)
    identity = ("dataset_id", "source_file", "source_path")
    for (shape, _), paths in groups.items():
        try:
            raw = read_with_provenance(spark, paths, "source_path")
            cleaned, rep = (clean_long if shape == "long" else clean_wide)(
                raw, group=identity, materialize=materialize)
        except Exception as exc:  # noqa: BLE001 - reported per file
            failed(paths, exc)
            continue
        reports.append(report_frame(rep))
        if cleaned is not None:
            longs.append(cleaned)
    report = None
    for r in reports:
        r = report_frame(r) if "file" not in r.columns else r
        report = r if report is None else report.unionByName(r, allowMissingColumns=True)
    return (R.union_sources(longs) if longs else None), report
