"""Reshape: unpivot wide -> long, detect value columns, pivot long -> wide,
select active features, union sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import fixed
from ._join import join_on_keys

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def unpivot_numbers(df: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str],
                    name_column: str = "candidate_source_column",
                    value_column: str = "votes") -> DataFrame:
    """Wide -> long: one row per input row and value column, values as numbers or null.

    Numbers and texts travel in lanes of their own, as an unpivot wants one type: numeric
    columns are widened to double and never printed, texts are parsed after the unpivot,
    by one expression however many columns there are.
    """
    value_columns = list(value_columns)
    typed = {c: is_numeric_type(df.schema[c].dataType) for c in value_columns}
    ids = [F.col(f"`{c}`") for c in id_columns]
    if all(typed.values()):
        values = [F.col(f"`{c}`").cast("double").alias(c) for c in value_columns]
        long = df.select(*ids, *values).unpivot(ids, [F.col(f"`{c}`") for c in value_columns],
                                                name_column, value_column)
        return long.withColumn(value_column, X.to_number(f"`{value_column}`", True))
    none = F.lit(None)
    lanes = [F.struct(
        (F.col(f"`{c}`") if numeric else none).cast("double").alias("number"),
        (none if numeric else F.col(f"`{c}`")).cast("string").alias("text")).alias(c)
        for c, numeric in typed.items()]
    long = df.select(*ids, *lanes).unpivot(ids, [F.col(f"`{c}`") for c in value_columns],
                                           name_column, value_column)
    return long.withColumn(value_column, F.coalesce(
        X.to_number(f"`{value_column}`.number", True), X.to_number(f"`{value_column}`.text")))


def unpivot_votes(df: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str],
                  name_column: str = "candidate_source_column",
                  value_column: str = "votes") -> DataFrame:
    """Unpivot and coerce the values to numbers; a missing or bad value -> 0."""
    long = unpivot_numbers(df, id_columns, value_columns, name_column, value_column)
    return long.withColumn(value_column, F.coalesce(F.col(f"`{value_column}`"), F.lit(0.0)))


def candidate_value_columns(df: DataFrame, metadata_columns: Sequence[str],
                            excluded: Sequence[str] = fixed.NON_VALUE_COLUMNS) -> list[str]:
    """Columns that may hold values: not metadata, not excluded by name, and of a
    text or numeric source type (dates and booleans never qualify)."""
    meta, excl = set(metadata_columns), set(excluded)
    out = []
    for f in df.schema.fields:
        if f.name in meta or f.name in excl:
            continue
        if is_numeric_type(f.dataType) or isinstance(f.dataType, T.StringType):
            out.append(f.name)
    return out


def detect_value_columns(df: DataFrame, group_columns: Sequence[str],
                         metadata_columns: Sequence[str],
                         min_ratio: float = fixed.VALUE_COLUMN_MIN_NUMERIC_RATIO,
                         excluded: Sequence[str] = fixed.NON_VALUE_COLUMNS,
                         name_column: str = "column") -> DataFrame:
    """Per group (e.g. source file) and column: the share of rows holding a
    number, and whether it reaches ``min_ratio``.

    One pass and one row per group: every column's numbers are counted as they are read
    (partial sums on the map side, so a large file is not a large task), and only the
    ratios are turned into rows.
    """
    cols = candidate_value_columns(df, list(group_columns) + list(metadata_columns), excluded)
    if not cols:
        schema = ", ".join([f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group_columns]
                           + [f"{name_column} string", "numeric_ratio double",
                              "is_value_column boolean"])
        return df.sparkSession.createDataFrame([], schema)
    ratio = [F.avg(X.is_number(f"`{c}`", is_numeric_type(df.schema[c].dataType)).cast("double"))
             for c in cols]
    counted = df.groupBy(*group_columns).agg(F.array(*[
        F.struct(F.lit(c).alias("name"), r.alias("ratio")) for c, r in zip(cols, ratio)])
        .alias("__columns"))
    found = counted.select(*group_columns, F.explode("__columns").alias("__c")).select(
        *group_columns, F.col("__c.name").alias(name_column),
        F.col("__c.ratio").alias("numeric_ratio")).where(F.col("numeric_ratio").isNotNull())
    return found.withColumn("is_value_column", F.col("numeric_ratio") >= F.lit(min_ratio))


def unpivot_detected(df: DataFrame, group_columns: Sequence[str],
                     metadata_columns: Sequence[str],
                     min_ratio: float = fixed.VALUE_COLUMN_MIN_NUMERIC_RATIO,
                     excluded: Sequence[str] = fixed.NON_VALUE_COLUMNS,
                     name_column: str = "candidate_source_column",
                     value_column: str = "votes", detected: DataFrame | None = None
                     ) -> DataFrame:
    """Unpivot only the columns that pass the numeric-ratio rule in their group.

    ``detected`` (group columns + column name of the value columns) may be
    passed when the caller has it already, so the rule is not computed twice.
    """
    id_cols = list(dict.fromkeys(list(group_columns) + [c for c in metadata_columns
                                                         if c in df.columns]))
    if detected is None:
        detected = (detect_value_columns(df, group_columns, metadata_columns, min_ratio,
                                         excluded, name_column)
                    .where("is_value_column").select(*group_columns, name_column))
    cols = candidate_value_columns(df, id_cols, excluded)
    long = unpivot_votes(df, id_cols, cols, name_column, value_column)
    return join_on_keys(long, detected, list(group_columns) + [name_column], how="left_semi")


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Sorted distinct values of a column (a pivot's column list).

    The list must fit a pivot anyway, so it is bounded by
    ``spark.sql.pivotMaxValues`` and checked before it is used.
    """
    spark = df.sparkSession
    cap = limit or int(spark.conf.get("spark.sql.pivotMaxValues", "10000"))
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull())
              .distinct().orderBy(column).limit(cap + 1).collect()]
    if len(values) > cap:
        raise ValueError(f"pivot on {column!r} exceeds {cap} distinct values; "
                         "keep the long form (or a map column) instead")
    return values


def pivot_sum(df: DataFrame, index: Sequence[str], pivot_column: str, value_column: str,
              values: Sequence | None = None, fill: float | None = 0.0) -> DataFrame:
    """Group by the index (null keys form their own group), sum per pivot
    value, one column per value; absent combinations -> ``fill``.

    The pivot sums to (index, pivot value) first, with a map-side combine, so its
    second step works on at most one row per cell, whatever the skew of the input.
    """
    if values is None:
        values = distinct_values(df, pivot_column)
    wide = (df.groupBy(*index).pivot(pivot_column, list(values))
            .agg(F.coalesce(F.sum(F.col(value_column)), F.lit(0.0))))
    if fill is None:
        return wide
    # Fill by position: names from data may differ only by case ("Dupont",
    # "DUPONT"), which a by-name reference would find ambiguous.
    names = wide.columns
    tmp = wide.toDF(*[f"__c{i}" for i in range(len(names))])
    k = len(index)
    tmp = tmp.select(*[F.col(f"__c{i}") for i in range(k)],
                     *[F.coalesce(F.col(f"__c{i}"), F.lit(fill)).alias(f"__c{i}")
                       for i in range(k, len(names))])
    return tmp.toDF(*names)


def pivot_shares(long: DataFrame, index: Sequence[str] = fixed.WIDE_INDEX_COLUMNS,
                 candidate: str = "candidate", share: str = "vote_share_exprimes",
                 values: Sequence | None = None) -> DataFrame:
    """Long shares -> wide: one row per station index, one share column per candidate."""
    index = [c for c in index if c in long.columns]
    src = long.where(F.col(candidate).isNotNull()).withColumn(
        share, X.finite_or_null(share))
    return pivot_sum(src, index, candidate, share, values)


def active_features(long: DataFrame, group: Sequence[str], feature: str, value: str,
                    min_total: float = fixed.MIN_TOTAL_SHARE) -> DataFrame:
    """Features whose total over the group reaches ``min_total`` (null -> 0)."""
    return (long.groupBy(*group, feature)
            .agg(F.coalesce(F.sum(X.finite_or_null(value)), F.lit(0.0)).alias("total"))
            .where(F.col("total") >= F.lit(min_total)))


def union_sources(frames: Sequence[DataFrame],
                  order: Sequence[str] = fixed.LONG_COLUMN_ORDER) -> DataFrame:
    """Union by name, missing columns null; known columns first, extras after."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    known = [c for c in order if c in out.columns]
    extra = [c for c in out.columns if c not in known]
    return out.select(*[F.col(f"`{c}`") for c in known + extra])
