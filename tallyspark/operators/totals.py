"""Totals: group sums on every row, exact medians, rebuilt station totals and
shares with a source / computed fallback.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ._join import join_on_keys
from .reshape import is_numeric_type


def group_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Attach ``sum(value)`` of the row's group to every row (null keys group).

    Written as aggregate + join rather than a window: the aggregate combines
    on the map side and the join is many-to-one, which AQE splits when one
    group is hot.  A window would put a hot group in a single task.
    """
    totals = df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(out))
    return join_on_keys(df.drop(out) if out in df.columns else df, totals, keys, how="left")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median",
                 accuracy: int = 10000) -> DataFrame:
    """Exact, interpolated median of ``value`` per group; nulls ignored; groups
    without values are absent.

    No group is sorted whole, however large:

    1. equal values are counted (map-side combine): one row per distinct value;
    2. ``percentile_approx`` (a mergeable sketch of bounded size, partial
       aggregation) brackets the middle of each group within a rank error of
       about ``2n/accuracy``;
    3. one grouped pass counts the values below the bracket and up to its top,
       which proves whether the bracket holds the two middle ranks; a group
       whose bracket does not is given its whole range, so the result stays
       exact;
    4. a running count over the distinct values inside the bracket (about
       ``4n/accuracy`` of them) locates the middle one or two.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    counts = v.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    eps = 2.0 / accuracy
    sketch = (v.groupBy(*keys)
              .agg(F.percentile_approx("__v", [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)],
                                       accuracy).alias("__q"))
              .select(*keys, F.col("__q")[0].alias("__qlo"), F.col("__q")[1].alias("__qhi")))
    placed = join_on_keys(counts, sketch, keys, how="inner")
    n = F.col("__n")
    lo_rank, hi_rank = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    bounds = (placed.groupBy(*keys)
              .agg(F.sum("__c").alias("__n"), F.first("__qlo").alias("__qlo"),
                   F.first("__qhi").alias("__qhi"),
                   F.coalesce(F.sum(F.when(F.col("__v") < F.col("__qlo"), F.col("__c"))),
                              F.lit(0)).alias("__below"),
                   F.coalesce(F.sum(F.when(F.col("__v") <= F.col("__qhi"), F.col("__c"))),
                              F.lit(0)).alias("__upto")))
    holds = (F.col("__below") <= lo_rank) & (hi_rank < F.col("__upto"))
    bounds = bounds.select(*keys, "__n",
                           F.when(holds, F.col("__qlo")).alias("__lo"),
                           F.when(holds, F.col("__qhi")).alias("__hi"),
                           F.when(holds, F.col("__below")).otherwise(F.lit(0)).alias("__base"))
    inside = F.col("__lo").isNull() | ((F.col("__v") >= F.col("__lo"))
                                       & (F.col("__v") <= F.col("__hi")))
    cand = join_on_keys(counts, bounds, keys, how="inner").where(inside)
    ordered = (Window.partitionBy(*keys).orderBy("__v")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = cand.withColumn("__end", F.col("__base") + F.sum("__c").over(ordered))
    start = F.col("__end") - F.col("__c")
    covers_lo = (start <= lo_rank) & (lo_rank < F.col("__end"))
    covers_hi = (start <= hi_rank) & (hi_rank < F.col("__end"))
    return (ranked.groupBy(*keys)
            .agg(((F.max(F.when(covers_lo, F.col("__v"))) +
                   F.max(F.when(covers_hi, F.col("__v")))) / 2.0).alias(out)))


def vote_shares(df: DataFrame, votes: str = "votes", expressed: str = "nb_exprim",
                registered: str = "nb_inscr", share_expressed: str = "vote_share_exprimes",
                share_registered: str = "vote_share_registered") -> DataFrame:
    """votes / expressed and votes / registered, null when not finite; null votes -> 0."""
    v = F.coalesce(X.to_number(votes, True), F.lit(0.0))
    return df.withColumns({votes: v, share_expressed: X.share(v, expressed),
                           share_registered: X.share(v, registered)})


def share_fallback(df: DataFrame, source: str, votes: str, total: str,
                   out: str | None = None) -> DataFrame:
    """Keep the source share when finite, else votes / total."""
    return df.withColumn(out or source,
                         F.coalesce(X.finite_or_null(source), X.share(votes, total)))


def reconstruct_expressed(df: DataFrame, keys: Sequence[str], votes: str = "votes",
                          out: str = "nb_exprim") -> DataFrame:
    """Expressed total of a station = sum of its candidates' votes, on every row."""
    df = df.withColumn(votes, X.to_number(votes, True))
    return group_total(df, keys, votes, out)


def reconstruct_registered(df: DataFrame, keys: Sequence[str], votes: str = "votes",
                           share: str = "vote_share_registered", out: str = "nb_inscr"
                           ) -> DataFrame:
    """Registered total per station = median of votes / share over rows with a
    positive share, rounded half to even; attached to every row."""
    s = X.to_number(share, True)
    est = df.select(*keys, F.when(s.isNotNull() & (s > 0),
                                  F.try_divide(X.to_number(votes, True), s)).alias("__est"))
    med = exact_median(est, keys, "__est", "__m").select(
        *keys, F.bround("__m", 0).alias(out))
    return join_on_keys(df.drop(out) if out in df.columns else df, med, keys, how="left")


def rebuild_station_totals(df: DataFrame, keys: Sequence[str], votes: str = "votes",
                           share: str = "vote_share_registered", expressed: str = "nb_exprim",
                           registered: str = "nb_inscr") -> DataFrame:
    """Both rebuilt totals of a long-family station on every row: expressed =
    sum of votes, registered = half-even rounded median of votes / registered
    share over rows with a positive share (null without a share column).

    The two station-level results are joined to each other first (one row
    per station), then to the rows once.
    """
    v = X.to_number(votes, True)
    station = df.groupBy(*keys).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias(expressed))
    if share in df.columns:
        s = X.to_number(share, True)
        est = df.select(*keys, F.when(s.isNotNull() & (s > 0), F.try_divide(v, s))
                        .alias("__est"))
        med = exact_median(est, keys, "__est", "__m").select(
            *keys, F.bround("__m", 0).alias(registered))
        station = join_on_keys(station, med, keys, how="left")
    else:
        station = station.withColumn(registered, F.lit(None).cast("double"))
    rows = df.drop(*[c for c in (expressed, registered) if c in df.columns])
    return join_on_keys(rows.withColumn(votes, v), station, keys, how="left")


def backcalc_totals(df: DataFrame, keys: Sequence[str], count: str,
                    percents: dict[str, str]) -> DataFrame:
    """Per group and per output name, the median of ``count / (pct/100)`` over
    rows with pct > 0, rounded half to even, as a nullable long.

    ``percents`` maps output column -> percentage column.  Rows with a null key
    are left out of the groups.  All estimates are stacked into one column so
    the medians of every output come from one sort.
    """
    names = list(percents)
    valid = df
    for k in keys:
        valid = valid.where(F.col(k).isNotNull())
    def numeric(c):
        return is_numeric_type(df.schema[c].dataType)
    stacked = valid.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("__name"),
                 X.backcalc_total(count, percents[n], numeric(count) and numeric(percents[n]))
                 .alias("__est")) for n in names
    ])).alias("__s")).select(*keys, "__s.__name", "__s.__est")
    med = exact_median(stacked, list(keys) + ["__name"], "__est", "__m")
    groups = valid.select(*keys).distinct()
    wide = med.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__name") == n, F.bround("__m", 0))).cast("bigint").alias(n)
        for n in names])
    return join_on_keys(groups, wide, keys, how="left", null_safe=False)
