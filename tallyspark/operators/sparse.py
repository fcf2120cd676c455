"""Wide form without a pivot: sparse station rows and a dictionary of names.

A pivot needs a column per name and stops at ``spark.sql.pivotMaxValues``.  Here a
station's row holds the positions and values of the names it has; the dictionary maps
positions to names.  Both are ordinary tables, whatever the number of names, and names
that differ only in case or hold dots need no care.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import fixed
from ..session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row in it below


def numbered(df: DataFrame, column: str, out: str = "position") -> DataFrame:
    """Distinct non-null values of ``column``, numbered from 0 in their order.

    No window over all values: they are range-partitioned and sorted, numbered within
    their partition, and shifted by the sizes of the partitions before (one row per
    partition).
    """
    ensure_checkpoint_dir(df.sparkSession)
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = values.repartitionByRange(column).sortWithinPartitions(column)
    placed = ranged.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__id", _ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (placed.withColumn("__part", part).join(starts, "__part")
            .select(column, (F.col("__start") + F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1))
                    .alias(out)))


@dataclass(frozen=True)
class SparseWide:
    """``rows``: index columns, ``positions`` array<long> (ascending), ``values``
    array<double>; ``names``: (name, position).  An absent cell is 0."""

    rows: DataFrame
    names: DataFrame
    index: tuple[str, ...]
    name: str

    def cells(self) -> DataFrame:
        """One row per present cell, with its name."""
        cell = F.explode(F.arrays_zip("positions", "values")).alias("__cell")
        return (self.rows.select(*self.index, cell)
                .select(*self.index, F.col("__cell.positions").alias("position"),
                        F.col("__cell.values").alias("value"))
                .join(self.names, "position"))

    def columns(self, names: Sequence[str]) -> DataFrame:
        """The rows with a dense column for each of ``names`` (absent: 0; a name that is
        not in the dictionary gives a column of zeros)."""
        wanted = {r[self.name]: r["position"] for r in
                  self.names.where(F.col(self.name).isin(*names)).collect()} if names else {}
        held = F.map_from_arrays("positions", "values")
        rows = self.rows.withColumn("__held", held)
        return rows.select(*self.index, *[
            F.coalesce(F.try_element_at("__held", F.lit(wanted[n])), F.lit(0.0)).alias(n)
            if n in wanted else F.lit(0.0).alias(n) for n in names])

    def write(self, path: str) -> str:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.names.write.mode("overwrite").parquet(f"{path}/names")
        return path


def read_sparse(spark, path: str) -> SparseWide:
    rows, names = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/names")
    index = tuple(c for c in rows.columns if c not in ("positions", "values"))
    return SparseWide(rows, names, index, next(c for c in names.columns if c != "position"))


def sparse_wide(long: DataFrame, index: Sequence[str] = fixed.WIDE_INDEX_COLUMNS,
                name: str = "candidate", value: str = "vote_share_exprimes") -> SparseWide:
    """Sums per (index, name), as one sparse row per index tuple.

    Null index values form groups; null names have no cell (their station still has a
    row); null values count as 0.  A row holds as many cells as its station has names.
    """
    index = list(index)
    names = numbered(long, name)
    cells = long.groupBy(*index, name).agg(
        F.coalesce(F.sum(X.finite_or_null(value)), F.lit(0.0)).alias("__v"))
    placed = cells.join(names, name, "left")
    rows = placed.groupBy(*index).agg(F.array_sort(F.collect_list(F.when(
        F.col("position").isNotNull(), F.struct("position", "__v")))).alias("__cells"))
    return SparseWide(rows.select(*index, F.col("__cells.position").alias("positions"),
                                  F.col("__cells.__v").alias("values")), names, tuple(index), name)


def sparse_range_check(wide: SparseWide, eps: float = fixed.SHARE_RANGE_EPS) -> DataFrame:
    """A10 on the sparse form, one row: rows, columns (index and names), extra copies of
    an index tuple, cells below 0 and above 1.  The copies are counted, not assumed."""
    low = F.size(F.filter("values", lambda v: v < -eps))
    high = F.size(F.filter("values", lambda v: v > 1 + eps))
    per_index = wide.rows.groupBy(*wide.index).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(low).alias("__low"), F.sum(high).alias("__high"))
    found = per_index.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("wide_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("wide_duplicate_index_rows"),
        F.coalesce(F.sum("__low"), F.lit(0)).alias("wide_cells_below_zero"),
        F.coalesce(F.sum("__high"), F.lit(0)).alias("wide_cells_above_one"))
    columns = wide.names.agg((F.count(F.lit(1)) + len(wide.index)).alias("wide_columns"))
    both = found.unionByName(columns, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
