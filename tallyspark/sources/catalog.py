"""The grid of expected dataset ids and its coverage by present data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: dataset kinds and rounds of the source catalogue.
KINDS_WITH_ROUNDS = ("legislatives", "presidentielles", "regionales", "municipales")
KINDS_WITHOUT_ROUNDS = ("europeennes",)
ROUNDS = ("1ertour", "2emetour")
ID_PREFIX = "elections"


def id_grid(spark: SparkSession, kinds_with_rounds: Sequence[str] = KINDS_WITH_ROUNDS,
            kinds_without_rounds: Sequence[str] = KINDS_WITHOUT_ROUNDS,
            years: tuple[int, int] = (2000, 2025), rounds: Sequence[str] = ROUNDS,
            prefix: str = ID_PREFIX, sep: str = "-") -> DataFrame:
    """Every expected id: kind × year × round (kinds without rounds: kind × year).

    Built with generators (``range`` + ``explode``), not joins.
    """
    y = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
    with_r = (y.select("year", F.explode(F.array(*[F.lit(k) for k in kinds_with_rounds]))
                       .alias("kind"))
              .select("kind", "year", F.explode(F.array(*[F.lit(r) for r in rounds]))
                      .alias("round")))
    without = (y.select("year", F.explode(F.array(*[F.lit(k) for k in kinds_without_rounds]))
                        .alias("kind"))
               .select("kind", "year", F.lit(None).cast("string").alias("round")))
    grid = with_r.unionByName(without) if kinds_without_rounds else with_r
    parts = [F.lit(prefix)] if prefix else []
    return grid.withColumn("dataset_id", F.concat_ws(sep, *parts, "kind",
                                                     F.col("year").cast("string"), "round"))


def coverage(grid: DataFrame, present: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Grid rows with a ``present`` flag (left join against the distinct
    present ids, which are at most as many as the grid)."""
    ids = present.select(key).distinct().withColumn("present", F.lit(True))
    return (grid.join(ids, [key], "left")
            .withColumn("present", F.coalesce(F.col("present"), F.lit(False))))


def gaps(grid: DataFrame, present: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Expected ids with no data (left anti join)."""
    return grid.join(present.select(key).distinct(), [key], "left_anti")
