"""Sinks: Parquet / CSV writes, whole-table exports and per-key exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never a
    machine-local temporary folder: every executor must see it)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark removes a query's shuffle files at its end, not when the driver collects garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write inside leaves no shuffle files behind: what it wrote is read instead."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", **options) -> str:
    """S7."""
    df.write.mode(mode).options(**options).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header line, no index; one file per task (the folder is the table)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with header and an explicit schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def export_tables(tables: Mapping[str, DataFrame | None], root: str) -> dict[str, str]:
    """Write each named table as CSV under ``root``; absent ones skipped."""
    done = {}
    for name, df in tables.items():
        if df is None:
            continue
        done[name] = write_csv(df, f"{root.rstrip('/')}/{name}")
    return done


def export_by_key(df: DataFrame, key: str, path: str, fmt: str = "csv",
                  key_column: str = "dataset_key") -> str:
    """S10 + S11 + S12: one folder per key value, named by the file-safe form
    of the key.  The key column itself stays in the files; rows with a null
    key go to ``unknown``.

    Rows are rebalanced by key: AQE splits a key's rows over as many tasks as
    their measured size asks for, and joins small keys.
    """
    out = df.withColumn(key_column, X.safe_name(key))
    writer = (out.hint("rebalance", key_column).write.mode("overwrite")
              .partitionBy(key_column))
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_named_files(df: DataFrame, name: str, order: Sequence[str], root: str,
                      finish: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """One Parquet source per value of the text column ``name``, called by that value: a
    folder of part files that hold its rows in the given order, part after part by name.
    One job writes all of them; rows are dealt out by ranges of (name, order), so a part
    is one task's work and a large source is many tasks'.  The folders then get their names
    by renames, which move no data.  Rows without a name are left out.  ``finish`` makes the
    columns of the files from those of ``df`` row by row, once the rows are dealt out."""
    spark = df.sparkSession
    staged = f"{root.rstrip('/')}/_named_{uuid.uuid4().hex}"
    dealt = (df.withColumn("__file", F.col(name)).drop(name).where(F.col("__file").isNotNull())
             .repartitionByRange("__file", *order).sortWithinPartitions("__file", *order))
    with shuffles_dropped(spark):
        (finish(dealt) if finish else dealt).write.partitionBy("__file").parquet(staged)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(staged)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/__file=*")):
        folder = status.getPath().getName()
        target = f"{root.rstrip('/')}/{unquote(folder.split('=', 1)[1])}"
        if not fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"cannot name {target}")
        out.append(target)
    fs.delete(at, True)
    return sorted(out)
