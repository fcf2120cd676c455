"""Shared staging folders.

Intermediate tables that several jobs read are written as Parquet below the
folder the cluster names in ``spark.checkpoint.dir`` (else the warehouse, which
executors share too) and read back, so a lost executor costs a re-read and
never a recomputation of the whole lineage.  Folders of a finished process are
removed at its end.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where it lies.

    On a cluster it is installed or sent with ``--py-files``; a path that does
    not exist there is ignored.
    """
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", home)
    return spark


def shared_root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    root = (conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir()
            or spark.conf.get("spark.sql.warehouse.dir"))
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not created yet) in the shared folder."""
    path = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back (schema kept)."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that no later step reads: what came of them is staged itself."""
    for df in frames:
        remove(df.sparkSession, df.staged_at)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: its shared folder outlives it
            return
