"""Spark session helpers.

The library never creates a session behind a caller's back: operators take the
DataFrames they work on.  These helpers are for tests, the bench and the
driver entry point.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every session of ours should carry.  AQE re-plans joins at runtime
# (broadcast only when the measured size is under the threshold, split skewed
# partitions of sort-merge joins, coalesce small shuffle partitions).
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tallyspark", memory: str = "16g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names; set one only if unset.

    ``spark.checkpoint.dir`` points to shared storage and is honoured as is.
    Where it is unset, a folder below the warehouse serves, which executors
    share as well.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
