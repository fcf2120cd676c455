"""Incremental ingest: newly arriving long-family files are cleaned as they
land, with the same batch operators, and added to the long table as one
folder per micro-batch (a batch that runs again after a failure replaces its
own folder).

The source has no streaming operators; this is only the file-arrival form
of the batch cleaner.  Each micro-batch holds whole files, and every
rebuilt total is per (dataset, station) inside one file, so cleaning a
batch of files gives the rows the batch cleaner gives for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import ingest as I


def incremental_clean_long(spark: SparkSession, source_dir: str, schema: T.StructType,
                           target: str, checkpoint: str, report_target: str | None = None,
                           available_now: bool = True) -> StreamingQuery:
    """Start a file stream over ``source_dir`` (Parquet, fixed ``schema``).

    ``checkpoint`` must be a shared folder: it records which files were done,
    so a restarted query (or one whose executors were lost) resumes without
    cleaning a file twice.  ``available_now`` processes what is there and
    stops; otherwise the query keeps watching the folder.
    """
    stream = (spark.readStream.schema(schema).parquet(source_dir)
              .select("*", F.col("_metadata.file_name").alias("source_file"),
                      F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
                      .alias("dataset_id"),
                      F.col("_metadata.row_index").alias("raw_row_id")))

    def clean_batch(batch: DataFrame, batch_id: int) -> None:
        long, report = I.clean_long(batch)
        if long is not None:
            long.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if report_target:
            (I.report_frame(report).write.mode("overwrite")
             .parquet(f"{report_target}/batch={batch_id}"))

    writer = stream.writeStream.foreachBatch(clean_batch).option("checkpointLocation",
                                                                 checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="30 seconds")
    return writer.start()
