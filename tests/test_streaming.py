"""Incremental ingest equals the batch cleaner on the same files."""

import os
import tempfile

import pandas as pd

from tallyspark.sources import ingest as I
from tallyspark.sources import sinks as K
from tallyspark.streaming import incremental_clean_long


def test_incremental_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="tallyspark-stream-src-")
    for i in range(2):
        pd.DataFrame({
            "source_bv_id": [f"75056_01{i}1", f"75056_01{i}1", f"75056_01{i}2"],
            "scrutin": ["Municipales"] * 3, "annee": [2020] * 3, "tour": [1] * 3,
            "candidate": ["A", "B", "A"], "votes": [10.0, 30.0, 5.0],
            "vote_share_exprimes": [None, 0.75, 1.0],
            "vote_share_registered": [0.1, 0.3, 0.05],
        }).to_parquet(os.path.join(src, f"elections-municipales-2020-{i}.parquet"))
    schema = spark.read.parquet(src).schema
    target = K.scratch_path(spark, "stream-long")
    q = incremental_clean_long(spark, src, schema, target, K.scratch_path(spark, "stream-ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(target)
    batch, _ = I.clean_long(I.read_with_provenance(spark, src))
    cols = ["dataset_id", "id_bvote", "candidate", "votes", "nb_exprim", "nb_inscr",
            "vote_share_exprimes", "vote_share_registered"]
    assert sorted(got.select(cols).collect()) == sorted(batch.select(cols).collect())
    assert got.count() == 6
