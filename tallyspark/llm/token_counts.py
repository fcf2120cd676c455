"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer version, n_tokens) that
outlives a run.  A call joins the digests of its texts to it, encodes one text
of each digest that is missing, appends those counts and reads every count from
the cache.  The digest is taken of the text as it is: normalisation is the identity,
since byte_bpe_50k.json has no normalizer and any change of a text could change its
count; texts that differ only in form share no row.

Contract: a null text counts as empty (0 tokens, 0 bytes); repeated rows and
copies share one cache row and each get a result row; null keys are kept; other
columns of the input are ignored, so names cannot clash; an empty table gives an
empty result and leaves the cache as it was.  A cache row written twice (two
runs at once) is read once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging
from .tokens import SpaceChunks, edges, grouped

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


@lru_cache(maxsize=2)
def _counter(path: str) -> SpaceChunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    opening = edges(tokenizer, lambda t: t.startswith("\u0120"))

    def encode_words(words: list[str]) -> list[int]:
        found = grouped(tokenizer, " " + " ".join(words), opening, len(words), True)
        if found is None:
            return encode([" " + w for w in words])
        return np.diff(found[1], prepend=0).tolist()

    return SpaceChunks(encode, encode_words)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            counts = [sum(counter.pieces(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(key, digest, n_bytes, n_tokens) per row of ``docs``; ``cache`` is a folder.

    Only texts whose digest the cache lacks are encoded, once each.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), content.alias("text"),
                       F.unhex(F.sha2(content, 256)).alias("digest"))

    def cached() -> DataFrame:
        table = (spark.read.schema(CACHE_SCHEMA).parquet(cache)
                 if staging.path_exists(spark, cache)
                 else spark.createDataFrame([], CACHE_SCHEMA))
        return (table.where(F.col("version") == version)
                .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))

    # One text per digest: copies meet in the map-side partial aggregate, so a
    # text that is a third of the corpus sends one row per task.
    misses = (rows.groupBy("digest").agg(F.first("text").alias("text"))
              .join(cached().select("digest"), "digest", "left_anti"))
    (misses.select("digest", "text")
     .mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
     .select("digest", F.lit(version).alias("version"), "n_tokens")
     .write.mode("append").parquet(cache))
    return (rows.select(F.col("key").alias(key), "digest",
                        F.octet_length("text").cast("long").alias("n_bytes"))
            .join(cached(), "digest", "left"))
