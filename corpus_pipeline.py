"""Corpus pipeline: quality rules, line dedup, near-duplicate join, PII, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that the next stage gets, written and read again.  All but the last
return the columns of ``documents``.

* quality_rules: documents that fail the base or their group's fences go.
* line_dedup: lines of 20 characters or more that 3 documents share stay in the
  document with the largest id only; documents left without text go.
* ngram_join: of documents linked by 5-word n-gram similarity of 0.8 or more, the
  one with the smallest id of each group stays.
* pii: personal data and terms that reveal it are hidden in the text.
* packing: the texts' tokens are packed into windows of 4096 by source; one row
  per piece with its ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, ngram_join, packing, pii, quality
from tallyspark.llm.staging import free_names, importable, new_folder

#: The stages rest on sketches, set joins and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def _n_chars(docs: DataFrame) -> DataFrame:
    """Lengths that fit the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A verdict is that of an id and a text: equal texts of a group have equal ones."""
    importable(spark)
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    doc, same = free_names(docs, "id", "same")
    # Columns that the operator reads, by names that no other column of docs can take.
    rows = docs.select("doc_id", digest.alias("same"), "text", "lang", "source")
    passed = (quality.quality_verdicts(rows, ["doc_id", "same"]).where("kept")
              .select(F.col("doc_id").alias(doc), F.col("same").alias(same)).distinct())
    return docs.join(passed, F.col("doc_id").eqNullSafe(F.col(doc)) & (digest == F.col(same)),
                     "left_semi")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    left = line_dedup.drop_repeated_lines(docs, min_chars=20, min_docs=3)
    return _n_chars(left.where(F.length(F.btrim("text", F.lit(line_dedup.BLANKS))) > 0)
                    .select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat a key are one document; rows without a key stay."""
    importable(spark)
    groups = ngram_join.jaccard_components(docs, size=5, percent=80)
    gone = (groups.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _n_chars(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)


STAGES = [("quality_rules", quality_rules), ("line_dedup", drop_lines),
          ("ngram_join", drop_near_copies), ("pii", hide_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        path = new_folder(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
