"""Bindings of the driver tables to the count-data model.

The operators are generic (column names are arguments); these views give
them inputs from the TPC-H-like tables so every registered query reads the
given tables and grows with them.

| view            | source                  | dataset        | station   | candidate        | votes            |
|-----------------|-------------------------|----------------|-----------|------------------|------------------|
| ballots         | orders + customer       | o_orderstatus  | o_custkey | o_orderpriority  | count of orders  |
| purchases       | lineitem + part + supp. | ship year      | l_suppkey | p_brand          | sum(l_quantity)  |
| activity        | events                  | half-month     | user_id   | event_type       | count of events  |
| lines           | lineitem (long family)  | l_returnflag   | l_suppkey | l_partkey        | l_quantity       |
| receipts        | orders + lineitem       | o_orderstatus  | o_orderkey| l_linenumber     | line amount      |
| vectors         | embeddings              | 'embeddings'   | vec_id    | dimension        | value            |

Every aggregate is taken before a join where the join key allows it, so the
large fact table is combined on the map side before it is shuffled.
Dimension tables are joined without hints: AQE turns a join into a broadcast
only when the measured size of a side is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reshape import pivot_sum
from ..operators.totals import vote_shares


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- ballots
def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long votes: (dataset_id, id_bvote, num_arrond, candidate, votes)."""
    counts = (table(spark, sf_dir, "orders")
              .groupBy("o_orderstatus", "o_custkey", "o_orderpriority")
              .agg(F.count(F.lit(1)).alias("n")))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (counts.join(cust, counts.o_custkey == cust.c_custkey, "inner")
            .select(F.col("o_orderstatus").alias("dataset_id"),
                    F.col("o_custkey").cast("string").alias("id_bvote"),
                    F.col("c_nationkey").cast("string").alias("num_arrond"),
                    F.col("o_orderpriority").alias("candidate"),
                    F.col("n").cast("double").alias("votes")))


def with_totals(long: DataFrame, dataset: str = "dataset_id", station: str = "id_bvote"
                ) -> DataFrame:
    """Expressed = station total within the dataset; registered = station total
    over all datasets; shares of both."""
    # One shuffle by station serves both windows.  Rows come at (dataset, station,
    # candidate) grain, so a window holds datasets x candidates rows at most.
    within = Window.partitionBy(dataset, station)
    over_all = Window.partitionBy(station)
    out = (long.withColumn("nb_inscr", F.sum("votes").over(over_all))
           .withColumn("nb_exprim", F.sum("votes").over(within)))
    return vote_shares(out)


def ballots_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_totals(ballots(spark, sf_dir))


def ballots_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw wide station file: one row per (status, customer), one count
    column per priority, plus customer columns that are not candidates by
    name (a text one, and a number one the 80 % rule will take)."""
    long = ballots(spark, sf_dir)
    wide = pivot_sum(long, ["dataset_id", "id_bvote", "num_arrond"], "candidate", "votes")
    totals = (long.groupBy("dataset_id", "id_bvote")
              .agg(F.sum("votes").alias("nb_exprim")))
    registered = long.groupBy("id_bvote").agg(F.sum("votes").alias("nb_inscr"))
    cust = (table(spark, sf_dir, "customer")
            .select(F.col("c_custkey").cast("string").alias("id_bvote"),
                    "c_mktsegment", "c_acctbal"))
    return (wide.join(totals, ["dataset_id", "id_bvote"]).join(registered, ["id_bvote"])
            .join(cust, ["id_bvote"]))


# -------------------------------------------------------------- purchases
def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Summed once, at the view's own grain: almost every line item has a (year, supplier,
    # part) of its own, so sums at that grain would hold all rows and combine few.
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("y"), "l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = (lines.join(part, lines.l_partkey == part.p_partkey)
              .join(supp, lines.l_suppkey == supp.s_suppkey))
    sums = joined.groupBy("y", "l_suppkey", "s_nationkey", "p_brand").agg(
        F.sum("l_quantity").alias("votes"))
    return sums.select(F.col("y").cast("string").alias("dataset_id"),
                       F.col("l_suppkey").cast("string").alias("id_bvote"),
                       F.col("s_nationkey").cast("string").alias("num_arrond"),
                       F.col("p_brand").alias("candidate"), "votes")


def purchases_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_totals(purchases(spark, sf_dir))


# --------------------------------------------------------------- activity
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    half = F.when(F.dayofmonth("ts") <= 15, F.lit("a")).otherwise(F.lit("b"))
    return (ev.groupBy(F.concat(F.date_format("ts", "yyyy-MM"), F.lit("-"), half)
                       .alias("dataset_id"),
                       F.col("user_id").cast("string").alias("id_bvote"),
                       F.pmod(F.col("user_id"), F.lit(20)).cast("string").alias("num_arrond"),
                       F.col("event_type").alias("candidate"))
            .agg(F.count(F.lit(1)).cast("double").alias("votes")))


def activity_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_totals(activity(spark, sf_dir))


# ------------------------------------------------------------------ lines
# The long family is named with its marker, as the family convention has it;
# one file per dataset.
LINES_FILE = "lineitem_muni_"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Already-long family: one row per line item, with source shares that are
    sometimes absent (a zero tax is read as not reported)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("dataset_id"),
        F.concat(F.lit(LINES_FILE), F.col("l_returnflag"), F.lit(".parquet"))
        .alias("source_file"),
        F.col("l_orderkey").alias("raw_row_id"),
        F.col("l_suppkey").cast("string").alias("id_bvote"),
        F.col("l_suppkey").cast("string").alias("source_bv_id"),
        F.col("l_partkey").cast("string").alias("candidate"),
        F.col("l_linenumber").cast("string").alias("candidate_source_column"),
        F.col("l_quantity").alias("votes"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("vote_share_exprimes"),
        F.col("l_discount").alias("vote_share_registered"))


# --------------------------------------------------------------- receipts
def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows of the receipts binding: one per order line."""
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("string").alias("candidate"), amount.alias("votes"))


def receipt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station rows of the receipts binding: one per order with its total."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("dataset_id"),
        F.col("o_orderkey").cast("string").alias("id_bvote"),
        F.col("o_totalprice").alias("nb_exprim"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines against the order's reported total."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .select(F.col("o_orderstatus").alias("dataset_id"),
                    F.col("o_orderkey").cast("string").alias("id_bvote"),
                    F.col("l_linenumber").cast("string").alias("candidate"),
                    amount.alias("votes"),
                    F.col("o_totalprice").alias("nb_exprim")))


# ---------------------------------------------------------------- vectors
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.lit("embeddings").alias("dataset_id"),
                      F.col("vec_id").cast("string").alias("id_bvote"),
                      F.col("label").cast("string").alias("num_arrond"),
                      F.posexplode("embedding").alias("pos", "x")).select(
        "dataset_id", "id_bvote", "num_arrond",
        F.format_string("d%02d", F.col("pos")).alias("candidate"),
        F.col("x").cast("double").alias("votes"))
