"""Registered queries: shares, rebuilt totals, pivots, station checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import reshape as R
from ..operators import totals as TT
from . import sqlviews as S
from . import views as V
from .registry import register

LONG_DOUBLES = ("votes", "nb_exprim", "nb_inscr", "vote_share_exprimes", "vote_share_registered")


@register("vote_shares", S.BALLOTS_LONG, LONG_DOUBLES)
def vote_shares(spark, d):
    """P15 + W1: per (status, customer, priority) order count, station totals and shares."""
    return V.ballots_long(spark, d)


@register("reconstruct_expressed",
          f"SELECT *, sum(votes) OVER (PARTITION BY dataset_id, id_bvote) AS nb_exprim "
          f"FROM ({S.PURCHASES}) AS p", ("votes", "nb_exprim"))
def reconstruct_expressed(spark, d):
    """Expressed total of a station = sum of its candidates' votes, on every row."""
    return TT.reconstruct_expressed(V.purchases(spark, d), ["dataset_id", "id_bvote"])


@register("share_fallback", f"""
SELECT dataset_id, raw_row_id, candidate_source_column, candidate, id_bvote, votes, nb_exprim,
       coalesce(CASE WHEN isfinite(vote_share_exprimes) THEN vote_share_exprimes END,
                CASE WHEN nb_exprim <> 0 THEN votes / nb_exprim END) AS vote_share_exprimes
FROM (SELECT *, sum(votes) OVER (PARTITION BY dataset_id, id_bvote) AS nb_exprim
      FROM ({S.LINES}) AS l) AS t
""", ("votes", "nb_exprim", "vote_share_exprimes"))
def share_fallback(spark, d):
    """Source share when finite, else votes / rebuilt total."""
    df = TT.reconstruct_expressed(V.lines(spark, d), ["dataset_id", "id_bvote"])
    df = TT.share_fallback(df, "vote_share_exprimes", "votes", "nb_exprim")
    return df.select("dataset_id", "raw_row_id", "candidate_source_column", "candidate",
                     "id_bvote", "votes", "nb_exprim", "vote_share_exprimes")


@register("reconstruct_registered", f"""
SELECT dataset_id, id_bvote,
       round_even(median(CASE WHEN vote_share_registered > 0
                              THEN votes / vote_share_registered END), 0) AS nb_inscr
FROM ({S.LINES}) AS l GROUP BY ALL
""", ("nb_inscr",))
def reconstruct_registered(spark, d):
    """A2 + J1: registered total per station = half-even rounded median of
    votes / registered share over rows with a positive share."""
    df = TT.reconstruct_registered(V.lines(spark, d), ["dataset_id", "id_bvote"])
    return df.select("dataset_id", "id_bvote", "nb_inscr").distinct()


def _lines_with_percents(spark, d):
    return V.lines(spark, d).select(
        "id_bvote", "dataset_id", "votes",
        (F.col("vote_share_registered") * 100.0).alias("pct_expressed"),
        (F.coalesce(F.col("vote_share_exprimes"), F.lit(0.0)) * 100.0).alias("pct_registered"))


@register("backcalc_totals", f"""
SELECT id_bvote, dataset_id,
  CAST(round_even(median(CASE WHEN pct_expressed / 100.0::DOUBLE > 0
                         THEN votes / (pct_expressed / 100.0::DOUBLE) END), 0) AS BIGINT) AS nb_exprim,
  CAST(round_even(median(CASE WHEN pct_registered / 100.0::DOUBLE > 0
                         THEN votes / (pct_registered / 100.0::DOUBLE) END), 0) AS BIGINT) AS nb_inscr
FROM (SELECT id_bvote, dataset_id, votes,
             vote_share_registered * 100.0::DOUBLE AS pct_expressed,
             coalesce(vote_share_exprimes, 0.0::DOUBLE) * 100.0::DOUBLE AS pct_registered
      FROM ({S.LINES}) AS l) AS t
WHERE id_bvote IS NOT NULL AND dataset_id IS NOT NULL
GROUP BY ALL
""", ())
def backcalc_totals(spark, d):
    """A3 + P24: two medians per group of count / (percent / 100), half-even, as long."""
    return TT.backcalc_totals(_lines_with_percents(spark, d), ["id_bvote", "dataset_id"],
                              "votes", {"nb_exprim": "pct_expressed",
                                        "nb_inscr": "pct_registered"})


STATION_DOUBLES = ("nb_exprim", "candidate_votes_sum", "expressed_vote_diff",
                   "abs_expressed_vote_diff", "vote_share_sum_from_votes",
                   "vote_share_sum_diff", "abs_vote_share_sum_diff")

STATION_CHECK_SQL = f"""
SELECT dataset_id, id_bvote, nb_exprim, candidate_votes_sum, candidate_count,
       'source_total_check' AS validation_scope,
       candidate_votes_sum - nb_exprim AS expressed_vote_diff,
       abs(candidate_votes_sum - nb_exprim) AS abs_expressed_vote_diff,
       s AS vote_share_sum_from_votes, s - 1 AS vote_share_sum_diff,
       abs(s - 1) AS abs_vote_share_sum_diff,
       coalesce(abs(candidate_votes_sum - nb_exprim) <= 0.5, false) AS expressed_votes_ok,
       (abs(s - 1) IS NULL OR abs(s - 1) <= 0.005) AS vote_share_sum_ok
FROM (SELECT *, CASE WHEN nb_exprim <> 0 THEN candidate_votes_sum / nb_exprim END AS s
      FROM (SELECT dataset_id, id_bvote, nb_exprim,
                   coalesce(sum(votes), 0) AS candidate_votes_sum,
                   count(DISTINCT candidate) AS candidate_count
            FROM ({S.RECEIPTS}) AS r GROUP BY ALL) AS g) AS c
"""


def _station_check(spark, d):
    """Lines are summed per order before the orders are joined in."""
    return Q.station_vote_check(V.receipt_lines(spark, d),
                                ["dataset_id", "id_bvote", "nb_exprim"],
                                stations=V.receipt_orders(spark, d), station_key=["order_key"])


@register("station_vote_check", STATION_CHECK_SQL, STATION_DOUBLES)
def station_vote_check(spark, d):
    """A4: sum of line amounts per order against the order's reported total.
    Only orders that have lines are judged, as the check goes over result rows."""
    return _station_check(spark, d)


@register("station_mismatches",
          f"SELECT * FROM ({STATION_CHECK_SQL}) AS c "
          f"WHERE NOT expressed_votes_ok OR NOT vote_share_sum_ok", STATION_DOUBLES)
def station_mismatches(spark, d):
    """F6 + T2: stations failing either check, largest difference first."""
    return Q.station_mismatches(_station_check(spark, d))


PIVOT_INDEX = ("dataset_id", "id_bvote", "num_arrond", "nb_inscr", "nb_exprim")


def _pivot_sql(src: str, index, value: str, values, pivot: str = "candidate") -> str:
    idx = ", ".join(index)
    return f"""
SELECT {idx}, round(coalesce(COLUMNS(* EXCLUDE ({idx})), 0), 6) + 0.0
FROM (PIVOT (SELECT {idx}, {pivot}, {value} FROM ({src}) AS s WHERE {pivot} IS NOT NULL)
      ON {pivot} IN {S.names(values)} USING sum({value}) GROUP BY {idx}) AS p
"""


@register("pivot_shares", f"""
SELECT * REPLACE (round(nb_inscr, 6) + 0.0 AS nb_inscr, round(nb_exprim, 6) + 0.0 AS nb_exprim)
FROM ({_pivot_sql(S.BALLOTS_LONG, PIVOT_INDEX, "vote_share_exprimes", S.PRIORITIES)}) AS w
""", raw_sql=True)
def pivot_shares(spark, d):
    """R3 + A1: one row per station index, one share column per candidate, absent -> 0."""
    return R.pivot_shares(V.ballots_long(spark, d), PIVOT_INDEX)


@register("pivot_votes", f"""
SELECT m.dataset_id, m.id_bvote, m.num_arrond, w.* EXCLUDE (dataset_id, id_bvote)
FROM (SELECT dataset_id, id_bvote, num_arrond FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset_id, id_bvote ORDER BY num_arrond) AS rn
        FROM ({S.PURCHASES}) AS p) AS t WHERE rn = 1) AS m
LEFT JOIN ({_pivot_sql(S.PURCHASES, ("dataset_id", "id_bvote"), "votes", S.BRANDS)}) AS w
  USING (dataset_id, id_bvote)
""", raw_sql=True)
def pivot_votes(spark, d):
    """R4 + J2 + W5: votes per (dataset, station) pivoted by candidate (absent
    -> 0), attached by a left join to one metadata row per station."""
    long = V.purchases(spark, d)
    keys = ["dataset_id", "id_bvote"]
    meta = Q.first_per_key(long.select(*keys, "num_arrond"), keys, ["num_arrond"])
    wide = R.pivot_sum(long, keys, "candidate", "votes")
    return meta.join(wide, keys, "left")


@register("available_sets", f"""
SELECT DISTINCT dataset_id, num_arrond FROM ({S.PURCHASES}) AS p
""")
def available_sets(spark, d):
    """A11 + T1 + U6: distinct (dataset, area) coverage, sorted."""
    return Q.available_sets(V.purchases(spark, d), ["dataset_id", "num_arrond"],
                            ["dataset_id", "num_arrond"])
