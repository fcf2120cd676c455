"""DuckDB text of the views in ``views.py``, for the oracle queries.

Each constant is a SELECT over the pre-registered driver tables that returns
the same rows as the Spark view of the same name.
"""

BALLOTS = """
SELECT o.o_orderstatus AS dataset_id, CAST(o.o_custkey AS VARCHAR) AS id_bvote,
       CAST(c.c_nationkey AS VARCHAR) AS num_arrond, o.o_orderpriority AS candidate,
       CAST(count(*) AS DOUBLE) AS votes
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY o.o_orderstatus, o.o_custkey, c.c_nationkey, o.o_orderpriority
"""

PURCHASES = """
SELECT CAST(year(l.l_shipdate) AS VARCHAR) AS dataset_id, CAST(l.l_suppkey AS VARCHAR) AS id_bvote,
       CAST(s.s_nationkey AS VARCHAR) AS num_arrond, p.p_brand AS candidate,
       sum(l.l_quantity) AS votes
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
     JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY ALL
"""

ACTIVITY = """
SELECT strftime(ts, '%Y-%m') || '-' || CASE WHEN day(ts) <= 15 THEN 'a' ELSE 'b' END AS dataset_id,
       CAST(user_id AS VARCHAR) AS id_bvote,
       CAST(((user_id % 20) + 20) % 20 AS VARCHAR) AS num_arrond,
       event_type AS candidate, CAST(count(*) AS DOUBLE) AS votes
FROM events GROUP BY ALL
"""

LINES = """
SELECT l_returnflag AS dataset_id, 'lineitem_muni_' || l_returnflag || '.parquet' AS source_file, l_orderkey AS raw_row_id,
       CAST(l_suppkey AS VARCHAR) AS id_bvote, CAST(l_suppkey AS VARCHAR) AS source_bv_id,
       CAST(l_partkey AS VARCHAR) AS candidate,
       CAST(l_linenumber AS VARCHAR) AS candidate_source_column,
       l_quantity AS votes, l_extendedprice AS amount,
       CASE WHEN l_tax <> 0 THEN l_tax END AS vote_share_exprimes,
       l_discount AS vote_share_registered
FROM lineitem
"""

RECEIPTS = """
SELECT o.o_orderstatus AS dataset_id, CAST(o.o_orderkey AS VARCHAR) AS id_bvote,
       CAST(l.l_linenumber AS VARCHAR) AS candidate,
       l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) AS votes,
       o.o_totalprice AS nb_exprim
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

VECTORS = """
SELECT 'embeddings' AS dataset_id, CAST(vec_id AS VARCHAR) AS id_bvote,
       CAST(label AS VARCHAR) AS num_arrond,
       printf('d%02d', CAST(u.pos - 1 AS INTEGER)) AS candidate, CAST(u.x AS DOUBLE) AS votes
FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS pos,
                                 unnest(embedding) AS x) u
"""


# Pivot columns have to be named for the text to back a view.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BRANDS = tuple(f"Brand#{n}" for n in range(1, 26))


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def with_totals(src: str) -> str:
    """Station totals within / across datasets and both shares."""
    return f"""
SELECT *, CASE WHEN nb_exprim <> 0 THEN votes / nb_exprim END AS vote_share_exprimes,
          CASE WHEN nb_inscr <> 0 THEN votes / nb_inscr END AS vote_share_registered
FROM (SELECT *, sum(votes) OVER (PARTITION BY dataset_id, id_bvote) AS nb_exprim,
                sum(votes) OVER (PARTITION BY id_bvote) AS nb_inscr
      FROM ({src}) AS v) AS t
"""


BALLOTS_LONG = with_totals(BALLOTS)
PURCHASES_LONG = with_totals(PURCHASES)
ACTIVITY_LONG = with_totals(ACTIVITY)


def cte(**views: str) -> str:
    """``WITH a AS (...), b AS (...)`` from keyword arguments."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + "\n"

# Raw wide station file made from ballots: one count column per priority
# (absent -> 0), station totals, and two customer columns.
BALLOTS_WIDE = f"""
SELECT w.*, t.nb_exprim, r.nb_inscr, c.c_mktsegment, c.c_acctbal
FROM (SELECT dataset_id, id_bvote, num_arrond, coalesce(COLUMNS(* EXCLUDE (dataset_id, id_bvote, num_arrond)), 0.0::DOUBLE)
      FROM (PIVOT (SELECT dataset_id, id_bvote, num_arrond, candidate, votes FROM ({BALLOTS}) AS b)
            ON candidate IN {names(PRIORITIES)} USING sum(votes)
            GROUP BY dataset_id, id_bvote, num_arrond) AS p) AS w
JOIN (SELECT dataset_id, id_bvote, sum(votes) AS nb_exprim FROM ({BALLOTS}) AS b GROUP BY ALL) AS t
  USING (dataset_id, id_bvote)
JOIN (SELECT id_bvote, sum(votes) AS nb_inscr FROM ({BALLOTS}) AS b GROUP BY ALL) AS r USING (id_bvote)
JOIN (SELECT CAST(c_custkey AS VARCHAR) AS id_bvote, c_mktsegment, c_acctbal FROM customer) AS c
  USING (id_bvote)
"""

WIDE_META = ("dataset_id", "id_bvote", "num_arrond", "nb_exprim", "nb_inscr")
NUMBER_RE = "'[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'"


def wide_cells(meta=WIDE_META) -> str:
    """Every non-metadata cell of the wide file as text (nulls kept)."""
    m = ", ".join(meta)
    return f"""
SELECT * FROM (SELECT {m}, CAST(COLUMNS(* EXCLUDE ({m})) AS VARCHAR) FROM ({BALLOTS_WIDE}) AS w0) AS w
UNPIVOT INCLUDE NULLS (v FOR candidate_source_column IN (COLUMNS(* EXCLUDE ({m}))))
"""


def detected(meta=WIDE_META) -> str:
    """Per dataset and column: numeric ratio and the 80 % decision."""
    return f"""
SELECT dataset_id, candidate_source_column AS "column",
       avg(CASE WHEN regexp_full_match(trim(v), {NUMBER_RE})
                  OR lower(trim(v)) IN ('inf', '+inf', 'infinity', '+infinity', '-inf', '-infinity')
                THEN 1.0 ELSE 0.0 END)::DOUBLE AS numeric_ratio
FROM ({wide_cells(meta)}) AS c GROUP BY ALL
"""


def wide_long(meta=WIDE_META) -> str:
    """Unpivot of the detected value columns; a missing or bad value -> 0."""
    return f"""
SELECT c.dataset_id, c.id_bvote, c.num_arrond, c.nb_exprim, c.nb_inscr,
       c.candidate_source_column, coalesce(TRY_CAST(trim(c.v) AS DOUBLE), 0.0::DOUBLE) AS votes
FROM ({wide_cells(meta)}) AS c
JOIN ({detected(meta)}) AS d ON c.dataset_id = d.dataset_id AND c.candidate_source_column = d."column"
WHERE d.numeric_ratio >= 0.8
"""
