"""Registered queries of the forms without a bound on the number of names: the sparse
wide table and the subspace PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sparse as SP
from ..operators import subspace as SU
from ..session import ensure_checkpoint_dir
from . import sqlviews as S
from . import views as V
from .registry import register
from .statistics import COMPONENTS, EIGEN_SQL, STATIONS, VALUE

#: Parts as names: far more of them than a pivot takes once the tables grow.
PART_SHARES = """
SELECT l_returnflag AS dataset_id, CAST(l_suppkey AS VARCHAR) AS id_bvote,
       CAST(l_partkey AS VARCHAR) AS candidate, sum(l_quantity) AS value
FROM lineitem GROUP BY ALL
"""


def _sparse_parts(spark, d) -> SP.SparseWide:
    return SP.sparse_wide(V.lines(spark, d).select("dataset_id", "id_bvote", "candidate", "votes"),
                          ["dataset_id", "id_bvote"], "candidate", "votes")


@register("sparse_wide", f"""
SELECT dataset_id, id_bvote, candidate, value, position
FROM ({PART_SHARES}) AS c
JOIN (SELECT candidate, row_number() OVER (ORDER BY candidate) - 1 AS position
      FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS candidate FROM lineitem) AS n) AS names
  USING (candidate)
""", ("value",))
def sparse_wide(spark, d):
    """R3 + R4 without a pivot: sparse rows written and read back, one row per cell with
    the name's position."""
    from ..sources.sinks import scratch_path
    wide = _sparse_parts(spark, d)
    back = SP.read_sparse(spark, wide.write(scratch_path(spark, "sparse-wide")))
    return back.cells().select("dataset_id", "id_bvote", "candidate", "value", "position")


@register("sparse_range_check", f"""
SELECT (SELECT count(*) FROM (SELECT DISTINCT dataset_id, id_bvote FROM ({PART_SHARES}) AS p) AS r)
         AS wide_rows,
       count(DISTINCT candidate) + 2 AS wide_columns, CAST(0 AS BIGINT) AS wide_duplicate_index_rows,
       CAST(count_if(value < -1e-9) AS BIGINT) AS wide_cells_below_zero,
       CAST(count_if(value > 1 + 1e-9) AS BIGINT) AS wide_cells_above_one
FROM ({PART_SHARES}) AS c
""")
def sparse_range_check(spark, d):
    """A10 on the sparse form, copies of an index tuple counted."""
    return SP.sparse_range_check(_sparse_parts(spark, d)).select(
        "wide_rows", "wide_columns", "wide_duplicate_index_rows", "wide_cells_below_zero",
        "wide_cells_above_one")


SUBSPACE_DATASET = "O"


@register("subspace_loadings", EIGEN_SQL + f"""
SELECT * FROM loads WHERE dataset_id = '{SUBSPACE_DATASET}'
""", COMPONENTS)
def subspace_loadings(spark, d):
    """M4-M6 without a bound on features: loadings by subspace iteration on sparse cells."""
    ensure_checkpoint_dir(spark)
    cells = (V.ballots_long(spark, d).where(F.col("dataset_id") == SUBSPACE_DATASET)
             .select(F.concat_ws("|", *STATIONS).alias("station"), "candidate", VALUE))
    fit = SU.subspace_pca(cells, "station", "candidate", VALUE, n_components=len(COMPONENTS))
    return fit.loadings.select(F.lit(SUBSPACE_DATASET).alias("dataset_id"), "candidate", *COMPONENTS)
