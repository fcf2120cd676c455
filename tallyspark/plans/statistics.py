"""Registered queries: feature statistics, correlation, PCA, CCA, summaries."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import stats as ST
from ..operators.reshape import active_features
from ..session import ensure_checkpoint_dir
from . import sqlviews as S
from . import views as V
from .registry import register

STATIONS = ("id_bvote", "num_arrond", "nb_inscr")
VALUE = "vote_share_exprimes"
CCA_PAIRS = (("F", "O"), ("O", "P"))


def ballot_features(spark, d, materialize: bool = True) -> ST.Features:
    """Station × candidate share vectors of the ballots view.

    The long rows and the vectors feed several jobs (means, sums, then scores);
    they are checkpointed to the session's shared checkpoint folder so each
    later job starts from them instead of re-running the scan, joins and pivots.
    """
    long = V.ballots_long(spark, d).select("dataset_id", *STATIONS, "candidate", VALUE)
    if materialize:
        ensure_checkpoint_dir(spark)
        long = long.checkpoint()
    feats = ST.feature_vectors(long, "dataset_id", STATIONS, "candidate", VALUE)
    if materialize:
        feats = replace(feats, vectors=feats.vectors.checkpoint())
    return feats


def vector_features(spark, d) -> ST.Features:
    """The embedding dimensions as features of one dataset (no threshold:
    dimensions are signed, so the share-total rule does not apply).  The array
    column is the station's dense vector as it is."""
    rows = V.table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    dataset = F.lit("embeddings").alias("dataset_id")
    vectors = rows.select(dataset, F.col("vec_id").cast("string").alias("id_bvote"),
                          F.col("label").cast("string").alias("num_arrond"),
                          F.col("embedding").cast("array<double>").alias("x"))
    names = (rows.agg(F.max(F.size("embedding")).alias("p"))
             .select(dataset, F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("idx"))
             .select("dataset_id", F.format_string("d%02d", "idx").alias("candidate"), "idx",
                     F.lit(None).cast("double").alias("total")))
    return ST.Features(vectors, names, "dataset_id", ("id_bvote", "num_arrond"))


# SQL: zero-filled station × active-feature grid of the ballots view.
GRID_SQL = S.cte(
    l=S.BALLOTS_LONG,
    act="SELECT dataset_id, candidate FROM l GROUP BY ALL "
        "HAVING coalesce(sum(vote_share_exprimes), 0) >= 0.002",
    st="SELECT DISTINCT dataset_id, id_bvote, num_arrond, nb_inscr FROM l",
    cells="SELECT dataset_id, id_bvote, num_arrond, nb_inscr, candidate, "
          "coalesce(sum(vote_share_exprimes), 0) AS x FROM l GROUP BY ALL",
    grid="SELECT st.*, act.candidate, coalesce(c.x, 0) AS x FROM st JOIN act USING (dataset_id) "
         "LEFT JOIN cells c USING (dataset_id, id_bvote, num_arrond, nb_inscr, candidate)",
    fstats="SELECT dataset_id, candidate, avg(x) AS mean, "
           "CASE WHEN stddev_samp(x) = 0 THEN 1 ELSE stddev_samp(x) END AS std "
           "FROM grid GROUP BY ALL")


@register("active_features", S.cte(l=S.BALLOTS_LONG) + """
SELECT dataset_id, candidate, coalesce(sum(vote_share_exprimes), 0) AS total FROM l
GROUP BY ALL HAVING coalesce(sum(vote_share_exprimes), 0) >= 0.002
""", ("total",))
def q_active_features(spark, d):
    """R6 + M1: candidates whose share total over the dataset reaches 0.002."""
    return active_features(V.ballots_long(spark, d), ["dataset_id"], "candidate", VALUE)


@register("feature_stats", GRID_SQL + "SELECT * FROM fstats", ("mean", "std"))
def q_feature_stats(spark, d):
    """Per dataset and candidate, mean and sample std (zero -> 1) over
    every station, absent shares counted as 0."""
    return ST.feature_stats(ballot_features(spark, d, materialize=False))


@register("standardize", GRID_SQL + """
SELECT g.dataset_id, g.id_bvote, g.num_arrond, g.nb_inscr, g.candidate,
       (g.x - s.mean) / s.std AS z
FROM grid g JOIN fstats s USING (dataset_id, candidate)
""", ("nb_inscr", "z"))
def q_standardize(spark, d):
    """M2: z = (x - mean) / std for every station and active candidate."""
    feats = ballot_features(spark, d, materialize=False)
    st = ST.feature_stats(feats)
    cells = feats.vectors.select("dataset_id", *STATIONS, F.posexplode("x").alias("idx", "v"))
    names = feats.features.select("dataset_id", "idx", "candidate")
    stats = st.join(names, ["dataset_id", "candidate"])
    return (cells.join(stats, ["dataset_id", "idx"])
            .select("dataset_id", *STATIONS, "candidate",
                    ((F.col("v") - F.col("mean")) / F.col("std")).alias("z")))


def _matrix_frame(spark, rows, left="feature_i", right="feature_j", value="r"):
    return spark.createDataFrame(rows, f"dataset_id string, {left} string, {right} string, "
                                 f"{value} double")


@register("correlation_matrix", GRID_SQL + """
SELECT a.dataset_id, a.candidate AS feature_i, b.candidate AS feature_j, corr(a.x, b.x) AS r
FROM grid a JOIN grid b ON a.dataset_id = b.dataset_id AND a.id_bvote = b.id_bvote
     AND a.num_arrond = b.num_arrond AND a.nb_inscr = b.nb_inscr
GROUP BY ALL
""", ("r",))
def q_correlation_matrix(spark, d):
    """M3: Pearson correlation of every candidate pair per dataset, from the
    distributed sums (no pairs of rows are formed)."""
    feats = ballot_features(spark, d)
    names = ST._collect_features(feats)
    rows = []
    for r in ST.gram(feats.vectors, ["dataset_id"]).collect():
        f = names[r["dataset_id"]]
        m = ST.moments_of(r, len(f))
        c = ST.standardized_cov(m)
        for i, a in enumerate(f):
            for j, b in enumerate(f):
                rows.append((r["dataset_id"], a, b, float(c[i, j])))
    return _matrix_frame(spark, rows)


CROSS_SQL = GRID_SQL + """
SELECT 'F' AS left_election, 'O' AS right_election, a.candidate AS feature_x,
       b.candidate AS feature_y, corr(a.x, b.x) AS r
FROM (SELECT * FROM grid WHERE dataset_id = 'F') a
JOIN (SELECT * FROM grid WHERE dataset_id = 'O') b ON a.id_bvote = b.id_bvote
GROUP BY ALL
"""


@register("cross_correlation", CROSS_SQL, ("r",))
def q_cross_correlation(spark, d):
    """M3 (cross): correlation of left and right candidates over the stations
    the two datasets share, from per-key sums (no joined rows are built)."""
    feats = ballot_features(spark, d)
    names = ST._collect_features(feats)
    left, right = CCA_PAIRS[0]
    lv = feats.vectors.where(F.col("dataset_id") == left)
    rv = feats.vectors.where(F.col("dataset_id") == right)
    s = ST.cca_sums(lv, rv, "id_bvote")
    fx, fy = names[left], names[right]
    mx = ST.moments(s["n"], s["mx"], s["Sx"], ST._unpack(s["Sxx"], len(fx)))
    my = ST.moments(s["n"], s["my"], s["Sy"], ST._unpack(s["Syy"], len(fy)))
    cross = s["Sxy"].reshape(len(fx), len(fy)) - np.outer(s["Sx"], s["Sy"]) / s["n"]
    r = cross / (s["n"] - 1) / np.outer(mx.std, my.std)
    rows = [(left, right, a, b, float(r[i, j])) for i, a in enumerate(fx)
            for j, b in enumerate(fy)]
    return spark.createDataFrame(rows, "left_election string, right_election string, "
                                 "feature_x string, feature_y string, r double")


@register("cca_join", S.cte(l=S.BALLOTS_LONG) + """
SELECT id_bvote, a.n AS left_rows, b.n AS right_rows, a.n * b.n AS joined_rows,
       a.area AS num_arrond_left, b.area AS num_arrond_right
FROM (SELECT id_bvote, count(*) AS n, min(num_arrond) AS area
      FROM (SELECT DISTINCT id_bvote, num_arrond, nb_inscr FROM l WHERE dataset_id = 'F') AS x
      GROUP BY id_bvote) a
JOIN (SELECT id_bvote, count(*) AS n, min(num_arrond) AS area
      FROM (SELECT DISTINCT id_bvote, num_arrond, nb_inscr FROM l WHERE dataset_id = 'O') AS y
      GROUP BY id_bvote) b
  USING (id_bvote)
""")
def q_cca_join(spark, d):
    """Station rows of two datasets matched on the station id.  A
    repeated id matches many-to-many; its pair count a·b is reported, the
    pairs themselves are not emitted."""
    long = V.ballots_long(spark, d)
    left, right = CCA_PAIRS[0]
    rows = long.select("dataset_id", *STATIONS).distinct()

    def side(ds, suffix):
        return (rows.where(F.col("dataset_id") == ds).groupBy("id_bvote")
                .agg(F.count(F.lit(1)).alias(f"{suffix}_rows"),
                     F.min("num_arrond").alias(f"num_arrond_{suffix}")))
    j = side(left, "left").join(side(right, "right"), ["id_bvote"])
    return j.withColumn("joined_rows", F.col("left_rows") * F.col("right_rows"))


# ---------------------------------------------------------------- PCA family
# SQL eigen-decomposition: a symmetric matrix squared often enough (trace kept at
# 1) becomes the projector of its first eigenvector; it is taken off and the rest
# follows.  The row of the projector's largest diagonal entry, over its root, is
# the eigenvector with its largest entry positive.
EIGEN_SQL = GRID_SQL.replace("WITH l AS", "WITH RECURSIVE l AS", 1).rstrip() + """,
corr AS (SELECT a.dataset_id, a.candidate AS f, b.candidate AS g,
                CASE WHEN isfinite(corr(a.x, b.x)) THEN corr(a.x, b.x) ELSE 0 END AS r
         FROM grid a JOIN grid b ON a.dataset_id = b.dataset_id AND a.id_bvote = b.id_bvote
              AND a.num_arrond = b.num_arrond AND a.nb_inscr = b.nb_inscr GROUP BY ALL),
mats AS (SELECT dataset_id, list(line ORDER BY f) AS mat, list(f ORDER BY f) AS names
         FROM (SELECT dataset_id, f, list(r ORDER BY g) AS line FROM corr GROUP BY ALL) AS t
         GROUP BY dataset_id),
powers AS (
  SELECT dataset_id, 1 AS comp, 0 AS step, mat, mat AS cur, NULL::DOUBLE AS lam,
         NULL::DOUBLE[][] AS proj FROM mats
  UNION ALL
  SELECT dataset_id, CASE WHEN step < 40 THEN comp ELSE comp + 1 END,
         CASE WHEN step < 40 THEN step + 1 ELSE 0 END, CASE WHEN step < 40 THEN mat ELSE rest END,
         CASE WHEN step < 40 THEN list_transform(cur, lambda a: list_transform(cur,
                lambda b: list_dot_product(a, b) / size)) ELSE rest END,
         CASE WHEN step = 40 THEN value END, CASE WHEN step = 40 THEN cur END
  FROM (SELECT *, list_transform(range(1, len(mat) + 1), lambda i: list_transform(
                    range(1, len(mat) + 1), lambda j: mat[i][j] - value * cur[i][j])) AS rest
        FROM (SELECT *, list_sum(list_transform(cur, lambda a: list_dot_product(a, a))) AS size,
                     list_sum(list_transform(range(1, len(mat) + 1),
                              lambda i: list_dot_product(mat[i], cur[i]))) AS value
              FROM powers) AS p1) AS p2
  WHERE comp <= least(4, len(mat))),
found AS (SELECT dataset_id, comp - 1 AS comp, lam, proj,
                 list_transform(range(1, len(proj) + 1), lambda i: proj[i][i]) AS diag
          FROM powers WHERE lam IS NOT NULL),
vecs AS (SELECT dataset_id, comp, lam,
                list_transform(proj[list_position(diag, list_max(diag))],
                               lambda x: x / sqrt(list_max(diag))) AS vec FROM found),
loads AS (SELECT dataset_id, unnest(names) AS candidate, unnest(v1) AS PC1, unnest(v2) AS PC2,
                 unnest(v3) AS PC3, unnest(v4) AS PC4
          FROM mats JOIN (SELECT dataset_id, any_value(vec) FILTER (comp = 1) AS v1,
                                 any_value(vec) FILTER (comp = 2) AS v2,
                                 any_value(vec) FILTER (comp = 3) AS v3,
                                 any_value(vec) FILTER (comp = 4) AS v4
                          FROM vecs GROUP BY dataset_id) AS v USING (dataset_id)),
scores AS (SELECT g.dataset_id, g.id_bvote, g.num_arrond, g.nb_inscr, sum(z * PC1) AS PC1,
                  sum(z * PC2) AS PC2, sum(z * PC3) AS PC3, sum(z * PC4) AS PC4
           FROM (SELECT g.*, (g.x - s.mean) / s.std AS z
                 FROM grid g JOIN fstats s USING (dataset_id, candidate)) AS g
           JOIN loads USING (dataset_id, candidate) GROUP BY ALL)
"""

# The components after the fourth share what the trace has left (five candidates).
VARIANCE_SQL = EIGEN_SQL + """,
spectrum AS (
  SELECT dataset_id, comp, lam, len(mat) AS p FROM found JOIN mats USING (dataset_id)
  UNION ALL
  SELECT dataset_id, 5, len(any_value(mat)) - sum(lam), 5 FROM found JOIN mats USING (dataset_id)
  GROUP BY dataset_id HAVING len(any_value(mat)) = 5)
SELECT dataset_id, CAST(comp AS INTEGER) AS component_index, 'PC' || comp AS component,
       lam / p AS explained_variance_ratio,
       sum(lam / p) OVER (PARTITION BY dataset_id ORDER BY comp) AS cumulative_variance_ratio
FROM spectrum
"""
VARIANCES = ("explained_variance_ratio", "cumulative_variance_ratio")
COMPONENTS = ("PC1", "PC2", "PC3", "PC4")


def _pca(spark, d, k):
    feats = ballot_features(spark, d)
    return feats, ST.fit_pca(feats, n_components=k)


@register("explained_variance", VARIANCE_SQL, VARIANCES)
def q_explained_variance(spark, d):
    """M4 + W3 + T4: explained variance ratio of every component per dataset,
    with the running total."""
    _, fits = _pca(spark, d, 4)
    return ST.explained_variance(spark, fits)


@register("pca_loadings", EIGEN_SQL + "SELECT * FROM loads", COMPONENTS)
def q_pca_loadings(spark, d):
    """M5: loadings of the first 4 components per dataset."""
    _, fits = _pca(spark, d, 4)
    return ST.loadings_frame(spark, fits)


@register("pca_scores", EIGEN_SQL + "SELECT * FROM scores", ("nb_inscr", *COMPONENTS))
def q_pca_scores(spark, d):
    """M6: component scores of every station, with its station columns."""
    feats, fits = _pca(spark, d, 4)
    return ST.pca_scores(spark, feats, fits)


@register("top_loadings", EIGEN_SQL + """
SELECT dataset_id, candidate, component, loading, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, component
                               ORDER BY abs(loading) DESC, candidate) AS rank
  FROM (UNPIVOT loads ON PC1, PC2, PC3, PC4 INTO NAME component VALUE loading) AS u) AS t
WHERE rank <= 8
""", ("loading",))
def q_top_loadings(spark, d):
    """Per component, the 8 candidates with the largest absolute loading."""
    _, fits = _pca(spark, d, 4)
    return ST.top_loadings(ST.loadings_frame(spark, fits), n=8)


@register("pca_group_summary", EIGEN_SQL + """
SELECT s.*, n.n_name AS layout_name, n.n_regionkey AS layout_group
FROM (SELECT dataset_id, num_arrond, avg(PC1) AS PC1, avg(PC2) AS PC2,
             count(DISTINCT id_bvote) AS polling_stations, avg(nb_inscr) AS mean_registered
      FROM scores WHERE num_arrond IS NOT NULL GROUP BY ALL) AS s
LEFT JOIN nation n ON s.num_arrond = CAST(n.n_nationkey AS VARCHAR)
""", ("PC1", "PC2", "mean_registered"))
def q_pca_group_summary(spark, d):
    """A5 + M11 + J5: mean PC1 / PC2 per area, joined to the nation layout."""
    feats, fits = _pca(spark, d, 4)
    summary = ST.group_summary(ST.pca_scores(spark, feats, fits), "num_arrond", "id_bvote",
                               "nb_inscr")
    return _with_layout(spark, d, summary)


def _with_layout(spark, d, summary):
    """Attach the layout of each area (nation name and region).  The nation
    table is a fixed-size dimension, which AQE broadcasts by its measured size."""
    nation = V.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("num_arrond"),
        F.col("n_name").alias("layout_name"), F.col("n_regionkey").alias("layout_group"))
    return summary.join(nation, ["num_arrond"], "left")


@register("pca_multi", VARIANCE_SQL, VARIANCES)
def q_pca_multi(spark, d):
    """M10 + U5: explained variance of all datasets from one grouped job, k = 10."""
    _, fits = _pca(spark, d, 10)
    return ST.explained_variance(spark, fits).where(F.col("component_index") <= 8)


@register("embedding_pca")
def q_embedding_pca(spark, d):
    """M4 on the 64 embedding dimensions (p = 64 features, one dataset)."""
    feats = vector_features(spark, d)
    return ST.explained_variance(spark, ST.fit_pca(feats, n_components=4))


# ---------------------------------------------------------------- CCA family
def _cca(spark, d, pairs=CCA_PAIRS[:1]):
    feats = ballot_features(spark, d)
    return feats, ST.fit_cca(feats, pairs, "id_bvote", n_components=3)


@register("cca_correlations")
def q_cca_correlations(spark, d):
    """M7: canonical correlations of statuses F and O over shared customers."""
    _, fits = _cca(spark, d)
    return ST.cca_correlations(spark, fits)


@register("cca_single", GRID_SQL + """
, sides AS (
  SELECT dataset_id, id_bvote, x FROM grid
  WHERE (dataset_id, candidate) IN (SELECT (dataset_id, min(candidate)) FROM grid
                                    GROUP BY dataset_id))
SELECT 'F' AS left_election, 'O' AS right_election, count(*) AS common_polling_stations,
       'CC1' AS component, abs(corr(a.x, b.x)) AS canonical_correlation,
       var_samp(a.x) = 0 OR var_samp(b.x) = 0 AS is_degenerate
FROM (SELECT * FROM sides WHERE dataset_id = 'F') a
JOIN (SELECT * FROM sides WHERE dataset_id = 'O') b ON a.id_bvote = b.id_bvote
""", ("canonical_correlation",))
def q_cca_single(spark, d):
    """M7 with one feature a side (the first by name), where the canonical correlation is
    the size of the plain one."""
    feats = ballot_features(spark, d)
    names = ST._collect_features(feats)
    left, right = CCA_PAIRS[0]
    one = feats.vectors.withColumn("x", F.slice("x", 1, 1))
    sums = ST.cca_sums(one.where(F.col("dataset_id") == left),
                       one.where(F.col("dataset_id") == right), "id_bvote")
    fit = ST.solve_cca(sums, names[left][:1], names[right][:1], 1, fixed.CCA_RIDGE, left, right)
    return ST.cca_correlations(spark, {(left, right): fit})


@register("cca_weights")
def q_cca_weights(spark, d):
    """M8: canonical weights of both sides, named by candidate."""
    _, fits = _cca(spark, d)
    return ST.cca_weights(spark, fits)


@register("cca_scores")
def q_cca_scores(spark, d):
    """M9: canonical variates of the station rows of both sides that match."""
    feats, fits = _cca(spark, d)
    return ST.cca_scores(spark, feats, fits)


@register("cca_multi")
def q_cca_multi(spark, d):
    """Correlations of two dataset pairs with their common-station counts."""
    _, fits = _cca(spark, d, CCA_PAIRS)
    return ST.cca_correlations(spark, fits)


@register("group_layout_join", S.cte(l=S.BALLOTS_LONG) + """
SELECT s.num_arrond, s.dataset_id, s.polling_stations, s.mean_registered,
       n.n_name AS layout_name, n.n_regionkey AS layout_group
FROM (SELECT dataset_id, num_arrond, count(DISTINCT id_bvote) AS polling_stations,
             avg(nb_inscr) AS mean_registered
      FROM (SELECT DISTINCT dataset_id, id_bvote, num_arrond, nb_inscr FROM l) AS st
      WHERE num_arrond IS NOT NULL GROUP BY ALL) AS s
LEFT JOIN nation n ON s.num_arrond = CAST(n.n_nationkey AS VARCHAR)
""", ("mean_registered",))
def q_group_layout_join(spark, d):
    """Per-area station summary joined to a fixed-size layout table."""
    rows = V.ballots_long(spark, d).select("dataset_id", *STATIONS).distinct()
    summary = (rows.where(F.col("num_arrond").isNotNull())
               .groupBy("dataset_id", "num_arrond")
               .agg(F.countDistinct("id_bvote").alias("polling_stations"),
                    F.avg("nb_inscr").alias("mean_registered")))
    return _with_layout(spark, d, summary)
