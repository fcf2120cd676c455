"""Statistics on long feature tables: column stats, standardisation,
correlation, PCA and CCA, group summaries.

Layout of the work:

* ``feature_vectors`` turns long cells (dataset, station, feature, value) into
  one dense vector per station of a dataset, over that dataset's active
  features.  A station holds at most ``p`` entries, so nothing unbounded is
  collected.
* ``gram`` takes the mean vector per dataset first and then sums, per dataset,
  the centred vectors and the packed upper triangle of their ``x xᵀ`` with
  ``Summarizer`` - ordinary grouped aggregates with a map-side partial step,
  one plan for every dataset at once.  Centring first keeps columns whose
  spread is small against their mean exact, and a constant column's variance
  is exactly 0.  No row pairs are ever emitted.
* The p×p eigen / SVD solve runs on the driver (p is the number of features;
  it is checked against ``MAX_FEATURES``).
* Scores are computed on the executors from the dense vectors and a weights
  table whose size (datasets × p × k) is known on the driver, so it is
  broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import fixed
from ._join import join_on_keys
from .reshape import active_features

MAX_FEATURES = 2048


# ------------------------------------------------------------ feature matrix
@dataclass(frozen=True)
class Features:
    """Dense per-station vectors plus the feature order of each dataset."""
    vectors: DataFrame      # dataset, station columns..., x: array<double>
    features: DataFrame     # dataset, feature, idx, total
    dataset: str
    stations: tuple[str, ...]


def feature_vectors(long: DataFrame, dataset: str, stations: Sequence[str], feature: str,
                    value: str, min_total: float = fixed.MIN_TOTAL_SHARE,
                    station_rows: DataFrame | None = None) -> Features:
    """M1 + R6: per dataset keep features whose total reaches ``min_total``;
    one row per distinct station tuple with the dense vector of its values
    (absent -> 0, null -> 0).

    ``station_rows`` gives the rows of the matrix; by default the distinct
    station tuples present in ``long`` for the dataset.
    """
    stations = list(stations)
    active = active_features(long, [dataset], feature, value, min_total)
    order = Window.partitionBy(dataset).orderBy(feature)
    feats = (active.withColumn("idx", F.row_number().over(order) - 1)
             .select(dataset, feature, "idx", "total"))
    width = feats.groupBy(dataset).agg(F.count(F.lit(1)).alias("__p"))
    cells = (long.groupBy(dataset, *stations, feature)
             .agg(F.coalesce(F.sum(X.finite_or_null(value)), F.lit(0.0)).alias("__x")))
    cells = cells.join(feats.select(dataset, feature, "idx"), [dataset, feature])
    packed = (cells.groupBy(dataset, *stations)
              .agg(F.map_from_entries(F.collect_list(F.struct("idx", "__x"))).alias("__m")))
    rows = station_rows if station_rows is not None else \
        long.select(dataset, *stations).distinct()
    rows = rows.join(width, [dataset])           # datasets without features drop out
    full = join_on_keys(rows, packed, [dataset, *stations], how="left")
    dense = F.transform(F.sequence(F.lit(0), F.col("__p") - 1),
                        lambda i: F.coalesce(F.try_element_at(F.col("__m"), i), F.lit(0.0)))
    vectors = full.select(dataset, *stations, dense.alias("x"))
    return Features(vectors, feats, dataset, tuple(stations))


def _outer_packed(x):
    """Upper triangle of x xᵀ, row by row, as one array."""
    n = F.size(x)
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
        F.sequence(i, n - 1), lambda j: F.element_at(x, i + 1) * F.element_at(x, j + 1))))


def _cross(x, y):
    """x yᵀ row by row (len(x) * len(y) values)."""
    return F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: a * b)))


def centred(vectors: DataFrame, group: Sequence[str], x: str = "x") -> DataFrame:
    """``vectors`` with ``x`` less its group's mean, and that mean as ``shift``."""
    means = (vectors.groupBy(*group)
             .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(x)))).alias("shift")))
    return (join_on_keys(vectors, means, group)
            .withColumn(x, F.zip_with(x, "shift", lambda v, m: v - m)))


def gram(vectors: DataFrame, group: Sequence[str], x: str = "x") -> DataFrame:
    """Per group: n, the mean (shift), and Σ(x - shift) and packed Σ of its x xᵀ
    (as ML vectors)."""
    return (centred(vectors, group, x).groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n"), F.first("shift").alias("shift"),
                 Summarizer.sum(array_to_vector(F.col(x))).alias("sx"),
                 Summarizer.sum(array_to_vector(_outer_packed(F.col(x)))).alias("sxx")))


def _unpack(packed: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    iu = np.triu_indices(p)
    m[iu] = packed
    m.T[iu] = packed
    return m


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    std: np.ndarray          # sample std, 0 -> 1
    constant: np.ndarray     # bool per feature
    cov: np.ndarray          # sample covariance (n - 1)


def moments(n: int, shift: np.ndarray, sx: np.ndarray, sxx: np.ndarray) -> Moments:
    """Mean, sample std (exactly zero -> 1) and covariance from the sums of the
    vectors less ``shift``, which is their mean up to rounding (or, for a join,
    the mean of one side)."""
    off = sx / n
    cov = (sxx - n * np.outer(off, off)) / (n - 1) if n > 1 else np.full_like(sxx, np.nan)
    var = np.diag(cov).copy()
    constant = ~(var > 0)
    std = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, var)))
    cov = np.where(constant[:, None] | constant[None, :], 0.0, cov)
    return Moments(n, shift + off, std, constant, cov)


def moments_of(row, p: int) -> Moments:
    """Moments of a collected ``gram`` row with ``p`` features."""
    return moments(int(row["n"]), np.array(row["shift"]), row["sx"].toArray(),
                   _unpack(row["sxx"].toArray(), p))


def standardized_cov(m: Moments) -> np.ndarray:
    """Covariance of the standardised matrix (the correlation matrix, with
    zero rows and columns for constant features)."""
    return m.cov / np.outer(m.std, m.std)


def _sign_fix(vectors: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Make the largest absolute entry of each column positive (ties: first
    name in sort order)."""
    out = vectors.copy()
    order = np.argsort(np.asarray(names, dtype=object), kind="stable")
    for c in range(out.shape[1]):
        col = out[order, c]
        if col.size == 0:
            continue
        top = np.max(np.abs(col))
        first = int(np.argmax(np.isclose(np.abs(col), top, rtol=1e-9, atol=1e-15)))
        if col[first] < 0:
            out[:, c] = -out[:, c]
    return out


# ------------------------------------------------------------------- PCA
@dataclass
class PCAFit:
    dataset: str
    features: list[str]
    moments: Moments
    eigenvalues: np.ndarray      # all min(n, p), descending
    loadings: np.ndarray         # p × k


def _collect_features(feats: Features) -> dict[str, list[str]]:
    rows = feats.features.select(feats.dataset, "idx", F.col(feats.features.columns[1])
                                 .alias("f")).collect()
    out: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        out.setdefault(r[0], []).append((r[1], r[2]))
    names = {k: [f for _, f in sorted(v)] for k, v in out.items()}
    for k, v in names.items():
        if len(v) > MAX_FEATURES:
            raise ValueError(f"{k}: {len(v)} features exceed MAX_FEATURES={MAX_FEATURES}; "
                             "raise min_total or MAX_FEATURES")
    return names


def fit_pca(feats: Features, n_components: int = 4,
            datasets: Sequence[str] | None = None) -> dict[str, PCAFit]:
    """M4 + M5: per dataset, eigen-decomposition of the standardised
    covariance; loadings signed so the largest entry is positive.

    ``datasets`` restricts the fit to those slices (F5): an unknown or empty
    one raises ``ValueError``.  By default every dataset is fitted from the
    same grouped job.
    """
    names = _collect_features(feats)
    vectors = feats.vectors
    if datasets is not None:
        missing = sorted(set(datasets) - set(names))
        if missing:
            raise ValueError(f"Unknown dataset_id: {', '.join(missing)}")
        vectors = vectors.where(F.col(feats.dataset).isin(*datasets))
    sums = gram(vectors, [feats.dataset]).collect()
    fits = {}
    for r in sums:
        ds, n = r[feats.dataset], int(r["n"])
        f = names[ds]
        p = len(f)
        m = moments_of(r, p)
        c = standardized_cov(m)
        vals, vecs = np.linalg.eigh(c)
        order = np.argsort(-vals, kind="stable")
        vals, vecs = vals[order], vecs[:, order]
        rank = min(n, p)
        k = min(n_components, rank)
        vals = np.clip(vals[:rank], 0.0, None)
        fits[ds] = PCAFit(ds, f, m, vals, _sign_fix(vecs[:, :k], f))
    return fits


def explained_variance(spark, fits: dict[str, PCAFit], dataset: str = "dataset_id"
                       ) -> DataFrame:
    """Explained variance ratio of every component and its running total."""
    rows = []
    for ds, fit in fits.items():
        total = fit.eigenvalues.sum()
        for i, v in enumerate(fit.eigenvalues):
            rows.append((ds, i + 1, f"PC{i + 1}", float(v / total) if total > 0 else None))
    df = spark.createDataFrame(rows, f"{dataset} string, component_index int, component string, "
                               "explained_variance_ratio double")
    w = (Window.partitionBy(dataset).orderBy("component_index")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("cumulative_variance_ratio", F.sum("explained_variance_ratio").over(w))


def loadings_frame(spark, fits: dict[str, PCAFit], dataset: str = "dataset_id",
                   feature: str = "candidate", prefix: str = "PC") -> DataFrame:
    """Loadings: one row per (dataset, feature), one column per component."""
    k = max((f.loadings.shape[1] for f in fits.values()), default=0)
    rows = []
    for ds, fit in fits.items():
        for j, name in enumerate(fit.features):
            vals = [float(fit.loadings[j, c]) if c < fit.loadings.shape[1] else None
                    for c in range(k)]
            rows.append((ds, name, *vals))
    schema = T.StructType([T.StructField(dataset, T.StringType()),
                           T.StructField(feature, T.StringType())] +
                          [T.StructField(f"{prefix}{c + 1}", T.DoubleType()) for c in range(k)])
    return spark.createDataFrame(rows, schema)


def _weights_table(spark, dataset: str, per_ds: dict[str, tuple[np.ndarray, np.ndarray]]
                   ) -> DataFrame:
    """(dataset, w: k arrays of p weights, off: k offsets) for scoring.

    score_c = Σ_j x_j w_jc - off_c with w = v / std and off = Σ_j mean_j w_jc.
    Built on the driver from p × k matrices, so its size is known: it is
    broadcast.
    """
    rows = []
    for ds, (w, off) in per_ds.items():
        rows.append((ds, [[float(v) for v in w[:, c]] for c in range(w.shape[1])],
                     [float(v) for v in off]))
    return F.broadcast(spark.createDataFrame(
        rows, f"{dataset} string, __w array<array<double>>, __off array<double>"))


def _dot(x, w):
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def score(vectors: DataFrame, dataset: str, weights: DataFrame, k: int, prefix: str,
          keep: Sequence[str], suffix: str = "") -> DataFrame:
    joined = vectors.join(weights, [dataset])
    cols = [F.col(c) for c in keep]
    for c in range(k):
        val = F.when(F.size("__w") > c, _dot(F.col("x"), F.element_at("__w", c + 1))
                     - F.element_at("__off", c + 1))
        cols.append(val.alias(f"{prefix}{c + 1}{suffix}"))
    return joined.select(*cols)


def pca_scores(spark, feats: Features, fits: dict[str, PCAFit], prefix: str = "PC"
               ) -> DataFrame:
    """M6: scores Z·V for every station row, with its station columns."""
    per_ds = {}
    k = 0
    for ds, fit in fits.items():
        w = fit.loadings / fit.moments.std[:, None]
        w[fit.moments.constant, :] = 0.0
        per_ds[ds] = (w, fit.moments.mean @ w)
        k = max(k, w.shape[1])
    weights = _weights_table(spark, feats.dataset, per_ds)
    return score(feats.vectors, feats.dataset, weights, k, prefix,
                 [feats.dataset, *feats.stations])


def top_loadings(loadings: DataFrame, dataset: str = "dataset_id", feature: str = "candidate",
                 n: int = 8, prefix: str = "PC") -> DataFrame:
    """Per component, the n features with the largest absolute loading."""
    comps = [c for c in loadings.columns if c.startswith(prefix)]
    long = loadings.select(dataset, feature, F.explode(F.array(*[
        F.struct(F.lit(c).alias("component"), F.col(c).alias("loading")) for c in comps
    ])).alias("s")).select(dataset, feature, "s.component", "s.loading").where(
        F.col("loading").isNotNull())
    w = Window.partitionBy(dataset, "component").orderBy(F.abs("loading").desc(), feature)
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def group_summary(scores: DataFrame, group: str, station: str, registered: str | None,
                  dataset: str = "dataset_id") -> DataFrame:
    """A5: per (dataset, area): mean PC1, mean PC2 (null if absent), distinct
    stations, mean registered; null areas dropped; sorted."""
    pc2 = F.avg("PC2") if "PC2" in scores.columns else F.lit(None).cast("double")
    aggs = [F.avg("PC1").alias("PC1"), pc2.alias("PC2"),
            F.countDistinct(station).alias("polling_stations")]
    if registered:
        aggs.append(F.avg(registered).alias("mean_registered"))
    return (scores.where(F.col(group).isNotNull()).groupBy(dataset, group).agg(*aggs)
            .orderBy(dataset, group))


# ------------------------------------------------------------------- CCA
@dataclass
class CCAFit:
    left: str
    right: str
    n: int
    x_features: list[str]
    y_features: list[str]
    correlations: np.ndarray
    degenerate: np.ndarray
    wx: np.ndarray
    wy: np.ndarray
    mx: Moments
    my: Moments


def cca_sums(left: DataFrame, right: DataFrame, key: str) -> dict:
    """Sums over the joined rows without building the joined rows.

    Each side is shifted by its own mean first, which the sums do not mind.

    For a key with a left rows and b right rows the join holds a·b rows; their
    sums are b·Σx, a·Σy, b·Σxxᵀ, a·Σyyᵀ and Σx Σyᵀ.  So each side is summed
    per key first (combine on the map side), the per-key sums are joined one
    to one, and a weighted sum finishes.
    """
    one = F.lit("side").alias("__side")
    left = centred(left.withColumn("__side", one), ["__side"]).withColumnRenamed("shift", "mx")
    right = centred(right.withColumn("__side", one), ["__side"]).withColumnRenamed("shift", "my")
    ls = (left.groupBy(key).agg(F.count(F.lit(1)).alias("a"), F.first("mx").alias("mx"),
                                Summarizer.sum(array_to_vector("x")).alias("sx"),
                                Summarizer.sum(array_to_vector(_outer_packed(F.col("x"))))
                                .alias("sxx")))
    rs = (right.groupBy(key).agg(F.count(F.lit(1)).alias("b"), F.first("my").alias("my"),
                                 Summarizer.sum(array_to_vector("x")).alias("sy"),
                                 Summarizer.sum(array_to_vector(_outer_packed(F.col("x"))))
                                 .alias("syy")))
    j = ls.join(rs, [key])
    sx, sy = vector_to_array("sx"), vector_to_array("sy")
    # Grouped on a constant: no joined key -> no row (a global aggregate would
    # ask an empty Summarizer for its sum).
    res = j.groupBy(F.lit(1).alias("__g")).agg(
        F.sum(F.col("a") * F.col("b")).alias("n"), F.first("mx").alias("mx"),
        F.first("my").alias("my"),
        Summarizer.sum(F.col("sx"), F.col("b").cast("double")).alias("tot_x"),
        Summarizer.sum(F.col("sy"), F.col("a").cast("double")).alias("tot_y"),
        Summarizer.sum(F.col("sxx"), F.col("b").cast("double")).alias("tot_xx"),
        Summarizer.sum(F.col("syy"), F.col("a").cast("double")).alias("tot_yy"),
        Summarizer.sum(array_to_vector(_cross(sx, sy))).alias("tot_xy")).collect()
    if not res or not res[0]["n"]:
        return {"n": 0}
    tot = res[0]
    return {"n": int(tot["n"]), "mx": np.array(tot["mx"]), "my": np.array(tot["my"]), "Sx": tot["tot_x"].toArray(), "Sy": tot["tot_y"].toArray(),
            "Sxx": tot["tot_xx"].toArray(), "Syy": tot["tot_yy"].toArray(),
            "Sxy": tot["tot_xy"].toArray()}


def _inv_sqrt(s: np.ndarray, ridge: float):
    vals, vecs = np.linalg.eigh(s)
    return vecs @ np.diag(1.0 / np.sqrt(np.maximum(vals, ridge))) @ vecs.T, vals, vecs


def solve_cca(sums: dict, x_features: list[str], y_features: list[str], n_components: int,
              ridge: float, left: str, right: str) -> CCAFit:
    """M7 + M8 on the driver: whitened cross-covariance, SVD, weights."""
    n = sums["n"]
    if n == 0:
        raise ValueError(f"No common stations between {left} and {right}")
    p, q = len(x_features), len(y_features)
    mx = moments(n, sums["mx"], sums["Sx"], _unpack(sums["Sxx"], p))
    my = moments(n, sums["my"], sums["Sy"], _unpack(sums["Syy"], q))
    sxx = standardized_cov(mx) + ridge * np.eye(p)
    syy = standardized_cov(my) + ridge * np.eye(q)
    cross = sums["Sxy"].reshape(p, q) - np.outer(sums["Sx"], sums["Sy"]) / n
    cross[mx.constant, :] = 0.0
    cross[:, my.constant] = 0.0
    sxy = cross / (n - 1) / np.outer(mx.std, my.std)
    ix, ex, vx = _inv_sqrt(sxx, ridge)
    iy, ey, vy = _inv_sqrt(syy, ridge)
    u, corr, vt = np.linalg.svd(ix @ sxy @ iy, full_matrices=False)
    k = min(n_components, len(corr))
    wx, wy = ix @ u[:, :k], iy @ vt.T[:, :k]
    # A direction is degenerate when most of it lies where Sxx or Syy is
    # (numerically) singular: its weights are then ridge artefacts.
    small_x, small_y = ex <= 10 * ridge, ey <= 10 * ridge
    frac_x = ((vx.T @ u[:, :k]) ** 2)[small_x].sum(axis=0)
    frac_y = ((vy.T @ vt.T[:, :k]) ** 2)[small_y].sum(axis=0)
    degenerate = (frac_x > 0.5) | (frac_y > 0.5)
    # Flip both sides together so the largest left weight is positive.
    fixed_x = _sign_fix(wx, x_features)
    signs = np.where(np.isclose(fixed_x, wx).all(axis=0), 1.0, -1.0)
    return CCAFit(left, right, n, x_features, y_features, corr[:k],
                  degenerate, wx * signs, wy * signs, mx, my)


def fit_cca(feats: Features, pairs: Sequence[tuple[str, str]], key: str = "id_bvote",
            n_components: int = 3, ridge: float = fixed.CCA_RIDGE) -> dict:
    """CCA of each (left, right) dataset pair, joined on ``key``."""
    names = _collect_features(feats)
    fits = {}
    for left, right in pairs:
        if left not in names or right not in names:
            raise ValueError(f"Unknown dataset in pair ({left}, {right})")
        lv = feats.vectors.where(F.col(feats.dataset) == left)
        rv = feats.vectors.where(F.col(feats.dataset) == right)
        sums = cca_sums(lv, rv, key)
        fits[(left, right)] = solve_cca(sums, names[left], names[right], n_components, ridge,
                                        left, right)
    return fits


def cca_correlations(spark, fits: dict) -> DataFrame:
    rows = []
    for (left, right), f in fits.items():
        for c, v in enumerate(f.correlations):
            rows.append((left, right, f.n, f"CC{c + 1}", float(v), bool(f.degenerate[c])))
    return spark.createDataFrame(rows, "left_election string, right_election string, "
                                 "common_polling_stations long, component string, "
                                 "canonical_correlation double, is_degenerate boolean")


def cca_weights(spark, fits: dict, feature: str = "candidate") -> DataFrame:
    rows = []
    for (left, right), f in fits.items():
        for side, names, w in (("x", f.x_features, f.wx), ("y", f.y_features, f.wy)):
            for j, name in enumerate(names):
                for c in range(w.shape[1]):
                    rows.append((left, right, side, name, f"CC{c + 1}", float(w[j, c])))
    return spark.createDataFrame(rows, f"left_election string, right_election string, "
                                 f"side string, {feature} string, component string, "
                                 "weight double")


def cca_scores(spark, feats: Features, fits: dict, key: str = "id_bvote",
               area: str = "num_arrond") -> DataFrame:
    """M9: canonical variates of the station rows that take part in the match.

    A joined pair's left variate depends only on its left row and its right
    variate only on its right row, so each side is scored on its own rows
    (``side`` = left / right) for the keys present on both sides.  The pair
    table is their join on ``key``; it is not built here, because a key
    repeated a and b times would turn into a·b rows.
    """
    out = None
    for (left, right), f in fits.items():
        lv = feats.vectors.where(F.col(feats.dataset) == left)
        rv = feats.vectors.where(F.col(feats.dataset) == right)
        for ds, w, m, side, mine, other in ((left, f.wx, f.mx, "left", lv, rv),
                                            (right, f.wy, f.my, "right", rv, lv)):
            ww = w / m.std[:, None]
            ww[m.constant, :] = 0.0
            weights = _weights_table(spark, feats.dataset, {ds: (ww, m.mean @ ww)})
            matched = mine.join(other.select(key).distinct(), [key], "left_semi")
            keep = [key] + [c for c in feats.stations if c != key and c == area]
            s = score(matched, feats.dataset, weights, w.shape[1], "CC", keep)
            s = s.select(F.lit(left).alias("left_election"),
                         F.lit(right).alias("right_election"), F.lit(side).alias("side"),
                         *s.columns)
            out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def feature_stats(feats: Features) -> DataFrame:
    """Per (dataset, feature) mean and sample std (zero -> 1) over all
    station rows, absent values counted as 0; computed on the executors."""
    exploded = feats.vectors.select(feats.dataset, F.posexplode("x").alias("idx", "v"))
    stats = (exploded.groupBy(feats.dataset, "idx")
             .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")))
    stats = stats.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0))
                             .otherwise(F.col("std")))
    return stats.join(feats.features, [feats.dataset, "idx"]).drop("idx", "total")
