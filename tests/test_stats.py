"""PCA / CCA against a dense numpy brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest

from tallyspark.operators import stats as ST


def _long_from_matrix(spark, X, ds="d", names=None, ids=None, areas=None):
    n, p = X.shape
    names = names or [f"f{j}" for j in range(p)]
    ids = ids or [str(i) for i in range(n)]
    areas = areas or [str(i % 3) for i in range(n)]
    rows = [(ds, ids[i], areas[i], names[j], float(X[i, j]))
            for i in range(n) for j in range(p) if X[i, j] != 0]
    return spark.createDataFrame(rows, "dataset_id string, id_bvote string, num_arrond string, "
                                 "candidate string, v double")


def _brute_pca(X):
    mean = X.mean(axis=0)
    std = X.std(axis=0, ddof=1)
    std[std == 0] = 1.0
    Z = (X - mean) / std
    U, s, Vt = np.linalg.svd(Z, full_matrices=False)
    ev = s ** 2 / (len(Z) - 1)
    return ev / ev.sum(), Vt.T, U * s


def test_pca_matches_dense_svd(spark):
    rng = np.random.default_rng(0)
    X = rng.random((40, 5))
    X[:, 2] = X[:, 0] * 2 + 0.1 * rng.random(40)
    long = _long_from_matrix(spark, X)
    feats = ST.feature_vectors(long, "dataset_id", ["id_bvote", "num_arrond"], "candidate", "v",
                               min_total=0.0)
    fits = ST.fit_pca(feats, n_components=3)
    ratio, V, scores = _brute_pca(X)
    fit = fits["d"]
    got = fit.eigenvalues / fit.eigenvalues.sum()
    np.testing.assert_allclose(got, ratio, atol=1e-10)
    for c in range(3):
        assert abs(abs(np.dot(fit.loadings[:, c], V[:, c])) - 1) < 1e-8
    sc = ST.pca_scores(spark, feats, fits).toPandas().sort_values(
        "id_bvote", key=lambda s: s.astype(int))
    for c in range(3):
        a = sc[f"PC{c + 1}"].to_numpy()
        b = scores[:, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    ev = ST.explained_variance(spark, fits).orderBy("component_index").toPandas()
    assert abs(ev.explained_variance_ratio.sum() - 1) < 1e-12
    np.testing.assert_allclose(ev.cumulative_variance_ratio.iloc[-1], 1.0)


@pytest.mark.parametrize("offset", [1e3, 1e5, 1e7])
def test_pca_of_columns_far_from_zero(spark, offset):
    rng = np.random.default_rng(3)
    a, b = offset + rng.random(200), rng.random(200)
    X = np.c_[a, b, 2 * a + 0.01 * rng.random(200), np.full(200, 0.1)]
    long = _long_from_matrix(spark, X)
    feats = ST.feature_vectors(long, "dataset_id", ["id_bvote", "num_arrond"], "candidate", "v",
                               min_total=0.0)
    m = ST.fit_pca(feats)["d"]
    Z = (X - X.mean(axis=0)) / np.where(np.ptp(X, axis=0) == 0, 1, X.std(axis=0, ddof=1))
    Z[:, 3] = 0
    want = np.linalg.svd(Z, compute_uv=False) ** 2 / 199
    np.testing.assert_allclose(m.eigenvalues, want, atol=1e-6)
    assert m.moments.constant.tolist() == [False, False, False, True]
    std = {r.candidate: r.std for r in ST.feature_stats(feats).collect()}
    np.testing.assert_allclose(m.moments.std, [std[f] for f in m.features], rtol=1e-7)


def test_pca_two_features_closed_form(spark):
    rng = np.random.default_rng(1)
    a = rng.random(30)
    X = np.c_[a, a + rng.random(30)]
    r = np.corrcoef(X.T)[0, 1]
    feats = ST.feature_vectors(_long_from_matrix(spark, X), "dataset_id",
                               ["id_bvote"], "candidate", "v", min_total=0.0)
    fit = ST.fit_pca(feats, 2)["d"]
    ratio = fit.eigenvalues / fit.eigenvalues.sum()
    np.testing.assert_allclose(sorted(ratio), sorted([(1 + abs(r)) / 2, (1 - abs(r)) / 2]))
    np.testing.assert_allclose(np.abs(fit.loadings), 2 ** -0.5, atol=1e-12)


def test_pca_constant_column_gets_zero_loading(spark):
    rng = np.random.default_rng(2)
    X = np.c_[rng.random(20), np.full(20, 0.3), rng.random(20)]
    feats = ST.feature_vectors(_long_from_matrix(spark, X), "dataset_id", ["id_bvote"],
                               "candidate", "v", min_total=0.0)
    fit = ST.fit_pca(feats, 3)["d"]
    pos = fit.eigenvalues > 1e-12
    assert np.allclose(fit.loadings[1, : pos.sum()], 0.0)


def _qr_cca(X, Y):
    """Canonical correlations as cosines of the angles between the column spaces."""
    qx, qy = (np.linalg.qr(M - M.mean(axis=0))[0] for M in (X, Y))
    return np.linalg.svd(qx.T @ qy, compute_uv=False)


def test_cca_matches_dense_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    n = 30
    X = rng.random((n, 3))
    Y = np.c_[X[:, 0] + 0.2 * rng.random(n), rng.random(n), X[:, 1] * 0.5 + rng.random(n)]
    ids_x = [str(i) for i in range(n)]
    ids_y = [str(i) for i in range(n)]
    # repeat station 0 on both sides: 2 x 2 = 4 joined rows
    Xr = np.vstack([X, X[:1] * 0.9])
    Yr = np.vstack([Y, Y[:1] * 1.1])
    ids_x.append("0")
    ids_y.append("0")
    # the area tells the repeated rows apart, so they are separate station tuples
    rows_tag = [str(i) for i in range(n + 1)]
    lx = _long_from_matrix(spark, Xr, "L", ["a", "b", "c"], ids_x, rows_tag)
    ly = _long_from_matrix(spark, Yr, "R", ["a", "b", "c"], ids_y, rows_tag)
    long = lx.unionByName(ly)
    feats = ST.feature_vectors(long, "dataset_id", ["id_bvote", "num_arrond"], "candidate",
                               "v", min_total=0.0)
    fit = ST.fit_cca(feats, [("L", "R")], "id_bvote", n_components=3)[("L", "R")]
    # brute force on the materialised join
    px = pd.DataFrame(Xr).assign(k=ids_x)
    py = pd.DataFrame(Yr).assign(k=ids_y)
    j = px.merge(py, on="k")
    assert fit.n == len(j) == n + 3
    c = _qr_cca(j[["0_x", "1_x", "2_x"]].to_numpy(), j[["0_y", "1_y", "2_y"]].to_numpy())
    np.testing.assert_allclose(fit.correlations, c, atol=1e-6)
    assert np.all(np.diff(fit.correlations) <= 1e-12)
    sc = ST.cca_scores(spark, feats, {("L", "R"): fit}).toPandas()
    assert len(sc) == 2 * (n + 1)                  # one row per station row and side
    # the pair table (built here on the small fixture) has unit-variance
    # variates that correlate at the canonical correlation
    pairs = sc[sc.side == "left"].merge(sc[sc.side == "right"], on="id_bvote",
                                        suffixes=("_left", "_right"))
    assert len(pairs) == n + 3
    for i in range(3):
        a, b = pairs[f"CC{i + 1}_left"], pairs[f"CC{i + 1}_right"]
        assert abs(a.std(ddof=1) - 1) < 1e-6
        assert abs(np.corrcoef(a, b)[0, 1] - fit.correlations[i]) < 1e-6


def test_cca_no_common_station_raises(spark):
    X = np.random.default_rng(4).random((5, 2))
    long = _long_from_matrix(spark, X, "L", ids=list("abcde")).unionByName(
        _long_from_matrix(spark, X, "R", ids=list("vwxyz")))
    feats = ST.feature_vectors(long, "dataset_id", ["id_bvote"], "candidate", "v",
                               min_total=0.0)
    with pytest.raises(ValueError, match="No common stations"):
        ST.fit_cca(feats, [("L", "R")], "id_bvote")


def test_cca_degenerate_two_share_blocks(spark):
    rng = np.random.default_rng(5)
    a = rng.random(40)
    b = 0.7 * a + 0.3 * rng.random(40)
    X = np.c_[a, 1 - a]
    Y = np.c_[b, 1 - b]
    ids = [str(i) for i in range(40)]
    long = _long_from_matrix(spark, X, "L", ["p", "q"], ids).unionByName(
        _long_from_matrix(spark, Y, "R", ["p", "q"], ids))
    feats = ST.feature_vectors(long, "dataset_id", ["id_bvote"], "candidate", "v",
                               min_total=0.0)
    fit = ST.fit_cca(feats, [("L", "R")], "id_bvote", n_components=2)[("L", "R")]
    r = abs(np.corrcoef(a, b)[0, 1])
    assert abs(fit.correlations[0] - r) < 1e-6
    assert fit.correlations[1] < 1e-6
    assert not fit.degenerate[0] and fit.degenerate[1]


def test_pca_single_slice_and_unknown(spark):
    rng = np.random.default_rng(8)
    long = _long_from_matrix(spark, rng.random((10, 3)), "A").unionByName(
        _long_from_matrix(spark, rng.random((12, 3)), "B"))
    feats = ST.feature_vectors(long, "dataset_id", ["id_bvote"], "candidate", "v",
                               min_total=0.0)
    assert set(ST.fit_pca(feats, 2, datasets=["B"])) == {"B"}
    with pytest.raises(ValueError, match="Unknown dataset_id"):
        ST.fit_pca(feats, 2, datasets=["Z"])


def test_ballot_vectors_are_built_once(spark):
    """The jobs of a fit start from the vectors, not from the joins that make them."""
    from tallyspark.plans import statistics as P
    vectors = P.ballot_features(spark, "/root/testdata/sf0.001").vectors
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_cca_over_repeated_and_absent_keys(spark):
    from tallyspark.operators import stats as ST
    left = spark.createDataFrame([("1", [1.0, 2.0]), ("1", [2.0, 5.0]), ("2", [0.0, 1.0]), (None, [9.0, 9.0])],
                                 "k string, x array<double>")
    right = spark.createDataFrame([("1", [3.0]), ("2", [1.0]), ("2", [4.0]), ("3", [7.0])], "k string, x array<double>")
    assert ST.cca_sums(left, right, "k")["n"] == 4
