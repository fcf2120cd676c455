"""Sparse wide form above the pivot limit, and PCA above the dense bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reshape as R
from tallyspark.operators import sparse as SP
from tallyspark.operators import stats as ST
from tallyspark.operators import subspace as SU

NAMES = 12_000  # above spark.sql.pivotMaxValues


def test_sparse_wide_above_the_pivot_limit(spark, tmp_path):
    long = spark.range(40_000).select(
        (F.col("id") % 7).cast("string").alias("id_bvote"),
        F.concat(F.lit("M. N"), (F.col("id") % NAMES).cast("string")).alias("candidate"),
        (F.col("id") % 5).cast("double").alias("v"))
    with pytest.raises(ValueError, match="exceeds"):
        R.pivot_sum(long, ["id_bvote"], "candidate", "v")
    wide = SP.sparse_wide(long, ["id_bvote"], "candidate", "v")
    names = {r.candidate: r.position for r in wide.names.collect()}
    assert [n for n, _ in sorted(names.items(), key=lambda x: x[1])] == sorted(names)
    assert sorted(names.values()) == list(range(NAMES))
    want = {(r.id_bvote, r.candidate): r.v for r in
            long.groupBy("id_bvote", "candidate").agg(F.sum("v").alias("v")).collect()}
    path = wide.write(str(tmp_path / "wide"))
    again = SP.read_sparse(spark, path)
    assert {(r.id_bvote, r.candidate): r.value for r in again.cells().collect()} == want
    some = ["M. N5", "M. N11999", "nobody"]
    for r in again.columns(some).collect():
        assert [r[c] for c in some] == [want.get((r.id_bvote, c), 0.0) for c in some]
    check = SP.sparse_range_check(again).first()
    assert (check.wide_rows, check.wide_columns, check.wide_duplicate_index_rows) == (7, NAMES + 1, 0)
    assert check.wide_cells_above_one == sum(v > 1 + 1e-9 for v in want.values())


def test_sparse_wide_nulls_and_copies(spark):
    rows = [(None, "Dupont", 0.5), (None, "DUPONT", 0.25), ("a", None, 0.5), ("b", "Dupont", None),
            ("b", "Dupont", -0.5), ("c", "x", float("nan"))]
    long = spark.createDataFrame(rows, "k string, candidate string, v double")
    wide = SP.sparse_wide(long, ["k"], "candidate", "v")
    got = {r.k: (r.positions, r["values"]) for r in wide.rows.collect()}
    assert got == {None: ([0, 1], [0.25, 0.5]), "a": ([], []), "b": ([1], [-0.5]), "c": ([2], [0.0])}
    twice = SP.SparseWide(wide.rows.unionAll(wide.rows.where("k = 'b'")), wide.names, ("k",), "candidate")
    check = SP.sparse_range_check(twice).first()
    assert (check.wide_rows, check.wide_duplicate_index_rows, check.wide_cells_below_zero) == (5, 1, 2)
    empty = SP.sparse_wide(long.limit(0), ["k"], "candidate", "v")
    assert empty.rows.count() == 0 and SP.sparse_range_check(empty).first().wide_rows == 0


def cells_of(spark, x):
    rows = [(f"s{i:04d}", f"f{j:04d}", float(v)) for i, line in enumerate(x)
            for j, v in enumerate(line) if v != 0]
    return spark.createDataFrame(rows, "row string, feature string, v double")


def dense(x, k):
    std = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(std > 0, std, 1)
    z[:, np.ptp(x, axis=0) == 0] = 0
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    top = np.abs(vt[:k]).argmax(axis=1)
    vt = vt[:k] * np.sign(vt[np.arange(k), top])[:, None]
    return s[:k] ** 2 / (len(x) - 1), vt.T, z @ vt.T


def check_fit(fit, x, k, atol):
    values, loadings, scores = dense(x, k)
    np.testing.assert_allclose(fit.eigenvalues, values, rtol=1e-8)
    pcs = [f"PC{i + 1}" for i in range(k)]
    got = fit.loadings.orderBy("feature").toPandas()
    held = [int(f[1:]) for f in got.feature]
    np.testing.assert_allclose(got[pcs].to_numpy(), loadings[held], atol=atol)
    got = fit.scores.orderBy("row").toPandas()
    held = [int(s[1:]) for s in got.row]
    np.testing.assert_allclose(got[pcs].to_numpy(), scores[held], atol=atol * 100)


def test_pca_above_the_dense_bound(spark):
    random = np.random.default_rng(11)
    n, p, k = 60, 3000, 3
    factors = random.normal(size=(n, 4)) * [6, 4, 2.5, 1.5]
    x = factors @ random.normal(size=(4, p)) + random.normal(size=(n, p))
    x[random.random((n, p)) < 0.5] = 0
    x[:, 5] = 0.25
    assert p > ST.MAX_FEATURES
    fit = SU.subspace_pca(cells_of(spark, x), "row", "feature", "v", k)
    assert fit.n_features == p and fit.total_variance == p - 1
    check_fit(fit, x, k, 1e-5)


def test_pca_small_cases(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(30, 6)) * (random.random((30, 6)) < 0.6)
    x[4] = 0
    x[:, 2] = x[:, 1] * 2  # one direction less
    fit = SU.subspace_pca(cells_of(spark, x), "row", "feature", "v", 3, n_rows=30)
    check_fit(fit, x, 3, 1e-6)
    flat = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 1.0)], "row string, feature string, v double")
    with pytest.raises(ValueError):
        SU.subspace_pca(flat, "row", "feature", "v", 1)
