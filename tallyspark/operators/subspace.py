"""PCA for any number of features: subspace iteration on sparse cells.

The dense fit in ``stats`` builds a p x p matrix; here nothing of size p reaches the
driver.  Z is the standardised station matrix (absent cells are 0 before centring).  A
basis V (features x m, m a few more than the components asked for) is multiplied by
Zᵀ Z again and again: cells meet V by feature and are summed per station, then meet
that result by station and are summed per feature.  Z is never filled in: with cells
s = x / std, Z V = S V - 1 tᵀ where t are m sums over features, and as the columns of Z
sum to 0, Zᵀ Y = Sᵀ Y.

Each round's basis is made orthonormal from its m x m Gram matrix (sums combined in
the cluster as a tree; factored on the driver), twice, so that the squared condition
of the first pass does no harm.  Rounds end when the leading values stand still.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import ensure_checkpoint_dir

#: Basis vectors beyond the components asked for.
EXTRA = 8


@dataclass
class SubspacePCA:
    """``eigenvalues`` of the k components, the sum of all eigenvalues
    (``total_variance``: one per feature that varies), loadings (feature, PC1..) and
    scores (row, PC1..) as DataFrames."""

    eigenvalues: np.ndarray
    total_variance: float
    n_rows: int
    n_features: int
    iterations: int
    loadings: DataFrame
    scores: DataFrame


def _names(m: int, letter: str) -> list[str]:
    return [f"{letter}{i}" for i in range(m)]


def _inner(df: DataFrame, a: list[str], b: list[str]) -> list[np.ndarray]:
    """aᵀ b and bᵀ b of two column groups, summed in the cluster."""
    pairs = [(x, y) for x in a for y in b] + [(x, y) for x in b for y in b]
    sums = df.agg(*[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(f"s{i}")
                    for i, (x, y) in enumerate(pairs)]).first()
    values = np.array(list(sums), float)
    m = len(b)
    return [values[:len(a) * m].reshape(len(a), m), values[len(a) * m:].reshape(m, m)]


def _turned(df: DataFrame, keep: list[str], columns: list[str], by: np.ndarray, out: list[str]
            ) -> DataFrame:
    """Columns times a small matrix."""
    def mix(weights):
        total = F.lit(0.0)
        for c, w in zip(columns, weights):
            total = total + F.col(c) * F.lit(float(w))
        return total
    return df.select(*keep, *[mix(by[:, i]).alias(o) for i, o in enumerate(out)])


def _whitener(gram: np.ndarray) -> np.ndarray:
    """R with (W R)ᵀ (W R) = 1; directions that vanish are left out."""
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(), 0.0) * 1e-14
    return vectors[:, good] / np.sqrt(values[good])


def _standardised(cells: DataFrame, row: str, feature: str, value: str, n_rows: int | None):
    """(cells (row, feature, s), features (feature, c, varies), number of rows)."""
    summed = cells.groupBy(row, feature).agg(
        F.coalesce(F.sum(X.finite_or_null(value)), F.lit(0.0)).alias("__x"))
    summed = summed.where(F.col(feature).isNotNull()).checkpoint()
    n = n_rows if n_rows is not None else summed.select(row).distinct().count()
    first = summed.groupBy(feature).agg(
        F.count(F.lit(1)).alias("__k"), (F.sum("__x") / n).alias("__mean"),
        F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    spread = summed.join(first, feature).groupBy(feature).agg(
        F.first("__mean").alias("__mean"), F.first("__k").alias("__k"),
        F.sum((F.col("__x") - F.col("__mean")) ** 2).alias("__sq"),
        F.min("__min").alias("__min"), F.max("__max").alias("__max"))
    filled = F.col("__sq") + (n - F.col("__k")) * F.col("__mean") ** 2
    same = (F.col("__min") == F.col("__max")) & ((F.col("__k") == n) | (F.col("__min") == 0))
    std = F.sqrt(filled / max(n - 1, 1))
    scale = F.when(~same & (std > 0), 1 / std).otherwise(F.lit(0.0))
    features = spread.select(feature, scale.alias("__w"),
                             (F.col("__mean") * scale).alias("__c")).checkpoint()
    scaled = (summed.join(features.where("__w > 0"), feature)
              .select(row, feature, (F.col("__x") * F.col("__w")).alias("__s"))
              .where("__s <> 0").checkpoint())
    return summed, scaled, features, n


def subspace_pca(cells: DataFrame, row: str, feature: str, value: str, n_components: int = 4,
                 n_rows: int | None = None, tolerance: float = 1e-12, max_rounds: int = 100
                 ) -> SubspacePCA:
    """The leading components of the standardised matrix of ``cells`` (row, feature,
    value): absent or null values are 0, repeated cells are summed, a feature that does
    not vary has loading 0.

    ``n_rows`` counts rows without cells too (default: the rows present).  Signs as in
    the dense fit: the largest loading in absolute value is positive, ties go to the
    first name.  Fewer than two rows, or no feature that varies: ``ValueError``.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    summed, scaled, features, n = _standardised(cells, row, feature, value, n_rows)
    moving = features.where("__w > 0")
    p, varying = features.count(), moving.count()
    if n < 2 or not varying:
        raise ValueError("no variation to decompose")
    m = min(n_components + EXTRA, varying, n)
    k = min(n_components, m)
    v = _names(m, "v")
    basis = moving.select(feature, "__c", *[
        (F.pmod(F.xxhash64(F.col(feature), F.lit(i)), F.lit(1 << 20)) / (1 << 19) - 1).alias(c)
        for i, c in enumerate(v)])
    basis, v = _orthonormal(basis, [feature, "__c"], v, "v")
    last, rounds = None, 0
    while True:
        rounds += 1
        w = _names(len(v), "w")
        onto = _project(scaled, basis, row, feature, v, _names(len(v), "y"))
        back = (scaled.join(onto, row).groupBy(feature).agg(*[
            F.sum(F.col("__s") * F.col(f"y{i}")).alias(c) for i, c in enumerate(w)]))
        both = basis.join(back, feature).checkpoint()
        ritz, gram = _inner(both, v, w)
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        lead = values[:k]
        if (last is not None and len(last) == len(lead)
                and np.all(np.abs(lead - last) <= tolerance * max(lead[0], 1e-300))
                or rounds >= max_rounds):
            break
        last = lead
        white = _whitener(gram)
        v = _names(white.shape[1], "v")
        turned = _turned(both, [feature, "__c"], w, white, v)
        basis, v = _orthonormal(turned, [feature, "__c"], v, "v")
    return _result(summed, scaled, features, both, row, feature, v, values, turn, k, n, p,
                   varying, rounds)


def _orthonormal(basis: DataFrame, keep: list[str], v: list[str], letter: str
                 ) -> tuple[DataFrame, list[str]]:
    basis = basis.checkpoint()
    _, gram = _inner(basis, [], v)
    white = _whitener(gram)
    out = _names(white.shape[1], letter)
    return _turned(basis, keep, v, white, out).checkpoint(), out


def _project(scaled: DataFrame, basis: DataFrame, row: str, feature: str, v: list[str],
             out: list[str]) -> DataFrame:
    """Z V for the rows that have cells."""
    t = basis.agg(*[F.sum(F.col("__c") * F.col(c)) for c in v]).first()
    return scaled.join(basis, feature).groupBy(row).agg(*[
        (F.sum(F.col("__s") * F.col(c)) - F.lit(float(t[i]))).alias(o)
        for i, (c, o) in enumerate(zip(v, out))])


def _result(summed, scaled, features, both, row, feature, v, values, turn, k, n, p, varying,
            rounds) -> SubspacePCA:
    k = min(k, len(values))
    pcs = [f"PC{i + 1}" for i in range(k)]
    loads = _turned(both, [feature, "__c"], v, turn[:, :k], pcs).checkpoint()
    # largest |loading|, the first name of equal ones
    signs = loads.agg(*[F.min(F.struct(
        (-F.round(F.abs(c), 12)).alias("size"), F.col(feature).alias("name"),
        F.signum(c).alias("sign")))["sign"].alias(c) for c in pcs])
    sign = np.array([s or 1.0 for s in signs.first()])
    flipped = _turned(loads, [feature, "__c"], pcs, np.diag(sign), pcs).checkpoint()
    scores = _project(scaled, flipped, row, feature, pcs, pcs)
    t = flipped.agg(*[F.sum(F.col("__c") * F.col(c)) for c in pcs]).first()
    present = summed.select(row).distinct()  # rows whose cells are all 0 project to -t
    scores = present.join(scores, row, "left").select(row, *[
        F.coalesce(F.col(c), F.lit(-float(t[i]))).alias(c) for i, c in enumerate(pcs)])
    loadings = features.select(feature).join(flipped.drop("__c"), feature, "left").select(
        feature, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in pcs])
    return SubspacePCA(np.clip(values[:k], 0, None) / (n - 1), float(varying), n, p, rounds,
                       loadings, scores)
