"""Join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nullable(df: DataFrame, name: str) -> bool:
    return df.schema[name].nullable


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 how: str = "left", null_safe: bool = True) -> DataFrame:
    """Equi-join on same-named keys; null keys match each other when ``null_safe``.

    When no key can be null on either side a plain ``USING`` join is planned,
    which keeps the existing hash partitioning of an aggregated side.  With
    nullable keys the condition is ``<=>`` per key (still an equi-join for
    Catalyst: sort-merge or broadcast hash).  Output has one copy of each key;
    for full outer joins the key is the non-null side.
    """
    keys = list(keys)
    if not null_safe or not any(_nullable(left, k) or _nullable(right, k) for k in keys):
        return left.join(right, on=keys, how=how)
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in keys else F.col(f"`{c}`")
                             for c in right.columns])
    cond = None
    for k in keys:
        term = F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
        cond = term if cond is None else cond & term
    joined = left.join(renamed, on=cond, how=how)
    out = []
    for c in left.columns:
        if c in keys:
            if how in ("right", "right_outer"):
                out.append(F.col(f"`__r_{c}`").alias(c))
            elif how in ("full", "outer", "full_outer"):
                out.append(F.coalesce(F.col(f"`{c}`"), F.col(f"`__r_{c}`")).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        else:
            out.append(F.col(f"`{c}`"))
    if how not in ("left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        out += [F.col(f"`{c}`") for c in right.columns if c not in keys]
    return joined.select(*out)
