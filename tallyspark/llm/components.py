"""Connected components of an edge table.

Every round has two steps.  Edges are partitioned by their larger end and each
task contracts its own edges to stars around their smallest node; then each star
centre is replaced by its own centre, if it has one (a join, so that a centre
with very many nodes is split like any skewed join side).  Rounds end when
nothing changes; each round's result is staged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage, unstage


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of an edge list: (node, smallest node of its component), centres left out."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[label])
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, root = contract(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component.

    ``edges`` has two long columns; loops, repeated and reversed edges are fine.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    stars = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    stars = stars.where("node <> root")
    seen = last = None
    while True:
        local = (stars.repartition("node").mapInArrow(_contract_part, "node long, root long")
                 .distinct())
        local = stage(local, "stars")
        up = local.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("up"))
        stars = stage(local.join(up, "root", "left")
                      .select("node", F.coalesce("up", "root").alias("root")).distinct(), "stars")
        # A row that repeats a node, or whose root is a node, keeps the rounds going.
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root")
                                                   .cast("decimal(38,0)"))).first()
        unstage(local, *[last] if last is not None else [])
        if state == seen:
            return stars
        seen, last = state, stars
