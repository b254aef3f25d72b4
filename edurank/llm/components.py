"""Connected components of links too many for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.plans.materialize import materialize

MAX_ROUNDS = 64


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest node, other node) that connect the same nodes as the given ones."""
    if not len(a):
        return a, b
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    others = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[others]], nodes[others]


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, v, m): every link with the smallest node of u's neighbourhood, u included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b); the root is the smallest node of the component.

    Large-star and small-star rounds: each keeps no more links than there were,
    and a hub's links are joined to one row, which a skewed join splits.  A round
    is written to the shared folder, so no lineage grows with the rounds.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _nearest(large)
        turned = materialize(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.where("u <> m").select("u", F.col("m").alias("v")))
            .distinct()
        )
        if _same(edges, turned):
            return turned.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                turned.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        edges = turned
    raise RuntimeError(f"links not settled after {MAX_ROUNDS} rounds")


def _same(one: DataFrame, other: DataFrame) -> bool:
    def mark(edges: DataFrame):
        value = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(edges.select(F.count("*"), F.coalesce(F.sum(value), F.lit(0))).first())

    return mark(one) == mark(other)
