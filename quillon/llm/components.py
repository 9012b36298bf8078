"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) over the nodes of these links, for a batch that fits in memory."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long, not null); root is the least node of its component.

    A link (u, v) is kept with u > v. In a large star every larger neighbour of a node is linked with the least
    one, in a small star every smaller one; both keep the components, and in the end each component is one star.
    A node with very many links is met in aggregates that combine before the shuffle and in joins that can be split.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = scratch.keep(ordered.distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or not mark.n:
            break
        seen = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large)
        lower = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.distinct())
        scratch.drop(edges, least, large, lower)
        edges = new
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
