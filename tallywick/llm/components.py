"""Connected components of an undirected graph by alternating large and small stars.

Each round is two joins over the edges, none of which gathers a node's neighbours; the edges are
written between rounds. The number of rounds grows with the logarithm of the longest path.
A table of at most FEW edges (some megabytes) is settled by one task instead, as rounds of jobs take longer than the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


FEW = 500_000


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each one reaches) of edges (u, v)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        # the roots of both ends of an edge are tied, then paths are halved until all point to roots
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches], strict=True)] or [np.zeros(0, np.int64)] * 2
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_reached(*ends)], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge (a, b)."""
    spark = edges.sparkSession
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_settle, "node long, component long")
    mark = None  # the number of edges and the sum of their hashes
    while True:
        # large star: every larger neighbour of u is tied to the smallest of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "edges")
        # a graph of stars maps to itself
        before, mark = mark, small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        same = before == mark
        for old in (edges, low, large, least):
            forget(spark, old)
        edges = small
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
