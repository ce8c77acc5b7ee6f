"""Connected components of an edge table, by alternating large-star and small-star steps. As many edges
as one task holds in little memory are joined there, for each step takes five jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wordloom.llm.common import discard, materialize

#: Most edges (16 bytes each) that one task joins.
FEW_EDGES = 500_000


def _least_neighbour(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) of a table with m, the least of u and its neighbours; and the table of these.
    Partial sums come first. They are written, so that the join has a stage of its own, which
    Spark can split where one node has very many edges."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u").withColumn("m", F.least("m", "u")), least


def _told(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The table of some edges, and its number of rows and sum of hashes, seen while it is written."""
    seen = Observation()
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes))
    return table, seen.get


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and for each the least node that it is linked with or itself."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [np.column_stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    if edges:
        out = pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(*np.concatenate(edges).T)], ["node", "component"])
        for at in range(0, out.num_rows, 50_000):
            yield out.slice(at, 50_000)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v): the least node it is linked with,
    directly or through others. Self-loops and repeated edges don't matter. No row, no result."""
    now, state = _told(edges.where("u <> v").select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")).distinct())
    if state["n"] <= FEW_EDGES:
        out = materialize(now.coalesce(1).mapInArrow(_joined, "node bigint, component bigint"))
        discard(now)
        return out
    before = None
    while state != before and state["n"]:
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, first = _least_neighbour(both)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        seen, second = _least_neighbour(large)
        small = seen.select("u", "m").unionAll(seen.select("v", "m")).toDF("u", "v").where("u <> v")
        after, state = _told(small.distinct())
        for table in (now, first, large, second):
            discard(table)
        now = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(nodes.select("component", "component").distinct())
