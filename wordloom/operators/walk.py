"""A tree's nodes in the orders in which a walk meets them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import prefixes
from wordloom.operators.build import node_counts
from wordloom.session import sized, with_rank


def ancestors(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, up, prefix): the nodes above each query that is a node, from its parent (1) on."""
    found = queries.join(nodes.select(F.col("prefix").alias("query")), "query", "left_semi")
    rows = found.select("query", F.explode(prefixes("query")).alias("prefix")).where("prefix <> query")
    return rows.select("query", (F.length("query") - F.length("prefix")).alias("up"), "prefix")


def descendants(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, prefix): each query that is a node and all nodes below it; by prefix they are in
    pre-order."""
    below = nodes.select("prefix", F.explode(prefixes("prefix")).alias("query"))
    return below.join(sized(queries), "query").select("query", "prefix")


def traversal(nodes: DataFrame) -> DataFrame:
    """(step, edge, prefix): the edges `open` and `close` of every node, from step 0 on, as a walk
    over the whole tree goes through them. A node's steps follow from its place in pre-order, its
    depth and the number of nodes below it, so no walk takes place."""
    rows = with_rank(nodes.select("prefix"), [F.col("prefix")], "place").join(node_counts(nodes), "prefix")
    depth = F.length("prefix")
    opened = (2 * F.col("place") - (depth - 1)).alias("step")
    closed = (2 * (F.col("place") + F.col("node_count")) - depth).alias("step")
    return rows.select(opened, F.lit("open").alias("edge"), "prefix").unionAll(rows.select(closed, F.lit("close").alias("edge"), "prefix"))
