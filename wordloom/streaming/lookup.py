"""Searches for a stream of queries against a built tree: stateless, so any mode of output.

Suggestions need windows over each query's rows, which a stream can't have without state; they
are computed for each micro-batch as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators import search


def lookups(stream: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, expr_index) for a stream of queries: a stream-static join."""
    words = nodes.where("expr_index IS NOT NULL").selectExpr("prefix AS query", "expr_index")
    return stream.join(words, "query", "left")


def answer(stream: DataFrame, nodes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, operator=search.suggestions) -> StreamingQuery:
    """Runs ``operator`` on each micro-batch of (query_id, query) and hands the results to ``sink``."""

    def batch(queries: DataFrame, number: int) -> None:
        sink(operator(nodes, queries), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
