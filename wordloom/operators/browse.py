"""Lookups and browsing of a node table, many queries at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import prefixes


def index_of(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, expr_index) for a column of queries; null for what is no word."""
    words = nodes.select(F.col("prefix").alias("query"), "expr_index")
    return queries.join(words, "query", "left")


def word_of_expr(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(expr_index, word, percentile) for a column of indexes; null for what no word has."""
    words = nodes.where("expr_index IS NOT NULL").select("expr_index", F.col("prefix").alias("word"), "percentile")
    return queries.join(words, "expr_index", "left")


def find(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with their node (`node`, null: none). An empty query stands for the first node of
    the top level."""
    first = nodes.where("parent = ''").agg(F.min("prefix").alias("first"))
    asked = queries.crossJoin(F.broadcast(first)).withColumn("asked", F.expr("IF(query = '', first, query)")).drop("first")
    return asked.join(nodes.select(F.col("prefix").alias("asked"), F.struct("*").alias("node")), "asked", "left")


def _folder_path(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, path): the longest folder among the prefixes of `node`, with a slash. All folders'
    prefixes are folders, so that is the whole path. Null where `node` is no node."""
    folders = nodes.where("is_folder").select("prefix")
    steps = asked.where("node <> ''").select("query", "node", F.explode(prefixes("node")).alias("prefix"))
    depth = steps.join(folders, "prefix", "left_semi").groupBy("query", "node").agg(F.max(F.length("prefix")).alias("n"))
    known = asked.join(nodes.select(F.col("prefix").alias("node"), F.lit(True).alias("is_node")), "node", "left")
    path = F.expr("CASE WHEN node = '' OR is_node THEN concat(substr(node, 1, coalesce(n, 0)), '/') END")
    return known.join(depth, ["query", "node"], "left").select("query", path.alias("path"))


def path_of(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, path) of words in the folder hierarchy. Only the word without its last character
    must be a node; else the path is null."""
    return _folder_path(nodes, queries.select("query", F.expr("substr(query, 1, greatest(length(query) - 1, 0))").alias("node")))


def listings(nodes: DataFrame) -> DataFrame:
    """(prefix, entry) of every node with children, and of the root (prefix ''): sub-folders as
    `x/`, and words that no folder between holds as `x.`."""
    folders = nodes.where("is_folder").select(F.col("parent").alias("prefix"), F.concat("prefix", F.lit("/")).alias("entry"))
    words = nodes.where("expr_index IS NOT NULL").select(F.col("prefix").alias("word"))
    # A word is listed at each proper prefix down from its longest proper prefix that is a folder.
    steps = words.select("word", F.posexplode(F.concat(F.array(F.lit("")), prefixes("word"))).alias("n", "prefix"))
    steps = steps.where("prefix <> word")
    marks = nodes.where("is_folder").select("prefix", F.lit(1).alias("folder"))
    steps = steps.join(marks, "prefix", "left")
    deepest = F.max(F.when(F.col("folder") == 1, F.col("n"))).over(Window.partitionBy("word"))
    steps = steps.withColumn("deepest", F.coalesce(deepest, F.lit(0))).where("n >= deepest")
    return folders.unionByName(steps.select("prefix", F.concat("word", F.lit(".")).alias("entry")))


def content_of(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, entry): the listing of each query; nothing for what has no children."""
    return queries.join(listings(nodes).withColumnRenamed("prefix", "query"), "query")


def path_and_content_of(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, path, entries), for queries that are nodes or empty; entries in order of name."""
    paths = _folder_path(nodes, queries.withColumn("node", F.col("query"))).where("path IS NOT NULL")
    entries = content_of(nodes, queries).groupBy("query").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return paths.join(entries, "query", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<string>")))


def moves(nodes: DataFrame) -> DataFrame:
    """(prefix, next_sibling, previous_sibling, first_child, last_child, n_children, parent)."""
    siblings = Window.partitionBy("parent").orderBy("prefix")
    children = nodes.groupBy(F.col("parent").alias("prefix")).agg(
        F.min("prefix").alias("first_child"), F.max("prefix").alias("last_child"), F.count(F.lit(1)).alias("n_children")
    )
    rows = nodes.select(
        "prefix", "parent", F.lead("prefix").over(siblings).alias("next_sibling"), F.lag("prefix").over(siblings).alias("previous_sibling")
    )
    return rows.join(children, "prefix", "left").fillna(0, ["n_children"])


def entries(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("prefix").alias("path"), "is_folder", "expr_index", F.coalesce("percentile", F.lit(0)).alias("percentile"), "max_child_percentile"
    )


def as_list(nodes: DataFrame, most: int | None = None, where: Column | str = "true") -> DataFrame:
    """Entries that pass ``where``, in order of path (which is pre-order); at most ``most``."""
    found = entries(nodes).where(where).orderBy("path")
    return found if most is None else found.limit(most)


def as_lookup(nodes: DataFrame) -> DataFrame:
    """One entry for each expr_index, the last in order of path."""
    rows = entries(nodes).where("expr_index IS NOT NULL")
    return rows.groupBy("expr_index").agg(F.max_by(F.struct("path", "is_folder", "percentile", "max_child_percentile"), "path").alias("e")).select("expr_index", "e.*")


def dump(nodes: DataFrame) -> DataFrame:
    """(path, place, line): the tree as text, folders before what they hold; order by path, place."""
    folders = nodes.where("is_folder").select("prefix")
    steps = nodes.select(F.col("prefix").alias("path"), F.explode(prefixes("prefix")).alias("prefix")).where("prefix <> path")
    depth = steps.join(folders, "prefix", "left_semi").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    rows = nodes.withColumnRenamed("prefix", "path").join(depth, "path", "left").withColumn("indent", F.expr("repeat(' ', coalesce(depth, 0))"))
    heads = rows.where("is_folder").select("path", F.lit(0).alias("place"), F.concat("indent", "node_char", F.lit(":")).alias("line"))
    text = F.format_string("%s%s    (idx: %d, %d%% & max: %d%%)", "indent", "path", "expr_index", "percentile", "max_child_percentile")
    return heads.unionByName(rows.where("expr_index IS NOT NULL").select("path", F.lit(1).alias("place"), text.alias("line")))
