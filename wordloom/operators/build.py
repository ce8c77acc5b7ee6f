"""From a dictionary to the node table: one row for each distinct prefix of its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import prefixes
from wordloom.session import materialize, with_rank


def inserted(dictionary: DataFrame) -> DataFrame:
    """(prefix, percentile, expr_index): what insertion in order leaves at each node. The row that
    makes a node sets its percentile, 0 unless it is the row's own word; each row of a word sets
    the word's expr_index."""
    steps = dictionary.select("ordinal", "word", "percentile", "expr_index", F.explode(prefixes("word")).alias("prefix"))
    own = "prefix = word"
    return steps.groupBy("prefix").agg(
        F.expr(f"min_by(IF({own}, percentile, 0), ordinal)").alias("percentile"),
        F.expr(f"max_by(expr_index, ordinal) FILTER (WHERE {own})").alias("expr_index"),
    )


def counted(found: DataFrame) -> DataFrame:
    """Adds word_count (words at or below the node) and max_child_percentile (strictly below)."""
    words = found.where("expr_index IS NOT NULL").select(F.col("prefix").alias("word"), "percentile")
    below = words.select("word", "percentile", F.explode(prefixes("word")).alias("prefix")).groupBy("prefix")
    below = below.agg(
        F.count(F.lit(1)).alias("word_count"),
        F.coalesce(F.expr("max(IF(prefix <> word, percentile, NULL))"), F.lit(0)).alias("max_child_percentile"),
    )
    return found.join(below, "prefix")


def foldered(nodes: DataFrame, folder_size: int) -> DataFrame:
    """Adds is_folder. Children are taken by falling word count; each becomes a folder, and counts
    as one word from then on, while the parent holds more than ``folder_size``. What is left
    before a child is a running sum, as a failed test can't pass again further on."""
    parent = nodes.select(F.col("prefix").alias("parent"), F.col("word_count").alias("of_parent"))
    rows = nodes.join(parent, "parent", "left")
    siblings = Window.partitionBy("parent")
    before = siblings.orderBy(F.desc("word_count"), "prefix").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce("of_parent", F.sum("word_count").over(siblings))
    left = total - F.coalesce(F.sum(F.col("word_count") - 1).over(before), F.lit(0))
    return rows.withColumn("is_folder", (left > folder_size) & (F.col("word_count") > 1)).drop("of_parent")


def build(dictionary: DataFrame, folder_size: int = 100) -> DataFrame:
    """The node table: pos (level order), prefix, parent, node_char, first_child_pos (0: none),
    is_folder, is_last_sibling, max_child_percentile, percentile and expr_index (null: no word),
    slot (number of words before, null: no word), word_count."""
    nodes = counted(materialize(inserted(dictionary)))
    nodes = nodes.withColumn("parent", F.expr("substr(prefix, 1, length(prefix) - 1)"))
    nodes = foldered(materialize(nodes), folder_size)
    nodes = nodes.withColumn("level", F.length("prefix")).withColumn("node_char", F.expr("right(prefix, 1)"))
    next_one = F.lead("prefix").over(Window.partitionBy("parent").orderBy("prefix"))
    nodes = nodes.withColumn("is_last_sibling", next_one.isNull())
    is_word = F.col("expr_index").isNotNull()
    order = [F.col("level"), F.col("prefix")]
    slots = with_rank(nodes.where(is_word).select("level", "prefix"), order, "slot").select("prefix", "slot")
    nodes = materialize(with_rank(nodes, order, "pos"))
    first = nodes.groupBy("parent").agg(F.min("pos").alias("first_child_pos")).withColumnRenamed("parent", "prefix")
    nodes = nodes.join(first, "prefix", "left").join(slots, "prefix", "left")
    return nodes.select(
        "pos", "prefix", "parent", "node_char", F.coalesce("first_child_pos", F.lit(0)).cast("bigint").alias("first_child_pos"),
        "is_folder", "is_last_sibling", F.col("max_child_percentile").cast("int").alias("max_child_percentile"),
        F.when(is_word, F.col("percentile")).cast("int").alias("percentile"), "expr_index", "slot",
        F.col("word_count").cast("bigint").alias("word_count"),
    )


def words_of(nodes: DataFrame) -> DataFrame:
    """(word, percentile, expr_index) as the built tree has them."""
    return nodes.where("expr_index IS NOT NULL").select(F.col("prefix").alias("word"), "percentile", "expr_index")


def node_counts(nodes: DataFrame) -> DataFrame:
    """(prefix, node_count): nodes at or below each node."""
    below = nodes.select(F.explode(prefixes("prefix")).alias("prefix"))
    return below.groupBy("prefix").agg(F.count(F.lit(1)).alias("node_count"))
