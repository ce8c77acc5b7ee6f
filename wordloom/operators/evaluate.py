"""Query sets with known answers, recall, and statistics of trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import KINDS, edited, single_edits


def typo_queries(words: DataFrame, per_kind: int) -> DataFrame:
    """(query_id, query, target, kind): for each kind of edit the commonest words of 5 to 12
    letters a-z, with one edit."""
    clean = words.where("length(word) BETWEEN 5 AND 12 AND word RLIKE '^[a-z]+$'")
    rows = reduce(DataFrame.unionByName, [clean.withColumn("kind", F.lit(k)) for k in KINDS])
    rows = rows.withColumn("query", edited("word", "kind")).where("query IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("percentile"), "ordinal"))
    rows = rows.withColumn("place", place).where(F.col("place") <= per_kind)
    number = F.expr(f"array_position(array{KINDS}, kind)").cast("bigint") * 1_000_000 + F.col("place")
    return rows.select(number.alias("query_id"), "query", F.col("word").alias("target"), "kind")


def prefix_queries(words: DataFrame, count: int) -> DataFrame:
    """(query_id, query): the prefixes of two and three letters with the greatest sum of
    percentiles of words of four letters a-z or more."""
    clean = words.where("length(word) >= 4 AND word RLIKE '^[a-z]+$'")
    cut = clean.select("percentile", F.explode(F.expr("array(substr(word, 1, 2), substr(word, 1, 3))")).alias("query"))
    sums = cut.groupBy("query").agg(F.sum("percentile").alias("weight"))
    best = sums.orderBy(F.desc("weight"), "query").limit(count)
    number = F.row_number().over(Window.orderBy(F.desc("weight"), "query")).cast("bigint")
    return best.select(number.alias("query_id"), "query")


def all_single_edits(words: DataFrame) -> DataFrame:
    """(word, edit): each word's single edits."""
    return words.select("word", F.explode(single_edits("word")).alias("edit"))


def first_letter_neighbours(words: DataFrame) -> DataFrame:
    """(word, edit): each word with its first letter replaced by the 25 others of a-z."""
    letters = F.explode(F.expr("transform(sequence(97, 122), i -> char(i))"))
    rows = words.select("word", letters.alias("letter")).where("letter <> substr(word, 1, 1)")
    return rows.select("word", F.expr("concat(letter, substr(word, 2))").alias("edit"))


def recall(truth: DataFrame, returned: DataFrame) -> DataFrame:
    """(query_id, results, truths, hits, recall) from (query_id, word); 1 where truth is empty."""
    found = returned.select("query_id", "word").distinct()
    hits = truth.select("query_id", "word").distinct().join(found.withColumn("hit", F.lit(1)), ["query_id", "word"], "left")
    hits = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("truths"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    sizes = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    rows = hits.join(sizes, "query_id", "full").fillna(0)
    return rows.withColumn("recall", F.expr("IF(truths = 0, 1.0D, hits / truths)"))


def rank_of(returned: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, rank): where each target (query_id, target) stands among the results, or null."""
    hits = returned.select("query_id", "rank", F.col("word").alias("target"))
    found = targets.select("query_id", "target").join(hits, ["query_id", "target"], "left")
    return found.groupBy("query_id").agg(F.min("rank").alias("rank"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row of totals and extremes."""
    children = nodes.groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    rows = nodes.join(children, "prefix", "left").fillna(0, ["c"])
    return rows.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count("expr_index").alias("total_words"), F.sum("c").alias("sum_children"),
        F.max("c").alias("max_children"), F.max(F.expr("IF(c > 0, first_child_pos - pos, 0)")).alias("max_rel_child_pos"),
        F.coalesce(F.max("percentile"), F.lit(0)).cast("bigint").alias("max_percentile"), F.max(F.length("prefix")).cast("bigint").alias("max_depth"),
    ).withColumn("avg_children", F.expr("round(sum_children / total_nodes, 6)"))


def child_histogram(nodes: DataFrame, buckets: int = 40) -> DataFrame:
    """(bucket, nodes) by number of children; the last bucket holds the rest."""
    children = nodes.groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    bucket = F.least(F.coalesce("c", F.lit(0)), F.lit(buckets - 1)).cast("bigint").alias("bucket")
    return nodes.join(children, "prefix", "left").groupBy(bucket).agg(F.count(F.lit(1)).alias("nodes"))


def percentile_histogram(nodes: DataFrame) -> DataFrame:
    """(bucket, nodes) by tens of percentile over all nodes, what is no word counting as 0."""
    bucket = F.expr("least(coalesce(percentile, 0) div 10, 100)").cast("bigint").alias("bucket")
    return nodes.groupBy(bucket).agg(F.count(F.lit(1)).alias("nodes"))


def histogram_line(histogram: DataFrame, buckets: int) -> DataFrame:
    """(line): the numbers of a (bucket, nodes) histogram of at most ``buckets``, `[a, b, c]`, without
    zeros at the end."""
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "nodes"))).alias("held")
    last = F.coalesce(F.array_max(F.map_keys("held")), F.lit(-1))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.element_at("held", b.cast("bigint")), F.lit(0)).cast("string"))
    rows = histogram.where(F.col("nodes") > 0).agg(held)
    return rows.select(F.concat(F.lit("["), F.array_join(F.slice(numbers, F.lit(1), (last + 1).cast("int")), ", "), F.lit("]")).alias("line"))
