"""Typo-tolerant search of a node table, many queries in a job.

Queries are a DataFrame (query_id, query[, cap_not_found, cap_found]). Results are rows
(query_id, query, rank, kind, expr_index, percentile, word). Every choice among equals goes by
word, so results don't depend on partitions. ``candidates`` is a condition on expr_index; like the
reference semantics it does not touch the exact match. Operators take a node table, or an `Index`
of it, which many batches of queries share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import deletion_variants, prefixes, spellings_cap, within_one_edit
from wordloom.operators.build import words_of
from wordloom.session import materialize, sized

MOST = 6
SEEDS = 3
NOT_FOUND_CAP, FOUND_CAP = 20, 2
#: Kinds in the order in which equal percentiles stand.
MATCHING, SPELLING, EXTENSION = "Matching", "Spelling", "Extension"


def _best() -> list[Column]:
    return [F.desc("percentile"), F.asc("word")]


def _top(rows: DataFrame, limit: Column | int, by: str = "query_id", order: list[Column] | None = None) -> DataFrame:
    """The first ``limit`` rows of each query; Spark cuts them down before the shuffle too where
    the limit is a number."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*(order or _best())))
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("place")


@dataclass(frozen=True)
class Index:
    """A node table made ready for searches. Batches of queries are joined with it by key and
    read no more of a tree than what stands at their keys.

    places: (asked, has_children, match, more, sweep), a row for each node: its word's (percentile,
    expr_index, word) or null; the best words that strictly extend it; and the best words among
    those that start with it or with one of its later siblings. Words in lists are
    (minus, word, expr_index), minus being the percentile times -1, in order.
    variants: (variant, node, percentile, expr_index, promise): each node by itself and with one
    character less; expr_index is null for what is no word that may be found."""

    places: DataFrame
    variants: DataFrame

    def stored(self) -> Index:
        return Index(materialize(self.places), materialize(self.variants))


ENTRY = "struct<minus:int,word:string,expr_index:int>"


def index(nodes: DataFrame, candidates: Column | str = "true") -> Index:
    """The index of a node table, or of its words that pass ``candidates``."""
    entry = F.struct((-F.col("percentile")).cast("int").alias("minus"), F.col("word"), F.col("expr_index").cast("int").alias("expr_index"))
    words = words_of(nodes).where(candidates)
    steps = words.select("percentile", "word", entry.alias("entry"), F.explode(prefixes("word")).alias("asked")).where("asked <> word")
    more = _top(steps, MOST, "asked").groupBy("asked").agg(F.array_sort(F.collect_list("entry")).alias("more"))
    own = words.select(F.col("word").alias("asked"), entry.alias("own"))
    none = F.array().cast(f"array<{ENTRY}>")
    at = nodes.select(
        F.col("prefix").alias("asked"), "parent", (F.col("first_child_pos") > 0).alias("has_children"),
        F.when(F.col("expr_index").isNotNull(), F.struct("expr_index", "percentile", F.col("prefix").alias("word"))).alias("match"),
    ).join(more, "asked", "left").join(own, "asked", "left").withColumn("more", F.coalesce("more", none))
    # Siblings from the last one on; each one's sweep is the best of the one before it and its own.
    below = F.concat(F.when(F.col("own").isNull(), none).otherwise(F.array("own")), "more")
    siblings = at.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("asked", below.alias("below"))), asc=False).alias("siblings"))
    best = lambda state, x: F.slice(F.array_sort(F.concat(state["top"], x["below"])), 1, MOST)
    start = F.struct(none.alias("top"), F.array().cast(f"array<struct<asked:string,sweep:array<{ENTRY}>>>").alias("out"))
    step = lambda state, x: F.struct(best(state, x).alias("top"), F.concat(state["out"], F.array(F.struct(x["asked"].alias("asked"), best(state, x).alias("sweep")))).alias("out"))
    swept = siblings.select(F.explode(F.aggregate("siblings", start, step, lambda state: state["out"])).alias("s")).select("s.*")
    may = F.when(F.expr(candidates) if isinstance(candidates, str) else candidates, F.col("expr_index")).alias("expr_index")
    variants = nodes.select(
        F.explode(deletion_variants("prefix")).alias("variant"), F.col("prefix").alias("node"), "percentile", may,
        F.col("max_child_percentile").alias("promise"),
    )
    return Index(at.drop("own", "parent").join(swept, "asked"), variants)


def _index(nodes: DataFrame | Index, candidates: Column | str) -> Index:
    if not isinstance(nodes, Index):
        return index(nodes, candidates)
    if not isinstance(candidates, str) or candidates != "true":
        raise ValueError("an index holds the words it was made of; give the node table with other candidates")
    return nodes


def _with_caps(queries: DataFrame, first: DataFrame) -> DataFrame:
    """Queries with their caps, and what they ask for: an empty query for the first node."""
    rows = queries
    for name, value in (("cap_not_found", NOT_FOUND_CAP), ("cap_found", FOUND_CAP)):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(value))
    return rows.crossJoin(F.broadcast(first)).withColumn("asked", F.expr("IF(query = '', coalesce(first, ''), query)")).drop("first")


def _capped(rows: DataFrame) -> DataFrame:
    rows = rows.fillna(False, ["is_node", "has_children"])
    cap = spellings_cap(F.length("asked"), F.col("is_node"), F.col("cap_not_found"), F.col("cap_found"))
    return rows.withColumn("cap", cap)


def asked(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """A table of queries with what the tree has at them: asked (an empty query asks for the first node),
    is_node, has_children, match (the word's row or null), cap."""
    rows = materialize(_with_caps(queries, nodes.where("parent = ''").agg(F.min("prefix").alias("first"))))
    few = sized(rows.select("asked").distinct())
    at = nodes.join(few.withColumnRenamed("asked", "prefix"), "prefix", "left_semi").select(
        F.col("prefix").alias("asked"), F.lit(True).alias("is_node"), (F.col("first_child_pos") > 0).alias("has_children"),
        F.when(F.col("expr_index").isNotNull(), F.struct("expr_index", "percentile", F.col("prefix").alias("word"))).alias("match"),
    )
    return materialize(_capped(rows.join(at, "asked", "left")))


def _placed(found: Index, queries: DataFrame) -> DataFrame:
    """`asked` by way of an index, with `more` where there are extensions."""
    first = found.places.where("length(asked) = 1").agg(F.min("asked").alias("first"))
    at = found.places.select("asked", F.lit(True).alias("is_node"), "has_children", "match", F.when(F.col("has_children"), F.col("more")).alias("more"))
    return _capped(_with_caps(queries, first).join(at, "asked", "left"))


def neighbours(queries: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """Pairs of queries (query_id, asked) and rows of ``words`` that are at most one edit apart.
    Both sides' words and their variants of one character less meet in an equi-join; a pair that
    meets is then tested."""
    q = queries.select("query_id", "asked", F.explode(deletion_variants("asked")).alias("variant"))
    w = words.select("*", F.explode(deletion_variants(word)).alias("variant"))
    return w.join(sized(q), "variant").where(within_one_edit("asked", word)).drop("variant").distinct()


def _near(found: Index, rows: DataFrame) -> DataFrame:
    """``rows``, one for each query, with `spelled`, the best words one edit away up to the cap, and
    `seeds`, for queries that can't be extended the nodes within one edit whose descendants promise
    most."""
    kept = F.struct(*(c for c in rows.columns if c != "query_id")).alias("kept")
    variant = F.explode_outer(F.when(F.col("cap") > 0, deletion_variants("asked"))).alias("variant")
    asks = rows.select("query_id", kept, variant)
    near = asks.join(found.variants, (asks.variant == found.variants.variant) & within_one_edit("kept.asked", "node"), "left")
    word = F.struct((-F.col("percentile")).cast("int").alias("minus"), F.col("node").alias("word"), F.col("expr_index").cast("int").alias("expr_index"))
    seed = F.struct((-F.col("promise")).cast("int").alias("minus"), "node")
    near = near.groupBy("query_id").agg(
        F.first("kept").alias("kept"),
        F.collect_set(F.when(F.col("expr_index").isNotNull() & (F.col("node") != F.col("kept.asked")), word)).alias("spelled"),
        F.collect_set(F.when(~F.col("kept.has_children") & F.col("node").isNotNull(), seed)).alias("seeds"),
    )
    spelled = F.slice(F.array_sort("spelled"), F.lit(1), F.col("kept.cap"))
    return near.select("query_id", "kept.*", spelled.alias("spelled"), F.slice(F.array_sort("seeds"), 1, SEEDS)["node"].alias("seeds"))


def _entry(match: str) -> Column:
    at = lambda name: F.col(f"{match}.{name}")
    return F.struct((-at("percentile")).cast("int").alias("minus"), at("word").alias("word"), at("expr_index").cast("int").alias("expr_index"))


def _results(rows: DataFrame, pin: bool, **lists: Column) -> DataFrame:
    """Results in order: the match first (if pinned), then by percentile; without repeats. ``rows``
    has a row for each query with its match; ``lists`` are words by kind."""
    def item(place: int, kind: str, word: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), word["minus"].alias("minus"), word["word"].alias("word"), word["expr_index"].alias("expr_index"))

    own = F.when(F.col("match").isNotNull(), F.array(item(0, MATCHING, _entry("match"))))
    parts = [F.coalesce(own, F.array().cast("array<struct<place:int,kind:string,minus:int,word:string,expr_index:int>>"))]
    for place, (kind, words) in enumerate(lists.items(), 1):
        parts.append(F.transform(words, partial(item, place, kind)))
    rows = rows.select("query_id", "query", F.explode(F.concat(*parts)).alias("r")).select("query_id", "query", "r.*")
    again = F.row_number().over(Window.partitionBy("query_id", "expr_index").orderBy("place", "word"))
    rows = rows.withColumn("again", again).where("again = 1")
    order = [F.asc(F.expr("IF(place = 0, 0, 1)"))] if pin else []
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "minus", "place", "word")).cast("bigint")
    return rows.select("query_id", "query", rank.alias("rank"), "kind", "expr_index", (-F.col("minus")).alias("percentile"), "word")


def completions(nodes: DataFrame | Index, queries: DataFrame, candidates: Column | str = "true") -> DataFrame:
    """The best words that extend each query, and the query itself if it is a word, by percentile."""
    rows = _placed(_index(nodes, candidates), queries)
    # The match takes a place among the best if its percentile (and word) come before the last.
    more = F.coalesce("more", F.array().cast(f"array<{ENTRY}>"))
    both = F.slice(F.array_sort(F.when(F.col("match").isNull(), more).otherwise(F.concat(F.array(_entry("match")), more))), 1, MOST)
    held = F.coalesce(F.exists(both, lambda w: w["word"] == F.col("match.word")), F.lit(False))
    rows = rows.withColumn("both", both).withColumn("match", F.when(held, F.col("match")))
    extended = F.filter("both", lambda w: F.coalesce(w["word"] != F.col("match.word"), F.lit(True)))
    return _results(rows, False, Extension=extended)


def corrections(nodes: DataFrame | Index, queries: DataFrame, candidates: Column | str = "true") -> DataFrame:
    """The exact match, then the best words one edit away."""
    found = _index(nodes, candidates)
    return _results(_near(found, _placed(found, queries).drop("more")), True, Spelling=F.col("spelled"))


def suggestions(nodes: DataFrame | Index, queries: DataFrame, candidates: Column | str = "true") -> DataFrame:
    """Match, corrections and extensions in one list. A query that has no extensions is completed
    from its seeds: by the words of each seed's siblings from the seed on. What match and
    corrections leave of six rows goes to extensions, which may repeat each other and the
    corrections; repeats go last of all."""
    found = _index(nodes, candidates)
    rows = _near(found, _placed(found, queries))
    kept = F.struct(*(c for c in rows.columns if c not in ("query_id", "seeds"))).alias("kept")
    rows = rows.select("query_id", kept, F.explode_outer("seeds").alias("seed"))
    rows = rows.join(found.places.select(F.col("asked").alias("seed"), "sweep"), "seed", "left")
    rows = rows.groupBy("query_id").agg(F.first("kept").alias("kept"), F.flatten(F.collect_list("sweep")).alias("swept")).select("query_id", "kept.*", "swept")
    room = F.greatest(F.lit(MOST) - F.size("spelled") - F.when(F.col("match").isNotNull(), 1).otherwise(0), F.lit(0))
    extended = F.slice(F.array_sort(F.coalesce(F.when(F.col("has_children"), F.col("more")), F.col("swept"))), F.lit(1), room)
    return _results(rows, True, Spelling=F.col("spelled"), Extension=extended)


def shown(rows: DataFrame) -> DataFrame:
    """Adds `shown`, a line of text for each result."""
    return rows.withColumn("shown", F.format_string("%s %d %.1f%%", "kind", "expr_index", F.col("percentile") / 10))


def levenshtein_only(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, word) within one edit where a swap counts as two."""
    pairs = neighbours(queries.withColumn("asked", F.col("query")), words_of(nodes))
    return pairs.where("levenshtein(asked, word, 1) >= 0").select("query_id", F.col("asked").alias("query"), "word")


def words_within_one_edit(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, word) of all words within one edit, the query's own word included."""
    pairs = neighbours(queries.withColumn("asked", F.col("query")), words_of(nodes))
    return pairs.select("query_id", F.col("asked").alias("query"), "word")


def top_words(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, query, word, rank): the k best words that start with each query."""
    steps = words_of(nodes).select("*", F.explode(prefixes("word")).alias("query"))
    rows = queries.select("query_id", "query").join(steps, "query")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_best())).cast("bigint")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "query", "word", "rank")
