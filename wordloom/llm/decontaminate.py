"""Benchmark decontamination by SimHash of item-sized windows; DataFrame functions only.

Texts become words (runs of letters and digits, lower-cased) and hashes of five-word shingles. A
window of a document has as many words as an item. Two multisets of shingles are compared by
their weighted Jaccard similarity (sum of lesser over sum of greater counts), at least 0.8 for a
leak.

* Windows: a window that reaches the similarity lacks at most a fifth of the item's distinct
  shingles, so one of any floor(m / 5) + 1 of them, the item's anchors, occurs in it. Documents are
  joined with the anchors, and each hit places a window: where the item would start.
* Equal windows are one from here on, so a passage that many documents share is compared once.
* Candidates: 64-bit SimHash fingerprints of windows and items are cut into RADIUS + 1 blocks;
  fingerprints within RADIUS bits share at least one. Windows and items are joined on an anchor
  that the window was placed by together with a block, so neither makes all pairs: blocks of three
  or four bits tell little, and common anchors are divided by them. At similarity 0.8 fingerprints
  differ in 10 bits on average and in more than 19 once in 2,000.
* Candidates, as pairs of document and item, are verified by the exact similarity of the item and
  all windows of the document: each shingle in common counts for a range of windows, and running
  sums over the ends of these ranges give every window's count. Windows are cut by both ends of
  the text.

The benchmark is taken in blocks of at most ANCHORS anchors, each against all documents. Only a
block's anchors are broadcast; what else is joined has no bound but in documents that have hits,
and Spark chooses by size.

Defined results: null and empty texts, and those of fewer than five words, match nothing; so do
such items, which would be found by chance. Rows that repeat in either table give one row for each
pair of ids, and documents of one id are compared one by one. Rows of ``docs`` without an id are
left out. Ties between windows go to the first. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import count_rows, discard, materialize, tidy, without

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
#: Most anchors (about 32 bytes each) in one broadcast.
ANCHORS = 500_000
#: Most placed windows (under 50 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 300_000


def _held(column: Column) -> Column:
    """The column by way of a generator of one row. Optimizer rules don't move expressions across
    a generator, so what stands above reads the value and doesn't evaluate it again, which inside
    a lambda function would be once for each element."""
    return F.explode(F.array(column))


def _shingled(df: DataFrame, text_col: str) -> DataFrame:
    """Adds `hs`, the hashes of all five-word shingles in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    df = df.select("*", _held(F.transform(words, lambda w: F.xxhash64(w))).alias("ws"))
    runs = F.transform("ws", lambda w, i: F.xxhash64(w, *(F.get("ws", i + k) for k in range(1, WORDS))))
    runs = F.slice(runs, F.lit(1), F.greatest(F.size("ws") - (WORDS - 1), F.lit(0)))
    return df.select("*", _held(runs).alias("hs")).drop("ws")


def fingerprint(hashes: str) -> Column:
    """SimHash of an array of hashes: each bit is that of most of them."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(cast(if(2 * aggregate({hashes}, 0, (s, h) ->"
        f" s + cast(shiftrightunsigned(h, b) & 1L as int)) > size({hashes}), 1, 0) as bigint), b))"
    )


def _blocks(fp: str) -> Column:
    """(number, value) of the RADIUS + 1 blocks, as one number each."""
    n, out, at = RADIUS + 1, [], 0
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        out.append(F.lit(k * 1024) + F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return F.array(*out)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    items = _shingled(benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), "text")
    items = items.where(F.size("hs") > 0).withColumn("item", F.xxhash64("item_id", "hs"))
    items = items.dropDuplicates(["item"]).withColumn("n", F.size("hs")).withColumn("fp", fingerprint("hs"))
    return items.select("item", "item_id", "hs", "n", "fp")


def _anchors(items: DataFrame) -> DataFrame:
    """(item, h, at): for each item the floor(m / 5) + 1 least of its m distinct shingles, and where
    they stand in it."""
    least = F.array_sort(F.array_distinct("hs"))
    least = F.slice(least, F.lit(1), F.floor((1 - SIMILARITY) * F.size(least) + 1e-9).cast("int") + 1)
    places = items.withColumn("least", least).select("item", "n", "least", F.posexplode("hs").alias("at", "h"))
    return places.where(F.array_contains("least", F.col("h"))).select("item", "h", "n", "at")


def _placed(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, start, n, h): windows of n shingles that the hits h place. Items of the same size that
    agree in an anchor's place share a row."""
    found = _shingled(docs, "text").select("doc", F.posexplode("hs").alias("pos", "h"))
    found = found.join(F.broadcast(anchors.select("h", "n", "at").distinct()), "h")
    return found.select("doc", (F.col("pos") - F.col("at")).alias("start"), "n", "h").distinct()


def _texts_of(docs: DataFrame, wanted: DataFrame, doc_rows: int) -> DataFrame:
    """`docs` with their shingles, joined with a row or more of ``wanted`` for some of them."""
    few = doc_rows <= BROADCAST_WINDOWS
    return _shingled(docs.join(F.broadcast(wanted) if few else wanted, "doc"), "text")


def _candidates(windows: DataFrame, items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(window, item) of windows (window, n, fp, h) and items whose fingerprints are near."""
    left = windows.select("window", "n", "fp", "h", F.explode(_blocks("fp")).alias("block"))
    right = anchors.select("item", "h").distinct().join(items.select("item", "n", F.col("fp").alias("item_fp")), "item")
    right = right.select("item", "n", "h", "item_fp", F.explode(_blocks("item_fp")).alias("block"))
    near = left.join(right, ["h", "n", "block"])
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("window", "item").distinct()


def _best(docs: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item, similarity, start) of the best window of each pair, at SIMILARITY or more; pairs
    is a table (doc, item)."""
    of_doc = pairs.groupBy("doc").agg(F.collect_set("item").alias("items"))
    held = _texts_of(docs, of_doc, count_rows(pairs))
    places = held.select("doc", "items", F.size("hs").alias("m"), F.posexplode("hs").alias("pos", "h"))
    places = places.groupBy("doc", "h", "m", "items").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    places = places.select("doc", "h", "m", "places", F.explode("items").alias("item"))
    theirs = items.select("item", "n", F.explode("hs").alias("h")).groupBy("item", "n", "h").agg(F.count(F.lit(1)).cast("int").alias("c"))
    hits = places.join(theirs, ["item", "h"])
    # A place counts for windows that start after the c-th same place before it, and not beyond it.
    after = lambda p, i: F.greatest(p - F.col("n"), F.coalesce(F.get("places", i - F.col("c")), p - F.col("n"))) + 1
    ends = F.flatten(F.transform("places", lambda p, i: F.array(F.struct(after(p, i).alias("s"), F.lit(1).alias("d")), F.struct((p + 1).alias("s"), F.lit(-1).alias("d")))))
    ends = hits.select("doc", "item", "n", "m", F.explode(ends).alias("e"))
    ends = ends.groupBy("doc", "item", "n", "m", F.col("e.s").alias("s")).agg(F.sum("e.d").alias("d"))
    by_pair = Window.partitionBy("doc", "item", "n", "m").orderBy("s")
    common = F.sum("d").over(by_pair).alias("common")
    runs = ends.select("doc", "item", "n", "m", "s", common, (F.lead("s").over(by_pair) - 1).alias("last")).where("last IS NOT NULL")
    # Between two ends the count stands still; a window is least, so best, at either.
    runs = runs.select("*", F.explode(F.array("s", "last")).alias("start"))
    size = F.least(F.col("start") + F.col("n"), F.col("m")) - F.greatest("start", F.lit(0))
    best = runs.select("doc", "item", "start", (F.col("common") / (size + F.col("n") - F.col("common"))).alias("similarity"))
    best = best.where(F.col("similarity") >= SIMILARITY).groupBy("doc", "item")
    return best.agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best")).select(
        "doc", "item", "best.similarity", (-F.col("best.start")).alias("start")
    )


@tidy
def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, similarity (of the best window of the document), first_word (of the first
    window that is the best, from 0): one row for each document and item that leaks into it."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    docs = docs.withColumn("doc", F.struct("doc_id", F.xxhash64("text")))  # ids may repeat
    items = materialize(_items(benchmark, item_col, item_text_col))
    steps = max(1, -(-count_rows(_anchors(items)) // ANCHORS))
    out = []
    for step in range(steps):
        part = items.where(F.pmod("item", F.lit(steps)) == step)
        anchors = materialize(_anchors(part))
        placed = materialize(_placed(docs, anchors))
        by_doc = placed.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("places"))
        held = _texts_of(docs, by_doc, count_rows(placed)).select("doc", "hs", F.explode("places").alias("place"))
        start, n = F.col("place.start"), F.col("place.n")
        cut = F.slice("hs", F.greatest(start, F.lit(0)) + 1, n + F.least(start, F.lit(0)))
        held = held.select("doc", start.alias("start"), n.alias("n"), cut.alias("hs"))
        held = materialize(held.where(F.size("hs") > 0).withColumn("window", F.xxhash64("n", "hs")))
        windows = held.select("window", "hs").dropDuplicates(["window"])
        windows = materialize(windows.select("window", fingerprint("hs").alias("fp")))
        names = materialize(held.select("doc", "start", "n", "window"))
        discard(held)
        # Windows with the anchors that placed them; one that many documents share is here once.
        by = placed.join(names, ["doc", "start", "n"]).select("window", "n", "h").distinct()
        near = materialize(_candidates(by.join(windows, "window"), part, anchors))
        pairs = names.select("doc", "window").distinct().join(near, "window").select("doc", "item").distinct()
        found = _best(docs, materialize(pairs), part).join(part.select("item", "item_id"), "item")
        out.append(found.select("doc.doc_id", "item_id", "similarity", F.greatest("start", F.lit(0)).alias("first_word")))
    found = reduce(DataFrame.unionAll, out).groupBy("doc_id", "item_id")
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("first_word"))).alias("best")
    return found.agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.first_word")).alias("first_word"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    found = leaks(docs, benchmark, id_col, text_col)
    return without(docs, found.select(F.col("doc_id").alias(id_col)), id_col)
