"""N-gram Jaccard join by parity sketches.

Tokens are a document's distinct word shingles. Each token flips one bit of a very wide sketch,
so the Hamming distance of two sketches is at most the symmetric difference of the sets. The
sketch is cut into blocks; a block is kept as the XOR of random numbers of its set bits. Two sets
of a size band that may link differ in at most d tokens, so with d + 1 + e blocks at least e + 1
are equal: pairs that can link meet in a join on (band, block, value). Blocks without a set bit
say little, so they join as subsets of e at a time. Values that more than OFTEN sets share join only
two at a time, and only two of the same of some groups of values, fewer than the equal blocks with
a bit, which put two into one group. (Sets with very many blocks without a bit, which may have
fewer values in common, join two of any.) Nothing that can link is lost by this.

Sets that meet are gathered into clusters, without any pairs; clusters are dealt out as tiles of
bounded size. In a first round tiles hold short parity sketches, and sets stay together only by
sketches whose distance doesn't rule a link out. In a second round tiles hold the sets of what is
left of the clusters, and intersections are counted exactly, each set against those that it is not
joined with yet. Of a cluster that needs several tiles all sets are compared first with the one of
least class, then with the least of those not joined so far, and so on; tiles then hold only pairs
with one that is still alone, for those that are joined need no more links among each other. So
copies of one text, however many, are each read a few times. A tile returns a spanning forest of
its links, from which the components follow.

Equal sets are one class, found first. Classes are 64-bit hashes of whole sets.

Defined results: null text, empty text and text without words have no shingles and link with
nothing, not even each other; fewer words than a shingle has make one shingle. Rows that repeat
are documents like others; equal ids share a component. Other columns are not read.
"""

from __future__ import annotations

import bisect
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import kernel as K
from wordloom.llm.common import brief_shuffles, count_rows, discard, map_texts, materialize, reclaim, slices, tidy, without
from wordloom.llm.components import components

#: A key that more sets share joins only together with another key; with 1, keys join two at a time,
#: and a passage that many texts share doesn't gather them in one cluster.
OFTEN = 1
#: Most sets in one side of a tile, and most bytes, or one set that is larger.
TILE, TILE_BYTES = 256, 8_000_000
#: In so many rounds all sets of a cluster that needs several tiles are compared with one of them.
STARS = 4
#: Bits of a key that say its band, and the bit above them of keys that join with any other.
BAND, ANY = 64, 64
#: Bits of the sketches that are compared one to one.
SKETCH = 1024
#: Most ids (8 bytes each) that are sent to each executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class Bands:
    """Size bands and their blocks for links of ``100 * intersection >= percent * union``."""

    def __init__(self, percent: int, growth: float = 1.4):
        if percent < 70:
            raise ValueError("sets of a similarity under 0.7 differ in too many tokens for blocks of bits")
        self.percent, self.growth = percent, growth
        self.edges = [1]
        self.shapes: dict[int, tuple[int, int, int] | None] = {}

    def shape(self, band: int) -> tuple[int, int, int] | None:
        """Blocks, spare blocks, and groups of frequent keys of a band; None if only equal sets link
        in it. Of large bands as many blocks are spare as may well have no bit, and one more for
        each group, so that sets hardly ever have to be joined by subsets of their bare blocks."""
        if band not in self.shapes:
            low, high = self.edges[band], self.edges[band + 1] - 1
            differ = 2 * high * (100 - self.percent) // (100 + self.percent)
            groups, bare = 1 + (differ + 1) // 5, 1
            n = low * self.percent / 100  # tokens of the smallest set of the band
            for above in (4, 3, 2, 1, 0) if differ > 15 else ():
                bare, last = 1, 0
                while last < bare <= differ:
                    blocks, last = differ + 1 + bare + groups, bare
                    mean = blocks * math.exp(-n / blocks)
                    bare = max(bare, math.ceil(mean + above * math.sqrt(mean)))
                if bare <= differ // 2:
                    break
            else:
                bare = 1
            spare = bare + groups
            self.shapes[band] = (differ + 1 + spare, spare, groups) if differ else None
        return self.shapes[band]

    def of(self, n: int) -> list[tuple[int, int, int, int]]:
        """(band, blocks, spare blocks, groups) in which a set of n tokens may meet one as large or
        larger, or is the larger one. Bands where only equal sets link are left out."""
        while self.edges[-1] <= 100 * n // self.percent + 1:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * self.growth)))
        first = max(0, bisect.bisect_right(self.edges, n) - 1)
        last = bisect.bisect_right(self.edges, 100 * n // self.percent)
        bands = range(first, min(last, len(self.edges) - 1))
        return [(band, *shape) for band in bands if (shape := self.shape(band))]


def keys_of(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: hashes with the band in the lowest bits."""
    out = []
    for band, blocks, spare, groups in bands.of(len(tokens)):
        block = (K.mix(tokens, band + 1) >> K.U(20)) % K.U(blocks)
        order = np.argsort(block, kind="stable")
        sorted_blocks = block[order]
        first = np.flatnonzero(np.r_[True, sorted_blocks[1:] != sorted_blocks[:-1]])
        value = np.bitwise_xor.reduceat(K.mix(tokens, 1_000 + band)[order], first)
        keys = [K.mix(value ^ K.mix(sorted_blocks[first], 2_000 + band), 3)]
        bare = sorted(set(range(blocks)) - set(sorted_blocks[first].tolist()))
        for subset in combinations(bare, spare):
            k = K.mix(np.array([band], K.U), 4)
            for b in subset:
                k = K.mix(k ^ K.U(b), 5)
            keys.append(k)
        own = np.concatenate(keys) & ~K.U(BAND + ANY - 1) | K.U(band)
        out.append(own)
        if groups > 1 and len(bare) > spare - groups:
            out.append(own | K.U(ANY))
    return np.concatenate(out) if out else np.zeros(0, K.U)


def group_of(key: Column, bands: Bands) -> Column:
    """A frequent key joins with others of its group only."""
    bands.of(1 << 40)
    groups = F.array(*(F.lit((bands.shape(b) or (0, 0, 1))[2]) for b in range(min(BAND, len(bands.edges) - 1))))
    band = key.bitwiseAND(F.lit(BAND - 1))
    of = F.when(key.bitwiseAND(F.lit(ANY)) == 0, F.get(groups, band.cast("int"))).otherwise(F.lit(1))
    return F.xxhash64(key.bitwiseAND(F.lit(BAND + ANY - 1)), F.pmod(F.shiftright(key, 7), of))


def sketch_of(tokens: np.ndarray) -> bytes:
    """The parity sketch in SKETCH bits."""
    bits = np.bincount((K.mix(tokens, 6) >> K.U(30)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def class_of(tokens: np.ndarray) -> int:
    """The id of a set: a 64-bit hash of all its tokens."""
    with np.errstate(over="ignore"):
        return int(K.mix(np.array([K.mix(tokens, 9).sum(dtype=K.U) ^ K.U(len(tokens))], K.U), 10).view(np.int64)[0])


def _classes(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def make():
        def run(columns: list[pa.Array]) -> list[pa.Array]:
            sets = K.shingle_sets(columns[1], words)
            none = [not len(s) for s in sets]
            return [
                columns[0],
                pa.array([None if x else class_of(s) for s, x in zip(sets, none)], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([None if x else sketch_of(s) for s, x in zip(sets, none)], pa.binary()),
            ]

        return run

    schema = f"`{id_col}` bigint, cls bigint, n_shingles bigint, sketch binary"
    return map_texts(df, [id_col, text_col], schema, make)


def _keys(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(key, cls, first, crowd); a set that repeats within a task is written once. Of a batch's
    rows with the same key one is ``first``, and ``crowd`` if there are others."""

    def run(batches):
        bands, seen = Bands(percent), set()
        for batch in slices(batches):
            keys, classes = [], []
            for tokens in K.shingle_sets(batch.column(0), words):
                if not len(tokens) or (c := class_of(tokens)) in seen:
                    continue
                if len(seen) >= 250_000:
                    seen.clear()
                seen.add(c)
                keys.append(keys_of(tokens, bands))
                classes.append(np.full(len(keys[-1]), c, np.int64))
            if keys:
                key = np.concatenate(keys).view(np.int64)
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                first, crowd = np.zeros(len(key), bool), np.zeros(len(key), bool)
                first[at], crowd[at] = True, n > 1
                columns = [pa.array(x) for x in (key, np.concatenate(classes), first, crowd)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "cls", "first", "crowd"])

    return df.select(text_col).mapInArrow(run, "key bigint, cls bigint, first boolean, crowd boolean")


def _shared(rows: DataFrame) -> DataFrame:
    """(key, cls) of the keys that two or more classes have. Only a batch's first row of a key
    is dealt by key, so no task gets all rows of a key that very many sets have."""
    dealt = F.when(F.col("first"), F.col("key")).otherwise(F.xxhash64("key", "cls"))
    by_key = Window.partitionBy("dealt", "first")
    rows = rows.withColumn("dealt", dealt).repartition("dealt")
    rows = rows.withColumn("least", F.min("cls").over(by_key)).withColumn("most", F.max("cls").over(by_key))
    return rows.where("not first or crowd or least <> most").select("key", "cls")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(cls, tokens as bytes) of the ``wanted`` (id, cls) documents."""
    few = count_rows(wanted) <= BROADCAST_IDS
    docs = df.select(id_col, text_col).join(F.broadcast(wanted) if few else wanted, id_col)

    def run(batches):
        for batch in slices(batches):
            sets = K.shingle_sets(batch.column(0), words)
            same = [class_of(s) == c if len(s) else False for s, c in zip(sets, batch.column(1).to_pylist())]
            rows = [(s, c) for s, c, ok in zip(sets, batch.column(1).to_pylist(), same) if ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for _, c in rows], pa.int64()), pa.array([s.tobytes() for s, _ in rows], pa.binary())],
                ["cls", "tokens"],
            )

    return docs.select(text_col, "cls").mapInArrow(run, "cls bigint, tokens binary").dropDuplicates(["cls"])


class _Forest:
    """A spanning forest of the links that are told to it."""

    def __init__(self, classes: list[int], joined: np.ndarray | None = None):
        self.classes, self.links = classes, []
        self.tree = np.arange(len(classes))
        if joined is not None and joined.any():
            self.tree[joined] = np.flatnonzero(joined)[0]

    def apart(self, a: int) -> np.ndarray:
        """Those after ``a`` that are in another tree."""
        return np.flatnonzero(self.tree[a + 1 :] != self.tree[a]) + a + 1

    def link(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if self.tree[a] != self.tree[b]:
                self.tree[self.tree == self.tree[b]] = self.tree[a]
                self.links.append((self.classes[a], self.classes[b]))


def possible_links(classes: list[int], sizes: list[int], sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches allow a link."""
    out = _Forest(classes)
    n = np.array(sizes)
    bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    for a in range(len(classes) - 1):
        others = out.apart(a)
        others = others[100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a])]
        if len(others):
            distance = np.bitwise_count(bits[others] ^ bits[a]).sum(axis=1, dtype=np.int64)
            out.link(a, others[distance * (100 + percent) <= (n[a] + n[others]) * (100 - percent)])
    return out.links


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Do two sets link?"""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def forest(classes: list[int], sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the exact links among some sets, of which some are joined already."""
    out = _Forest(classes, joined)
    sizes = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(sizes)]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(ids.max() + 1, np.int32)
    for a in range(len(sets) - 1):
        others = out.apart(a)
        others = others[100 * np.minimum(sizes[others], sizes[a]) >= percent * np.maximum(sizes[others], sizes[a])]
        if not len(others):
            continue
        own = ids[at[a] : at[a + 1]]
        mark[own] = 1
        if 4 * len(others) > len(sets) - a:
            common = np.add.reduceat(mark[ids[at[a + 1] :]], at[a + 1 : -1] - at[a + 1])[others - a - 1]
        else:
            common = np.array([mark[ids[at[b] : at[b + 1]]].sum() for b in others.tolist()])
        mark[own] = 0
        out.link(a, others[100 * common >= percent * (sizes[others] + sizes[a] - common)])
    return out.links


def _links(members: DataFrame, held: str, compare) -> DataFrame:
    """Links (u, v) that ``compare(classes, sizes, column held)`` finds in each tile; members, a
    table: (cluster, cls, n, held, alone). Any two members of a cluster of which one is ``alone``
    share a tile."""
    one, size = F.count(F.lit(1)), F.sum(F.length(held))
    sides = F.ceil(F.greatest(one / TILE, size / TILE_BYTES)).cast("int")
    side = F.pmod(F.hash("cls"), F.col("sides"))
    totals = materialize(members.groupBy("cluster").agg(sides.alias("sides")))
    # Each side that holds a set alone meets each side of all.
    dealt = materialize(members.where("alone").select("cluster", "cls").join(totals, "cluster").select("cluster", "sides", side.alias("side")))
    lone = materialize(dealt.groupBy("cluster", "sides").agg(F.collect_set("side").alias("lone")))
    rows = members.join(lone, "cluster").withColumn("side", side)
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    other = F.explode(F.when(F.array_contains("lone", F.col("side")), every).otherwise(F.col("lone"))).alias("other")
    m = rows.select("cluster", "cls", "n", held, "side", other)
    tile = F.xxhash64("cluster", F.least("side", "other"), F.greatest("side", "other")).alias("tile")
    m = m.select(tile, "cls", "n", held)

    def run(batches):
        tile, classes, sizes, values = None, [], [], []

        def done():
            found = compare(classes, sizes, values) if len(classes) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"]
            )

        for batch in batches:
            for t, c, n, x in zip(*(x.to_pylist() for x in batch.columns)):
                if t != tile:
                    if classes:
                        yield done()
                    tile, classes, sizes, values = t, [], [], []
                classes.append(c)
                sizes.append(n)
                values.append(x)
        yield done()

    return m.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "u bigint, v bigint")


def _starred(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of sets with one set of their cluster, for clusters of several tiles; and the
    table of sets, n telling which are joined with others by these, as one tree, ``alone`` which
    are not."""
    size = F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.length("tokens")) / TILE_BYTES)
    large = materialize(sets.groupBy("cluster").agg(size.alias("size")).where("size > 1").select("cluster"))
    links = sets.select(F.col("cls").alias("u"), F.col("cls").alias("v")).limit(0)
    if large.isEmpty():
        return links, sets
    rest, now = sets.join(large, "cluster", "left_anti"), materialize(sets.join(large, "cluster"))

    def against(batches):
        for batch in batches:
            u, v, x, y = (c.to_pylist() for c in batch.columns)
            same = [a != b and similar(np.frombuffer(s, K.U), np.frombuffer(t, K.U), percent) for a, b, s, t in zip(u, v, x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([a for a, k in zip(u, same) if k], [b for b, k in zip(v, same) if k])], ["u", "v"])

    for step in range(STARS):
        centre = now.where("alone").groupBy("cluster").agg(F.min_by("cls", F.xxhash64("cls", F.lit(step))).alias("centre"))
        centre = centre.join(now.select(F.col("cls").alias("centre"), F.col("tokens").alias("held")), "centre")
        pairs = now.join(materialize(centre), "cluster").select("cls", "centre", "tokens", "held")
        found = materialize(pairs.mapInArrow(against, "u bigint, v bigint"))
        links = links.unionAll(found)
        # Joined is the largest tree of the cluster.
        tree = materialize(now.select("cluster", "cls").join(components(links).toDF("cls", "tree"), "cls"))
        first = tree.groupBy("cluster", "tree").count().groupBy("cluster").agg(F.max_by("tree", "count").alias("tree"))
        joined = tree.join(materialize(first), ["cluster", "tree"]).select("cls", F.lit(1).alias("n"))
        now = now.drop("n", "alone").join(joined, "cls", "left").fillna(0, ["n"]).withColumn("alone", F.col("n") == 0)
        now = materialize(now.select("cluster", "cls", "n", "tokens", "alone"))
        if now.where("alone").isEmpty():
            break
    return links, materialize(rest.unionByName(now))


def _met(shared: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join all sets that meet in a key, or in two where many have them.
    Aggregates are written before they are joined, so that Spark can split a join at a key that
    many rows have."""
    n = F.countDistinct("cls").alias("n")
    groups = materialize(shared.groupBy("key").agg(F.min("cls").alias("least"), n).where(F.col("n") > 1))
    met = materialize(shared.join(groups, "key"))
    plain = met.where(F.col("n") <= OFTEN).select(F.col("cls").alias("u"), F.col("least").alias("v"))
    frequent = met.where(F.col("n") > OFTEN).withColumn("grp", group_of(F.col("key"), Bands(percent)))
    frequent = frequent.groupBy("cls", "grp").agg(F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    rest = lambda i: F.slice("keys", i + 2, F.size("keys"))
    both = F.flatten(F.transform("keys", lambda k, i: F.transform(rest(i), lambda other: F.xxhash64(k, other))))
    pairs = materialize(frequent.select("cls", F.explode(both).alias("both")))
    least = materialize(pairs.groupBy("both").agg(F.min("cls").alias("v"), F.max("cls").alias("w")).where("v <> w"))
    return plain.unionAll(pairs.join(least, "both").select(F.col("cls").alias("u"), "v"))


@tidy
def join_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """``id_col`` (integer), n_shingles, component_id: one row for each document."""
    df = df.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    docs = materialize(_classes(df, id_col, text_col, words))
    classes = materialize(docs.where("cls is not null").groupBy("cls").agg(F.min(id_col).alias("first_id")))

    with brief_shuffles(df.sparkSession):
        return _components(df, docs, classes, id_col, text_col, words, percent)


def _components(
    df: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, percent: int
) -> DataFrame:
    """The result of `join_components` from its tables of documents and of classes."""
    shared = materialize(_shared(_keys(df, id_col, text_col, words, percent)))
    reclaim(df.sparkSession)  # the keys are many times what is left of them
    clusters = components(_met(shared, percent)).toDF("cls", "cluster")

    firsts = clusters.join(classes, "cls").withColumnRenamed("first_id", id_col)
    sketches = docs.join(firsts, [id_col, "cls"]).dropDuplicates(["cls"])
    sketches = materialize(sketches.select("cluster", "cls", F.col("n_shingles").alias("n"), "sketch", F.lit(True).alias("alone")))
    possible = _links(sketches, "sketch", lambda c, n, x: possible_links(c, n, x, percent))
    clusters = components(possible).toDF("cls", "cluster")

    wanted = materialize(classes.join(clusters, "cls").select(F.col("first_id").alias(id_col), "cls", "cluster"))
    sets = _sets(df, wanted.select(id_col, "cls"), id_col, text_col, words)
    sets = wanted.select("cls", "cluster").join(sets, "cls").select("cluster", "cls", F.lit(0).alias("n"), "tokens", F.lit(True).alias("alone"))
    exact = lambda c, joined, x: forest(c, [np.frombuffer(t, K.U) for t in x], percent, np.array(joined, bool))
    starred, sets = _starred(materialize(sets), percent)
    links = _links(sets, "tokens", exact)
    linked = components(starred.unionAll(links)).toDF("cls", "component")

    named = materialize(classes.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    least_id = materialize(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = materialize(named.join(least_id, "component").select("cls", "component_id"))
    out = docs.join(named, "cls", "left")
    return out.select(id_col, "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``df`` without the documents that another of less id is linked with, directly
    or through others; of rows with the same id and text one stays."""
    found = materialize(join_components(df, id_col, text_col, words, percent).where("n_shingles > 0"))
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id"))
    gone = gone.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col))
    kept = without(df, gone, id_col)
    twice = found.groupBy(id_col).count().where("count > 1")
    if twice.isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])
