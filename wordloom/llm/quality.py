"""Quality rules with an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of order 4 over characters: the code points of
any script, lower-cased, with digits, white space, stops and other marks as one each. Spark counts the n-grams of all
documents, and computes continuation counts, discounts, back-off weights and probabilities from
the counts, for each language, in DataFrames. So the model grows with what the corpus holds, and
nothing of it is gathered in one place.

It is kept in an additive form. What an n-gram's probability is above what its context's weight
and the shorter n-gram's probability make it is one number, a context's weight another; the
logarithm of a probability is the sum of those numbers that are there. The numbers are dealt into
parts by hash, of at most PART numbers and for any languages, and a part is sent to the executors
as two arrays, hashes in sorted order and numbers. Texts are scored by binary search in them; a
worker remembers sums in a table of fixed size. A model of several parts scores in as many passes,
whose sums are added. So memory is bounded whatever the corpus, the scripts and the number of
languages.

A document passes if the logarithm of its perplexity lies within its language's band: from the
lower quartile less ``below`` times the interquartile range to the upper quartile plus ``above``
times it, the quartiles being those of the documents that pass the base rules. The band reaches
farther up, where texts in two languages lie, than down, where lists and repetition do.

Defined results: null and empty texts have no words and fail the base rules. A null language is a
language of its own. Rows that repeat are judged alike; very long texts are scored whole, in
slices. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import unicodedata
import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import kernel as K
from wordloom.llm.common import count_rows, map_texts, materialize, slices, texts_of, tidy

ORDER, BITS = 4, 16
SPACE, LINE, DIGIT, STOP, MARK = 32, 10, 48, 46, 35
#: Most numbers of the model that are sent at once; 12 bytes each.
PART = 4_000_000
#: Sums that a worker remembers (16 bytes each), a power of two.
KNOWN = 1 << 20
#: N-grams that a task gathers before it sends their counts.
GATHER = 2_000_000
#: Code points of a long text that are scored at once.
STEP = 1 << 20
SYMBOLS = "#*$%&|<>"


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """What each code point below 0x10000 counts as."""
    out = np.arange(0x10000, dtype=np.uint64)
    for point in range(0x10000):
        c = chr(point)
        if c == "\n" or 0xE000 <= point < 0xF900:  # private, for those beyond 0xFFFF
            continue
        if c.isspace() or unicodedata.category(c) == "Cc":
            out[point] = SPACE
        elif unicodedata.category(c)[0] == "N":
            out[point] = DIGIT
        elif unicodedata.category(c)[0] in "LM":
            out[point] = ord(c.lower()) if len(c.lower()) == 1 else point
        else:
            out[point] = STOP if c in ".,;:!?'\"()-" else MARK
    return out


def codes(text: str) -> np.ndarray:
    """The n-grams of order 4 that end at each character, 16 bits a character; white space stands
    before. Characters beyond 0xFFFF share the private ones."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = np.full(len(points) + ORDER - 1, SPACE, np.uint64)
    s[ORDER - 1 :] = _characters()[np.where(points < 0x10000, points, 0xE000 + points % 0x1900)]
    out = s[: len(points)].copy()
    for i in range(1, ORDER):
        out = (out << K.U(BITS)) | s[i : i + len(points)]
    return out


def _counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): all n-grams of order 4; tasks send sums."""

    def run(batches):
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        gathered = 0

        def merged(parts):
            if len(parts) == 1:
                return parts[0]
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def send():
            for lang, parts in sums.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            sums.clear()

        for batch in slices(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                by_lang.setdefault(lang, []).append(codes(text))
            for lang, found in by_lang.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                parts = sums.setdefault(lang, [])
                parts.append((grams, n))
                gathered += len(grams)
                if len(parts) > 8:
                    before = sum(len(g) for g, _ in parts)
                    parts[:] = [merged(parts)]
                    gathered -= before - len(parts[0][0])
            if gathered > GATHER:
                yield from send()
                gathered = 0
        yield from send()

    out = df.select(lang_col, text_col).mapInArrow(run, "lang string, gram bigint, n bigint")
    return out.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _with_discounts(grams: DataFrame) -> DataFrame:
    """Adds d, the modified Kneser-Ney discount of each n-gram's count, from the language's numbers
    of n-grams seen once, twice, three and four times (at least one of each)."""
    seen = grams.groupBy("lang").agg(*(F.greatest(F.lit(1), F.sum((F.col("n") == k).cast("int"))).alias(f"c{k}") for k in (1, 2, 3, 4)))
    y = F.expr("c1 / (c1 + 2 * c2)")
    d = [1 - 2 * y * F.expr("c2 / c1"), 2 - 3 * y * F.expr("c3 / c2"), 3 - 4 * y * F.expr("c4 / c3")]
    d = [F.least(F.greatest(x, F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k, x in enumerate(d, 1)]
    of = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return grams.join(materialize(seen.select("lang", *d)), "lang").select("lang", "gram", "n", of.alias("d"))


def _last(gram: str, order: int) -> Column:
    """The last ``order`` characters of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * order) - 1)) if order < 4 else F.col(gram)


def model(counts: DataFrame) -> DataFrame:
    """(lang, kind, gram, value): kind 1 to 4 is the order of an n-gram, whose value is added where
    it stands; kind 11 to 14 is ten and the order of n-grams whose context ``gram`` is, with the
    logarithm of its back-off weight. ``counts`` is a table (lang, gram, n) of order 4."""
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # in how many ways an n-gram continues a longer one
        shorter = orders[k + 1].groupBy("lang", _last("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        orders[k] = materialize(shorter)
    out, below = [], None
    for k in range(1, ORDER + 1):
        grams = _with_discounts(orders[k]).withColumn("context", F.shiftrightunsigned("gram", BITS))
        contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        contexts = materialize(contexts.select("lang", "context", "total", (F.col("taken") / F.col("total")).alias("weight")))
        out.append(contexts.select("lang", F.lit(10 + k).alias("kind"), F.col("context").alias("gram"), F.log("weight").alias("value")))
        found = grams.join(contexts, ["lang", "context"])
        if below is None:
            found = found.withColumn("p0", F.lit(1.0 / (1 << BITS)))
        else:
            found = found.withColumn("shorter", _last("gram", k - 1)).join(below, ["lang", "shorter"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("p0")
        found = materialize(found.select("lang", "gram", p.alias("p"), (F.log(p) - F.log("weight") - F.log("p0")).alias("value")))
        out.append(found.select("lang", F.lit(k).alias("kind"), "gram", "value"))
        below = found.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("p0"))
    return reduce(DataFrame.unionAll, out)


@lru_cache(maxsize=10_000)
def _seed(lang: str) -> np.uint64:
    points = np.frombuffer(lang.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    return K.mix(np.array([np.bitwise_xor.reduce(K.mix(points + K.U(256) * np.arange(len(points), dtype=np.uint64), 31), initial=K.U(7))]), 32)[0]


def _hashes(seeds, kind, grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(grams ^ K.mix(np.atleast_1d(seeds + K.U(1) * np.asarray(kind, np.uint64)), 33), 34)


class Arrays:
    """A part of the model, hashes in sorted order and their numbers, with a table of what has been
    looked up."""

    def __init__(self, rows: pa.Table):
        langs = rows["lang"].combine_chunks().dictionary_encode()
        seeds = np.array([_seed(x) for x in langs.dictionary.to_pylist()], np.uint64)
        kinds, grams, values = (rows[c].to_numpy() for c in ("kind", "gram", "value"))
        hashes = _hashes(seeds[langs.indices.to_numpy()], kinds, grams.view(np.uint64)) if len(grams) else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    def remember(self) -> None:
        self.known = np.zeros(KNOWN, np.uint64), np.zeros(KNOWN)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at].astype(np.float64), 0.0)

    def sums(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """For n-grams of order 4, what this part has for them and their shorter ones."""
        seed = _seed(lang)
        out = np.zeros(len(grams))
        for k in range(1, ORDER + 1):
            own = grams & K.U((1 << BITS * k) - 1)
            out += self.look_up(_hashes(seed, k, own)) + self.look_up(_hashes(seed, 10 + k, own >> K.U(BITS)))
        return out

    def total(self, lang: str, grams: np.ndarray) -> float:
        """The sum over a text's n-grams."""
        keys, values = self.known
        marks = _hashes(_seed(lang), 99, grams) | K.U(1)
        at = marks >> K.U(64 - KNOWN.bit_length() + 1)
        new = keys[at] != marks
        own = values[at]
        if new.any():
            some, first, which = np.unique(grams[new], return_index=True, return_inverse=True)
            sums = self.sums(lang, some)
            own[new] = sums[which]
            where = at[new][first]
            keys[where], values[where] = marks[new][first], sums
        return float(own.sum())


def base_rules(column: pa.Array) -> dict[str, list]:
    """Counts of the base rules for a column of texts."""
    data, offsets = K.flat(column)
    hashes, _, _, at = K.words(data, offsets, fold=False)
    runs = K.shingles(hashes, 3)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for text, a, b in zip(texts_of(column), at[:-1].tolist(), at[1:].tolist()):
        out["n_words"].append(b - a)
        out["word_chars"].append(len(text) - sum(map(text.count, " \t\n\v\f\r")))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        repeated = 0
        if b - a >= 4:
            own = runs[a : b - 2]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                twice = np.zeros(len(own), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                marked = np.zeros(b - a, bool)
                for k in range(3):
                    marked[k : k + len(own)] |= twice
                repeated = int(marked.sum())
        out["n_repeat_words"].append(repeated)
    return out


#: The part of the model that a worker got last, by name.
_parts: dict[str, Arrays] = {}


def _summed(docs: DataFrame, part: DataFrame, columns: dict[str, str], base: bool) -> DataFrame:
    """``columns`` (names and types, with lang and text) but the text, with `total`, what this part
    of the model has for the text; and the base counts if asked for."""
    arrays = Arrays(part.select("lang", "kind", "gram", "value").toArrow())
    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(arrays)
    names = [c for c in columns if c != "text"]

    def make():
        if name not in _parts:
            _parts.clear()
            sent.value.remember()
            _parts[name] = sent.value
        own = _parts[name]

        def run(batch: list[pa.Array]) -> list[pa.Array]:
            texts = texts_of(batch[-1])
            totals = []
            for lang, text in zip(batch[names.index("lang")].to_pylist(), texts):
                total = 0.0
                for at in range(0, len(text), STEP):
                    total += own.total(lang, codes(text[max(0, at - ORDER + 1) : at + STEP])[min(at, ORDER - 1) :])
                totals.append(total)
            counts = base_rules(batch[-1]) if base else {}
            chars = [len(t) for t in texts]
            return [*batch[:-1], pa.array(totals, pa.float64()), pa.array(chars, pa.int64()), *(pa.array(v, pa.int64()) for v in counts.values())]

        return run

    schema = ", ".join(f"`{c}` {columns[c]}" for c in names) + ", total double, chars bigint"
    if base:
        schema += ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    return map_texts(docs, [*names, "text"], schema, make)


@tidy
def judge(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 2.5, above: float = 3.0
) -> DataFrame:
    """``id_col``, lang, the base counts, base_failed, kept, log_perplexity (of a character) and its
    band (perplexity_low, perplexity_high, as logarithms)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("?")).alias("lang"), F.col(text_col).alias("text"))
    numbers = materialize(model(materialize(_counts(docs, "text", "lang"))))
    parts = max(1, -(-count_rows(numbers) * 5 // (4 * PART)))  # parts are dealt by hash, so uneven
    of = lambda i: numbers.where(F.pmod(F.xxhash64("lang", "kind", "gram"), F.lit(parts)) == i)
    types = {"id": df.schema[id_col].dataType.simpleString(), "lang": "string"}
    if parts == 1:
        scored = _summed(docs, of(0), types | {"text": "string"}, base=True)
    else:
        # Rows of the same text and language have the same sums, which are made and added by both.
        docs = docs.withColumn("mark", F.xxhash64("text")).withColumn("again", F.xxhash64(F.reverse("text")))
        of_text = {"mark": "bigint", "again": "bigint", "lang": "string", "text": "string"}
        scored = materialize(_summed(docs, of(0), {"id": types["id"]} | of_text, base=True))
        key = ["mark", "again", "lang"]
        rest = [_summed(docs, of(i), of_text, base=False).groupBy(key).agg(F.max("total").alias("total")) for i in range(1, parts)]
        rest = materialize(reduce(DataFrame.unionAll, rest).groupBy(key).agg(F.sum("total").alias("more")))
        scored = scored.join(rest, key).withColumn("total", F.col("total") + F.col("more"))
    mean = F.when(F.col("chars") > 0, -(F.col("total") / F.col("chars")) - F.log(F.lit(1.0 / (1 << BITS)))).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = materialize(scored.select(F.col("id").alias(id_col), "lang", *base, mean.alias("log_perplexity"), failed.alias("base_failed")))
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q")
    bands = scored.where("not base_failed").groupBy("lang").agg(quartiles)
    spread = F.col("q")[1] - F.col("q")[0]
    low, high = F.col("q")[0] - below * spread, F.col("q")[1] + above * spread
    bands = materialize(bands.select("lang", low.alias("perplexity_low"), high.alias("perplexity_high")))
    out = scored.join(bands, "lang", "left")
    inside = F.col("log_perplexity").between(F.col("perplexity_low"), F.col("perplexity_high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
