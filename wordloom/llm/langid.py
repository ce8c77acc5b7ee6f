"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of
a word is the sum, over all its segmentations into pieces, of the products of their
probabilities; a forward pass over the word's characters gets it without listing them. A text's
score in a language is the sum over its words of the logarithm. Words are runs of letters,
lower-cased, with the vocabulary's mark of a word's start before them.

The piece probabilities are fitted by expectation-maximisation (forward and backward passes) to
the words of a bounded sample of labelled documents: at most about ``sample`` for each language,
chosen by a hash of the id. This is a classifier's training sample; prediction reads every whole
text. Model size: pieces of the vocabulary times languages.

Defined results: null text, empty text and text without letters is `und` with score 0, as is
every text if no document is labelled. Equal scores go to the first language in order of name.
Rows that repeat are predicted alike. A character outside the vocabulary counts as a rare piece.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import map_rows, map_texts, texts_of

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-8
ROUNDS = 4
SMOOTHING = 0.05
#: Bytes of words and their scores that are remembered from one block of texts to the next.
REMEMBERED = 40_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """All ways to cut words into pieces of the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        pieces = sorted({model.id_to_piece(i) for i in plain})
        self.size = len(pieces) + 1  # the last is any other character
        self.longest = max(map(len, pieces))
        self.known = []
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
                codes = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64).reshape(-1, n)
                h = np.zeros(len(ids), np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k]
                order = np.argsort(h)
                self.known.append((h[order], ids[order]))

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of each piece that occurs, in order of end; and the lengths."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(codes)) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        left = np.repeat(lengths, lengths) - start
        out = []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                keep = left[at] >= n
                at, h = at[keep], h[keep]
                if not len(at):
                    break
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + n - 1]
                hashes, ids = self.known[n - 1]
                if len(hashes):
                    i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    found = hashes[i] == h
                    piece = ids[i]
                else:
                    found, piece = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
                if n == 1:
                    piece = np.where(found, piece, self.size - 1)
                    found = np.ones(len(at), bool)
                a = at[found]
                out.append((word[a], start[a], start[a] + n, piece[found]))
        w, s, e, p = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((s, e))
        return w[order], s[order], e[order], p[order], lengths

    def forward(self, words: list[str], probability: np.ndarray, counts: np.ndarray | None = None):
        """Logarithm of each word's probability in each language. With counts[word, language]:
        also the expected uses of each piece. Columns are rescaled step by step, so words may
        be of any length."""
        w, s, e, p, lengths = self.edges(words)
        k = probability.shape[1]
        last = int(lengths.max())
        # forward[t] and its logarithmic scale, each relative to the word
        value = np.zeros((last + 1, len(words), k))
        scale = np.zeros((last + 1, len(words)))
        value[0] = 1
        bounds = np.searchsorted(e, np.arange(1, last + 2))
        for t in range(1, last + 1):
            a, b = bounds[t - 1], bounds[t]
            ww, ss = w[a:b], s[a:b]
            cuts = np.flatnonzero(np.r_[True, ss[1:] != ss[:-1]]) if b > a else []
            # log scale of t: that of t - 1, a piece of one character always ends here
            live = ww[ss == t - 1]
            scale[t, live] = scale[t - 1, live]
            for i, lo in enumerate(cuts):
                hi = cuts[i + 1] if i + 1 < len(cuts) else b - a
                x, u = ww[lo:hi], int(ss[lo])
                value[t, x] += value[u, x] * np.exp(scale[u, x] - scale[t, x])[:, None] * probability[p[a + lo : a + hi]]
            top = value[t, live].max(axis=1)
            value[t, live] /= top[:, None]
            scale[t, live] += np.log(top)
        rows = np.arange(len(words))
        with np.errstate(divide="ignore"):
            total = np.log(value[lengths, rows]) + scale[lengths, rows][:, None]
        if counts is None:
            return total
        back = np.zeros_like(value)  # times exp(scale of the word's end - scale of t)
        back[lengths, rows] = 1
        uses = np.zeros(probability.shape)
        ends = value[lengths, rows]
        final = scale[lengths, rows]
        for t in range(last, 0, -1):
            a, b = bounds[t - 1], bounds[t]
            ww, ss, pp = w[a:b], s[a:b], p[a:b]
            cuts = np.flatnonzero(np.r_[True, ss[1:] != ss[:-1]]) if b > a else []
            for i, lo in enumerate(cuts):
                hi = cuts[i + 1] if i + 1 < len(cuts) else b - a
                x, u, q = ww[lo:hi], int(ss[lo]), pp[lo:hi]
                step = np.exp(scale[u, x] - scale[t, x])[:, None] * probability[q]
                use = value[u, x] * step * back[t, x] / ends[x] * counts[x]
                for j in range(k):
                    uses[:, j] += np.bincount(q, use[:, j], minlength=self.size)
                back[u, x] += step * back[t, x]
        del final
        return total, uses

    def scores(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Logarithms, in blocks of words of like length so that memory stays bounded."""
        out = np.zeros((len(words), probability.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 10_000 and (to - at + 1) * (len(words[order[to]]) + 2) <= 150_000:
                to += 1
            block = order[at:to]
            out[block] = self.forward([words[i] for i in block], probability)
            at = to
        return out


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, word, n) of the training sample."""
    sizes = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("size"))
    chance = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("size")) * 1_000_000
    chosen = labelled.join(F.broadcast(sizes.select(lang_col, chance.alias("chance"))), lang_col)
    chosen = chosen.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < F.col("chance"))

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        found: Counter = Counter()
        for lang, text in zip(columns[0].to_pylist(), texts_of(columns[1])):
            for word, n in Counter(WORD.findall(text.lower())).items():
                found[lang, word] += n
        return [
            pa.array([k[0] for k in found], pa.string()),
            pa.array([k[1] for k in found], pa.string()),
            pa.array(list(found.values()), pa.int64()),
        ]

    words = map_texts(chosen, [lang_col, text_col], "lang string, word string, n bigint", lambda: run)
    return words.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int, vocabulary: str):
    """(languages, probability[piece, language]) from labelled documents."""
    rows = _sample(labelled, id_col, text_col, lang_col, sample).toPandas()
    langs = sorted(rows.lang.unique())
    if not langs:
        return [], None
    own = lattice(vocabulary)
    words = sorted(rows.word.unique())
    index = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(words), len(langs)))
    counts[[index[w] for w in rows.word], [langs.index(x) for x in rows.lang]] = rows.n
    probability = np.full((own.size, len(langs)), 1 / own.size)
    words_in_order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for _ in range(ROUNDS):
        uses = np.zeros(probability.shape)
        at = 0
        while at < len(words_in_order):
            to = at + 1
            while to < len(words_in_order) and to - at < 10_000 and (to - at + 1) * (len(words[words_in_order[to]]) + 2) <= 150_000:
                to += 1
            block = words_in_order[at:to]
            uses += own.forward([words[i] for i in block], probability, counts[block])[1]
            at = to
        uses += SMOOTHING
        probability = np.maximum(uses / uses.sum(axis=0), UNKNOWN)
    return langs, probability


def _letters(words: list[str]) -> bool:
    """Is there a letter? The pattern of words also takes numbers like ½."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def predictor(langs: list[str], probability: np.ndarray, path: str):
    """A function from texts to their languages and scores."""
    own = lattice(path)
    known: dict[str, int] = {}
    table = np.zeros((0, len(langs)))
    filled = held = 0

    def learn(words: set[str]) -> None:
        nonlocal table, filled, held
        new = list(words.difference(known))
        size = lambda some: sum(map(sys.getsizeof, some)) + (100 + 8 * len(langs)) * len(some)
        if held + size(new) > REMEMBERED:
            known.clear()
            table = np.zeros((0, len(langs)))
            filled, held, new = 0, 0, list(words)
        held += size(new)
        if new:
            if filled + len(new) > len(table):
                table = np.vstack([table[:filled], np.zeros((len(new) + filled + 10_000, len(langs)))])
            table[filled : filled + len(new)] = own.scores(new, probability)
            known.update(zip(new, range(filled, filled + len(new))))
            filled += len(new)

    def predict(texts: list[str]) -> tuple[list[str], list[float]]:
        pred, score = [], []
        for at in range(0, len(texts), 500):
            found = [WORD.findall(t.lower()) for t in texts[at : at + 500]]
            if langs:
                learn(set().union(*found))
            for words in found:
                if not langs or not _letters(words):
                    pred.append("und")
                    score.append(0.0)
                    continue
                sums = table[list(map(known.__getitem__, words))].sum(axis=0) / len(words) ** 0.5
                best = int(sums.argmax())
                pred.append(langs[best])
                score.append(float(1 / np.exp(sums - sums[best]).sum()))
        return pred, score

    return predict


def _held_out(id_col: str) -> Column:
    """Is crc32(id as text) mod 4 equal to 2? Without an id it is not."""
    held = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2
    return F.coalesce(held, F.lit(False))


def _labelled(df: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    return df.where(~_held_out(id_col) & F.col(lang_col).isNotNull())


def keep_identified(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: float = 0.5,
    sample: int = 400,
    vocabulary: str | None = None,
) -> DataFrame:
    """The rows of ``df`` whose language is found with a score of at least ``least``."""
    path = vocabulary or default_vocabulary()
    langs, probability = fit(_labelled(df, id_col, lang_col), id_col, text_col, lang_col, sample, path)
    model = df.sparkSession.sparkContext.broadcast((langs, probability))

    def make():
        predict = predictor(*model.value, path)

        def run(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
            pred, score = predict(texts_of(batch.column(at)))
            return batch.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score)], pa.bool_()))

        return run

    return map_rows(df, text_col, make)


def identify(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 400,
    vocabulary: str | None = None,
) -> DataFrame:
    """``id_col``, held_out, lang_pred, score.

    Documents whose crc32(id as text) mod 4 is 2 are held out of the training. score: the share
    of the predicted language, where the scores are divided by the root of the number of words
    so that long texts don't all reach 1.
    """
    path = vocabulary or default_vocabulary()
    langs, probability = fit(_labelled(df, id_col, lang_col), id_col, text_col, lang_col, sample, path)
    model = df.sparkSession.sparkContext.broadcast((langs, probability))
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        predict = predictor(*model.value, path)

        def run(columns: list[pa.Array]) -> list[pa.Array]:
            pred, score = predict(texts_of(columns[2]))
            return [columns[0], columns[1], pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return run

    schema = f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double"
    return map_texts(
        df.select(id_col, _held_out(id_col).alias("held_out"), text_col), [id_col, "held_out", text_col], schema, make
    )
