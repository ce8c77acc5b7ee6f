"""License scans by the Dice coefficient over word bigrams.

A template is the normalised text of a licence or of a notice. It is compared with stretches of a
document's words. A stretch is a match if the Dice coefficient of its bigrams and the template's,
both as multisets, is at least ``least``; its size is then between least / (2 - least) times the
template's and the inverse of that, and a third of the template's bigrams (at ``least`` 0.8) may be
missing at most: templates of which too few bigrams occur in a text are not tried.

A match's evidence is what it has in common beyond that: 2 * common - least * (both sizes). The
stretch of most evidence is found from running sums, in which a bigram counts if the template has
it; then its common bigrams are counted exactly. Where a bigram occurs more often than in the
template this may put a stretch off, so the sums are also tried with only as many of each bigram
as a stretch of the largest size may count, and short templates on all stretches.

Of matches that overlap, of whatever templates, the one of most evidence stands: a notice of one
licence is no notice of a similar one, and a licence text no part of another. The best match of
each licence is reported.

Defined results: null and empty texts have no licence. Templates under three words would be found
by chance and are refused. Ties go to the template that stands first. Rows that repeat give the
same rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import map_texts, texts_of
from wordloom.llm.licence_texts import templates as known_templates

WORD = re.compile(r"[^\W_]+")
#: Templates of so many bigrams at most are tried on all stretches where running sums fail.
SHORT = 200


class _Numbers(dict):
    """Words by number; others are -1."""

    def __missing__(self, word: str) -> int:
        return -1


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        texts = [WORD.findall(text.lower()) for _, text in templates]
        for (_, text), words in zip(templates, texts):
            if len(words) < 3:
                raise ValueError(f"a template of under three words: {text!r}")
        self.names = [name for name, _ in templates]
        self.sizes = [len(words) - 1 for words in texts]
        self.words = _Numbers((w, i) for i, w in enumerate(sorted({w for words in texts for w in words})))
        grams = [Counter(self._pairs(np.array([self.words[w] for w in words], np.int64)).tolist()) for words in texts]
        self.pairs = np.array(sorted({p for g in grams for p in g}), np.int64)
        number = {p: i for i, p in enumerate(self.pairs.tolist())}
        self.grams = [{number[p]: c for p, c in g.items()} for g in grams]
        rows = sorted((p, t) for t, g in enumerate(self.grams) for p in g)
        self.of_pair = np.array([t for _, t in rows], np.int64)  # templates, pair by pair
        self.begin = np.searchsorted([p for p, _ in rows], np.arange(len(self.pairs) + 1))
        self.low = [math.ceil(n * least / (2 - least) - 1e-9) for n in self.sizes]
        self.high = [math.floor(n * (2 - least) / least + 1e-9) for n in self.sizes]

    def _pairs(self, words: np.ndarray) -> np.ndarray:
        """A number for each bigram of known words, -1 for others."""
        pairs = words[:-1] * len(self.words) + words[1:]
        pairs[(words[:-1] < 0) | (words[1:] < 0)] = -1
        return pairs

    def common(self, t: int, pairs: np.ndarray) -> int:
        """Bigrams that template and stretch have in common."""
        found, n = np.unique(pairs[pairs >= 0], return_counts=True)
        own = self.grams[t]
        return sum(min(c, own.get(p, 0)) for p, c in zip(found.tolist(), n.tolist()))

    def evidence(self, t: int, pairs: np.ndarray) -> float:
        return 2 * self.common(t, pairs) - self.least * (len(pairs) + self.sizes[t])

    def _crowded(self, t: int, pairs: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """The hits that any stretch of the largest size which ends there may count."""
        out, seen = hits.copy(), {}
        for i in np.flatnonzero(hits).tolist():
            places = seen.setdefault(int(pairs[i]), [])
            n = self.grams[t][int(pairs[i])]
            out[i] = len(places) < n or places[-n] <= i - self.high[t]
            places.append(i)
        return out

    def _best(self, t: int, pairs: np.ndarray, lo: int, hi: int) -> tuple[float, int, int] | None:
        """Evidence, first bigram and end of the best stretch found within lo to hi."""
        own = pairs[lo:hi]
        own_hits = np.isin(own, np.fromiter(self.grams[t], np.int64, len(self.grams[t])))
        enough = self.least * self.sizes[t] - 1e-9
        best = None
        for hits in (own_hits, None):
            if hits is None:
                hits = self._crowded(t, own, own_hits)
                if (hits == own_hits).all():
                    break  # what was found is the best
                if self.sizes[t] <= SHORT:
                    return self._any(t, own, own_hits, lo) if self.common(t, own) >= self.low[t] else None
            sums = np.r_[0.0, np.cumsum(2.0 * hits - self.least)]
            least = np.minimum.accumulate(sums)
            end = int(np.argmax(sums - least))
            if sums[end] - least[end] < enough:
                break  # no stretch can do
            start = int(np.flatnonzero(sums[: end + 1] == least[end])[-1])
            found = self.evidence(t, own[start:end])
            if found >= -1e-9 and (best is None or found > best[0]):
                best = (found, lo + start, lo + end)
        return best

    def _any(self, t: int, own: np.ndarray, hits: np.ndarray, lo: int) -> tuple[float, int, int] | None:
        """The best of all stretches that start and end with a bigram of the template."""
        best, places = None, np.flatnonzero(hits).tolist()
        for k, start in enumerate(places):
            seen, common = Counter(), 0
            for i in places[k:]:
                if i - start + 1 > self.high[t]:
                    break
                p = int(own[i])
                seen[p] += 1
                common += seen[p] <= self.grams[t][p]
                found = 2 * common - self.least * (i - start + 1 + self.sizes[t])
                if found >= -1e-9 and (best is None or found > best[0]):
                    best = (found, lo + start, lo + i + 1)
        return best

    def matches(self, words: list[str]) -> list[tuple[float, int, int, int]]:
        """(evidence, template, first word, last word) of matches that don't overlap."""
        pairs = self._pairs(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        where = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        pairs = np.where(self.pairs[where] == pairs, where, -1)
        hit = pairs[pairs >= 0]
        if len(hit) < min(self.low):
            return []
        n = self.begin[hit + 1] - self.begin[hit]
        at = np.repeat(self.begin[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        counts = np.bincount(self.of_pair[at], minlength=len(self.names))
        queue: list[tuple[float, int, int, int, int, int]] = []
        out: list[tuple[float, int, int, int]] = []

        def look(t: int, lo: int, hi: int) -> None:
            if hi - lo >= self.low[t] and (x := self._best(t, pairs, lo, hi)):
                heapq.heappush(queue, (-x[0], t, x[1], x[2], lo, hi))

        for t in np.flatnonzero(counts >= self.low).tolist():
            look(t, 0, len(pairs))
        while queue:
            e, t, a, b, lo, hi = heapq.heappop(queue)
            # A match is from word a to b; what is taken already divides the place it was found in.
            taken = sorted((c, d) for _, _, c, d in out if lo <= d and c <= hi)
            if all(b < c or d < a for c, d in taken):
                out.append((-e, t, a, b))
                taken = [(a, b)]
            for c, d in taken:
                look(t, lo, c - 1)
                lo = d + 1
            look(t, lo, hi)
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, dice, start, end): the best match of each licence."""
        low = text.lower()
        if len(low) != len(text):  # some letters change their length
            low = "".join(c if len(c) == 1 else x for c, x in ((x.lower(), x) for x in text))
        words = WORD.findall(low)
        if len(words) < 3:
            return []
        best: dict[str, tuple[float, int, int]] = {}
        for e, t, a, b in self.matches(words):
            if self.names[t] not in best:
                n = b - a + self.sizes[t]
                best[self.names[t]] = ((e + self.least * n) / n, a, b)
        if not best:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        return sorted((name, dice, spans[a][0], spans[b][1]) for name, (dice, a, b) in best.items())


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...] | None, least: float) -> Scanner:
    return Scanner(templates or known_templates(), least)


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
    templates: tuple[tuple[str, str], ...] | None = None,
) -> DataFrame:
    """``id_col``, license, dice, start, end (code points): one row for each document and licence
    found; documents without one have no row. Without ``templates`` those of `licence_texts`."""

    def make():
        own = scanner(templates, least)

        def run(columns: list[pa.Array]) -> list[pa.Array]:
            rows = [(i, *x) for i, t in zip(columns[0].to_pylist(), texts_of(columns[1])) for x in own.scan(t)]
            c = list(zip(*rows)) or [[]] * 5
            types = [columns[0].type, pa.string(), pa.float64(), pa.int64(), pa.int64()]
            return [pa.array(x, t) for x, t in zip(c, types)]

        return run

    id_type = df.schema[id_col].dataType.simpleString()
    return map_texts(df, [id_col, text_col], f"`{id_col}` {id_type}, license string, dice double, start bigint, end bigint", make)
