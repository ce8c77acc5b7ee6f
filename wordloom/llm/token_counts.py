"""Token counts of whole texts under a byte-level BPE, by prefix dynamic programming.

For a word of the pre-tokenizer the table ``count[i]`` holds the exact number of tokens of its
first ``i`` bytes. A prefix ends with exactly one token: the one that may stand after the last
token of the shorter prefix, where two tokens may stand side by side if the merges, run over
both together, give just these two. So one pass over the bytes fills the table, and a question
on a prefix, a truncation or a budget reads it without encoding again.

Defined results: null and empty texts have 0 bytes and 0 tokens and are within any limit. Rows
that repeat, also with the same id, are each counted. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import repeat

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wordloom.llm.common import Remembered, map_texts, texts_of

#: Bytes of each of two memories of words, and pairs of tokens that are remembered (130 bytes each).
REMEMBERED, PAIRS = 90_000_000, 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, str]:
    """The letters by which the file writes bytes -> the characters 0 to 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): chr(b) for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): chr(b) for i, b in enumerate(others)}


class PrefixCounter:
    """Exact token counts of every prefix of a text. Words are strings of bytes (latin-1)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        plain = lambda piece: "".join(letters[c] for c in piece)
        self.rank: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[plain(left), plain(right)] = i
        special = {t["content"] for t in spec["added_tokens"]}
        self.tokens = [plain(t) for t in spec["model"]["vocab"] if t not in special]
        self.matches = ahocorasick.Automaton()  # finds all tokens that end at a byte
        for i, token in enumerate(self.tokens):
            self.matches.add_word(token, (len(token), i))
        self.matches.make_automaton()
        self.special = regex.compile("|".join(map(regex.escape, sorted(special)))) if special else None
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        # The same for texts up to U+024F, by a faster library.
        letters, digits, blank = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
        self.latin = re.compile("[\x00-ɏ]*")
        self.latin_words = re.compile(
            f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{blank}{letters}{digits}]+"
            f"|[{blank}]+(?![^{blank}])|[{blank}]+"
        )
        self.fits: dict[int, bool] = {}
        self.totals = Remembered(self.count_word, REMEMBERED)
        self.by_chunk = Remembered(lambda chunk: self.count_chunk(" " + chunk), REMEMBERED)
        self.space_runs = re.compile(r"[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
        self.lone_space = re.compile(r"(?<=\S) ")

    def merged(self, word: str) -> list[str]:
        """Tokens of ``word`` by running the merges; only pairs of tokens come here."""
        parts = list(word)
        while len(parts) > 1:
            ranks = list(map(self.rank.get, zip(parts, parts[1:]), repeat(1 << 60)))
            if (best := min(ranks)) == 1 << 60:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """May token ``right`` stand after ``left`` (-1: at the start of a word)?"""
        if left < 0:
            ok = self.merged(self.tokens[right]) == [self.tokens[right]]
        else:
            pair = [self.tokens[left], self.tokens[right]]
            ok = tuple(pair) not in self.rank and self.merged("".join(pair)) == pair
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[left << 20 | right] = ok
        return ok

    def table(self, word: str) -> list[int]:
        """count[i] for each number of bytes i of a word of the pre-tokenizer."""
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        known = self.fits.get
        done = -1
        for end, (size, token) in self.matches.iter(word):
            if end == done:
                continue
            start = end + 1 - size
            left = last[start]
            ok = known(left << 20 | token)
            if self.may_follow(left, token) if ok is None else ok:
                last[end + 1], count[end + 1] = token, count[start] + 1
                done = end
        return count

    def count_word(self, word: str) -> int:
        if self.special is not None and self.special.fullmatch(word):
            return 1
        return self.table(word.encode("utf-8", "surrogatepass").decode("latin-1"))[-1]

    def pieces(self, text: str) -> list[str]:
        """Words of the pre-tokenizer and special strings, in order; together they are the text."""
        split = (self.latin_words if self.latin.fullmatch(text) else self.words).findall
        if self.special is None or not (found := list(self.special.finditer(text))):
            return split(text)
        out, at = [], 0
        for m in found:
            out += [*split(text[at : m.start()]), m[0]]
            at = m.end()
        return out + split(text[at:])

    def chunks(self, text: str) -> list[str]:
        """``text`` cut before spaces, where no word of the pre-tokenizer reaches across: a space
        always opens a new one, except after other white space. All but the first chunk go
        without the space before them."""
        if self.space_runs.search(text) is None:
            return text.split(" ")
        return self.lone_space.split(text)

    def count_chunk(self, chunk: str) -> int:
        return sum(map(self.totals.__getitem__, self.pieces(chunk)))

    def count(self, text: str) -> int:
        chunks = self.chunks(text)
        return self.count_chunk(chunks[0]) + sum(map(self.by_chunk.__getitem__, chunks[1:]))

    def prefix_counts(self, text: str) -> list[int]:
        """The number of tokens of text[:p], for each number of characters p."""
        out, base, run_start, run_base = [0], 0, 0, 0
        at = 0
        for piece in self.pieces(text):
            if self.special is not None and self.special.fullmatch(piece):
                inner = [self.count(text[: at + c]) - base for c in range(1, len(piece))] + [1]
            else:
                widths = [0]
                for c in piece:
                    widths.append(widths[-1] + len(c.encode("utf-8", "surrogatepass")))
                counts = self.table(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
                inner = [counts[w] for w in widths[1:]]
                if piece[0] == "'" and piece[1:2].isalpha():  # cut, it is no contraction
                    inner[:-1] = [self.count(piece[:c]) for c in range(1, len(piece))]
            for c, n in enumerate(inner):
                p = at + c + 1
                if text[p - 1].isspace():
                    if p == 1 or not text[p - 2].isspace():
                        run_start, run_base = p - 1, out[p - 1]
                    out.append(run_base + self.totals[text[run_start:p]])
                else:
                    out.append(base + n)
            at += len(piece)
            base += inner[-1]
        return out

    def fitting(self, text: str, limit: int) -> int:
        """The most characters of a prefix that has at most ``limit`` tokens."""
        if limit <= 0 or not text:
            return 0
        chunks = self.chunks(text)
        base, at = 0, 0
        for i, chunk in enumerate(chunks):
            n = self.by_chunk[chunk] if i else self.count_chunk(chunk)
            if base + n > limit:
                break
            base, at = base + n, at + len(chunk) + (i > 0)
        else:
            return len(text)
        tail = f" {chunk}" if i else chunk
        counts = self.prefix_counts(tail)
        return at + max(p for p, n in enumerate(counts) if base + n <= limit)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    tokenizer: str | None = None,
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), and fitting_chars:
    the length in code points of the longest prefix of at most ``limit`` tokens."""
    path = tokenizer or default_tokenizer()
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        own = counter(path)

        def run(columns: list[pa.Array]) -> list[pa.Array]:
            texts = texts_of(columns[1])
            tokens = [own.count(t) for t in texts]
            return [
                columns[0],
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
                pa.array([len(t) if n <= limit else own.fitting(t, limit) for t, n in zip(texts, tokens)], pa.int64()),
            ]

        return run

    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, fitting_chars bigint"
    return map_texts(df, [id_col, text_col], schema, make)
