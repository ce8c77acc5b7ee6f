"""Hashes of words and shingles of whole batches of texts, in array operations.

A word's hash is a polynomial in its bytes modulo 2**64, read off running sums over the batch,
then scrambled; a shingle's hash combines those of its words. Equal words give equal hashes on
every machine. Two different shingles of a comparison share a hash with a chance of about 5e-20.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text in one step; a batch, or one long text, is cut between words.
STEP = 1 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambles 64-bit numbers; one to one."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for base in (_BASE, _INVERSE):
            steps = np.full(n + 1, U(base))
            steps[0] = U(1)
            out.append(np.cumprod(steps, dtype=U))
    return out[0], out[1]


@lru_cache(maxsize=2)
def _bytes(fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte (A-Z as a-z if ``fold``), and which bytes belong to words."""
    values = mix(np.arange(256, dtype=U), 77)
    if fold:
        values[65:91] = values[97:123]
    inside = np.ones(256, bool)
    inside[[0x20, *range(9, 14)]] = False
    return values, inside


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text starts and the last ends. Null: empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word `[^\\x20\\x09-\\x0D]+`, and each text's first word."""
    values, inside = _bytes(fold)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # of a text
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        to = min(len(data), at + STEP)
        if to < len(data):  # back to the start of a text or to white space
            cuts = np.flatnonzero(first[at + 1 : to + 1] | ~inside[data[at + 1 : to + 1]])
            if len(cuts):
                to = at + 1 + int(cuts[-1])
            else:
                more = np.flatnonzero(first[to:] | ~inside[np.append(data[to:], 32)])
                to += int(more[0])
        part = data[at:to]
        word = inside[part]
        new = word.copy()
        new[1:] &= ~word[:-1] | first[at + 1 : to]
        last = word.copy()
        last[:-1] &= ~word[1:] | first[at + 1 : to]
        s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
        power, inverse = _powers(max(STEP, 1 << (len(part)).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(values[part] * power[: len(part)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs may cross from a text into the next one."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, size):
            out = out * U(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out, size)


def shingle_sets(column: pa.Array, size: int, fold: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: of ``size`` words, or of all its words if it
    has fewer; none without words."""
    data, offsets = flat(column)
    hashes, _, _, at = words(data, offsets, fold)
    runs = shingles(hashes, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(shingles(hashes[a:b], b - a) if b > a else np.zeros(0, U))
    return out
