"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one pass of Viterbi.

The automaton over the vocabulary gives, for each position of a text, all pieces that end there
(it follows the output links). One pass from left to right keeps for each position the best way
to reach it:

* for a unigram model, the greatest sum of piece scores;
* for a byte-pair model, whose result is not a maximum of scores, the one piece that may end
  there: a piece is relaxed only from a position whose last piece it may follow, where two pieces
  may stand side by side if the model's merges, run over both together, give just these two.

Either way the result is that of the model's own library. Pieces never reach over the start of
a run of white space, so what lies between two such starts is encoded on its own and remembered.
A character that is in no piece becomes its bytes, or the unknown piece without byte pieces.

Defined results: null and empty texts have no pieces. Rows that repeat are encoded alike. The
mark of white space itself (U+2581) decodes as a space, as in the library; ``round_trip`` says
whether decoding gives the text back. Only models without character normalisation are read.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import Remembered, map_texts, texts_of

NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Bytes of the memory of stretches, and pairs of pieces that are remembered (130 bytes each).
REMEMBERED, PAIRS = 120_000_000, 500_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        for piece in (dict(_fields(v)) for k, v in fields if k == 1):
            self.pieces.append(piece[1].decode())
            self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            self.kinds.append(piece.get(3, NORMAL))
        trainer = dict(_fields(next(v for k, v in fields if k == 2)))
        normalizer = dict(_fields(next(v for k, v in fields if k == 3)))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or normalizer.get(4, 1) or trainer.get(24):
            raise ValueError("only unigram and byte-pair models with identity normalisation are read")
        self.prefix = "▁" if normalizer.get(3, 1) else ""
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.lowest = min(self.scores) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known = Remembered(self.ids_of, REMEMBERED)
        self.table = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁", " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.table[self.unknown] = " ⁇ ".encode()
        self.runs = re.compile("▁+[^▁]*|[^▁]+")

    def merged(self, text: str) -> list[str]:
        """The merges, run over the characters of one or two pieces."""
        parts = list(text)
        while len(parts) > 1:
            ids = [self.ids.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((self.scores[i] for i in ids if i is not None), default=None)
            if best is None:
                break
            at = next(k for k, i in enumerate(ids) if i is not None and self.scores[i] == best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """May piece ``right`` stand after ``left`` (-1: where nothing merges with it)?"""
        pair = [self.pieces[i] for i in (left, right) if i >= 0]
        ok = ("".join(pair) not in self.ids or left < 0) and self.merged("".join(pair)) == pair
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[left << 20 | right] = ok
        return ok

    def encode_run(self, run: str) -> list[int]:
        """Pieces of a stretch that no piece reaches out of, by one pass over the automaton."""
        n = len(run)
        last, start, score = [-1] * (n + 1), [-1] * (n + 1), [0.0] * (n + 1)
        known, bpe = self.fits.get, self.kind == BPE
        for end, (size, piece) in self.automaton.iter(run):
            a = end + 1 - size
            if a and start[a] < 0:
                self._alone(run, a, last, start, score)
            if bpe:
                if start[end + 1] >= 0:
                    continue
                left = last[a] if a and last[a] >= 0 else -1
                ok = known(left << 20 | piece)
                if self.may_follow(left, piece) if ok is None else ok:
                    last[end + 1], start[end + 1] = piece, a
            else:
                s = score[a] + self.scores[piece]
                if start[end + 1] < 0 or s > score[end + 1]:
                    last[end + 1], start[end + 1], score[end + 1] = piece, a, s
        self._alone(run, n, last, start, score)
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(run[at - 1].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at = start[at]
        return out[::-1]

    def _alone(self, run: str, to: int, last: list[int], start: list[int], score: list[float]) -> None:
        """Reaches ``to`` over the characters before it that stand alone."""
        at = to
        while at and start[at] < 0:
            at -= 1
        for k in range(at, to):
            last[k + 1], start[k + 1], score[k + 1] = -2, k, score[k] + self.lowest

    def ids_of(self, run: str) -> bytes:
        """Ids of a stretch as bytes. With a prefix, one without marks stands for that after one."""
        return np.array(self.encode_run(self.prefix + run if run[0] != "▁" else run), np.int32).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Piece ids as 32-bit numbers."""
        if not text:
            return b""
        words = text.split(" ")
        if self.prefix and all(words) and "▁" not in text:
            return b"".join(map(self.known.__getitem__, words))
        return b"".join(self.known[r] if r[0] != "▁" or r[:2] == "▁▁" or len(r) < 2 else self.known[r[1:]] if self.prefix else self.known[r] for r in self.runs.findall(self.prefix + text.replace(" ", "▁")))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.table.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``id_col``, n_pieces, pieces (ids), round_trip: does decoding give the text back?"""
    path = model or default_model()

    def make():
        own = codec(path)

        def run(columns: list[pa.Array]) -> list[pa.Array]:
            texts = texts_of(columns[1])
            ids = [np.frombuffer(own.encode_bytes(t), np.int32) for t in texts]
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            back = [own.decode(x.tolist()) == t for x, t in zip(ids, texts)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))
            return [columns[0], pa.array(sizes), lists.cast(pa.list_(pa.field("element", pa.int32()))), pa.array(back)]

        return run

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_pieces bigint, pieces array<int>, round_trip boolean"
    return map_texts(df, [id_col, text_col], schema, make)


def decode_texts(df: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str | None = None) -> DataFrame:
    """``id_col`` and the text of a column of piece ids. Null: empty."""
    path = model or default_model()

    def make():
        own = codec(path)
        return lambda columns: [columns[0], pa.array([own.decode(x or []) for x in columns[1].to_pylist()], pa.string())]

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string"
    return map_texts(df, [id_col, pieces_col], schema, make)
