import itertools
import random
import struct

import pytest
import sentencepiece

from wordloom.llm.sp_codec import Codec, codec, decode_texts, default_model, encode_texts

TEXTS = [
    "", "a", " a", "a  b ", "  ", "日本語 \U00012000x ñ\t\nfoo ▁x", "<s> <unk> <0x41>", "x" * 500, "▁", "\U00012000",
    "=======  -- ...   !!!!", "a\U00012000b c",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_as_the_library(library):
    own, r = codec(default_model()), random.Random(1)
    texts = TEXTS + ["".join(r.choice("aeinrst  \n.,é日\U00012000▁") for _ in range(r.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert own.encode(t) == library.encode(t)
        assert own.decode(own.encode(t)) == library.decode(library.encode(t))


def field(k, v):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(v, int):
        return varint(k << 3) + varint(v)
    if isinstance(v, float):
        return varint(k << 3 | 5) + struct.pack("<f", v)
    return varint(k << 3 | 2) + varint(len(v)) + v


def test_unigram_model_takes_the_best_sum(tmp_path):
    r = random.Random(3)
    pieces = ["▁"] + sorted({"".join(r.choice("abc▁"[: 3 + (k == 0)]) for k in range(r.randint(1, 4))) for _ in range(40)} | set("abc"))
    scores = {p: -r.random() * 5 - 1 for p in dict.fromkeys(pieces)}
    data = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    for p, s in scores.items():
        data += field(1, field(1, p.encode()) + field(2, s))
    data += field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0))
    (tmp_path / "m.model").write_bytes(data)
    own = Codec(str(tmp_path / "m.model"))
    names = list(scores)
    for _ in range(200):
        text = "".join(r.choice("abc ") for _ in range(r.randint(1, 9)))
        whole = "▁" + text.replace(" ", "▁")
        best = -1e9
        for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(whole)]
            parts = [whole[a:b] for a, b in zip(at, at[1:])]
            if all(p in scores for p in parts):
                best = max(best, sum(scores[p] for p in parts))
        got = own.encode(text)
        assert abs(sum(scores[names[i - 1]] for i in got) - best) < 1e-5
        assert own.decode(got) == text


def test_query(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(50, None, 1), (0, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    out = encode_texts(df)
    got = out.collect()
    assert sorted((r.doc_id, r.pieces) for r in got) == sorted((i, library.encode(t or "")) for i, t, _ in rows)
    assert all(r.n_pieces == len(r.pieces) for r in got)
    assert sorted(r.doc_id for r in got if not r.round_trip) == [i for i, t in enumerate(TEXTS) if "▁" in t]
    assert sorted(r.text for r in decode_texts(out).collect()) == sorted(library.decode(library.encode(t or "")) for _, t, _ in rows)
    assert encode_texts(df.limit(0)).count() == 0
