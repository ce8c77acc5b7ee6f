import math

import numpy as np

from wordloom.llm.langid import default_vocabulary, identify, lattice


def brute(word, own, pieces, probability):
    text = "▁" + word
    ways = [1.0] + [0.0] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            piece = pieces.get(text[s:e], own.size - 1 if e - s == 1 else None)
            if piece is not None:
                ways[e] += ways[s] * probability[piece, 0]
    return math.log(ways[-1])


def test_forward_sums_all_segmentations():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_vocabulary())
    own = lattice(default_vocabulary())
    plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    pieces = {p: i for i, p in enumerate(sorted({model.id_to_piece(i) for i in plain}))}
    probability = np.random.default_rng(1).dirichlet(np.ones(own.size), 1).T + 1e-7
    words = ["a", "the", "interesting", "ñandú", "日本語", "zzqx" * 14, "𒀀b"]
    got = own.scores(words, probability)[:, 0]
    want = [brute(w, own, pieces, probability) for w in words]
    assert np.allclose(got, want)
    total, uses = own.forward(words[:4], probability, np.ones((4, 1)))
    assert np.allclose(total[:, 0], want[:4])
    lengths = np.array([len(p) for p in sorted(pieces)] + [1])
    assert math.isclose((uses[:, 0] * lengths).sum(), sum(len(w) + 1 for w in words[:4]), rel_tol=1e-9)


def test_query(spark):
    en = ["the cat sat on the mat", "this is the house of the man", "when will the others come back"] * 4
    de = ["die katze sitzt auf der matte", "das ist das haus von dem mann", "wann werden die anderen kommen"] * 4
    rows = [(i, t, x, "y") for i, (t, x) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de])]
    rows += [(900, None, "en", ""), (901, "", None, ""), (902, "12 % ½", None, ""), (903, "der mann und die katze", None, ""), (903, "where is the cat", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify(df).collect()]
    assert len(got) == len(rows)
    pred = sorted((i, p) for i, p, _ in got if i >= 900)
    assert pred == [(900, "und"), (901, "und"), (902, "und"), (903, "de"), (903, "en")]
    assert all(0 <= s <= 1 for _, _, s in got) and all(s == 0 for i, _, s in got if 900 <= i < 903)
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0
