import re
from collections import Counter

import numpy as np
import pyarrow as pa

from wordloom.llm import quality as Q
from wordloom.llm.common import materialize
from wordloom.llm.quality import judge

TEXTS = [
    "", None, " \n\t", "one", "a b c a b c", "a b c d a b c d a\n\nx\nx\n x\nx \n", "# * $ % & | < > é b\x1cc",
    "the quick brown fox\n" * 30, "日本 語 the cat", "word " * 200, " ".join(f"w{i} the of" for i in range(80)),
]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            marked |= {i, i + 1, i + 2}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_base_rules():
    got = Q.base_rules(pa.array(TEXTS))
    assert list(zip(*got.values())) == [base(t or "") for t in TEXTS]


def arrays(spark, texts):
    """The model of texts (lang, text), in one part."""
    df = spark.createDataFrame(texts, "lang string, text string")
    out = Q.Arrays(Q.model(materialize(Q._counts(df, "text", "lang"))).toArrow())
    out.remember()
    return out


def log_p(own, lang, grams):
    return own.sums(lang, np.asarray(grams, np.uint64)) - np.log(1 << 16)


TRAINED = [("a", "abab ba abba Ünïcode 42"), ("b", "москва и река, река и москва"), ("b", "да"), ("c", "日本語の文章は日本の文章"), ("d", None), ("d", "😀😁 x")]


def test_model_is_a_distribution(spark):
    own = arrays(spark, TRAINED)
    for lang, context in (("a", "aba"), ("a", "zzz"), ("b", "рек"), ("c", "日本語"), ("c", "x日本"), ("d", "   ")):
        head = 0
        for c in context:
            head = head << 16 | ord(c)
        grams = (np.uint64(head << 16) + np.arange(1 << 16, dtype=np.uint64)).astype(np.uint64)
        assert np.isclose(np.exp(log_p(own, lang, grams)).sum(), 1, atol=1e-3)


def test_kneser_ney_by_hand(spark):
    own = arrays(spark, TRAINED)
    for lang in "abcd":
        counts = {4: Counter(g for x, t in TRAINED if x == lang for g in Q.codes(t or "").tolist())}
        for k in (3, 2, 1):
            counts[k] = Counter(g & ((1 << 16 * k) - 1) for g in counts[k + 1])
        discounts = {}
        for k, c in counts.items():
            n = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            discounts[k] = [0, *(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))]

        def p(gram, k):
            if k == 0:
                return 2**-16
            same = {g: v for g, v in counts[k].items() if g >> 16 == gram >> 16}
            below = p(gram & ((1 << 16 * (k - 1)) - 1), k - 1)
            if not same:
                return below
            total, here, d = sum(same.values()), counts[k][gram], discounts[k]
            return (here - d[min(here, 3)]) / total + sum(d[min(v, 3)] for v in same.values()) / total * below

        grams = [*counts[4], *Q.codes("abxab рекада の本語 ab").tolist()]
        assert np.allclose(log_p(own, lang, grams), [np.log(p(g, 4)) for g in grams], atol=1e-4)
        text = "ab река 日本 abab"
        assert np.isclose(own.total(lang, Q.codes(text)), own.sums(lang, Q.codes(text)).sum())
        assert np.isclose(own.total(lang, Q.codes(text)), own.sums(lang, Q.codes(text)).sum())


def test_scripts_are_told_apart(spark):
    """In any script texts of other characters or in another order are less expected."""
    r = np.random.default_rng(4)
    letters = {"ru": "абвгдежзик", "zh": "的一是不了人我在有他", "el": "αβγδεζηθικ"}
    rows, shuffled = [], {}
    for lang, own in letters.items():
        some = ["".join(r.choice(list(own), 4)) for _ in range(12)]
        for i in range(60):
            rows.append((len(rows), " ".join(r.choice(some, 80)), lang))
        mixed = [*rows[-1][1]]
        r.shuffle(mixed)
        shuffled[len(rows)] = lang
        rows.append((len(rows), " ".join("".join(mixed).split()), lang))
    got = {x.doc_id: x for x in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, lang in shuffled.items():
        fine = [x.log_perplexity for j, x in got.items() if x.lang == lang and j != i]
        assert got[i].log_perplexity > 1.3 * max(fine) and not got[i].kept
        assert sum(x.kept for x in got.values() if x.lang == lang) >= 55


def test_many_languages_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(Q, "KNOWN", 1 << 10)
    long = " ".join(f"w{i % 977} of the x{i % 31}" for i in range(120_000))
    rows = [(i, f"text of language {i}, some words of it", f"l{i}") for i in range(1000)] + [(2000, long, "en"), (2000, long, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in judge(df).collect()}
    assert len(got) == 1001 and got[2000].n_words == len(long.split())
    monkeypatch.setattr(Q, "PART", 8_000)
    monkeypatch.setattr(Q, "STEP", 1000)
    again = {r.doc_id: r for r in judge(df).collect()}
    assert all(abs(r.log_perplexity - again[i].log_perplexity) < 1e-6 and r.kept == again[i].kept for i, r in got.items())


def test_query(spark, monkeypatch):
    r = np.random.default_rng(1)
    junk = " ".join("".join(map(chr, r.integers(97, 123, 7))) for _ in range(90))
    rows = [(i, t, "en" if i % 3 else None, "x") for i, t in enumerate(TEXTS)]
    fine = [" ".join(f"{'abcdefg'[(i * j) % 7]}{'aeiou'[j % 5]}n" for j in range(70 + i)) + f" k{i}" for i in range(60)]
    rows += [(100 + i, t, "en", "x") for i, t in enumerate(fine)] + [(200, junk, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in judge(df).collect()}
    own = sorted(r.log_perplexity for i, r in got.items() if 100 <= i < 200)
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, (n, chars, symbols, dup, rep) = got[i], base(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert not got[200].base_failed and got[200].log_perplexity > own[-1]
    assert got[200].kept == (got[200].log_perplexity <= got[200].perplexity_high)
    monkeypatch.setattr(Q, "PART", 500)
    again = {r.doc_id: r for r in judge(df).collect()}
    assert {i: (r.kept, round(r.log_perplexity, 6)) for i, r in got.items()} == {i: (r.kept, round(r.log_perplexity, 6)) for i, r in again.items()}
    assert judge(df.limit(0)).count() == 0
