import pytest
from tokenizers import Tokenizer

from wordloom.llm.token_counts import count_tokens, counter, default_tokenizer

TEXTS = [
    "", " ", "a", "I'll we're  x\n\n\n  foo <|endoftext|> bar  ", "日本語 ñandú 🙂🙂", "x" * 3000,
    " " * 500 + "a", "don't'rex 'r 12345 67 $$$ ###", " 　 a", "ab  cd\n\n ef 'll 's x'v", "² ½ ª\x1c \x85 b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def n(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(library, text):
    own = counter(default_tokenizer())
    text = text[:600]
    want = [n(library, text[:p]) for p in range(len(text) + 1)]
    assert own.prefix_counts(text) == want
    for limit in (0, 1, 2, 3, 5, 9, 17):
        assert own.fitting(text, limit) == max(p for p, k in enumerate(want) if k <= limit)


def test_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (0, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes): r for r in count_tokens(df, limit=5).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i, len((t or "").encode())]
        assert r.n_tokens == n(library, t or "") and r.over_limit == (r.n_tokens > 5)
    assert count_tokens(df.limit(0)).count() == 0
