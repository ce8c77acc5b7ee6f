import hashlib
import random
import re

import numpy as np
import pytest

from wordloom.llm import pii
from wordloom.llm.pii import base_spans, find, luhn, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans():
    r = random.Random(4)
    texts = ["é a@b@c.d.e@f.gg 1.2.3.4.5.6.7.8 300.1.1.1 +1 (555) 010-2233.", "4111 1111 1111 1111 5500-0000-0000-0004 41111111111111112", "007.08.0009.1"]
    texts += ["".join(r.choice("ab@@..--++0123456789  ()é%") for _ in range(r.randint(5, 80))) for _ in range(3000)]
    for t in texts:
        assert base_spans(t) == brute(t), t


def test_query(spark):
    token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    text = f'words token = "{token}" and mail me@x.org now'
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "plain words of averyveryverylongcompoundword2 and more")]
    rows += [(10 + i, f'a token = "{hashlib.sha1(str(i).encode()).hexdigest()}" b') for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in find(df).collect()}
    assert find(df).count() == len(rows)
    at, mail = text.index(token), text.index("me@")
    assert got[1].spans == f"secret:{at}:{at + 40},email:{mail}:{mail + 8}" and got[1].n_email == 1
    assert got[1].base_sha256 == hashlib.sha256(f"email:{mail}:{mail + 8}".encode()).hexdigest()
    assert got[2].spans == got[3].spans == got[4].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert redact(text, got[1].spans) == 'words token = "<SECRET>" and mail <EMAIL> now'
    assert find(df.limit(0)).count() == 0


def named(text):
    """All candidates for persons by the two patterns alone, the longest of those that overlap first."""
    titled = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?|Doña?)\.? (?:[A-Z]\w+[ '-]?){1,3}"
    found = {(m.start(), m.start() + len(m[0].rstrip(" '-"))) for m in re.finditer(titled, text)}
    for name in pii.FIRST_NAMES:
        found |= {m.span() for m in re.finditer(rf"(?<!\w){name} [A-Z]\w+", text)}
    out, end = [], 0
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= end:
            out.append(("person", s, e))
            end = e
    return out


def test_names_do_not_depend_on_other_words():
    for text in ("by Ms Jones.", "Doña Elena Ruiz", "(John Smith)", '"John Smith"', "name:John Smith", "x John Mary Smith"):
        assert pii.candidates(text, []) == named(text) != [], text
    r = random.Random(6)
    pieces = ["Ms", "Ms.", "Mr", "Doña", "Don", "Señora", "x", "John", "Mary", "Jean", "Jones", "Ruiz", "é", "(", '"', ":", " ", " ", " ", "-", "'", "\n", "."]
    for _ in range(5000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(2, 20)))
        assert pii.candidates(text, []) == named(text), text


def test_reliabilities_are_found():
    """Of labelers of known reliability, one of which says nothing and one little, EM tells right
    candidates from wrong ones better than a count of votes, and the classifier follows it."""
    r = np.random.default_rng(3)
    right = r.random(20_000) < 0.3
    votes, odds = [], np.full(len(right), np.log(0.3 / 0.7))  # the odds that who knows the reliabilities has
    for yes, no in ((0.95, 0.9), (0.9, 0.95), (0.6, 0.55), (0.5, 0.5), (0.85, 0.8)):
        says = np.where(right, r.random(len(right)) < yes, r.random(len(right)) > no)
        votes.append(np.where(r.random(len(right)) < 0.1, 0, np.where(says, 1, -1)))
        odds += np.select([votes[-1] == 1, votes[-1] == -1], [np.log(yes / (1 - no)), np.log((1 - yes) / no)], 0.0)
    rows, which, n = np.unique(np.column_stack(votes), axis=0, return_inverse=True, return_counts=True)
    p = pii.posteriors(rows, n.astype(float))
    found = p[which] > 0.5
    best, counted = ((odds > 0) == right).mean(), ((np.column_stack(votes).sum(axis=1) > 0) == right).mean()
    assert best >= (found == right).mean() - 0.002 and (found == right).mean() > best - 0.005 > counted
    assert abs((n @ p) / n.sum() - 0.3) < 0.03
    shapes = np.column_stack([rows, np.ones((len(rows), 2), np.int64)])
    weights = pii.fit_classifier(shapes, n.astype(float))
    accepted = (pii._features(shapes) @ weights >= 0)[which]
    assert (accepted == right).mean() > best - 0.01


def test_no_column_for_lengths(spark):
    df = spark.createDataFrame([(1, "call +1 555 000 1234")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.redact_texts(df, length_col="n_chars")
    assert pii.redact_texts(df).first().text == "call <PHONE>"


def test_long_text_and_clashing_columns(spark):
    text = "words and words " * 100_000 + "mail me@x.org"
    df = spark.createDataFrame([(1, text, "a", 2), (1, text, "a", 2), (2, None, None, None)], "doc_id long, text string, spans string, n_email int")
    got = sorted((x.doc_id, x.n_email, x.spans) for x in find(df).collect())
    at = text.index("me@")
    assert got == [(1, 1, f"email:{at}:{len(text)}")] * 2 + [(2, 0, "")]
