"""Personal data by weak supervision.

Fixed patterns give the base spans (e-mail and IP addresses, card and phone numbers). Wider
patterns and a gazetteer propose further candidates: secrets, telephone numbers without a
country code, identity and bank account numbers, and names of persons. Five labelers vote on
each candidate: a strict pattern, words of the context, a gazetteer, the marks around it, and the
mix of its characters. Expectation-maximisation over the counts of all vote patterns estimates
how reliable each labeler is for each kind, and a logistic classifier of votes and shape, fitted
to the posteriors, decides. Counts cover all documents; the table of patterns is bounded by the
number of vote patterns, shapes and kinds (below 20,000 rows) for any corpus.

Defined results: null and empty texts have no spans. Candidates that overlap base spans are left
out. Rows that repeat give the same spans. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import map_rows, map_texts, materialize, texts_of

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order of their spans.
KINDS = (*BASE, "secret", "number", "account", "person")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
_NUMBER = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])?[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])")
_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?|Doña?)\.? "
_TITLED = re.compile(rf"\b{_TITLES}(?:[A-Z]\w+[ '-]?){{1,3}}")
# How each match of _TITLED starts; searched faster, as it begins with letters.
_TITLE = re.compile(rf"{_TITLES}[A-Z]")

# The gazetteers.
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica"
    " Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Sandra Steven Ashley Andrew Emily Peter Anna Paul Laura"
    " Hans Klaus Jürgen Wolfgang Ursula Monika Sabine Heike Pierre Jean Michel Marie Nathalie Isabelle José Juan Carlos Luis"
    " Carmen Ana María Antonio Francisco Javier".split()
)
_NAMED = re.compile(rf"(?:{'|'.join(sorted(FIRST_NAMES))})(?= ([A-Z]\w+))")
_IN_WORD = re.compile(r"\w")
PREFIXES = ("AKIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox", "eyJ", "AIza", "glpat-")
COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CONTEXT = {
    "secret": re.compile(r"token|secret|passw|api|key|auth|bearer|credential|clave|contrase|schlüssel|jeton", re.I),
    "number": re.compile(r"phone|tel|call|mobile|fax|contact|ruf|móvil|appel", re.I),
    "account": re.compile(r"ssn|social|iban|account|konto|cuenta|compte|bank", re.I),
    "person": re.compile(r"name|contact|dear|sincerely|regards|by|author|signed|von|herr|frau|mr|mrs|dr", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def candidates(text: str, base: list[Span]) -> list[Span]:
    found: list[Span] = []
    if _DIGIT.search(text):
        for m in _SECRET.finditer(text):
            if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]):
                found.append(("secret", *m.span()))
        found += [("number", *m.span()) for m in _NUMBER.finditer(text)]
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    at = 0
    while title := _TITLE.search(text, at):
        at = title.start() + 1
        if m := _TITLED.match(text, title.start()):
            found.append(("person", m.start(), m.start() + len(m[0].rstrip(" '-"))))
            at = m.end()
    for m in _NAMED.finditer(text):
        if not (m.start() and _IN_WORD.match(text, m.start() - 1)):
            found.append(("person", m.start(), m.end(1)))
    out, end = [], 0
    taken = sorted(base, key=lambda s: s[1])
    for kind, s, e in sorted(set(found), key=lambda c: (c[1], -c[2], KINDS.index(c[0]))):
        if s >= end and not any(b[1] < e and s < b[2] for b in taken):
            out.append((kind, s, e))
            end = e
    return out


def _entropy(piece: str) -> float:
    return -sum(n / len(piece) * math.log2(n / len(piece)) for n in Counter(piece).values())


def votes(text: str, span: Span) -> tuple[int, ...]:
    """Each labeler's vote (1, -1, or 0 for none), then the shape: classes of length and digits."""
    kind, s, e = span
    piece, before, after = text[s:e], text[max(0, s - 24) : s], text[e : e + 2]
    digits = sum(c.isdigit() for c in piece) / len(piece)
    context = 1 if CONTEXT[kind].search(before) else -1
    marks = 1 if re.search(r"[=:(\"']\s*$", before) else 0
    if kind == "secret":
        strict = 1 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[\w+/-]{24,}", piece) else -1
        known = 1 if piece.startswith(PREFIXES) else 0
        marks = marks or -1
        mixed = 1 if _entropy(piece) >= 3 and 0.1 <= digits <= 0.9 else -1
    elif kind == "number":
        strict = 1 if len(piece) >= 12 else 0
        known = 1 if "555" in piece[:8] else 0
        mixed = -1 if re.match(r"\.[0-9]|[0-9%$€]", after) or re.search(r"[$€#]\s?$", before) else 1
    elif kind == "account":
        plain = piece[:4].isalnum() and not piece[0].isdigit()
        number = "".join(str(int(c, 36)) for c in piece[4:] + piece[:4]) if plain else ""
        strict = 1 if not plain or int(number) % 97 == 1 else -1
        known = 0 if not plain else 1 if piece[:2] in COUNTRIES else -1
        mixed = 1 if digits >= 0.6 else -1
    else:
        strict = 1 if _TITLED.match(piece) else 0
        known = 1 if FIRST_NAMES.intersection(piece.split()) else 0
        mixed = 1 if all(w[:1].isupper() and w[1:].islower() for w in piece.replace(".", "").split()) else -1
    shape = (min(3, len(piece) // 12), min(3, int(digits * 4)))
    return (strict, context, known, marks, mixed, *shape)


def posteriors(patterns: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Probability that a candidate is right, for each vote pattern (rows of -1, 0, 1) seen n
    times, by expectation-maximisation; labelers start as better than chance."""
    p = 1 / (1 + np.exp(-patterns.sum(axis=1)))
    for _ in range(rounds):
        prior = (n @ p + 1) / (n.sum() + 2)
        odds = np.full(len(p), math.log(prior / (1 - prior)))
        for j in range(patterns.shape[1]):
            right, wrong = np.array([1.0, 2.0, 4.0]), np.array([4.0, 2.0, 1.0])
            np.add.at(right, patterns[:, j] + 1, n * p)
            np.add.at(wrong, patterns[:, j] + 1, n * (1 - p))
            odds += np.log((right / right.sum()) / (wrong / wrong.sum()))[patterns[:, j] + 1]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def _features(rows: np.ndarray) -> np.ndarray:
    shape = [(rows[:, c] == k).astype(float) for c in (5, 6) for k in range(4)]
    return np.column_stack([np.ones(len(rows)), rows[:, :5], *shape])


def fit_classifier(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression on posteriors, by Newton's steps."""
    x, y = _features(rows), posteriors(rows[:, :5], n)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + 0.5 * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _proposed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base spans joined, further candidates, their votes and shapes)."""

    def propose(columns: list[pa.Array]) -> list[pa.Array]:
        base, more, seen = [], [], []
        for text in texts_of(columns[1]):
            found = base_spans(text)
            extra = candidates(text, found)
            base.append(_joined(found))
            more.append([f"{k}:{s}:{e}" for k, s, e in extra])
            seen.append([_vote(text, c) for c in extra])
        texts = pa.list_(pa.field("element", pa.string()))
        return [columns[0], pa.array(base, pa.string()), pa.array(more, texts), pa.array(seen, texts)]

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, base string, candidates array<string>, votes array<string>"
    return map_texts(df, [id_col, text_col], schema, lambda: propose)


def _vote(text: str, span: Span) -> str:
    return " ".join(map(str, (span[0], *votes(text, span))))


def _accepted(proposed: DataFrame) -> set[str]:
    """The votes and shapes that the classifiers of the kinds accept."""
    counts = proposed.select(F.explode("votes").alias("vote")).groupBy("vote").agg(F.count(F.lit(1)).alias("n")).collect()
    by_kind: dict[str, list[tuple[list[int], int]]] = {}
    for vote, n in sorted(counts):
        kind, *values = vote.split()
        by_kind.setdefault(kind, []).append((list(map(int, values)), n))
    accepted = set()
    for kind, rows in by_kind.items():
        values = np.array([r for r, _ in rows])
        weights = fit_classifier(values, np.array([float(n) for _, n in rows]))
        for r, score in zip(values, _features(values) @ weights):
            if score >= 0:
                accepted.add(" ".join(map(str, (kind, *r))))
    return accepted


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans (`kind:start:end` in code
    points, end exclusive, joined by commas), n_spans."""
    found = materialize(_proposed(df, id_col, text_col))
    accepted = _accepted(found)

    def decide(columns: list[pa.Array]) -> list[pa.Array]:
        out: list[list] = [[] for _ in range(7)]
        for base, more, seen in zip(*(c.to_pylist() for c in columns[1:])):
            spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
            kinds = Counter(s[0] for s in spans)
            spans += [(k, int(s), int(e)) for k, s, e in (x.split(":") for x, v in zip(more, seen) if v in accepted)]
            for column, value in zip(out, (*(kinds[k] for k in BASE), hashlib.sha256(base.encode()).hexdigest(), _joined(spans), len(spans))):
                column.append(value)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return [columns[0], *(pa.array(c, t) for c, t in zip(out, types))]

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
    return map_texts(found, [id_col, "base", "candidates", "votes"], schema, lambda: decide)


def redact_texts(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of ``df`` with the spans in ``text_col`` replaced by their kinds; ``length_col``,
    if given, gets the new number of code points where the text changed. Null stays null."""
    if length_col is not None and length_col not in df.columns:
        raise ValueError(f"no column {length_col!r} in {df.columns}")
    number = df.columns.index(length_col) if length_col is not None else None
    accepted = _accepted(_proposed(df, text_col, text_col))

    def run(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        texts, changed = batch.column(at).to_pylist(), {}
        for i, text in enumerate(texts):
            if text:
                base = base_spans(text)
                spans = base + [c for c in candidates(text, base) if _vote(text, c) in accepted]
                if spans:
                    changed[i] = texts[i] = redact(text, _joined(spans))
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        if number is not None:
            n = number
            lengths = columns[n].to_pylist()
            for i, text in changed.items():
                lengths[i] = len(text)
            columns[n] = pa.array(lengths, columns[n].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(df, text_col, lambda: run)


def redact(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping ones by one."""
    out, at = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",") if x):
        if int(s) >= at:
            out += [text[at : int(s)], f"<{kind.upper()}>"]
        at = max(at, int(e))
    return "".join(out) + text[at:]
