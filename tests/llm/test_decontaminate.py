import random
import re
from collections import Counter

from wordloom.llm import decontaminate as D
from wordloom.llm.decontaminate import leaks


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    out = {}
    for d, text in docs:
        hs = shingles(text)
        for i, item in items:
            own = Counter(shingles(item))
            n = sum(own.values())
            for s in range(1 - n, len(hs)) if n and hs else ():
                w = Counter(hs[max(0, s) : s + n])
                common = sum((w & own).values())
                x = common / (sum(w.values()) + n - common)
                if x >= 0.8:
                    out[d, i] = max(x, out.get((d, i), 0))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    some = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(some(r.choice([5, 6, 12, 30, 60])))) for i in range(25)] + [(90, None), (91, ""), (92, "one two"), (3, "x " * 30)]
    docs = [(100, None), (101, ""), (102, "one two"), (103, "x, " * 30), (103, "x, " * 31)]
    for k in range(120):
        i, text = items[r.randrange(25)]
        passage = text.split()
        for _ in range(r.choice([0, 0, 1, 2])):
            passage[r.randrange(len(passage))] = word()
        parts = some(r.randint(0, 50)) + passage + some(r.randint(0, 50))
        docs.append((k, " ".join(parts).capitalize().replace(" ", ", ", r.randint(0, 3))))
    want = brute(docs, items)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hs int")
    for blocks in (D.ANCHORS, 40):
        monkeypatch.setattr(D, "ANCHORS", blocks)
        got = {(x.doc_id, x.item_id): x.similarity for x in leaks(d, b).collect()}
        assert got.keys() == want.keys() and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    assert leaks(d.limit(0), b).count() == leaks(d, b.limit(0)).count() == 0
    nodes = leaks(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", nodes)
