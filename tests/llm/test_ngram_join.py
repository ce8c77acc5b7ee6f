import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import components
from wordloom.llm import ngram_join as N
from wordloom.llm.ngram_join import join_components


def brute(rows, words=4, percent=85):
    sets = []
    for _, text in rows:
        w = [x for x in "".join(c if ord(c) > 127 else c.lower() for c in text or "").split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            j = rows[y][0]
            common, union = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if sets[x] and sets[y] and 100 * common >= percent * union:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cls int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A B"), (6, "a b c d"), (7, "a b c d e"), (8, "b a"), (9, "a b c d")]
    check(spark, rows)
    assert join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_that_crowd(spark, monkeypatch):
    monkeypatch.setattr(N, "OFTEN", 3)
    monkeypatch.setattr(N, "TILE", 8)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, common = [], r.choices(vocabulary, k=12)
    for i in range(24):
        base = common + r.choices(vocabulary, k=r.choice([8, 20, 60, 150]))
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.choice([0, 1, 2, 20])):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    check(spark, rows)


@pytest.mark.parametrize("n", [7, 12, 40, 200, 900])
def test_pairs_within_the_bound_meet_twice(n):
    r = np.random.default_rng(n)
    bands = N.Bands(85)
    for _ in range(40):
        base = r.integers(0, 2**63, n).astype(np.uint64)
        cut = int(n * 0.15)
        other = np.unique(np.r_[base[: n - cut // 2], r.integers(0, 2**63, cut - cut // 2).astype(np.uint64)])
        common = len(np.intersect1d(base, other))
        if 100 * common >= 85 * (n + len(other) - common) and len(np.setxor1d(base, other)):
            shared = np.intersect1d(N.keys_of(np.sort(base), bands), N.keys_of(other, bands))
            assert len(shared) >= 2


def test_sketches_rule_no_link_out():
    r = np.random.default_rng(8)
    sets = []
    for n in (5, 30, 300, 3000):
        base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        sets += [base] + [np.unique(np.r_[base[k:], r.integers(0, 2**63, k).astype(np.uint64)]) for k in (1, n // 14, n // 12)]
    names = list(range(len(sets)))
    possible = {frozenset(p) for p in N.possible_links(names, [len(s) for s in sets], [N.sketch_of(s) for s in sets], 85)}
    for a, b in N.forest(names, sets, 85):
        joined, grew = {a}, True
        while grew:
            more = {x for p in possible if p & joined for x in p} - joined
            joined, grew = joined | more, bool(more)
        assert b in joined


def test_frequent_keys_meet_in_a_group(spark):
    """Two sets that may link have two common keys in one group, whatever their size."""
    r = np.random.default_rng(5)
    bands, rows = N.Bands(85), []
    for n in (7, 40, 200, 900, 5000):
        for _ in range(20):
            base = r.integers(0, 2**63, n).astype(np.uint64)
            cut = int(n * 0.15)
            other = np.unique(np.r_[base[: n - cut // 2], r.integers(0, 2**63, cut - cut // 2).astype(np.uint64)])
            common = len(np.intersect1d(base, other))
            if 100 * common >= 85 * (n + len(other) - common) and len(np.setxor1d(base, other)):
                shared = np.intersect1d(N.keys_of(np.sort(base), bands), N.keys_of(other, bands))
                rows.append([len(rows), shared.view(np.int64).tolist()])
    keys = spark.createDataFrame(rows, "pair int, keys array<bigint>").selectExpr("pair", "explode(keys) AS key")
    twice = keys.groupBy("pair", N.group_of(F.col("key"), N.Bands(85))).count().where("count > 1").select("pair").distinct()
    assert len(rows) > 50 and twice.count() == len(rows)


def test_copies_of_a_long_text(spark):
    """64 near copies of a text of 20,000 words, each with other words changed."""
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    rows = []
    for i in range(64):
        copy = list(base)
        for _ in range(50):
            copy[r.randrange(len(copy))] = f"x{i}"
        rows.append((i + 10, " ".join(copy)))
    begun = time.time()
    got = join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {10} and len(got) == 64
    assert time.time() - begun < 300


def test_large_clusters(spark, monkeypatch):
    """Clusters of many tiles: near copies of one text, of a text that drifts, and texts that share
    half of their words with all others."""
    monkeypatch.setattr(N, "TILE", 10)
    monkeypatch.setattr(N, "OFTEN", 4)
    r = random.Random(7)
    some = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    base, drift, half = some(60), some(80), some(60)
    rows = []
    for i in range(40):
        copy = list(base)
        copy[r.randrange(60)] = "x"
        drift[r.randrange(80)] = "y"
        for words in (copy, drift, half + some(60 if i % 2 else 4)):
            rows.append((len(rows) * 7 % 121, " ".join(words)))
    rows += [rows[0], rows[5]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cluster int")
    want = brute(list(dict(rows).items()))
    got = join_components(df).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(i, *x) for i, x in want.items()} and len(got) == len(rows)


def test_components_in_one_task_and_by_stars(spark, monkeypatch):
    """Both ways give the least node of each component: of a chain, of rings, and of a random graph."""
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 8), (8, 7), (3, 3)] + rng.integers(1000, 1400, (180, 2)).tolist()
    want = {n: {n} for e in edges for n in e if e[0] != e[1]}
    for u, v in edges:
        if u != v and want[u] is not want[v]:
            want[u] |= want[v]
            for n in want[v]:
                want[n] = want[u]
    df, jobs = spark.createDataFrame(edges, "u bigint, v bigint"), []
    real = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: jobs.append(1) or real(df))
    for few, most in ((components.FEW_EDGES, 2), (0, 100)):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        jobs.clear()
        assert {r.node: r.component for r in components.components(df).collect()} == {n: min(of) for n, of in want.items()}
        assert len(jobs) <= most


def test_shuffled_keys_are_deleted_before_sets_meet(spark, monkeypatch):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(f.getName().startswith("shuffle_") for f in (files.apply(i) for files in [disk.getAllFiles()] for i in range(files.size())))
    real, seen = N.reclaim, []

    def reclaim(session):
        before, until = held(), time.time() + 10
        real(session)
        while held() >= before and time.time() < until:  # Spark deletes in the background
            time.sleep(0.1)
        seen.append((before, held()))

    monkeypatch.setattr(N, "reclaim", reclaim)
    join_components(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id bigint, text string"))
    assert [after < before for before, after in seen] == [True]


def test_steps_leave_no_shuffles(spark, monkeypatch):
    """The files of a step's shuffles go as its table is written, whether or not a plan is collected."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(f.getName().startswith("shuffle_") for f in (files.apply(i) for files in [disk.getAllFiles()] for i in range(files.size())))
    real, left = N.materialize, []

    def materialize(df):
        before, until = held(), time.time() + 5
        out = real(df)
        while held() > before and time.time() < until:  # Spark deletes in the background
            time.sleep(0.05)
        left.append(held() - before)
        return out

    monkeypatch.setattr(N, "materialize", materialize)
    monkeypatch.setattr(N, "reclaim", lambda session: None)
    join_components(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id bigint, text string"))
    assert len(left) > 4 and max(left[2:]) <= 0  # after the tables of documents and of classes
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
