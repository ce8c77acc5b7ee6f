import itertools

import pytest

from wordloom.functions.text import single_edits, within_one_edit
from wordloom.operators import browse, build, evaluate, search
from wordloom.sources import dictionary as D

LAYOUT = [("aa", 21, 1), ("ab1", 22, 2), ("ab2", 23, 3), ("add", 24, 4), ("aee", 25, 5), ("aff", 26, 6), ("aff1", 27, 7), ("aff2", 28, 8), ("aff3", 29, 9), ("aft", 30, 10), ("agg", 31, 11)]
WALK = [("alla", 900, 1), ("alle", 800, 2), ("avla", 700, 3), ("alltid", 600, 4), ("atlas", 500, 5), ("ko", 400, 6)]


def tree(spark, rows, size=100):
    return build.build(D.from_rows(spark, rows), size).cache()


def ask(spark, *queries, caps=None):
    rows = [(i, q, *(caps or ())) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id long, query string" + (", cap_not_found int, cap_found int" if caps else ""))


def lines(df):
    return [(r.word, r.kind[0]) for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank))]


def test_layout(spark):
    got = sorted(tree(spark, LAYOUT, 3).collect(), key=lambda r: r.pos)
    assert [r.prefix for r in got] == ["a", "aa", "ab", "ad", "ae", "af", "ag", "ab1", "ab2", "add", "aee", "aff", "aft", "agg", "aff1", "aff2", "aff3"]
    assert [r.first_child_pos for r in got] == [1, 0, 7, 9, 10, 11, 13, 0, 0, 0, 0, 14, 0, 0, 0, 0, 0]
    assert [r.prefix for r in got if r.is_last_sibling] == ["a", "ag", "ab2", "add", "aee", "aft", "agg", "aff3"]
    assert [(r.slot, r.percentile) for r in got if r.expr_index] == list(enumerate([21, 22, 23, 24, 25, 26, 30, 31, 27, 28, 29]))
    assert {r.prefix: r.max_child_percentile for r in got if r.max_child_percentile} == {"a": 31, "ab": 23, "ad": 24, "ae": 25, "af": 30, "ag": 31, "aff": 29}


def test_insertion_order(spark):
    got = {r.prefix: (r.percentile, r.expr_index) for r in tree(spark, [("abc", 500, 1), ("ab", 900, 2), ("abc", 700, 3), ("abcd", 1, 4)]).collect()}
    assert got == {"a": (None, None), "ab": (0, 2), "abc": (500, 3), "abcd": (1, 4)}


def test_paths(spark):
    rows = [("ad1", 2, 1), ("ad2", 2, 2), ("ad3", 2, 3), ("add", 2, 4), ("adder", 2, 5), ("adder1", 2, 6), ("adder2", 2, 7), ("addition", 2, 8)]
    want = {"": "/", "a": "/", "ad": "a/", "ad1": "ad/", "ad2": "ad/", "ad3": "ad/", "add": "ad/", "adder": "adde/", "adder1": "adde/", "adder2": "adde/", "addi": "add/", "addit": "add/", "addition": "add/", "xy": None}
    got = browse.path_of(tree(spark, rows, 3), ask(spark, *want)).collect()
    assert {r.query: r.path for r in got} == want


def test_listings(spark):
    rows = [("add", 2, 1), ("adder", 2, 2), ("aardvark", 2, 3), ("apple", 2, 4), ("addition", 2, 5), ("ape", 2, 6), ("app", 2, 7)]
    nodes = tree(spark, rows, 3)
    want = {"": {"a/"}, "a": {"aardvark.", "ad/", "ap/"}, "ad": {"add.", "addition.", "adder."}, "ap": {"ape.", "app.", "apple."}, "zz": set(), "apple": set()}
    got = {q: set() for q in want}
    for r in browse.content_of(nodes, ask(spark, *want)).collect():
        got[r.query].add(r.entry)
    assert got == want
    both = {r.query: (r.path, r.entries) for r in browse.path_and_content_of(nodes, ask(spark, "ad", "", "zz", "apple")).collect()}
    assert both == {"ad": ("ad/", ["add.", "adder.", "addition."]), "": ("/", ["a/"]), "apple": ("ap/", [])}
    dumped = [r.line for r in browse.dump(nodes).orderBy("path", "place").collect()]
    assert dumped[:4] == ["a:", " aardvark    (idx: 3, 2% & max: 0%)", " d:", "  add    (idx: 1, 2% & max: 2%)"]


def test_suggestions(spark):
    pla = tree(spark, [("plan", 152, 1), ("plat", 324, 2), ("plate", 406, 3), ("plain", 107, 4), ("pluck", 258, 5), ("plastered", 209, 6)])
    assert lines(search.suggestions(pla, ask(spark, "pla"))) == [("plate", "E"), ("plat", "S"), ("plastered", "E"), ("plan", "E"), ("plain", "E")]


@pytest.fixture(scope="module")
def walk(spark):
    return tree(spark, WALK)


@pytest.mark.parametrize("query", ["lla", "ala", "all", "xalla", "alxla", "allax", "xlla", "axla", "allx", "laal", "lala", "alal"])
def test_edits_at_all_places(spark, walk, query):
    want = {w for w, _, _ in WALK if osa(query, w) == 1}
    assert {w for w, k in lines(search.corrections(walk, ask(spark, query, caps=(20, 20)))) if k == "S"} == (want if len(query) > 3 else set(sorted(want, key=lambda w: -dict((a, b) for a, b, _ in WALK)[w])[: 1 if any(w.startswith(query) for w, _, _ in WALK) else 2]))


def test_wrong_first_letter_is_completed(spark, walk):
    assert ("alltid", "E") in lines(search.suggestions(walk, ask(spark, "blla")))


def test_caps_filter_and_empty(spark):
    brad = [(chr(97 + i) + "rad", 900 - 10 * i, i) for i in range(26) if i != 1] + [("brad", 1000, 999)]
    nodes = tree(spark, brad)
    assert len(lines(search.corrections(nodes, ask(spark, "brad")))) == 3
    assert len(lines(search.corrections(nodes, ask(spark, "brad", caps=(64, 64))))) == 26
    co = tree(spark, [("co", 0, 1), ("cow", 900, 2), ("cover", 880, 3), ("count", 860, 4), ("cost", 840, 5), ("code", 820, 6), ("cool", 800, 7)])
    assert [w for w, _ in lines(search.completions(co, ask(spark, "co")))] == ["cow", "cover", "count", "cost", "code", "cool"]
    apple = tree(spark, [("apple", 900, 1), ("apply", 800, 2)])
    assert lines(search.completions(apple, ask(spark, "app"), "expr_index <> 2")) == [("apple", "E")]
    assert lines(search.corrections(apple, ask(spark, "apply"), "expr_index <> 2")) == [("apply", "M"), ("apple", "S")]
    assert lines(search.completions(apple, ask(spark, "xyz"))) == []
    assert lines(search.completions(apple, ask(spark, ""))) == [("apple", "E"), ("apply", "E")]
    assert {r.query: r.expr_index for r in browse.index_of(apple, ask(spark, "", "app", "apple")).collect()} == {"": None, "app": None, "apple": 1}
    empty = build.build(D.from_rows(spark, [("a", 1, 1)]).where("false"))
    assert search.suggestions(empty, ask(spark, "a", "")).count() == 0


def test_unicode(spark):
    nodes = tree(spark, [("allé", 900, 1), ("alla", 800, 2), ("förra", 700, 3)])
    assert {w for w, _ in lines(search.corrections(nodes, ask(spark, "allx")))} == {"allé", "alla"}
    assert lines(search.corrections(nodes, ask(spark, "frra"))) == [("förra", "S")]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_one_edit_is_exact_on_all_short_words(spark):
    words = ["".join(w) for n in range(5) for w in itertools.product("abc", repeat=n)]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    q = w.selectExpr("word AS query", "hash(word) AS query_id", "word AS asked")
    want = {(a, b) for a in words for b in words if osa(a, b) <= 1}
    got = {(r.asked, r.word) for r in search.neighbours(q, w).collect()}
    assert got == want
    pairs = q.crossJoin(w).where(within_one_edit("query", "word"))
    assert pairs.count() == len(want)
    assert all(osa(r.word, r.edit) == 1 for r in evaluate.all_single_edits(w.where("length(word) > 2")).collect())
    assert single_edits("word") is not None


def test_query_sets_and_recall(spark):
    words = D.from_rows(spark, [("straße", 900, 1), ("letter", 800, 2), ("banana", 700, 3), ("abxde", 600, 4), ("bb", 1, 5)])
    got = {(r.kind, r.target): r.query for r in evaluate.typo_queries(words, 2).collect()}
    assert got == {("delete", "letter"): "leter", ("delete", "banana"): "banna", ("insert", "letter"): "letxter", ("insert", "banana"): "banxana", ("substitute", "letter"): "letxer", ("substitute", "banana"): "banxna", ("transpose", "banana"): "baanna", ("transpose", "abxde"): "axbde"}
    assert [r.query for r in evaluate.prefix_queries(words, 2).collect()] == ["le", "let"]
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, word string")
    found = spark.createDataFrame([(1, "a", 2), (3, "z", 1)], "query_id long, word string, rank long")
    rows = {r.query_id: (r.results, r.truths, r.hits, r.recall) for r in evaluate.recall(truth, found).collect()}
    assert rows == {1: (1, 2, 1, 0.5), 2: (0, 1, 0, 0.0), 3: (1, 0, 0, 1.0)}
    targets = spark.createDataFrame([(1, "a"), (2, "q")], "query_id long, target string")
    assert {r.query_id: r.rank for r in evaluate.rank_of(found, targets).collect()} == {1: 2, 2: None}


def test_sources(spark, tmp_path):
    import zstandard

    text = 'ab"c\t500\t1\n"ab\t900\t2\nab"c\t700\t3\n'
    (tmp_path / "w.tsv").write_text(text)
    (tmp_path / "w.tsv.zst").write_bytes(zstandard.compress(text.encode()))
    for name in ("w.tsv", "w.tsv.zst"):
        got = [tuple(r) for r in D.read_tsv(spark, f"{tmp_path}/{name}").orderBy("ordinal").collect()]
        assert got == [(1, 'ab"c', 500, 1), (2, '"ab', 900, 2), (3, 'ab"c', 700, 3)]
    first = sorted(tuple(r) for r in D.keep_first(D.read_tsv(spark, f"{tmp_path}/w.tsv")).collect())
    assert first == [(1, 'ab"c', 500, 1), (2, '"ab', 900, 2)]
    more = D.appended(D.from_rows(spark, [("a", 1, 1)]), D.from_rows(spark, [("b", 2, 2)]))
    assert sorted(tuple(r) for r in more.collect()) == [(1, "a", 1, 1), (2, "b", 2, 2)]
    for bad in [("x", 1001, 1), ("x", 1, 1 << 24), ("", 1, 1)]:
        with pytest.raises(Exception, match="not a dictionary row"):
            D.from_rows(spark, [bad]).collect()
    nodes = tree(spark, LAYOUT, 3)
    D.save(nodes, f"{tmp_path}/tree")
    assert D.load(spark, f"{tmp_path}/tree").exceptAll(nodes).count() == 0
