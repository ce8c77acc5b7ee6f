
from pyspark.sql import functions as F

import pytest

from tests.test_search import ask, lines, tree
from wordloom.operators import browse, evaluate, search, walk
from wordloom.session import materialize, once, tidy, with_rank
from wordloom.sources import dictionary as D
from wordloom.streaming import lookup

WORDS = [("apple", 900, 1), ("apply", 800, 2), ("apt", 700, 3)]


def test_stream_of_queries(spark, tmp_path):
    nodes = tree(spark, WORDS)
    asked = ask(spark, "appel", "ap", "zzz")
    asked.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in")
    found = []
    query = lookup.answer(stream, nodes, lambda rows, number: found.extend(lines(rows)), f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    assert found == lines(search.suggestions(nodes, asked))
    assert lookup.lookups(stream, nodes).isStreaming


def test_words_by_index(spark):
    asked = spark.createDataFrame([(2,), (9,)], "expr_index int")
    assert {(r.expr_index, r.word) for r in browse.word_of_expr(tree(spark, WORDS), asked).collect()} == {(2, "apply"), (9, None)}


def test_ranks_are_dense_and_in_order(spark):
    df = spark.range(1000).selectExpr("id", "hash(id) % 37 AS a").repartition(7)
    rows = sorted(with_rank(df, [F.col("a"), F.col("id")], "place").collect(), key=lambda r: (r.a, r.id))
    assert [r.place for r in rows] == list(range(1000))


def test_vocabulary(spark):
    texts = spark.createDataFrame([("The the cat, a-b Cat",), ("the É",), (None,)], "text string")
    got = [tuple(r) for r in D.from_texts(texts).orderBy("ordinal").collect()]
    assert got == [(1, "the", 750, 1), (2, "cat", 500, 2), (3, "a", 250, 3), (4, "b", 0, 4)]


def test_walks(spark):
    nodes = tree(spark, [("ab", 9, 1), ("abc", 8, 2), ("b", 7, 3)])
    asked = spark.createDataFrame([("abc",), ("b",), ("x",), ("a",)], "query string")
    assert {tuple(r) for r in walk.ancestors(nodes, asked).collect()} == {("abc", 1, "ab"), ("abc", 2, "a")}
    assert {tuple(r) for r in walk.descendants(nodes, asked).collect()} == {("abc", "abc"), ("b", "b"), ("a", "a"), ("a", "ab"), ("a", "abc")}
    edges = [(r.edge[0], r.prefix) for r in walk.traversal(nodes).orderBy("step").collect()]
    assert edges == [("o", "a"), ("o", "ab"), ("o", "abc"), ("c", "abc"), ("c", "ab"), ("c", "a"), ("o", "b"), ("c", "b")]


def test_histogram_lines(spark):
    rows = spark.createDataFrame([(2, 5), (0, 7), (3, 0)], "bucket bigint, nodes bigint")
    assert evaluate.histogram_line(rows, 6).collect() == [("[7, 0, 5]",)]
    assert evaluate.histogram_line(rows.limit(0), 6).collect() == [("[]",)]


def test_index_of_a_tree(spark):
    """Searches of a stored index are those of the tree; other candidates need the tree."""
    nodes = tree(spark, WORDS)
    index, asked = search.index(nodes).stored(), ask(spark, "appel", "ap", "zzz", "", "aply")
    for operator in (search.suggestions, search.completions, search.corrections):
        assert lines(operator(index, asked)) == lines(operator(nodes, asked))
    some = lines(search.suggestions(nodes, asked, "expr_index <> 2"))
    assert some and not any(w == "apply" for w, kind in some if kind != "M")
    with pytest.raises(ValueError):
        search.suggestions(index, asked, "expr_index <> 2")


def test_tables_are_made_again_when_their_files_change(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    count = lambda: once(spark, ("t", path), lambda: spark.read.parquet(path), (path,)).count()
    assert count() == count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert count() == 5


def test_tidy_leaves_the_result(spark):
    made = []

    @tidy
    def operator(n):
        made.append(materialize(spark.range(n)))
        return made[0].where("id > 0")

    out = operator(4)
    assert out.count() == 3
    with pytest.raises(Exception, match="(?i)path_not_found|not exist|read file"):
        made[0].count()


def test_composed_on_reading(spark):
    words = [("e\u0301te\u0301", 5, 1), ("ko", 4, 2)]
    assert [r.word for r in D.from_rows(spark, words).orderBy("ordinal").collect()] == ["\u00e9t\u00e9", "ko"]
