"""Queries of the word-list engine, by name, and the SQL to hold them against.

All run over the vocabulary of `documents` (or over a tree of it) and over query sets made from
that vocabulary. The tables are made once in an application and for each place of the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import browse, build, evaluate, replay, search, walk
from wordloom.session import once, shared_folder
from wordloom.sources import dictionary as sources

PER_KIND, PREFIXES, FOLDER_SIZE, TOP = 50, 25, 100, 5
Query = Callable[[SparkSession, str], DataFrame]


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return once(spark, (name, sf_dir), build, (f"{sf_dir}/documents.parquet",))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = lambda: spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _once(spark, sf_dir, "dictionary", lambda: sources.from_texts(documents()))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "nodes", lambda: build.build(dictionary(spark, sf_dir), FOLDER_SIZE))


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The tree's index for searches, stored with the tree."""
    made = search.index(nodes(spark, sf_dir))
    return search.Index(_once(spark, sf_dir, "places", lambda: made.places), _once(spark, sf_dir, "variants", lambda: made.variants))


def typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "typos", lambda: evaluate.typo_queries(dictionary(spark, sf_dir), PER_KIND))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "prefixes", lambda: evaluate.prefix_queries(dictionary(spark, sf_dir), PREFIXES))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary from its rarest word on, and after it once more from the commonest on, with
    other percentiles and indexes."""
    words = dictionary(spark, sf_dir)
    last = words.agg(F.max("ordinal").alias("last"))
    back = words.crossJoin(F.broadcast(last)).withColumn("ordinal", F.col("last") + 1 - F.col("ordinal")).select(sources.COLUMNS)
    again = words.withColumns({"percentile": F.lit(999) - F.col("percentile"), "expr_index": F.col("expr_index") + 1_000_000})
    return sources.appended(back, again)


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typos(spark, sf_dir).select("query_id", "query").unionByName(prefixes(spark, sf_dir))


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words, and for each a word that is none or another one: without its middle letter."""
    words = dictionary(spark, sf_dir).select(F.col("word").alias("query"))
    cut = F.expr("concat(left(query, length(query) div 2), substr(query, length(query) div 2 + 2))").alias("query")
    return words.unionByName(words.select(cut).where("query <> ''")).distinct()


def _exact_lookup(spark, sf_dir):
    return browse.index_of(nodes(spark, sf_dir), _lookups(spark, sf_dir))


def _find(spark, sf_dir):
    found = browse.find(nodes(spark, sf_dir), _lookups(spark, sf_dir))
    return found.select("query", F.col("node").isNotNull().alias("is_node"), F.col("node.max_child_percentile").alias("max_child_percentile"))


def _word_of_expr(spark, sf_dir):
    """All indexes, and as many that no word has."""
    own = dictionary(spark, sf_dir).select("expr_index")
    return browse.word_of_expr(nodes(spark, sf_dir), own.unionByName(own.select((-F.col("expr_index")).alias("expr_index"))))


def _path_of(spark, sf_dir):
    words = dictionary(spark, sf_dir).select(F.col("word").alias("query"))
    return browse.path_of(nodes(spark, sf_dir), words)


def _content_of(spark, sf_dir):
    tree = nodes(spark, sf_dir)
    asked = tree.where("is_folder").select(F.col("prefix").alias("query"))
    return browse.content_of(tree, asked.unionByName(spark.createDataFrame([("",)], "query string")))


def _path_and_content(spark, sf_dir):
    found = browse.path_and_content_of(nodes(spark, sf_dir), prefixes(spark, sf_dir).select("query"))
    return found.select("query", "path", F.array_join("entries", " ").alias("entries"))


def _typo_results(spark, sf_dir, engine: str) -> DataFrame:
    tree, asked = nodes(spark, sf_dir), typos(spark, sf_dir).select("query_id", "query")
    if engine == "corrections":
        return search.corrections(index(spark, sf_dir), asked)
    if engine == "exhaustive":
        return search.corrections(index(spark, sf_dir), asked.withColumns({"cap_not_found": F.lit(64), "cap_found": F.lit(64)}))
    if engine == "suggestions":
        return search.suggestions(index(spark, sf_dir), asked)
    if engine == "levenshtein":
        return search.levenshtein_only(tree, asked)
    return search.words_within_one_edit(tree, asked)


def _recall_by_kind(spark, sf_dir):
    targets, rows = typos(spark, sf_dir), None
    for engine in ("corrections", "levenshtein", "one_edit"):
        hits = _typo_results(spark, sf_dir, engine).select("query_id", F.col("word").alias("target"), F.lit(1).alias("hit")).distinct()
        found = targets.join(hits, ["query_id", "target"], "left").withColumn("engine", F.lit(engine))
        rows = found if rows is None else rows.unionByName(found)
    rows = rows.rollup("engine", "kind").agg(F.count(F.lit(1)).alias("queries"), F.count("hit").alias("hits")).where("engine IS NOT NULL")
    return rows.select("engine", F.coalesce("kind", F.lit("all")).alias("kind"), "queries", "hits", (F.col("hits") / F.col("queries")).alias("recall"))


def _correction_shape(spark, sf_dir):
    truth, rows = _typo_results(spark, sf_dir, "one_edit"), None
    for engine in ("suggestions", "exhaustive", "levenshtein"):
        found = evaluate.recall(truth, _typo_results(spark, sf_dir, engine)).withColumn("engine", F.lit(engine))
        rows = found if rows is None else rows.unionByName(found)
    return rows.groupBy("engine").agg(F.sum("results").alias("results"), F.round(F.avg("recall"), 6).alias("recall"))


def _recall_at_5(spark, sf_dir):
    tree, asked, rows = nodes(spark, sf_dir), prefixes(spark, sf_dir), None
    truth = search.top_words(tree, asked, TOP)
    found = {name: run(index(spark, sf_dir), asked).where(F.col("rank") <= TOP) for name, run in (("suggestions", search.suggestions), ("completions", search.completions))}
    # A trie of the dictionary's own percentiles, which a word keeps that comes after its extensions.
    own = dictionary(spark, sf_dir).select(F.col("word").alias("prefix"), "percentile", "expr_index")
    found["pruning_trie"] = search.top_words(own, asked, TOP)
    for engine, got in found.items():
        some = evaluate.recall(truth, got).withColumn("engine", F.lit(engine))
        rows = some if rows is None else rows.unionByName(some)
    return rows.groupBy("engine").agg(F.sum("hits").alias("hits"), F.sum("truths").alias("truths"), F.round(F.avg("recall"), 6).alias("recall"))


def _rank_of(spark, sf_dir):
    return evaluate.rank_of(_typo_results(spark, sf_dir, "corrections"), typos(spark, sf_dir))


def _words(spark, sf_dir) -> DataFrame:
    return dictionary(spark, sf_dir).select("word")


def _tsv(spark, sf_dir, compression: str) -> DataFrame:
    """The dictionary, written as text and read back."""

    def through() -> DataFrame:
        path = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex}"
        sources.write_tsv(dictionary(spark, sf_dir), path, compression)
        return sources.read_tsv(spark, path)

    return _once(spark, sf_dir, f"tsv {compression}", through)


def _loaded(spark, sf_dir) -> DataFrame:
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    sources.save(nodes(spark, sf_dir), path)
    return sources.load(spark, path).select("prefix", "pos", "slot", "is_folder")


#: Words in order of insertion, one of them twice and one after its extension.
GIVEN = [("plate", 406, 3), ("plat", 324, 2), ("plan", 152, 1), ("plate", 7, 9), ("ko", 400, 6), ("kö", 20, 11)]


def _in_memory(spark, sf_dir) -> DataFrame:
    return build.inserted(sources.from_rows(spark, GIVEN))


def _composed(spark, sf_dir) -> DataFrame:
    """Words with their vowels marked by a combining accent, as read: composed."""
    marked = F.regexp_replace("word", "([aeiou])", "$1\u0301")
    rows = sources.checked(dictionary(spark, sf_dir).withColumn("word", marked))
    return rows.select("ordinal", "word", F.length("word").cast("bigint").alias("n"))


def _empty(spark) -> DataFrame:
    return spark.createDataFrame([(1, "")], "query_id bigint, query string")


def _find_empty(spark, sf_dir) -> DataFrame:
    return browse.find(nodes(spark, sf_dir), _empty(spark)).select("query", "node.prefix", "node.word_count")


def _node_queries(spark, sf_dir) -> DataFrame:
    return nodes(spark, sf_dir).select(F.col("prefix").alias("query"))


QUERIES: dict[str, Query] = {
    "dictionary": dictionary,
    "exact_lookup": _exact_lookup,
    "find_node": _find,
    "word_of_expr": _word_of_expr,
    "prefix_topk": lambda s, d: search.top_words(nodes(s, d), prefixes(s, d), TOP),
    "completions": lambda s, d: search.completions(index(s, d), prefixes(s, d)),
    "completions_filtered": lambda s, d: search.completions(nodes(s, d), prefixes(s, d), "expr_index % 2 = 0"),
    "node_table": lambda s, d: nodes(s, d).select("prefix", "percentile", "expr_index", "word_count", "max_child_percentile"),
    "node_layout": lambda s, d: nodes(s, d).select("pos", "prefix", "node_char", "first_child_pos", "is_last_sibling", "slot"),
    "node_counts": lambda s, d: build.node_counts(nodes(s, d)),
    "cursor_moves": lambda s, d: browse.moves(nodes(s, d)),
    "folders": lambda s, d: nodes(s, d).where("is_folder").select("prefix", "word_count"),
    "path_of": _path_of,
    "content_of": _content_of,
    "path_and_content_of": _path_and_content,
    "as_list": lambda s, d: browse.as_list(nodes(s, d), where="max_child_percentile >= 900"),
    "as_lookup": lambda s, d: browse.as_lookup(nodes(s, d)),
    "tree_dump": lambda s, d: browse.dump(nodes(s, d)),
    "tree_stats": lambda s, d: evaluate.tree_stats(nodes(s, d)),
    "child_histogram": lambda s, d: evaluate.child_histogram(nodes(s, d)),
    "percentile_histogram": lambda s, d: evaluate.percentile_histogram(nodes(s, d)),
    "typo_queries": typos,
    "prefix_queries": prefixes,
    "single_edits": lambda s, d: evaluate.all_single_edits(_words(s, d)),
    "first_letter_neighbours": lambda s, d: evaluate.first_letter_neighbours(_words(s, d)),
    "dl1_neighbours": lambda s, d: _typo_results(s, d, "one_edit"),
    "levenshtein_only": lambda s, d: _typo_results(s, d, "levenshtein"),
    "corrections_default": lambda s, d: _typo_results(s, d, "corrections"),
    "corrections_exhaustive": lambda s, d: _typo_results(s, d, "exhaustive"),
    "corrections_filtered": lambda s, d: search.corrections(nodes(s, d), typos(s, d).select("query_id", "query"), "expr_index % 2 = 0"),
    "suggestions": lambda s, d: search.suggestions(index(s, d), both(s, d)),
    "corrections_capped": lambda s, d: search.corrections(index(s, d), typos(s, d).select("query_id", "query", F.lit(3).alias("cap_not_found"), F.lit(1).alias("cap_found"))),
    "results_shown": lambda s, d: search.shown(search.completions(index(s, d), prefixes(s, d))).select("query_id", "rank", "shown"),
    "suggestions_replayed": lambda s, d: replay.replay(nodes(s, d), both(s, d)),
    "search_trace": lambda s, d: replay.trace(nodes(s, d), both(s, d)),
    "completions_empty": lambda s, d: search.completions(index(s, d), _empty(s)),
    "find_empty": _find_empty,
    "recall_by_kind": _recall_by_kind,
    "correction_shape": _correction_shape,
    "recall_at_5": _recall_at_5,
    "rank_of": _rank_of,
    "tsv_scan": lambda s, d: _tsv(s, d, "none"),
    "tsv_compressed_scan": lambda s, d: _tsv(s, d, "gzip"),
    "in_memory_source": _in_memory,
    "appended": repeated,
    "keep_first": lambda s, d: sources.keep_first(repeated(s, d)),
    "insertion_order": lambda s, d: build.inserted(repeated(s, d)),
    "composed_words": _composed,
    "saved_and_loaded": _loaded,
    "as_list_most": lambda s, d: browse.as_list(nodes(s, d), most=500),
    "as_lookup_repeated": lambda s, d: browse.as_lookup(nodes(s, d).withColumn("expr_index", F.expr("expr_index div 3").cast("int"))),
    "child_histogram_line": lambda s, d: evaluate.histogram_line(evaluate.child_histogram(nodes(s, d)), 40),
    "percentile_histogram_line": lambda s, d: evaluate.histogram_line(evaluate.percentile_histogram(nodes(s, d)), 101),
    "ancestors": lambda s, d: walk.ancestors(nodes(s, d), _node_queries(s, d)),
    "descendants": lambda s, d: walk.descendants(nodes(s, d), _node_queries(s, d)),
    "traversal": lambda s, d: walk.traversal(nodes(s, d)),
}

# --- The same in SQL. Neighbours are found by brute force, prefixes by LIKE or starts_with.

_DICT = """
tok AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents),
freq AS (SELECT word, count(*) AS f FROM tok GROUP BY word),
placed AS (SELECT word, row_number() OVER (ORDER BY f DESC, word) AS ordinal, count(*) OVER () AS n FROM freq),
dict AS MATERIALIZED (SELECT ordinal, word, CAST((1000 * (n - ordinal)) // n AS INTEGER) AS percentile,
  CAST(ordinal AS INTEGER) AS expr_index FROM placed)"""

_NODES = f"""{_DICT},
pre AS (SELECT left(word, k) AS prefix, word, ordinal FROM (SELECT word, ordinal, unnest(range(1, length(word) + 1)) AS k FROM dict)),
made AS (SELECT prefix, min(ordinal) AS made FROM pre GROUP BY prefix),
eff AS MATERIALIZED (SELECT word, ordinal, expr_index, CASE WHEN made < ordinal THEN 0 ELSE percentile END AS percentile
  FROM dict JOIN made ON prefix = word),
sums AS (SELECT prefix, count(*) AS word_count, coalesce(max(CASE WHEN pre.word <> prefix THEN percentile END), 0) AS mcp
  FROM pre JOIN eff USING (word) GROUP BY prefix),
nodes AS MATERIALIZED (SELECT prefix, left(prefix, length(prefix) - 1) AS parent, percentile, expr_index, word_count, mcp
  FROM sums LEFT JOIN eff ON word = prefix)"""

_FOLDERS = f"""{_NODES},
kids AS (SELECT c.prefix, c.word_count, coalesce(p.word_count, sum(c.word_count) OVER (PARTITION BY c.parent)) AS total,
  coalesce(sum(c.word_count - 1) OVER (PARTITION BY c.parent ORDER BY c.word_count DESC, c.prefix
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM nodes c LEFT JOIN nodes p ON p.prefix = c.parent),
folders AS MATERIALIZED (SELECT prefix, word_count FROM kids WHERE total - used > {FOLDER_SIZE} AND word_count > 1)"""

_LAYOUT = f"""{_NODES},
lay AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY length(prefix), prefix) - 1 AS pos FROM nodes),
firsts AS (SELECT parent AS prefix, min(pos) AS first_child_pos, count(*) AS c FROM lay GROUP BY parent)"""

_TYPOS = f"""
edits AS (SELECT word, ordinal, percentile, kind, CASE kind
    WHEN 'delete' THEN left(word, m) || substr(word, m + 2)
    WHEN 'insert' THEN left(word, m) || 'x' || substr(word, m + 1)
    WHEN 'substitute' THEN left(word, m) || CASE WHEN substr(word, m + 1, 1) = 'x' THEN 'y' ELSE 'x' END || substr(word, m + 2)
    ELSE CASE WHEN substr(word, m, 1) <> substr(word, m + 1, 1)
      THEN left(word, m - 1) || substr(word, m + 1, 1) || substr(word, m, 1) || substr(word, m + 2) END END AS query, nth
  FROM (SELECT *, length(word) // 2 AS m FROM dict WHERE length(word) BETWEEN 5 AND 12),
    (VALUES ('delete', 1), ('insert', 2), ('substitute', 3), ('transpose', 4)) k(kind, nth)),
typos AS MATERIALIZED (SELECT CAST(nth * 1000000 + place AS BIGINT) AS query_id, query, word AS target, kind
  FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY percentile DESC, ordinal) AS place FROM edits WHERE query IS NOT NULL)
  WHERE place <= {PER_KIND})"""

_PREFIXES = f"""
weights AS (SELECT left(word, k) AS query, sum(percentile) AS w FROM dict, (VALUES (2), (3)) t(k) WHERE length(word) >= 4 GROUP BY 1),
prefixes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w DESC, query) AS query_id, query FROM weights
  QUALIFY query_id <= {PREFIXES})"""

_LOOKUPS = """asks AS (SELECT word AS query FROM dict UNION SELECT * FROM
  (SELECT left(word, length(word) // 2) || substr(word, length(word) // 2 + 2) AS query FROM dict) WHERE query <> '')"""



def _half(a: str, b: str) -> str:
    """True of any two words within one edit: all but the two letters around the edit stand on one
    side of it or the other, so one half is equal."""
    h = f"((least(length({a}), length({b})) - 2) // 2)"
    return f"(left({a}, greatest({h}, 0)) = left({b}, greatest({h}, 0)) OR right({a}, greatest({h}, 0)) = right({b}, greatest({h}, 0)))"


_NEAR = f"""near AS MATERIALIZED (SELECT query_id, query, word, expr_index, percentile FROM q JOIN eff
  ON abs(length(query) - length(word)) <= 1 AND {_half('query', 'word')} AND damerau_levenshtein(query, word) <= 1)"""

_ASKED = """asked AS (SELECT query_id, query, prefix IS NOT NULL AS is_node, expr_index, percentile,
  prefix IS NOT NULL AND prefix IN (SELECT parent FROM nodes) AS has_children FROM q LEFT JOIN nodes ON prefix = query)"""


def _caps(not_found: int, found: int) -> str:
    return f"""CASE WHEN length(query) <= 1 THEN 0 WHEN length(query) = 2 THEN 1 WHEN length(query) = 3 THEN
      CASE WHEN is_node THEN 1 ELSE 2 END WHEN is_node THEN {found} ELSE {not_found} END"""


def _spelled(not_found: int = 20, found: int = 2, where: str = "TRUE") -> str:
    return f"""
matched AS (SELECT query_id, 'Matching' AS kind, 1 AS ko, expr_index, percentile, query AS word FROM asked WHERE expr_index IS NOT NULL),
spelled AS (SELECT query_id, 'Spelling' AS kind, 2 AS ko, expr_index, percentile, word FROM (
  SELECT n.*, {_caps(not_found, found).replace("query", "n.query")} AS cap,
    row_number() OVER (PARTITION BY n.query_id ORDER BY n.percentile DESC, n.word) AS place
  FROM near n JOIN asked a USING (query_id) WHERE n.word <> n.query AND ({where.replace("expr_index", "n.expr_index")})) WHERE place <= cap)"""


_RANKED = """SELECT query_id, query, row_number() OVER (PARTITION BY query_id ORDER BY pin, percentile DESC, ko, word) AS rank,
  kind, expr_index, percentile, word FROM (SELECT *, CASE WHEN kind = 'Matching' THEN {pin} ELSE 1 END AS pin FROM rows
  QUALIFY row_number() OVER (PARTITION BY query_id, expr_index ORDER BY ko, word) = 1) JOIN q USING (query_id)"""

_TYPO_Q = "q AS (SELECT query_id, query FROM typos)"
_PREFIX_Q = "q AS (SELECT query_id, query FROM prefixes)"


def _corrections(not_found: int = 20, found: int = 2, where: str = "TRUE") -> str:
    return f"""WITH {_NODES}, {_TYPOS}, {_TYPO_Q}, {_NEAR}, {_ASKED}, {_spelled(not_found, found, where)},
rows AS (SELECT * FROM matched UNION ALL SELECT * FROM spelled) {_RANKED.format(pin=0)}"""


def _completions(where: str = "TRUE") -> str:
    return f"""{_ASKED},
more AS (SELECT query_id, 'Extension' AS kind, 3 AS ko, e.expr_index, e.percentile, word FROM q JOIN eff e
  ON starts_with(word, query) AND word <> query WHERE {where.replace("expr_index", "e.expr_index")}),
own AS (SELECT query_id, 'Matching' AS kind, 1 AS ko, expr_index, percentile, query AS word FROM asked WHERE expr_index IS NOT NULL),
rows AS (SELECT * FROM (SELECT * FROM more UNION ALL SELECT * FROM own)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY percentile DESC, word) <= 6)"""


_AFTER_CAPS = f"""
room AS (SELECT a.*, greatest(6 - (SELECT count(*) FROM (SELECT query_id FROM matched UNION ALL SELECT query_id FROM spelled) t
  WHERE t.query_id = a.query_id), 0) AS room FROM asked a),
seeds AS (SELECT r.query_id, n.prefix AS seed FROM room r JOIN nodes n ON abs(length(r.query) - length(n.prefix)) <= 1
  AND {_half('r.query', 'n.prefix')} AND damerau_levenshtein(r.query, n.prefix) <= 1 WHERE NOT has_children AND length(r.query) > 1
  QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY n.mcp DESC, n.prefix) <= 3),
reach AS (SELECT query_id, word, e.expr_index, e.percentile FROM room JOIN eff e ON starts_with(word, query) AND word <> query
  WHERE has_children UNION ALL SELECT query_id, word, e.expr_index, e.percentile FROM seeds JOIN eff e
  ON starts_with(word, left(seed, length(seed) - 1)) AND left(word, length(seed)) >= seed AND length(word) >= length(seed)),
extended AS (SELECT query_id, 'Extension' AS kind, 3 AS ko, expr_index, percentile, word FROM (
  SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY x.percentile DESC, word) AS place, room
  FROM reach x JOIN room USING (query_id)) WHERE place <= room),
rows AS (SELECT * FROM matched UNION ALL SELECT * FROM spelled UNION ALL SELECT * FROM extended)"""

_SUGGESTED = f"{_NEAR}, {_ASKED}, {_spelled()}, {_AFTER_CAPS}"
_BOTH = "q AS (SELECT query_id, query FROM typos UNION ALL SELECT query_id, query FROM prefixes)"
_REPEATED = """rep AS (SELECT (SELECT count(*) FROM dict) + 1 - ordinal AS ordinal, word, percentile, expr_index FROM dict
UNION ALL SELECT (SELECT count(*) FROM dict) + ordinal, word, CAST(999 - percentile AS INTEGER), CAST(expr_index + 1000000 AS INTEGER) FROM dict)"""
_INSERTED = """SELECT left(word, k) AS prefix, CAST(arg_min(CASE WHEN k = length(word) THEN percentile ELSE 0 END, ordinal) AS INTEGER) AS percentile,
arg_max(expr_index, ordinal) FILTER (WHERE k = length(word)) AS expr_index
FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM rep) GROUP BY 1"""
_GIVEN = "rep AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}', {p}, CAST({x} AS INTEGER))" for i, (w, p, x) in enumerate(GIVEN, 1)) + ") t(ordinal, word, percentile, expr_index))"


def _line(rows: str, buckets: int) -> str:
    return f"""SELECT '[' || coalesce(string_agg(coalesce(nodes, 0), ', ' ORDER BY b), '') || ']' AS line
FROM range({buckets}) t(b) LEFT JOIN ({rows}) ON bucket = b WHERE b <= (SELECT max(bucket) FROM ({rows}))"""


_LEV = "(levenshtein(query, word) <= 1)"

ORACLE_SQL: dict[str, str] = {
    "dictionary": f"WITH {_DICT} SELECT ordinal, word, percentile, expr_index FROM dict",
    "exact_lookup": f"WITH {_DICT}, {_LOOKUPS} SELECT query, expr_index FROM asks LEFT JOIN dict ON word = query",
    "find_node": f"""WITH {_NODES}, {_LOOKUPS} SELECT query, prefix IS NOT NULL AS is_node, mcp AS max_child_percentile
FROM asks LEFT JOIN nodes ON prefix = query""",
    "word_of_expr": f"""WITH {_NODES}, asked AS (SELECT expr_index FROM dict UNION ALL SELECT -expr_index FROM dict)
SELECT expr_index, word, percentile FROM asked LEFT JOIN eff USING (expr_index)""",
    "prefix_topk": f"""WITH {_NODES}, {_PREFIXES} SELECT query_id, query, word,
row_number() OVER (PARTITION BY query_id ORDER BY percentile DESC, word) AS rank FROM prefixes JOIN eff ON starts_with(word, query)
QUALIFY rank <= {TOP}""",
    "completions": f"WITH {_NODES}, {_PREFIXES}, {_PREFIX_Q}, {_completions()} {_RANKED.format(pin=1)}",
    "completions_filtered": f"WITH {_NODES}, {_PREFIXES}, {_PREFIX_Q}, {_completions('expr_index % 2 = 0')} {_RANKED.format(pin=1)}",
    "node_table": f"WITH {_NODES} SELECT prefix, percentile, expr_index, word_count, mcp AS max_child_percentile FROM nodes",
    "node_layout": f"""WITH {_LAYOUT} SELECT pos, prefix, right(prefix, 1) AS node_char, coalesce(first_child_pos, 0) AS first_child_pos,
prefix = max(prefix) OVER (PARTITION BY parent) AS is_last_sibling,
CASE WHEN expr_index IS NOT NULL THEN CAST(count(expr_index) OVER (ORDER BY pos) - 1 AS BIGINT) END AS slot FROM lay LEFT JOIN firsts USING (prefix)""",
    "node_counts": f"""WITH {_NODES} SELECT p AS prefix, count(*) AS node_count
FROM (SELECT left(prefix, k) AS p FROM (SELECT prefix, unnest(range(1, length(prefix) + 1)) AS k FROM nodes)) GROUP BY p""",
    "cursor_moves": f"""WITH {_LAYOUT} SELECT a.prefix, a.parent, lead(a.prefix) OVER w AS next_sibling, lag(a.prefix) OVER w AS previous_sibling,
b.first_child, b.last_child, coalesce(b.n, 0) AS n_children FROM lay a LEFT JOIN (SELECT parent AS prefix, min(prefix) AS first_child,
max(prefix) AS last_child, count(*) AS n FROM lay GROUP BY parent) b ON a.prefix = b.prefix WINDOW w AS (PARTITION BY a.parent ORDER BY a.prefix)""",
    "folders": f"WITH {_FOLDERS} SELECT prefix, word_count FROM folders",
    "path_of": f"""WITH {_FOLDERS} SELECT d.word AS query, coalesce(max(f.prefix), '') || '/' AS path FROM dict d
LEFT JOIN (SELECT word, left(word, k) AS p FROM (SELECT word, unnest(range(1, length(word))) AS k FROM dict)) s ON s.word = d.word
LEFT JOIN folders f ON f.prefix = s.p GROUP BY d.word""",
    "content_of": f"""WITH {_FOLDERS}, own AS (SELECT e.word, coalesce(max(f.prefix), '') AS folder FROM eff e
LEFT JOIN (SELECT word, left(word, k) AS p FROM (SELECT word, unnest(range(1, length(word))) AS k FROM dict)) s ON s.word = e.word
LEFT JOIN folders f ON f.prefix = s.p GROUP BY e.word)
SELECT folder AS query, word || '.' AS entry FROM own
UNION ALL SELECT left(prefix, length(prefix) - 1) AS query, prefix || '/' AS entry FROM folders""",
    "path_and_content_of": f"""WITH {_FOLDERS}, {_PREFIXES}, items AS (
SELECT query, word || '.' AS entry FROM prefixes JOIN eff ON starts_with(word, query) AND word <> query
WHERE NOT EXISTS (SELECT 1 FROM folders f WHERE starts_with(word, f.prefix) AND length(f.prefix) > length(query) AND f.prefix <> word)
UNION ALL SELECT query, prefix || '/' FROM prefixes JOIN folders ON left(prefix, length(prefix) - 1) = query)
SELECT query, coalesce((SELECT max(prefix) FROM folders WHERE starts_with(query, prefix)), '') || '/' AS path,
coalesce((SELECT string_agg(entry, ' ' ORDER BY entry) FROM items i WHERE i.query = p.query), '') AS entries FROM prefixes p""",
    "as_list": f"""WITH {_FOLDERS} SELECT prefix AS path, prefix IN (SELECT prefix FROM folders) AS is_folder, expr_index,
coalesce(percentile, 0) AS percentile, mcp AS max_child_percentile FROM nodes WHERE mcp >= 900""",
    "as_lookup": f"""WITH {_FOLDERS} SELECT expr_index, prefix AS path, prefix IN (SELECT prefix FROM folders) AS is_folder,
percentile, mcp AS max_child_percentile FROM nodes WHERE expr_index IS NOT NULL""",
    "tree_dump": f"""WITH {_FOLDERS}, depth AS (SELECT n.prefix, count(f.prefix) AS depth FROM
(SELECT prefix, left(prefix, k) AS p FROM (SELECT prefix, unnest(range(0, length(prefix))) AS k FROM nodes)) n
LEFT JOIN folders f ON f.prefix = n.p GROUP BY n.prefix)
SELECT prefix AS path, CAST(0 AS INTEGER) AS place, repeat(' ', depth) || right(prefix, 1) || ':' AS line FROM folders JOIN depth USING (prefix)
UNION ALL SELECT prefix, CAST(1 AS INTEGER), repeat(' ', depth) || prefix || '    (idx: ' || expr_index || ', ' || percentile || '% & max: ' || mcp || '%)'
FROM nodes JOIN depth USING (prefix) WHERE expr_index IS NOT NULL""",
    "tree_stats": f"""WITH {_LAYOUT} SELECT count(*) AS total_nodes, count(expr_index) AS total_words, CAST(sum(coalesce(c, 0)) AS BIGINT) AS sum_children,
max(coalesce(c, 0)) AS max_children, max(coalesce(first_child_pos - pos, 0)) AS max_rel_child_pos, CAST(max(percentile) AS BIGINT) AS max_percentile,
max(length(prefix)) AS max_depth, round(sum(coalesce(c, 0)) / count(*), 6) AS avg_children FROM lay LEFT JOIN firsts USING (prefix)""",
    "child_histogram": f"""WITH {_LAYOUT} SELECT least(coalesce(c, 0), 39) AS bucket, count(*) AS nodes FROM lay LEFT JOIN firsts USING (prefix) GROUP BY 1""",
    "percentile_histogram": f"WITH {_NODES} SELECT CAST(least(coalesce(percentile, 0) // 10, 100) AS BIGINT) AS bucket, count(*) AS nodes FROM nodes GROUP BY 1",
    "typo_queries": f"WITH {_DICT}, {_TYPOS} SELECT query_id, query, target, kind FROM typos",
    "prefix_queries": f"WITH {_DICT}, {_PREFIXES} SELECT query_id, query FROM prefixes",
    "single_edits": f"""WITH {_DICT}, w AS (SELECT word FROM dict),
i AS (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM w),
e AS (SELECT word, left(word, i) || c || substr(word, i + 1) AS edit FROM i, (VALUES ('x'), ('a')) t(c)
UNION SELECT word, left(word, i) || c || substr(word, i + 2) FROM i, (VALUES ('x'), ('a'), ('')) t(c) WHERE i < length(word)
UNION SELECT word, left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM i WHERE i + 1 < length(word))
SELECT DISTINCT word, edit FROM e WHERE edit <> word""",
    "first_letter_neighbours": f"""WITH {_DICT}, w AS (SELECT word FROM dict)
SELECT word, chr(CAST(c AS INTEGER)) || substr(word, 2) AS edit FROM w, range(97, 123) t(c) WHERE chr(CAST(c AS INTEGER)) <> left(word, 1)""",
    "dl1_neighbours": f"WITH {_NODES}, {_TYPOS}, {_TYPO_Q}, {_NEAR} SELECT query_id, query, word FROM near",
    "levenshtein_only": f"WITH {_NODES}, {_TYPOS}, {_TYPO_Q}, {_NEAR} SELECT query_id, query, word FROM near WHERE {_LEV}",
    "corrections_default": _corrections(),
    "corrections_exhaustive": _corrections(64, 64),
    "corrections_filtered": _corrections(where="expr_index % 2 = 0"),
    "suggestions": f"WITH {_NODES}, {_TYPOS}, {_PREFIXES}, {_BOTH}, {_SUGGESTED} {_RANKED.format(pin=0)}",
    "corrections_capped": _corrections(3, 1),
    "results_shown": f"""WITH {_NODES}, {_PREFIXES}, {_PREFIX_Q}, {_completions()}
SELECT query_id, rank, kind || ' ' || expr_index || ' ' || printf('%.1f', percentile / 10) || '%' AS shown FROM ({_RANKED.format(pin=1)})""",
    "completions_empty": f"""WITH {_NODES}, q AS (SELECT CAST(1 AS BIGINT) AS query_id, min(prefix) AS query FROM nodes WHERE length(prefix) = 1), {_completions()}
SELECT query_id, '' AS query, rank, kind, expr_index, percentile, word FROM ({_RANKED.format(pin=1)})""",
    "find_empty": f"WITH {_NODES} SELECT '' AS query, prefix, word_count FROM nodes WHERE prefix = (SELECT min(prefix) FROM nodes WHERE length(prefix) = 1)",
    "tsv_scan": f"WITH {_DICT} SELECT ordinal, word, percentile, expr_index FROM dict",
    "tsv_compressed_scan": f"WITH {_DICT} SELECT ordinal, word, percentile, expr_index FROM dict",
    "in_memory_source": f"WITH {_GIVEN} {_INSERTED}",
    "appended": f"WITH {_DICT}, {_REPEATED} SELECT * FROM rep",
    "keep_first": f"WITH {_DICT}, {_REPEATED} SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY word ORDER BY ordinal) = 1",
    "insertion_order": f"WITH {_DICT}, {_REPEATED} {_INSERTED}",
    "composed_words": f"""WITH {_DICT} SELECT ordinal, nfc_normalize(regexp_replace(word, '([aeiou])', '\\1\u0301', 'g')) AS word, length(word) AS n FROM dict""",
    "saved_and_loaded": f"""WITH {_FOLDERS}, lay AS (SELECT *, row_number() OVER (ORDER BY length(prefix), prefix) - 1 AS pos FROM nodes)
SELECT prefix, pos, CASE WHEN expr_index IS NOT NULL THEN CAST(count(expr_index) OVER (ORDER BY pos) - 1 AS BIGINT) END AS slot,
prefix IN (SELECT prefix FROM folders) AS is_folder FROM lay""",
    "as_list_most": f"""WITH {_FOLDERS} SELECT prefix AS path, prefix IN (SELECT prefix FROM folders) AS is_folder, expr_index,
coalesce(percentile, 0) AS percentile, mcp AS max_child_percentile FROM nodes ORDER BY prefix LIMIT 500""",
    "as_lookup_repeated": f"""WITH {_FOLDERS} SELECT CAST(expr_index // 3 AS INTEGER) AS expr_index, prefix AS path, prefix IN (SELECT prefix FROM folders) AS is_folder,
percentile, mcp AS max_child_percentile FROM nodes WHERE expr_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY expr_index // 3 ORDER BY prefix DESC) = 1""",
    "child_histogram_line": f"WITH {_LAYOUT} {_line('SELECT least(coalesce(c, 0), 39) AS bucket, count(*) AS nodes FROM lay LEFT JOIN firsts USING (prefix) GROUP BY 1', 40)}",
    "percentile_histogram_line": f"WITH {_NODES} {_line('SELECT least(coalesce(percentile, 0) // 10, 100) AS bucket, count(*) AS nodes FROM nodes GROUP BY 1', 101)}",
    "ancestors": f"""WITH {_NODES} SELECT prefix AS query, CAST(length(prefix) - k AS INTEGER) AS up, left(prefix, k) AS prefix
FROM (SELECT prefix, unnest(range(1, length(prefix))) AS k FROM nodes)""",
    "descendants": f"WITH {_NODES} SELECT left(prefix, k) AS query, prefix FROM (SELECT prefix, unnest(range(1, length(prefix) + 1)) AS k FROM nodes)",
    "traversal": f"""WITH {_NODES}, edges AS (SELECT prefix, prefix || chr(1) AS mark, 'open' AS edge FROM nodes
UNION ALL SELECT prefix, prefix || chr(65535), 'close' FROM nodes)
SELECT row_number() OVER (ORDER BY mark) - 1 AS step, edge, prefix FROM edges""",
    "recall_by_kind": f"""WITH {_NODES}, {_TYPOS}, {_TYPO_Q}, {_NEAR}, {_ASKED}, {_spelled()},
found AS (SELECT 'corrections' AS engine, query_id, word FROM (SELECT * FROM matched UNION ALL SELECT * FROM spelled)
UNION SELECT 'levenshtein', query_id, word FROM near WHERE {_LEV} UNION SELECT 'one_edit', query_id, word FROM near),
hits AS (SELECT e.engine, t.kind, f.word IS NOT NULL AS hit FROM typos t CROSS JOIN (VALUES ('corrections'), ('levenshtein'), ('one_edit')) e(engine)
LEFT JOIN found f ON f.engine = e.engine AND f.query_id = t.query_id AND f.word = t.target)
SELECT engine, coalesce(kind, 'all') AS kind, count(*) AS queries, count(*) FILTER (WHERE hit) AS hits,
count(*) FILTER (WHERE hit) / count(*) AS recall FROM hits GROUP BY GROUPING SETS ((engine, kind), (engine))""",
    "correction_shape": f"""WITH {_NODES}, {_TYPOS}, {_TYPO_Q}, {_SUGGESTED}, r1 AS (SELECT DISTINCT query_id, word FROM rows),
found AS (SELECT 'suggestions' AS engine, query_id, word FROM r1 UNION ALL SELECT 'levenshtein', query_id, word FROM near WHERE {_LEV}
UNION ALL SELECT 'exhaustive', query_id, word FROM (SELECT n.query_id, n.word, n.query, length(n.query) AS l,
row_number() OVER (PARTITION BY n.query_id ORDER BY n.word = n.query DESC, n.percentile DESC, n.word) AS place, a.is_node, a.expr_index IS NOT NULL AS w
FROM near n JOIN asked a USING (query_id)) n WHERE place - CAST(w AS INTEGER) <= {_caps(64, 64)} OR word = query),
engines AS (SELECT DISTINCT engine FROM found),
per AS (SELECT engine, t.query_id, (SELECT count(*) FROM found f WHERE f.engine = e.engine AND f.query_id = t.query_id) AS results,
(SELECT count(*) FROM near n WHERE n.query_id = t.query_id) AS truths,
(SELECT count(*) FROM near n JOIN found f ON f.query_id = n.query_id AND f.word = n.word WHERE f.engine = e.engine AND n.query_id = t.query_id) AS hits
FROM engines e CROSS JOIN typos t)
SELECT engine, CAST(sum(results) AS BIGINT) AS results, round(avg(CASE WHEN truths = 0 THEN 1.0 ELSE hits / truths END), 6) AS recall
FROM per WHERE truths > 0 OR results > 0 GROUP BY engine""",
    "recall_at_5": f"""WITH {_NODES}, {_PREFIXES}, {_PREFIX_Q}, {_SUGGESTED}, s AS ({_RANKED.format(pin=0)}),
truth AS (SELECT query_id, word FROM q JOIN eff ON starts_with(word, query)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY percentile DESC, word) <= {TOP}),
found AS (SELECT 'suggestions' AS engine, query_id, word FROM s WHERE rank <= {TOP} UNION ALL SELECT 'completions', query_id, word FROM (
SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY percentile DESC, word <> query, word) AS place FROM q JOIN eff ON starts_with(word, query)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY percentile DESC, word) <= 6) WHERE place <= {TOP}
UNION ALL SELECT 'pruning_trie', query_id, word FROM q JOIN dict ON starts_with(word, query)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY percentile DESC, word) <= {TOP}),
per AS (SELECT engine, t.query_id, count(*) AS truths, count(f.word) AS hits FROM truth t
CROSS JOIN (VALUES ('suggestions'), ('completions'), ('pruning_trie')) e(engine)
LEFT JOIN found f USING (engine, query_id, word) GROUP BY ALL)
SELECT engine, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(truths) AS BIGINT) AS truths, round(avg(hits / truths), 6) AS recall FROM per GROUP BY engine""",
    "rank_of": f"""WITH ranked AS ({_corrections()}), {_DICT}, {_TYPOS}
SELECT t.query_id, min(r.rank) AS rank FROM typos t LEFT JOIN ranked r ON r.query_id = t.query_id AND r.word = t.target GROUP BY t.query_id""",
}
