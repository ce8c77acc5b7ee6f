"""Searches that keep the walk's own order among equals, and the trace of the walk.

The plain operators break ties by word. A walk over a tree in memory breaks them by the order in
which it meets nodes: a bounded list takes a word only if its percentile is above the list's
least, and then in the place of the first that has the least. `replay` feeds each query's
candidates to such lists in that order. `trace` writes down what the walk decides at each node.

Both see a query's candidates as one group: those within one edit, those that extend it, and those
that its seeds reach. Candidates are joined as in the plain operators; what a group holds is bounded by
the words that extend one query, so these two are for looking into results, not for bulk use.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import deletion_variants, prefixes, within_one_edit
from wordloom.operators import search
from wordloom.operators.build import words_of
from wordloom.session import materialize, sized, tidy

RESULT = "query_id BIGINT, query STRING, rank BIGINT, kind STRING, expr_index INT, percentile INT, word STRING"
TRACE = (
    "query_id BIGINT, place BIGINT, path STRING, query STRING, chr STRING, dist INT, min INT, percentile INT,"
    " max_child_percentile INT, keep STRING, search STRING, line STRING"
)


class Best:
    """A list of at most ``room`` items that a walk fills."""

    def __init__(self, room: int):
        self.room, self.items = room, []

    def least(self) -> int:
        """What a percentile must be above; below all while there is room."""
        full = len(self.items) >= self.room
        return min((p for p, _ in self.items), default=1 << 30) if full else -1

    def offer(self, percentile: int, item) -> bool:
        if percentile <= (least := self.least()) or not self.room:
            return False
        if len(self.items) < self.room:
            self.items.append((percentile, item))
        else:
            at = next(i for i, (p, _) in enumerate(self.items) if p == least)
            self.items[at] = (percentile, item)
        return True


def finished(matching: list[tuple], spelled: list[tuple], extended: list[tuple]) -> list[tuple]:
    """Rows (kind, percentile, expr_index, word) in order of result: a stable sort, then repeats
    that stand next to each other go, and what repeats the match goes anywhere."""
    rows = sorted(matching + spelled + extended, key=lambda r: (r[0] != search.MATCHING, -r[1]))
    out: list[tuple] = []
    for r in rows:
        if out and r[0] != search.MATCHING and (r[2] == out[-1][2] or matching and r[2] == matching[0][2]):
            continue
        out.append(r)
    return out


def _reach(nodes: DataFrame, found: DataFrame, candidates: Column | str) -> DataFrame:
    """(query_id, role, word, expr_index, percentile, seed): each query's match, neighbours,
    neighbouring nodes, and extensions."""
    words = words_of(nodes).where(candidates)
    near = search.neighbours(found.where("cap > 0"), words).where("asked <> word")
    near = near.select("query_id", F.lit("near").alias("role"), "word", "expr_index", "percentile", F.lit("").alias("seed"))
    own = found.where("match IS NOT NULL").select("query_id", F.lit("own").alias("role"), "match.word", "match.expr_index", "match.percentile", F.lit("").alias("seed"))
    steps = words.select("*", F.explode(prefixes("word")).alias("asked")).where("asked <> word")
    more = steps.join(sized(found.where("has_children").select("query_id", "asked")), "asked")
    more = more.select("query_id", F.lit("more").alias("role"), "word", "expr_index", "percentile", F.lit("").alias("seed"))
    at = nodes.select(F.col("prefix").alias("word"), F.lit(0).alias("expr_index"), F.col("max_child_percentile").alias("percentile"))
    seeds = search.neighbours(found.where("NOT has_children AND cap > 0"), at)
    seeds = seeds.select("query_id", F.lit("seed").alias("role"), "word", "expr_index", "percentile", F.lit("").alias("seed"))
    return own.unionByName(near).unionByName(more).unionByName(seeds)


@tidy
def replay(nodes: DataFrame, queries: DataFrame, candidates: Column | str = "true") -> DataFrame:
    """Suggestions as `search.suggestions`, with the walk's choice among equals and its repeats."""
    found = search.asked(nodes, queries)
    reach = materialize(_reach(nodes, found, candidates))

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        best = Best(search.SEEDS)
        for r in rows.sort_values("word").itertuples():
            best.offer(r.percentile, r.word)
        return pd.DataFrame([(rows.query_id.iloc[0], i, w) for i, (_, w) in enumerate(best.items)], columns=["query_id", "place", "seed"])

    seeds = materialize(reach.where("role = 'seed'").groupBy("query_id").applyInPandas(chosen, "query_id BIGINT, place INT, seed STRING"))
    parent = F.expr("substr(seed, 1, length(seed) - 1)")
    words = words_of(nodes).where(candidates)
    above = F.explode(F.expr("concat(array(''), slice(transform(sequence(1, length(word)), i -> substr(word, 1, i)), 1, length(word) - 1))"))
    swept = words.select("*", above.alias("parent")).join(sized(seeds.withColumn("parent", parent)), "parent")
    swept = swept.where("substr(word, 1, length(seed)) >= seed")
    swept = swept.select("query_id", F.format_string("sweep%d", "place").alias("role"), "word", "expr_index", "percentile", "seed")
    rows = reach.where("role <> 'seed'").unionByName(swept).join(found.select("query_id", "query", "cap"), "query_id")

    def result(rows: pd.DataFrame) -> pd.DataFrame:
        of = lambda role: rows[rows.role == role]
        matching = [(search.MATCHING, r.percentile, r.expr_index, r.word) for r in of("own").itertuples()]
        spelled = Best(int(rows.cap.iloc[0]))
        for r in of("near").sort_values("word").itertuples():
            spelled.offer(r.percentile, (search.SPELLING, r.percentile, r.expr_index, r.word))
        extended = Best(max(0, search.MOST - len(matching) - len(spelled.items)))
        for role in ("more", "sweep0", "sweep1", "sweep2"):  # level by level within each
            for r in sorted(of(role).itertuples(), key=lambda r: (len(r.word), r.word)):
                extended.offer(r.percentile, (search.EXTENSION, r.percentile, r.expr_index, r.word))
        out = finished(matching, [x for _, x in spelled.items], [x for _, x in extended.items])
        head = (rows.query_id.iloc[0], rows["query"].iloc[0])
        return pd.DataFrame(
            [(*head, i, kind, e, p, w) for i, (kind, p, e, w) in enumerate(out, 1)],
            columns=["query_id", "query", "rank", "kind", "expr_index", "percentile", "word"],
        )

    return rows.groupBy("query_id").applyInPandas(result, RESULT)


def distances(query: str, word: str) -> tuple[int, int]:
    """The distance of query and word, and the least one of the query's prefixes near its length
    from the word; both at most 2."""
    n, rows = len(query), [list(range(len(query) + 1))]
    for i, c in enumerate(word, 1):
        row = [i]
        for j, q in enumerate(query, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != q))
            if i > 1 and j > 1 and c == query[j - 2] and word[i - 2] == q:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    i = len(word)
    band = [rows[i][j] for j in range(max(0, i - 1), min(n, i + 1) + 1)]
    far = rows[i][n] if abs(i - n) <= 1 else 2
    return min(far, 2), min(min(band, default=2), 2)


def _walked(found: DataFrame, tree: DataFrame) -> DataFrame:
    """(query_id, prefix): the nodes that the walks of queries may decide on. The distance walk goes
    on below nodes within one edit of a prefix of the query; sweeps go through what extends the
    query, or what its neighbours' parents hold from the neighbour on."""
    starts = F.explode(F.concat(F.array(F.lit("")), F.expr("IF(query = '', array(), transform(sequence(1, greatest(length(query), 1)), i -> substr(query, 1, i)))"))).alias("start")
    of_query = found.where("cap > 0").select("query_id", "query", "has_children", starts).select("*", F.explode(deletion_variants("start")).alias("variant"))
    of_node = tree.select(F.col("prefix").alias("node"), F.explode(deletion_variants("prefix")).alias("variant"))
    near = materialize(of_node.join(sized(of_query), "variant").where(within_one_edit("start", "node")))
    below = tree.select("prefix", "parent").join(sized(near.select("query_id", F.col("node").alias("parent")).distinct()), "parent")
    roots = tree.where("parent = ''").select("prefix").crossJoin(sized(found.where("cap > 0").select("query_id")))
    steps = tree.select("prefix", F.explode(F.concat(F.array(F.lit("")), prefixes("prefix"))).alias("above"))
    more = steps.join(sized(found.where("has_children").select("query_id", F.col("asked").alias("above"))), "above")
    seeds = near.where("start = query AND NOT has_children").select("query_id", F.col("node").alias("seed"), F.expr("substr(node, 1, length(node) - 1)").alias("above"))
    swept = steps.join(sized(seeds.distinct()), "above").where("substr(prefix, 1, length(seed)) >= seed")
    rows = [x.select("query_id", "prefix") for x in (below, roots, more, swept)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3]).distinct()


@tidy
def trace(nodes: DataFrame, queries: DataFrame, candidates: set[int] | None = None) -> DataFrame:
    """The walk of each query, a row for each node it decides on, in order: first the distance
    walk, then the sweeps for extensions."""
    tree = nodes.select("prefix", "parent", "percentile", "expr_index", "max_child_percentile")
    found = search.asked(nodes, queries)
    asked = found.select("query_id", "query", "cap", F.col("match.expr_index").alias("own"))
    walked = materialize(_walked(found, tree))
    together = tree.join(sized(walked), "prefix").join(asked, "query_id")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        query, cap, number = rows["query"].iloc[0], int(rows.cap.iloc[0]), rows.query_id.iloc[0]
        at = {r.prefix: r for r in rows.itertuples()}
        kids: dict[str, list[str]] = {}
        for p in sorted(at):
            kids.setdefault(at[p].parent, []).append(p)
        is_word = lambda r: not pd.isna(r.expr_index)
        allowed = lambda r: candidates is None or int(r.expr_index) in candidates
        out: list[tuple] = []
        spelled, seeds = Best(cap), Best(search.SEEDS)

        def note(path, chr, dist, least, r, keep, go):
            if dist is not None:
                text = f"{query}, dist({dist}), min({least})"
                row = (None, dist, least, None, None)
            else:
                p = int(r.percentile) if is_word(r) else 0
                text = f"{chr} {p / 10:.1f}% (max {r.max_child_percentile / 10:.1f}%)"
                row = (chr, None, None, p, int(r.max_child_percentile))
            out.append((number, len(out), path, query, *row, keep, go, f"{path} <-> {text}, keep: {keep}, search: {go}"))

        stack = list(reversed(kids.get("", []))) if cap else []
        while stack:
            prefix = stack.pop()
            r, (dist, least) = at[prefix], distances(query, prefix)
            keep = "dist too big"
            if dist == 0:
                keep = "word match kept" if is_word(r) else "node match"
            elif dist == 1 and is_word(r):
                keep = "too low percentile"
                if r.percentile > spelled.least():
                    keep = "word kept" if allowed(r) else "candidate discarded"
                    if allowed(r):
                        spelled.offer(r.percentile, prefix)
            if dist <= 1:
                seeds.offer(r.max_child_percentile, prefix)
            below = kids.get(prefix, [])
            note(prefix, prefix[-1], dist, least, r, keep, "min dist too big" if least > 1 else "do search" if below else "no children")
            if least <= 1:
                stack += reversed(below)
        matched = int(not pd.isna(rows.own.iloc[0]))
        extended = Best(max(0, search.MOST - matched - len(spelled.items)))
        start = query if query else (kids.get("") or [""])[0]
        sweeps = [(kids[start], start)] if kids.get(start) and query in at else [([s for s in kids[at[w].parent] if s >= w], w) for _, w in seeds.items]
        for first, label in sweeps:
            queue = deque([(first, label)])
            while queue:
                group, path = queue.popleft()
                for prefix in group:
                    r, here = at[prefix], path + prefix[-1]
                    keep = "not a word"
                    if is_word(r):
                        keep = "too low percentile"
                        if r.percentile > extended.least():
                            keep = "word kept" if allowed(r) else "candidate discarded"
                            if allowed(r):
                                extended.offer(r.percentile, prefix)
                    go = "no children"
                    if r.max_child_percentile < extended.least():
                        go = "max child percentile too small"
                    elif kids.get(prefix):
                        queue.append((kids[prefix], here))
                        go = "do search"
                    note(here, prefix[-1], None, None, r, keep, go)
        columns = ["query_id", "place", "path", "query", "chr", "dist", "min", "percentile", "max_child_percentile", "keep", "search", "line"]
        return pd.DataFrame(out, columns=columns).astype({c: "Int32" for c in ("dist", "min", "percentile", "max_child_percentile")})

    return together.groupBy("query_id").applyInPandas(walk, TRACE)
