"""String functions of the engine, as columns. One character is one code point."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = ("delete", "insert", "substitute", "transpose")


@F.pandas_udf(StringType())
def _nfc(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else unicodedata.normalize("NFC", w))


def nfc(word: Column) -> Column:
    """Unicode composition. Words of ASCII go around Python."""
    return F.when(word.rlike(r"[^\x00-\x7F]"), _nfc(word)).otherwise(word)


def prefixes(word: str) -> Column:
    """All prefixes of a column of non-empty words, itself included."""
    return F.expr(f"transform(sequence(1, length({word})), i -> substr({word}, 1, i))")


def deletion_variants(word: str) -> Column:
    """The word and all words with one character less. Two words within one edit share one."""
    return F.expr(
        f"array_distinct(concat(array({word}), transform(sequence(1, greatest(length({word}), 1)),"
        f" i -> concat(substr({word}, 1, i - 1), substr({word}, i + 1)))))"
    )


def within_one_edit(a: str, b: str) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    swapped = (
        f"exists(sequence(1, greatest(length({a}) - 1, 1)), i -> concat(substr({a}, 1, i - 1), substr({a}, i + 1, 1),"
        f" substr({a}, i, 1), substr({a}, i + 2)) = {b})"
    )
    return F.expr(f"levenshtein({a}, {b}, 1) >= 0 OR (length({a}) = length({b}) AND length({a}) > 1 AND {swapped})")


def spellings_cap(length: Column, found: Column, not_found_cap: Column, found_cap: Column) -> Column:
    """How many corrections a query of ``length`` characters gets; found: is it a node?"""
    return (
        F.when(length <= 1, 0)
        .when(length == 2, 1)
        .when((length == 3) & found, 1)
        .when(length == 3, 2)
        .when(found, found_cap)
        .otherwise(not_found_cap)
        .cast("int")
    )


def edited(word: str, kind: str) -> Column:
    """One edit of the given kind in the middle of the word; null where it can't be made."""
    m = f"(length({word}) div 2)"  # characters before the middle one
    head, tail = f"substr({word}, 1, {m})", f"substr({word}, {m} + 1)"
    at, rest = f"substr({word}, {m} + 1, 1)", f"substr({word}, {m} + 2)"
    return F.expr(
        f"CASE WHEN length({word}) < 4 THEN NULL"
        f" WHEN {kind} = 'delete' THEN concat({head}, {rest})"
        f" WHEN {kind} = 'insert' THEN concat({head}, 'x', {tail})"
        f" WHEN {kind} = 'substitute' THEN concat({head}, IF({at} = 'x', 'y', 'x'), {rest})"
        f" WHEN substr({word}, {m}, 1) = {at} THEN NULL"
        f" ELSE concat(substr({word}, 1, {m} - 1), {at}, substr({word}, {m}, 1), {rest}) END"
    )


def single_edits(word: str, letters: str = "xa") -> Column:
    """All words one edit away: deletions, insertions and substitutions of ``letters``, swaps."""
    n, array = f"length({word})", "array(" + ", ".join(f"'{c}'" for c in letters) + ")"
    split = f"substr({word}, 1, i), c, substr({word}, i + 1)"
    swap = f"concat(substr({word}, 1, i - 1), substr({word}, i + 1, 1), substr({word}, i, 1), substr({word}, i + 2))"
    return F.expr(
        f"array_except(array_distinct(concat("
        f"transform(sequence(1, {n}), i -> concat(substr({word}, 1, i - 1), substr({word}, i + 1))),"
        f"flatten(transform(sequence(0, {n}), i -> transform({array}, c -> concat({split})))),"
        f"flatten(transform(sequence(1, {n}), i -> transform({array}, c -> concat(substr({word}, 1, i - 1), c, substr({word}, i + 1))))),"
        f"IF({n} > 1, transform(sequence(1, greatest({n} - 1, 1)), i -> {swap}), array()))), array({word}))"
    )
