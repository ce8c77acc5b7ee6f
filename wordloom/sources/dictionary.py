"""Where dictionaries come from and go to. A dictionary has one row a word:
(ordinal, word, percentile, expr_index), ordinal being the order of insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import nfc
from wordloom.session import materialize, with_rank

SCHEMA = "word STRING, percentile INT, expr_index INT"
COLUMNS = ["ordinal", "word", "percentile", "expr_index"]


def checked(df: DataFrame) -> DataFrame:
    """Words composed (NFC); rows outside the model's ranges stop the job. An empty word is none."""
    ok = F.col("percentile").between(0, 1000) & F.col("expr_index").between(0, (1 << 24) - 1) & (F.length("word") > 0)
    bad = F.concat(F.lit("not a dictionary row: "), F.to_json(F.struct("word", "percentile", "expr_index")))
    percentile = F.when(F.coalesce(ok, F.lit(False)), F.col("percentile")).otherwise(F.raise_error(bad).cast("int"))
    return df.select("ordinal", nfc(F.col("word")).alias("word"), percentile.alias("percentile"), "expr_index")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated `word, percentile, expr_index` without header or quotes; also .zst, .gz. A
    bad record stops the job. Lines keep their order: by file, split and line."""
    options = {"sep": "\t", "quote": "", "escape": "", "header": False, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": False}
    rows = spark.read.schema(SCHEMA).options(**options).csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    ranked = with_rank(rows.withColumn("place", place), [F.col("place")], "ordinal")
    return checked(ranked.withColumn("ordinal", F.col("ordinal") + 1))


def from_rows(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    """From (word, percentile, expr_index) in order of insertion."""
    numbered = [(i, *r) for i, r in enumerate(rows, 1)]
    return checked(spark.createDataFrame(numbered, f"ordinal BIGINT, {SCHEMA}"))


def appended(dictionary: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` inserted after all of ``dictionary``."""
    last = dictionary.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("last"))
    moved = more.crossJoin(F.broadcast(last)).withColumn("ordinal", F.col("ordinal") + F.col("last"))
    return dictionary.select(COLUMNS).unionByName(moved.select(COLUMNS))


def keep_first(dictionary: DataFrame) -> DataFrame:
    """The first row of each word."""
    rows = dictionary.groupBy("word").agg(F.min_by(F.struct(COLUMNS), "ordinal").alias("row"))
    return rows.select("row.*")


def from_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """The vocabulary of texts: lower-cased words of letters a-z, commonest first; the percentile
    falls from 999 to 0 with the rank, which is also the expr_index; more words than indexes stop
    the job."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    counts = words.select(F.lower("word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    counts = materialize(counts)
    total = counts.agg(F.count(F.lit(1)).alias("n"))
    ranked = with_rank(counts, [F.desc("freq"), F.asc("word")], "ordinal").crossJoin(F.broadcast(total))
    place = F.col("ordinal") + 1
    rows = ranked.select(
        place.alias("ordinal"),
        "word",
        F.expr("(1000 * (n - ordinal - 1)) div n").cast("int").alias("percentile"),
        place.cast("int").alias("expr_index"),
    )
    return checked(rows)


def save(nodes: DataFrame, path: str) -> None:
    """A built tree, sorted within files so that statistics prune ranges of prefixes."""
    nodes.repartitionByRange(F.col("prefix")).sortWithinPartitions("prefix").write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tsv(dictionary: DataFrame, path: str, compression: str = "none") -> None:
    """Tab-separated `word, percentile, expr_index`, files and lines in order of insertion."""
    rows = dictionary.repartitionByRange(F.col("ordinal")).sortWithinPartitions("ordinal").select("word", "percentile", "expr_index")
    rows.write.options(sep="\t", quote="", escape="", header=False, compression=compression, emptyValue="").csv(path)
