"""What the engine keeps between steps: tables in the folder that the cluster shares."""

from __future__ import annotations

import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a folder of our own is set, on a
    local master only: on a cluster each machine would have another one."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
            folder = f"/tmp/wordloom-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get().rstrip("/")


#: Folders made by `materialize` within each `tidy` operator that runs.
_made: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it again: lineage is cut and executors may be lost. Unlike
    a checkpoint of an RDD it keeps columns compressed and gives the planner a true size."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if _made:
        _made[-1].append(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._table_folder = folder
    return out


def discard(table: DataFrame) -> None:
    """Delete a table made by `materialize` that nothing reads any more."""
    _delete(table.sparkSession, table._table_folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Have the files of shuffles deleted whose results are tables by now. Spark deletes them once the
    driver has collected the plans that wrote them, which by itself it may do long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of an action's shuffles are deleted as it ends, by Spark itself; no plan has to
    be collected first. For operators each of whose steps ends in a table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


#: Most rows that a join sends to each executor.
SENT_ROWS = 50_000


def sized(rows: DataFrame) -> DataFrame:
    """A table to join with, and how: few rows are sent to each executor, more are dealt by key. Left
    to itself Spark goes by the size of compressed files, knows nothing of what `explode` adds, and may
    gather millions of rows in the driver."""
    return rows.hint("broadcast" if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else "merge")


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, with its result written as a table and all tables that it made on the way
    deleted. A failed run's tables are deleted too."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        _made.append([])
        out = None
        try:
            out = materialize(operator(*args, **options))
        finally:
            kept = out._table_folder if out is not None else None
            spark = SparkSession.getActiveSession()
            for folder in _made.pop():
                if folder == kept:
                    if _made:
                        _made[-1].append(folder)
                elif spark is not None:
                    _delete(spark, folder)
        return out

    return run


_kept: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], sources: tuple[str, ...] = ()) -> DataFrame:
    """The table that ``build`` gives, made once in an application and read from then on, as long as
    the files at ``sources`` stay as they are."""
    key = (spark.sparkContext.applicationId, *key, *(_state(spark, x) for x in sources))
    if key not in _kept:
        _kept[key] = materialize(build())
    return _kept[key]


def _state(spark: SparkSession, source: str) -> tuple:
    """Names, sizes and times of the files at a path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    out = []
    for status in found or ():
        inner = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in inner]
    return tuple(sorted(out))


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the row's place, from 0, in a total order. Rows are dealt into ranges, numbered in
    each, and moved on by the sizes of the ranges before, so no task sees all rows."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return parts.join(F.broadcast(sizes), "_range").withColumn(name, place.cast("bigint")).drop("_range", "_before")
