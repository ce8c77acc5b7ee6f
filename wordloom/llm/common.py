"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import brief_shuffles, discard, materialize, reclaim, shared_folder, tidy  # noqa: F401  (operators take them from here)


def map_texts(
    df: DataFrame,
    columns: list[str],
    schema: str,
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
) -> DataFrame:
    """Run a batch function over ``columns`` of ``df`` through Arrow.

    ``make`` is called once in each task; what it returns gets the columns of a batch and
    gives the columns of the output batch. Only ``columns`` reach Python, so other columns
    of ``df``, whatever their names, don't matter.
    """
    out = schema_of(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(function(batch.columns), schema=out)

    return df.select(*columns).mapInArrow(run, schema)


#: Bytes of a batch that a function gets at once, unless a single row has more.
SLICE = 4_000_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where they hold many long texts. After the last one the worker, which goes
    on to other tasks, hands free memory back."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    _hand_back()


def _hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_rows(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch, int], pa.RecordBatch]]) -> DataFrame:
    """Run a batch function over whole rows of ``df``; what it returns has the same columns. It
    gets each batch and the number of ``column`` in it."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches):
            yield function(batch, at)

    return df.mapInArrow(run, df.schema)


def without(df: DataFrame, ids: DataFrame, id_col: str, broadcast_rows: int = 500_000) -> DataFrame:
    """``df`` without the rows of ``ids``. Few ids are broadcast, more are joined by a shuffle."""
    ids = materialize(ids.distinct())
    few = count_rows(ids) <= broadcast_rows
    return df.join(F.broadcast(ids) if few else ids, id_col, "left_anti")


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster shares."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


class Remembered(dict):
    """What ``function`` gives for a key. All is forgotten when keys and values take more than
    ``most`` bytes; keys over LONGEST characters are not remembered."""

    LONGEST = 200

    def __init__(self, function: Callable, most: int):
        super().__init__()
        self.function, self.most, self.size = function, most, 0

    def __missing__(self, key):
        value = self.function(key)
        if not isinstance(key, str) or len(key) <= self.LONGEST:
            self.size += sys.getsizeof(key) + sys.getsizeof(value) + 100
            if self.size > self.most:
                self.clear()
                self.size = 0
            self[key] = value
        return value
