"""Small helpers shared by the text operators."""

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbor.sources.scratch import materialize

ROW = "__harbor_row"
GIVEN_HERE = {"harbor": "row number"}  # marks the column, so that one of a table's own is told from it


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def has_rows(df: DataFrame) -> bool:
    """Whether the rows have numbers. A table with a column of its own under that name is refused."""
    if ROW not in df.columns:
        return False
    if df.schema[ROW].metadata != GIVEN_HERE:
        raise ValueError(f"the table has a column {ROW} of its own")
    return True


def with_row(df: DataFrame) -> DataFrame:
    """Number the rows, within one pass."""
    return df if has_rows(df) else df.withColumn(ROW, F.monotonically_increasing_id().alias(ROW, metadata=GIVEN_HERE))


def numbered(df: DataFrame) -> DataFrame:
    """The rows written once with their numbers, so that every pass gives a row the same number.

    A second scan of the same files may cut them elsewhere and number the rows anew.
    """
    return df if has_rows(df) else materialize(with_row(df), "numbered")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where the table has such a column."""
    while name in df.columns:
        name += "_"
    return name


SLICE_BYTES = 1_000_000  # text that is worked on at once


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together, at least one text each. No text is copied."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = min(len(ends), int(np.searchsorted(ends, before + size)) + 1)
        yield begin, end
        begin = end


@cache
def _trim() -> Callable[[int], int] | None:
    """What makes the C library return freed memory, where it can."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


_kept: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Name what a worker keeps between tasks of an operator, and what lets go of it."""
    _kept[owner] = forget


def _work_for(owner: str) -> None:
    """A worker that turns to another operator lets go of what it kept for others."""
    if _owner != [owner]:
        _owner[:] = [owner]
        for other, forget in _kept.items():
            if other != owner:
                forget()


def trimmed(batches: Iterator[pa.RecordBatch], owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches of an operator; after each of them the worker returns the memory that it has freed."""
    _work_for(owner)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)
