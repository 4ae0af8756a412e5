"""Attach the columns of a one-row-per-key table to a large table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.defaults import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS
from harbor.sources.scratch import materialize_counted, written_bytes


def attach(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    keep: Column | None = None,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of ``rows`` with the rows of ``table`` that meet ``keep``. Writes ``table``.

    ``table`` has one row per key. What is kept of it is written once and measured:
    up to ``max_broadcast`` rows and ``max_bytes`` at rest it is broadcast, so that
    ``rows`` is not shuffled at all. Beyond that it is a join of two plain tables,
    whose skewed keys the engine splits among tasks, as one side has a row per key.
    """
    kept, number = materialize_counted(table if keep is None else table.filter(keep), "lookup")
    small = number <= max_broadcast and written_bytes(kept) <= max_bytes
    return rows.join(F.broadcast(kept) if small else kept, on)
