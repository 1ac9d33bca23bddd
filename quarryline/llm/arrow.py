"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.session import ship_package

#: Rows of an Arrow batch: texts of any length must fit in a worker together.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a batch function; ``make`` builds it once in each task (for models and caches)."""

    def run(batches):
        step = None
        for batch in batches:
            step = step or make()
            if batch.num_rows:
                yield from step_rows(step, batch)
        step = batch = None
        give_back()

    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers are used again by other stages, idle ones keep what they had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def step_rows(step, batch: pa.RecordBatch):
    """One output batch for each slice of a batch, so that outputs stay small too."""
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield step(batch.slice(at, BATCH_ROWS))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [value or b"" for value in column.to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
