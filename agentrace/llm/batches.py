"""Arrow batches in small slices, so that a task holds few texts at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
SLICE_ROWS = 2000


def slices(
    batch: pa.RecordBatch, size_of: str | None = None, most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about ``most`` bytes of column ``size_of``, one row at least."""
    if not batch.num_rows:
        return
    if size_of is None:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_numpy()
    at = size = 0
    for i, n in enumerate(lengths):
        if i > at and (size + n > most or i - at >= SLICE_ROWS):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += int(n)
    yield batch.slice(at)


def map_slices(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict],
    schema: T.StructType,
    size_of: str | None = None,
    after: Callable[[], None] | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` with ``fn`` applied to slices; it returns a dict of columns by name.

    ``after`` is called when a task's input has ended: workers outlive their tasks, and so would
    what they hold; memory that a task has freed goes back to the system then.
    """
    arrow = to_arrow_schema(schema)

    def run(batches):
        try:
            for batch in batches:
                for part in slices(batch, size_of, most):
                    columns = fn(part)
                    yield pa.RecordBatch.from_arrays(
                        [_array(columns[f.name], f.type) for f in arrow], schema=arrow
                    )
        finally:
            if after:
                after()
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of this process to the system, where it has a way to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def fields(df: DataFrame, *names: str, **more: str) -> T.StructType:
    """The fields ``names`` of a DataFrame, then new ones given as name=type."""
    own = [T.StructField(n, df.schema[n].dataType, df.schema[n].nullable) for n in names]
    new = [T.StructField(n, T._parse_datatype_string(t), True) for n, t in more.items()]
    return T.StructType(own + new)
