"""Arrow batches cut by bytes, so that a Python worker's memory does not hang on the length of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def cut(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes in ``column`` (one row at least)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            if i > at and total + lengths[i] > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(lengths[i])
        if n > at:
            yield batch.slice(at, n - at)


def release() -> None:
    """Gives freed memory back to the system.  Workers outlive their tasks, and what one keeps another cannot have."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], dict | Iterable[dict]], schema: str, limit: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` of ``fn`` over slices of at most ``limit`` bytes; ``fn`` returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for piece in cut(batches, column, limit):
            out = fn(piece)
            for columns in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, schema)
