"""Arrow-batched columns: run a Python function over whole texts and append what it returns.

The input's other columns pass through untouched, so no join brings decisions back to rows.
An input column that has the name of an appended one is replaced by it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: UTF-8 bytes of text that a function gets at once: bounds its memory whatever a batch holds.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


@lru_cache(maxsize=1)
def trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give memory that is free back to the system: Python workers live on between tasks, side by side with the JVM."""
    pa.default_memory_pool().release_unused()
    if (own := trim()) is not None:
        own(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives free memory back when its task ends."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def tidied_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that gives free memory back after each large one."""

    @wraps(run)
    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > 1 << 20:
            release()
        return out

    return whole


def append(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list[list]]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields`` appended.

    ``make()`` runs once a task and returns a function from a list of texts (None for null) to
    one list of values for each field.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    narrow = df.select(*dict.fromkeys([f.name for f in kept] + [text]))
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(schema)
    own = list(arrow)[len(kept):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for piece in pieces(batch, text):
                made = function(piece.column(text).to_pylist())
                columns = [piece.column(f.name) for f in kept] + [pa.array(v, type=f.type) for v, f in zip(made, own, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return narrow.mapInArrow(tidied(run), schema)
