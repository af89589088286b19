"""Rows in Arrow batches, a slice of bounded size at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Bytes of the rows that are Python objects at once; a larger row is a slice of its own.
SLICE = 1 << 20
#: Rows of a batch that goes back, about.
OUT = 5_000


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices of `most` bytes at most or one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), most)
        yield from slices(batch.slice(half), most)


def tidy() -> None:
    """Gives memory that is free again back to the system; Python workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def flat_mapped(df: DataFrame, of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that `of` makes of each row, which it gets as one argument for each column.

    Neither a batch as Python objects nor what comes of it is ever held whole, so that a worker's
    memory depends on neither the number of rows nor how many of them lie in a batch.
    """
    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        try:
            for batch in batches:
                for part in slices(batch):
                    rows: list[tuple] = []
                    for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        rows += of(*row)
                        if len(rows) >= OUT:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)
        finally:
            tidy()

    return df.mapInArrow(run, kind)
