"""What the operators share: cutting lineage, input sizes, numbering rows, reading batches of bytes."""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without one, with a local master, a folder beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_checkpoints(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name beside the checkpoints."""
    return f"{_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tidy() -> None:
    """Gives memory that is free again back to the system; Python workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    Rolling.forget()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidied(of: Callable) -> Callable:
    """A function of an iterator of batches, or of one group's table, with `tidy` at the end of the task or of a large group."""

    def batches(x: Iterator) -> Iterator:
        try:
            yield from of(x)
        finally:
            tidy()

    def group(x: pa.Table) -> pa.Table:
        out = of(x)
        if x.nbytes > 1 << 20:
            tidy()
        return out

    return batches if inspect.isgeneratorfunction(of) else group


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def dealt(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place that occurs, with the positions where it does."""
    by = np.argsort(place, kind="stable")
    edge = np.flatnonzero(np.diff(place[by], prepend=-1, append=-1)) if len(by) else by
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        yield int(place[by[i]]), by[i:j]


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; rows times 4 KB where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else df.count() * 4096


def pieces(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """So many groups that each gets about bytes_each of the input."""
    return max(least, -(-input_bytes(df) // bytes_each))


def numbered(df: DataFrame, group: list[str], order: list, name: str, parts: int) -> DataFrame:
    """Adds `name`: a gapless number from 0 within `group`.

    Rows are numbered in (group, part) windows, part being a hash of the order columns, and each
    part begins where the parts before it end: no window holds a whole group, however hot.
    """
    key = [*group, "_part"]
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    begin = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in key], begin.alias("_begin"))
    numbers = df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    joined = numbers.join(starts, on, "left")
    return joined.withColumn(name, F.col("_begin") + F.col("_row") - 1).drop(*[f"_{c}" for c in key], "_part", "_begin", "_row")


#: Rows of a window of running sums.
STEP = 256


def running(sizes: DataFrame, at: str, n: str, name: str) -> DataFrame:
    """(at, name): the sum of n over all smaller numbers at, each of which stands once; windows hold STEP numbers at most, level by level."""
    # Names of its own, since the next level's numbers are this one's chunks.
    sizes = sizes.select(F.col(at).alias("_at"), F.col(n).alias("_n"))
    before = lambda w: F.sum("_n").over(w) - F.col("_n")
    if (sizes.agg(F.max("_at")).first()[0] or 0) < STEP:
        return sizes.select(F.col("_at").alias(at), before(Window.orderBy("_at")).alias(name))
    sizes = sizes.withColumn("_chunk", F.floor(F.col("_at") / STEP).cast("long"))
    outer = running(cut(sizes.groupBy("_chunk").agg(F.sum("_n").alias("_n"))), "_chunk", "_n", "_outer")
    inner = sizes.select("_chunk", "_at", before(Window.partitionBy("_chunk").orderBy("_at")).alias("_inner"))
    return inner.join(outer, "_chunk").select(F.col("_at").alias(at), (F.col("_inner") + F.col("_outer")).alias(name))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in one array, and the n + 1 offsets of its values; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of one binary column; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.concatenate([[0], _lengths(batch.column(column))]))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, size[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def with_column(docs: DataFrame, text: str, name: str, kind: str, of: Callable[[pa.Array], np.ndarray], most: int) -> DataFrame:
    """The table with one more column, which `of` makes from the texts, a slice of about `most` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, most):
            column = part.column(text).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of(column))], names=[*part.schema.names, name])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(name, _parse_datatype_string(kind))]))


#: splitmix64's fixed values.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, by element."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any ranges of a byte array, from its prefix sums."""

    BASE = 0x5851F42D4C957F2D
    _powers: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._powers is None or len(cls._powers[0]) < n:
            cls._powers = tuple(
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(((n >> 18) + 1) << 18, p, np.uint64)]))
                for p in (np.uint64(cls.BASE), np.uint64(pow(cls.BASE, -1, 1 << 64)))
            )
        return cls._powers

    @classmethod
    def forget(cls) -> None:
        cls._powers = None

    def __init__(self, data: np.ndarray):
        up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])
