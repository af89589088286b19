"""Cutting of lineage in loops, spreading of small tables, and parts of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder of spark.checkpoint.dir; without one, with a local master, to a folder beside the warehouse."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
    return df.checkpoint(eager=True)


#: Bytes of a task's rows at least, and of a table at most, for `spread` to deal it out.
EACH, LITTLE = 16 << 20, 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt to as many tasks as run at once if they are few by the optimizer's estimate, so that what Python does with each of them isn't left to one task; a larger table stays as it lies."""
    parallel = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(parallel) if size < min(LITTLE, parallel * EACH) else df


def parts(df: DataFrame, rows_each: int) -> int:
    """So many parts that each has about `rows_each` of the rows, and one at least for each task that runs at once.

    The rows are counted: what the optimizer estimates for texts made from keys, or for joins, is far off.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_each))
