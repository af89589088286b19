"""A corpus from raw documents to packed sequences, stage by stage.

Null and empty texts are documents without words: no score rejects them, they are near no other text
and hold no repeats, and they are packed as one end id. Null sources are a source of their own; null
keys and repeated rows are documents like others. An empty table gives no rows, and without labels
all texts score alike. Columns beside those of documents stay until packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import shared_folder, table
from palimpsest.llm.mixing import mixed_order
from palimpsest.llm.ngram_join import one_of_each
from palimpsest.llm.packing import pack
from palimpsest.llm.queries import TARGETS
from palimpsest.llm.suffix_dedup import remove_repeats
from palimpsest.llm.toxicity import reject_toxic

#: Bytes of the strings that make up a repeated passage, fewer than fifty words have, and a passage's words.
PASSAGE, WORDS = 220, 50
#: Rows of an Arrow batch: whole texts pass through Python, so that Spark's 10,000 would hold many MB on both sides.
BATCH = 2000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """A stage in a session whose Arrow batches have BATCH rows at most."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.set(rows, str(min(BATCH, int(spark.conf.get(rows)))))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, that with the smallest doc_id."""
    return one_of_each(docs)


@bounded
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that occur more than once go from the texts; n_chars follows, and no document goes."""
    out = remove_repeats(docs, length=PASSAGE, words=WORDS)
    changed = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@bounded
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in an order that gives each source its target share, as long as it lasts."""
    return mixed_order(docs, TARGETS, other=1.0)


@bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences, filled in the order of mixing.

    Parquet doesn't keep the order of rows from file to file, so the documents are put in that order
    again; it follows from the documents alone.
    """
    pieces = pack(mixed_order(docs, TARGETS, other=1.0))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]

#: SQL can't tokenise or train, so run() is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet to the shared folder, and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
