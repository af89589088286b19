"""Readers of Parquet tables, whole texts, JSON and CSV with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file; one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_records(spark: SparkSession, path: str, schema: StructType, array: str | None = None) -> DataFrame:
    """Records of JSON files, or the members of one of their arrays; malformed records are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    return rows.select(F.explode(array).alias("_r")).select("_r.*") if array else rows


def csv_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def files_present(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """(path, length) of the files there are; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def release_point_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Release points linked from index pages, each once: identifier, Congress, law, date and titles."""
    from ..functions.text import release_point

    link = r"href=\"[^\"]*usc-rp@([0-9]+-[0-9a-z]+)\.htm\"[^>]*>([^<]*)<"
    found = pages.select(F.explode(F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("id"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("said"))).alias("_l"))
    rows = found.select(F.col("_l.id").alias("full_identifier"), F.col("_l.said").alias("said")).dropDuplicates(["full_identifier"])
    titles = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_extract("said", "(?i)titles?(.*)$", 1), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))))
    date = F.try_to_date(F.regexp_extract("said", "([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "MM/dd/yyyy")
    return rows.select("full_identifier", release_point(F.col("full_identifier")).alias("_p"), date.alias("publication_date"), titles.alias("titles")).select("full_identifier", "_p.*", "publication_date", "titles")
