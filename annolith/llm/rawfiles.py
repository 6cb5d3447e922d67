"""Files of raw bytes through Spark's own writer and reader.

``write_raw`` gives each partition files that hold its rows' bytes one after the other, each followed by a given separator;
a file takes a stated number of rows, so its size is bounded by theirs. The text writer passes a string's bytes on as they are, so its committer, retries and any file system that
Spark knows serve binary formats as well. ``read_raw`` gives each file's bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_raw(rows: DataFrame, path: str, separator: str, per_file: int) -> None:
    """rows: one binary column; so many rows go to a file."""
    rows.select(F.col(rows.columns[0]).cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", per_file).text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """path string, content binary: a row for each file that isn't empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content")
