"""Frozen tables: made once, then reused or compared (SRC14, SMP23)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.operators.checks import same_rows
from annolith.operators.tables import numbered

from .files import publish


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and put there in one step if there is none. Of two that make it at once, one wins and the other
    reads the winner's."""
    if not exists(spark, path):
        try:
            publish(make(), path)
        except FileExistsError:
            pass
    return spark.read.parquet(path)


def frozen(rows: DataFrame, path: str) -> DataFrame:
    """SMP23: the snapshot at path, which must equal rows (as a bag, in schema too); without one, rows become it."""
    spark = rows.sparkSession
    kept = once(spark, path, lambda: rows)
    names = lambda frame: [(f.name, f.dataType) for f in frame.schema]
    if names(kept) != names(rows) or not same_rows(kept, rows):
        raise ValueError(f"the snapshot {path} differs from what is asked for")
    return kept


def certified_first(items: DataFrame, order: list[Column | str], n: int, certificates: DataFrame, key: str, done: Column, path: str) -> DataFrame:
    """SMP23: the first n items in an order, all of which need a certificate (a row by key for which ``done`` holds), frozen at
    path. Missing certificates are an error that names some of them; so is a snapshot that differs."""
    first = numbered(items, order).where(F.col("position") < n)
    missing = first.join(certificates.where(done).select(key), key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise ValueError(f"without a certificate: {[r[0] for r in missing]}")
    return frozen(first, path)


def folder_manifest(spark: SparkSession, folder: str, path: str, pattern: str = "*") -> DataFrame:
    """SRC14: index, name, stem, year, bytes, folder of the files, in the order of the names' lower case; frozen at path.

    A manifest that is there is taken without another look at the folder, so later files move nothing; one of another folder,
    two files of one stem, and no files at all are errors. Empty files are not listed.
    """

    def make() -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)  # names and lengths: no file is opened
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        rows = files.select(name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.col("length").alias("bytes"))
        twice = rows.groupBy("stem").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"several files have the stem {twice[0]['stem']}")
        if rows.isEmpty():
            raise ValueError(f"no files in {folder}")
        year = F.try_to_number(F.nullif(F.regexp_extract("stem", r"^(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")
        placed = numbered(rows, [F.lower("name"), F.col("name")], "index")
        return placed.select("index", "name", "stem", year.alias("year"), "bytes", F.lit(folder.rstrip("/")).alias("folder"))

    kept = once(spark, path, make)
    other = kept.where(F.col("folder") != folder.rstrip("/")).limit(1).collect()
    if other:
        raise ValueError(f"the manifest is of {other[0]['folder']}, not of {folder}")
    return kept
