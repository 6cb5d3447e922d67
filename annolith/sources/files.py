"""Readers and writers with checks (SRC; each function names its items)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def csv_table(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """SRC01-03: pinned types; the header must name the schema's columns in order. ``columns`` prunes the scan."""
    header = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns
    header = [h.removeprefix("﻿") for h in header]
    if header != schema.names:
        raise ValueError(f"columns are {header}, not {schema.names}")
    out = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').csv(path)
    return out.select(*columns) if columns else out


def jsonl(spark: SparkSession, path: str, schema: StructType, mode: str = "strict") -> DataFrame:
    """SRC04-06: ``strict`` fails on a bad line, ``collect`` keeps it in ``_corrupt``, ``tolerant`` drops it."""
    if mode == "collect":
        kept = StructType([*schema.fields, StructField(CORRUPT, StringType())])
        return spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(schema).option("mode", {"strict": "FAILFAST", "tolerant": "DROPMALFORMED"}[mode]).json(path)


def blank_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count_if(F.trim("value") == "").alias("blank"), F.count("*").alias("lines"))


def json_records(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """SRC07: a file holds an object, a list, {"annotations": [...]}, or one object a line."""
    whole = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    kind, many = record.simpleString(), f"array<{record.simpleString()}>"
    listed = F.from_json("v", many)
    wrapped = F.from_json("v", f"struct<annotations:{many}>")["annotations"]
    lines = F.filter(F.transform(F.split("v", r"\r?\n"), lambda x: F.from_json(x, kind)), lambda x: x.isNotNull())
    single = F.array(F.from_json("v", kind))
    items = F.when(F.col("v").startswith("["), listed).when(wrapped.isNotNull(), wrapped).when(F.try_parse_json("v").isNotNull(), single).otherwise(lines)
    return whole.select(F.inline(items))


def last_record(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """SRC15: of several records the last one counts."""
    from annolith.operators.tables import latest

    return latest(rows, key, F.col(order))


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SRC14, SRC17: name, stem, bytes and SHA-256 of each file, in the order of the names' lower case."""
    from annolith.operators.tables import numbered

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    rows = files.select(name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return numbered(rows, [F.lower("name"), F.col("name")], "index")


def collection_hash(files: DataFrame) -> DataFrame:
    """SRC17: one hash over the sorted names and hashes of a manifest."""
    from annolith.operators.streams import sequence_hash

    lines = files.select(F.concat_ws(":", "name", "sha256").alias("line"))
    return sequence_hash(lines, [], "line").withColumnRenamed("sha256", "collection")


def publish(rows: DataFrame, path: str, kind: str = "parquet", verify: bool = True, **options: str) -> None:
    """SRC09-11: written beside the target, read again and compared, then renamed; a reader never sees a part."""
    spark = rows.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.format(kind).options(**options).save(aside)
    if verify:
        from annolith.operators.checks import same_rows

        again = spark.read.format(kind).schema(rows.schema).options(**options).load(aside)
        if not same_rows(rows, again):
            raise ValueError("what was written reads back differently")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        raise FileExistsError(path)
    if not fs.rename(hadoop(aside), hadoop(path)):
        raise OSError(f"{path} could not be put in place")


def upsert(registry: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """SRC18: latest entry by name."""
    from annolith.operators.tables import latest

    return latest(registry.unionByName(new), [key], F.col(order))


def markdown(rows: DataFrame, formats: dict[str, str] | None = None, missing: str = "—", most: int = 1000) -> str:
    """SRC19: a report table as text; reports are small, and a larger one is an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many rows for a report table")
    formats = formats or {}
    cell = lambda name, v: missing if v is None else formats.get(name, "{}").format(v)
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *["| " + " | ".join(cell(n, v) for n, v in zip(rows.columns, r, strict=True)) + " |" for r in found]])


def xml_file_count(xml, use: str = "DEFAULT"):
    """SRC12: files of a group in a METS document."""
    return F.expr(f"xpath_int({xml}, \"count(//*[local-name()='fileGrp'][@USE='{use}']/*[local-name()='file'])\")")


def links(html, pattern: str):
    """SRC13: the distinct groups of a pattern in the targets of links."""
    targets = F.regexp_extract_all(html, F.lit(r'<a[^>]*\shref="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(targets, lambda t: F.regexp_extract(t, pattern, 1)), lambda x: x != ""))
