"""Exact places of records in files that are read in splits (SRC03-06, SRC15, SRC21; each function names its items).

A split begins at a byte of a file, which Spark tells, and a task reads its splits one after the other. So a record's place in
its file is its place in the split and the number of records in the file's earlier splits: the splits' counts are one small
aggregate, and no row is sorted or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACE = ["_file", "_start", "_id"]


def placed(rows: DataFrame) -> DataFrame:
    """A file scan's rows with the file, the split's first byte and an id that grows within a split. It must be put on the
    scan itself: what comes later may not keep the order."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))


def numbered(rows: DataFrame, name: str, first: int = 1) -> DataFrame:
    """placed rows with their number in their file, the file's first record having ``first``, and ``file`` (its path)."""
    splits = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("_n")
    begins = splits.select("_file", "_start", (F.lit(first) + earlier - F.col("_first")).alias("_shift"))
    own = [c for c in rows.columns if c not in PLACE]
    return rows.join(begins, ["_file", "_start"]).select(*own, F.col("_file").alias("file"), (F.col("_id") + F.col("_shift")).alias(name))


def csv_records(spark: SparkSession, path: str, schema: StructType, quoted_lines: bool = False) -> DataFrame:
    """SRC03: rows with file and source_row, as the file numbers them: the header is row 1, so the first record has 2.

    The header of every file must name the schema's columns in order; a byte order mark before it is no part of a name.
    Empty lines are no records. quoted_lines: cells may hold line breaks; a file is then read as one split.
    """
    heads = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")).where("start = 0")
    first = heads.groupBy("file").agg(F.min_by("value", "id").alias("head"))
    cells = F.transform(parsed_line(F.regexp_replace("head", "^﻿", "")), lambda x: x)
    wrong = first.select("file", cells.alias("names")).where(F.col("names") != F.array(*map(F.lit, schema.names))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['file']} has the columns {wrong[0]['names']}, not {schema.names}")
    scan = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", quoted_lines).csv(path)
    return numbered(placed(scan), "source_row", 2)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC04, SRC05: file, line (from 1), record (null if there is none), problem: null, ``blank``, ``not JSON`` or ``not an
    object``, and value, the line itself."""
    lines = numbered(placed(spark.read.text(path)), "line")
    parsed = F.try_parse_json("value")
    blank, known = F.trim(F.regexp_replace("value", r"\s+", " ")) == "", F.schema_of_variant(parsed).startswith("OBJECT")
    problem = F.when(blank, "blank").when(parsed.isNull(), "not JSON").when(~known, "not an object")
    made = lines.withColumn("problem", problem)
    return made.select("file", "line", F.when(F.col("problem").isNull(), F.from_json("value", schema)).alias("record"), "problem", "value")


def strict(lines: DataFrame) -> DataFrame:
    """SRC05: json_lines' records, with file and line; the first problem that a task meets stops the job and names its place."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("problem"))
    checked = lines.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(place).cast("string")))
    return checked.where(F.col("problem").isNull()).select("file", "line", "record.*")


def complete(lines: DataFrame) -> DataFrame:
    """SRC06: json_lines' records without a last line that was cut off while it was written; a problem on any other line, but
    for blank ones, stops the job."""
    last = lines.groupBy("file").agg(F.max("line").alias("_last"))
    torn = (F.col("problem") == "not JSON") & (F.col("line") == F.col("_last"))
    place = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("problem"))
    bad = F.coalesce((F.col("problem") != "blank") & ~torn, F.lit(False))
    whole = F.when(bad, F.raise_error(place).cast("boolean")).otherwise(F.col("problem").isNull())
    return lines.join(last, "file").where(whole).select("file", "line", "record.*")


def report(lines: DataFrame) -> DataFrame:
    """SRC04: for each file: records, blank lines, and the number of lines with another problem."""
    bad = F.col("problem").isNotNull() & (F.col("problem") != "blank")
    return lines.groupBy("file").agg(F.count_if(F.col("problem").isNull()).alias("records"), F.count_if(F.col("problem") == "blank").alias("blank"), F.count_if(bad).alias("errors"))


# ---- one line's cells


def escaped_cell(value: Column) -> Column:
    """SRC21: a cell as CSV text: quoted if it holds a comma, a quote or a line feed, with quotes doubled; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    """SRC21: cells as one line of CSV text."""
    return F.concat_ws(",", *map(escaped_cell, values))


def parsed_line(line: Column) -> Column:
    """SRC21: the cells of a line of CSV text, an array of strings. A quote opens or closes a quoted part anywhere in a cell,
    two quotes are one wherever they stand (so a quoted cell of quotes alone reads back with one more), and a comma in a quoted
    part is text; an unclosed part ends with the line."""
    # pieces between commas; a piece that begins inside a quoted part belongs to the cell before it. Quotes decide which: after
    # an odd number of them a part is open, doubled ones keep it even
    pieces = F.split(line, ",", -1)
    quotes = lambda x: F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))
    start = F.struct(F.array().cast("array<string>").alias("cells"), F.lit(False).alias("open"))

    def add(state: Column, piece: Column) -> Column:
        n = F.size(state["cells"])
        longer = F.concat(F.slice(state["cells"], 1, n - 1), F.array(F.concat(F.get(state["cells"], n - 1), F.lit(","), piece)))
        cells = F.when(state["open"], longer).otherwise(F.concat(state["cells"], F.array(piece)))
        return F.struct(cells.alias("cells"), (state["open"] != (quotes(piece) % 2 == 1)).alias("open"))

    cells = F.aggregate(pieces, start, add)["cells"]
    # a doubled quote is kept, a single one goes
    return F.transform(cells, lambda x: F.replace(F.replace(F.replace(x, F.lit('""'), F.lit("\x00")), F.lit('"'), F.lit("")), F.lit("\x00"), F.lit('"')))


# ---- sources


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), F.lit("-"))


def discovered(spark: SparkSession, folder: str, record: StructType, item: str, assignment: str | None = None) -> DataFrame:
    """SRC15: every record of a folder's .json and .jsonl files: source_id, label, item, place, record.

    A .json file (an object, a list, or {"annotations": [...]}) takes the place of a .jsonl file of the same stem. Of a source's
    records of one item the last counts, by place in the file. A source is a file, or each assignment of a file. Lines and files
    that are no JSON, and records without an item, go.
    """
    kind = record.simpleString()
    name = F.url_decode(F.replace(F.regexp_extract("file", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))  # file paths come encoded
    many = numbered(placed(spark.read.option("pathGlobFilter", "*.jsonl").text(folder)), "place")
    many = many.select("file", "place", F.from_json("value", record).alias("record")).withColumn("stem", F.regexp_replace(name, r"\.jsonl$", ""))
    whole = spark.read.option("pathGlobFilter", "*.json").option("wholetext", True).text(folder).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    wrapped = F.from_json("v", f"struct<annotations:array<{kind}>>")["annotations"]
    single = F.array(F.from_json("v", record))
    items = F.when(F.col("v").startswith("["), F.from_json("v", f"array<{kind}>")).when(wrapped.isNotNull(), wrapped).when(F.try_parse_json("v").isNotNull(), single)
    one = whole.select("file", F.posexplode(items).alias("place", "record")).withColumn("place", F.col("place").cast("bigint") + 1).withColumn("stem", F.regexp_replace(name, r"\.json$", ""))
    stems = whole.select(F.regexp_replace(name, r"\.json$", "").alias("stem")).distinct()
    rows = one.select("stem", "place", "record").unionByName(many.join(stems, "stem", "left_anti").select("stem", "place", "record"))
    rows = rows.where(F.col(f"record.{item}").isNotNull())
    source, label = slug(F.col("stem")), F.col("stem")
    if assignment:
        given = F.coalesce(F.col(f"record.{assignment}").cast("string"), F.lit("export"))
        source, label = F.concat(source, F.lit(":"), slug(given)), F.concat(label, F.lit(" / "), given)
    rows = rows.select(source.alias("source_id"), label.alias("label"), F.col(f"record.{item}").alias("item"), "place", "record")
    return rows.groupBy("source_id", "item").agg(F.max_by(F.struct("label", "place", "record"), "place").alias("_last")).select("source_id", "_last.label", "item", "_last.place", "_last.record")
