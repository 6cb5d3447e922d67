"""The ledger as a stream (STR01-04).

A lateness of ten minutes is a choice of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LATENESS = "10 minutes"


def ledger_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8, pattern: str = "*.parquet") -> DataFrame:
    """STR01, STR02: files that appear in a folder, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need timestamps with a zone; times without one are UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def done_once(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """STR01: each key once, within the lateness."""
    return _timed(stream, ts).withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([key])


def window_rates(stream: DataFrame, ts: str, length: str, by: list[str], value: str, slide: str | None = None) -> DataFrame:
    """STR03, WIN09: counts and sums over tumbling or sliding windows."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = _timed(stream, ts).withWatermark(ts, LATENESS).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def quiet_sessions(stream: DataFrame, ts: str, quiet: str, by: list[str]) -> DataFrame:
    """WIN12: episodes that a quiet stretch ends."""
    out = _timed(stream, ts).withWatermark(ts, LATENESS).groupBy(F.session_window(ts, quiet).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def latest_status(stream: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """STR04: the last row of each key so far."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), ts).alias("last"), F.max(ts).alias("at")).select(key, "last.*", "at")


def run_available(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what is there and ends; a second run with the same checkpoint takes only what is new."""
    query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def collect_available(frame: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """The result of what is there as a table of this session (for results that are small by nature, as monitors)."""
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
