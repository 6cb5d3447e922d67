"""Stages that work in micro-batches side by side, each batch written once (STR02).

A stage reads what the one before has published, a bounded number of files a batch, while that one goes on with its next
batch. A batch is written aside and renamed into place under its number, so readers see all of it or nothing; after a failure
the same batch has the same number, and one that is there already is not written again. Tasks that succeeded before are left
out by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass
class Stage:
    """name; work: a batch's rows to result rows with the columns of schema, among them ``key`` and the boolean ``ok``."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    schema: StructType


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_batch(rows: DataFrame, folder: str, number: int) -> bool:
    """Publishes a batch under its number; False if it is there already."""
    spark = rows.sparkSession
    target = f"{folder}/batch={number}"
    fs, where = _fs(spark, target)
    if fs.exists(where):
        return False
    aside = f"{folder}/_aside-{uuid.uuid4().hex}"  # such names are hidden from readers
    rows.write.parquet(aside)
    if not fs.rename(_fs(spark, aside)[1], where):
        raise OSError(f"{target} could not be put in place")
    return True


def done_keys(spark: SparkSession, folder: str, schema: StructType, key: str, before: int) -> DataFrame:
    """Keys that succeeded in batches with a lower number."""
    batches = f"{folder}/batch=*"
    fs, where = _fs(spark, batches)
    if not fs.globStatus(where):
        return spark.createDataFrame([], schema).select(key)
    rows = spark.read.schema(schema).option("basePath", folder).parquet(batches)
    return rows.where((F.col("batch") < before) & F.col("ok")).select(key).distinct()


def start_stage(source: DataFrame, stage: Stage, folder: str, checkpoint: str, key: str, available_only: bool = True) -> StreamingQuery:
    """Starts a stage over a stream of rows with a key: results go to <folder>/<stage>/batch=<n>."""
    spark = source.sparkSession
    target = f"{folder}/{stage.name}"

    def one(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key]).join(done_keys(batch.sparkSession, target, stage.schema, key, number), key, "left_anti")
        put_batch(stage.work(fresh).select(*stage.schema.names), target, number)

    fs, where = _fs(spark, target)
    fs.mkdirs(where)  # the next stage's stream needs a folder to look at
    query = source.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/{stage.name}").queryName(f"{stage.name}-{uuid.uuid4().hex[:8]}")
    return (query.trigger(availableNow=True) if available_only else query.trigger(processingTime="1 second")).start()


def published(spark: SparkSession, stage: Stage, folder: str, files_per_batch: int) -> DataFrame:
    """A stage's results as a stream, a bounded number of files in each batch; only what succeeded goes on."""
    stream = spark.readStream.schema(stage.schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(f"{folder}/{stage.name}")
    return stream.where("ok")


def run_mixed(source: DataFrame, stages: list[Stage], folder: str, checkpoint: str, key: str, files_per_batch: int = 1, rounds: int = 100) -> list[int]:
    """Runs stages side by side until none has anything left; gives each stage's number of batches.

    In a round all stages are in flight at once, each over what was there when it began; what a stage publishes meanwhile is
    the next one's work in the next round. A failure in one stage lets the others end their round and is then raised; running
    it again goes on from the checkpoints.
    """
    spark = source.sparkSession

    def counts() -> list[int]:
        return [len(_fs(spark, f"{folder}/{s.name}")[0].globStatus(_fs(spark, f"{folder}/{s.name}/batch=*")[1]) or []) for s in stages]

    before = None
    for _ in range(rounds):
        streams = [source] + [None] * (len(stages) - 1)
        running = []
        for i, stage in enumerate(stages):
            running.append(start_stage(streams[i] if i == 0 else published(spark, stages[i - 1], folder, files_per_batch), stage, folder, checkpoint, key))
        failed = None
        for query in running:
            try:
                query.awaitTermination()
            except Exception as e:  # noqa: BLE001 - the others end their round first
                failed = failed or e
        if failed:
            raise failed
        if (now := counts()) == before:
            return now
        before = now
    raise RuntimeError("the stages have not come to an end")
