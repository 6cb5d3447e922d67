"""What the operators of this subpackage share: the cluster's shared folder, table reads, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a single-machine session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="annolith-")
        spark.sparkContext.setCheckpointDir(base)
    return base


_SCRATCH: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH[-1:]:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write for themselves inside this block are removed when it ends; what they returned must be
    stored by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_path(spark, path)
        released()


def quoted(name: str) -> str:
    """A column's name as it can be selected, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_bound(wanted: int, n: int, margin: float = 4.0) -> int:
    """A 64-bit hash up to which about ``margin`` times the wanted number of n rows lie (all, if n is small)."""
    share = min(1.0, margin * wanted / max(n, 1))
    return min((1 << 63) - 1, -(1 << 63) + int(share * 2**64))


#: Bytes of rows that reach a Python worker at once inside ``small_batches``; a longer row comes alone.
BATCH_BYTES = 4 << 20


def set_small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on jobs of this session hand long texts to Python in small batches: for rows that are returned and made later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs that start in this block hand long texts to Python in small batches; the session's own setting returns after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of stretches one after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def stretches(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold so many bytes of text at most; a longer text is a range of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def released(collect: bool = True) -> None:
    """Gives free memory of this process back to the system."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns p0, p1, ... and each old name's new one: no name can then clash or need quoting."""
    names = {name: f"p{i}" for i, name in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"p{i}" for i in range(len(df.columns))]), names


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Run) -> Run:
    """A task that gives its memory back when it ends: Spark keeps Python workers for other tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return task


def arrow_map(df: DataFrame, run: Run, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` of a frame whose columns may have any names, dots included."""
    names = df.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return positional(df)[0].mapInArrow(tidied(task), schema)
