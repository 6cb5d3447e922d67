"""Tables that operators write for themselves in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from annolith.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table: it is made once, and a lost executor costs only reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
