"""Tables that a job of several passes reads again, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back: later passes read a table instead of running the plan again, also after lost executors.

    Where the setting is unset (as in tests) the session's warehouse folder takes its place.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
