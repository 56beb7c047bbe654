"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.storage import shared_dir

__all__ = ["clear", "fresh", "shared_dir", "written"]

_made: list[str] = []


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a new Parquet table in the shared folder, read again: its lineage
    ends there, and a lost executor costs no more than the stage it was in."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what written() has made in this process. Results that were not written
    or collected yet read these tables, so it is for the caller to say when they are done with."""
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
