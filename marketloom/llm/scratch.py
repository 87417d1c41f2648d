"""Intermediate tables in the shared folder, dropped as soon as nothing reads them."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from marketloom.session import new_folder


def put(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes a table and continues from its files; also returns its folder for ``drop``."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables written by ``put`` and lets Spark's cleaner remove the shuffle files of frames that are gone."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    # The session holds on to its last query; a tiny one takes that place.
    spark.range(1).collect()
    gc.collect()
    jvm.System.gc()


def free_name(frame: DataFrame, base: str) -> str:
    """A column name that ``frame`` does not have."""
    while base.lower() in (c.lower() for c in frame.columns):
        base += "_"
    return base
