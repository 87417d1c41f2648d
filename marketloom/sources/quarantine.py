"""Rejected rows as JSON lines, one folder per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import scalars as S


def json_rows(rejected: DataFrame, run_id: str) -> DataFrame:
    """JSON-safe values: non-finite numbers as text, decimals as text, times in ISO form."""
    fields = []
    for field in rejected.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("double", "float"):
            c = F.when(S.finite(c) | c.isNull(), F.to_json(F.struct(c.alias("v")))).otherwise(S.json_safe(c))
            c = F.coalesce(F.get_json_object(c, "$.v"), S.json_safe(F.col(f"`{field.name}`")))
        elif kind == "decimal":
            c = c.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        fields.append(c.alias(field.name))
    return rejected.select(F.lit(run_id).alias("run_id"), F.lit("rejected").alias("status"), *fields)


def write(rejected: DataFrame, path: str, run_id: str, mode: str = "overwrite") -> str:
    """One folder per stream and run; a repeated run replaces its own folder only. Files are compressed, as payloads repeat their field names."""
    target = f"{path.rstrip('/')}/run_id={run_id}"
    json_rows(rejected, run_id).drop("run_id").write.mode(mode).option("ignoreNullFields", "false").option("compression", "gzip").json(target)
    return target


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
