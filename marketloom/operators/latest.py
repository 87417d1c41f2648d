"""One record per key: latest version, latest snapshot, first metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_KEY = ["order_id", "platform", "source_line_id"]


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key under ``order``.

    The rank filter is pushed below the shuffle (a group limit per map task), so a key that owns
    a large share of the rows still sends at most one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def deduplicate_lines(
    df: DataFrame,
    keys: list[str] | None = None,
    version: str = "source_updated_at",
    ties: list[str] | None = None,
) -> DataFrame:
    """Latest version per order line. Rows with an incomplete key are kept for validation, all of them.

    One aggregate over one read: each map task sends one row for each key it saw, so a line that was replayed a million times is no hot key.
    A row with an incomplete key is a key of its own by two hashes of its columns; equal ones come back as often as they were read.
    """
    keys = keys or [k for k in LINE_KEY if k in df.columns]
    ties = ties if ties is not None else [c for c in ("source_object", "source_row") if c in df.columns]
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hashed = [F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    own = F.when(~complete, F.struct(F.xxhash64(*hashed), F.hash(*hashed)))
    # Nulls are the least in structs, so the greatest one has the latest version, null versions last. The key is sent once, beside the row.
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys]), F.struct(version, *ties)).alias("_row")
    kept = df.withColumn("_own", own).groupBy(*keys, "_own").agg(newest, F.count(F.lit(1)).alias("_copies"))
    copies = F.when(F.col("_own").isNull(), F.array("_row")).otherwise(F.array_repeat("_row", F.col("_copies").cast("int")))
    return kept.select(*keys, F.inline(copies)).select(*[F.col(f"`{c}`") for c in df.columns])


def first_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Metadata of the first row per key, combined map-side."""
    payload = F.struct(*[F.col(c) for c in columns])
    picked = df.groupBy(*keys).agg(F.min_by(payload, F.struct(*order)).alias("_m"))
    return picked.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in columns])
