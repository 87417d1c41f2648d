"""Operational monitoring over event tables: ratios, latency quantiles, freshness, loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.prefix import exact_quantiles


def window_ratio(events: DataFrame, ts: str, condition: Column, size: str = "5 minutes", slide: str = "1 minute",
                 threshold: float = 0.10) -> DataFrame:
    """Share of matching events per sliding window, with an alert above the threshold.

    Events are first counted per slide interval, so each event is not copied into every window. Also for a stream with a watermark on
    ``ts``: a window then appears once, when the watermark has passed it.
    """
    per_slide = events.groupBy(F.window(ts, slide).alias("_s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("hits"))
    out = per_slide.groupBy(F.window("_s", size, slide).alias("w")).agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    share = F.col("hits") / F.col("n")
    return out.select(F.col("w.start").alias("window_start"), "n", "hits", F.round(share, 6).alias("share"),
                      (share > threshold).alias("alert"))


def latency_quantiles(events: DataFrame, ts: str, group: str, value: str, size: str = "5 minutes") -> DataFrame:
    """p50, p95 and p99 per group and window, interpolated, and the request rate per second.

    A busy endpoint may own most events of a window, so the quantiles are ranked over range slices.
    """
    seconds = events.sparkSession.sql(f"select cast(interval {size} as interval day to second) as i").select(
        (F.extract(F.lit("DAY"), "i") * 86400 + F.extract(F.lit("HOUR"), "i") * 3600 + F.extract(F.lit("MINUTE"), "i") * 60
         + F.extract(F.lit("SECOND"), "i")).cast("double").alias("s")).scalar()
    keyed = events.select(F.window(ts, size)["start"].alias("window_start"), group, value)
    out = exact_quantiles(keyed, ["window_start", group], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, few_groups=False)
    return out.withColumn("rate", F.col("n") / seconds)


def staleness(history: DataFrame, date_col: str, today: Column, limit_days: int = 7) -> DataFrame:
    row = history.agg(F.max(date_col).alias("last_date"))
    age = F.datediff(today, F.col("last_date"))
    return row.select("last_date", age.alias("age_days"), (age > limit_days).alias("stale"))


def heartbeat(status: DataFrame, at: str, now: Column, limit_seconds: int = 180) -> DataFrame:
    """Latest status row: healthy and younger than the limit."""
    row = status.agg(F.max_by(F.struct("status", at), at).alias("l"))
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(F.col(f"l.{at}")))
    return row.select(F.col("l.status").alias("status"), age.alias("age_seconds"),
                      ((F.col("l.status") == "healthy") & (age < limit_seconds)).alias("ok"))


def loss_percent(produced: Column, consumed: Column) -> Column:
    """Share of produced events that did not arrive, at least zero."""
    return F.when(produced > 0, F.greatest(F.lit(0.0), (produced - consumed) * 100.0 / produced)).otherwise(0.0)
