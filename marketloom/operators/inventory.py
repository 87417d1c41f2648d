"""Stock levels, reorder evaluation, alerts and the stock ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators.demand import recent_totals
from marketloom.operators.latest import latest_by
from marketloom.operators.prefix import running_total

# Effect of a movement type on stock.
MOVEMENT_SIGN = {
    "OUTBOUND_SALE": -1, "INBOUND_RESTOCK": 1, "RETURN_RESTOCK": 1, "CANCEL_RELEASE": 1, "OUT_OF_STOCK_REJECT": 0,
}


def daily_snapshots(snapshots: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Latest snapshot per SKU and business day."""
    order = [F.col("snapshot_at").desc()] + [F.col(t).desc() for t in ties or []]
    return latest_by(snapshots, ["sku", "snapshot_date"], order)


def latest_stock(daily: DataFrame) -> DataFrame:
    """Current stock per SKU: the snapshot of its last audited day, combined map-side."""
    return daily.groupBy("sku").agg(
        F.max_by("stock_on_hand", "snapshot_date").alias("current_stock"), F.max("snapshot_date").alias("last_audited_date"))


def latest_stock_ranked(daily: DataFrame) -> DataFrame:
    """The same by row number; the rank limit runs before the shuffle."""
    return latest_by(daily, ["sku"], [F.col("snapshot_date").desc()]).select(
        "sku", F.col("stock_on_hand").alias("current_stock"), F.col("snapshot_date").alias("last_audited_date"))


def health(stock: DataFrame, segments: DataFrame) -> DataFrame:
    """Inventory health of every SKU that has both stock and a segment, SQL policy."""
    joined = stock.join(segments, "sku")
    current, mean = F.col("current_stock"), F.col("mean_demand_exact")
    safety, point = F.col("safety_stock"), F.col("reorder_point")
    return joined.select(
        "sku", "product_name", "category", "matrix_segment", "current_stock", mean.alias("avg_daily_demand"),
        safety, point, S.alert_level(current, safety, point).alias("alert_level"),
        (current <= point).alias("needs_reorder"), S.days_to_stockout(current, mean).alias("days_until_stockout"),
        S.recommended_quantity(current, point, mean).alias("recommended_reorder_qty"), "last_audited_date")


def demand_source(history: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """Mean and deviation used by the policy: model forecast mean first, else recent history.

    ``history``: sku, hist_mean, hist_std. ``forecasts``: sku, forecast_mean.
    """
    joined = history
    if forecasts is None:
        joined = joined.withColumn("forecast_mean", F.lit(None).cast("double"))
    else:
        joined = joined.join(forecasts, "sku", "left")
    return joined.select(
        "sku", F.coalesce("forecast_mean", "hist_mean").alias("avg_demand"), F.col("hist_std").alias("sigma"),
        F.when(F.col("forecast_mean").isNotNull(), "model_forecast").otherwise("warehouse_history").alias("demand_source"))


def recent_demand(lines: DataFrame, days: int = 28, forecast_days: int = 7) -> DataFrame:
    """Per SKU from order lines: hist_mean and hist_std (sample deviation) of the latest ``days`` days, unsold ones included, and
    forecast_mean, the mean of the ``forecast_days`` days before the last one, null without any demand in them."""
    sums = recent_totals(lines, {"h": (0, days - 1), "f": (1, forecast_days)})
    mean, std = S.statistics_from_sums(F.col("h_days"), F.col("h_sum"), F.col("h_squares"))
    return sums.select("sku", mean.alias("hist_mean"), std.alias("hist_std"), F.when(F.col("f_sum") > 0, F.col("f_sum") / F.col("f_days")).alias("forecast_mean"))


def stock_source(skus: DataFrame, snapshots: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Requested stock first, then the latest snapshot; the source is labelled."""
    out = skus.join(snapshots.select("sku", F.col("current_stock").alias("_snap"), F.col("last_audited_date").alias("_at")), "sku", "left")
    if requested is not None:
        out = out.join(requested.select("sku", F.col("current_stock").alias("_asked")), "sku", "left")
    else:
        out = out.withColumn("_asked", F.lit(None).cast("int"))
    label = (
        F.when(F.col("_asked").isNotNull(), "request")
        .when(F.col("_snap").isNotNull(), F.concat(F.lit("warehouse_snapshot:"), F.col("_at").cast("string")))
        .otherwise("none"))
    return out.select("*", F.coalesce("_asked", "_snap").alias("current_stock"), label.alias("stock_source")).drop("_snap", "_at", "_asked")


def reorder_evaluation(demand: DataFrame, stock: DataFrame, lead_time: Column | int = 3, service_level: Column | float = 0.95) -> DataFrame:
    """Full reorder evaluation of all SKUs in one job, API policy.

    ``demand``: sku, avg_demand, sigma, demand_source. ``stock``: sku, current_stock, stock_source.
    """
    lead = lead_time if isinstance(lead_time, Column) else F.lit(float(lead_time))
    level = service_level if isinstance(service_level, Column) else F.lit(float(service_level))
    rows = demand.join(stock, "sku")
    safety = S.safety_stock(F.col("sigma"), S.z_for_service(level), lead)
    rows = rows.withColumn("safety_stock", safety)
    rows = rows.withColumn("reorder_point", S.reorder_point(F.col("avg_demand"), F.col("safety_stock"), lead))
    current, point = F.col("current_stock"), F.col("reorder_point")
    return rows.select(
        "sku", "current_stock", F.round("avg_demand", 1).alias("avg_daily_demand"), "safety_stock", "reorder_point",
        (current <= point).alias("needs_reorder"), S.alert_level(current, F.col("safety_stock"), point, "NO_DATA").alias("alert_level"),
        S.days_to_stockout(current, F.col("avg_demand"), "api").alias("days_until_stockout"),
        S.recommended_quantity(current, point, F.col("avg_demand")).alias("recommended_reorder_qty"), "stock_source", "demand_source")


def alert_order() -> list[Column]:
    level = F.when(F.col("alert_level") == "CRITICAL", 1).when(F.col("alert_level") == "WARNING", 2).otherwise(3)
    return [level.asc(), F.col("days_until_stockout").asc_nulls_last(), F.col("sku").asc()]


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts by level, total stock and total reorder quantity, one row."""
    level = F.col("alert_level")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_skus"), F.count_if(level.isin("CRITICAL", "WARNING")).alias("skus_needing_reorder"),
        F.count_if(level == "CRITICAL").alias("critical_count"), F.count_if(level == "WARNING").alias("warning_count"),
        F.count_if(level == "NORMAL").alias("normal_count"), F.sum("current_stock").cast("long").alias("total_stock"),
        F.sum("recommended_reorder_qty").cast("long").alias("total_reorder_qty"))


def stock_ledger(movements: DataFrame) -> DataFrame:
    """Running balance per SKU from signed movements, with the balance before each movement.

    A busy SKU can own a large share of the movements, so the running sum goes over range slices
    of (SKU, time, id): the busy SKU is spread over several slices.
    """
    sign = F.lit(0)
    for name, s in MOVEMENT_SIGN.items():
        sign = F.when(F.col("movement_type") == name, s).otherwise(sign)
    signed = movements.withColumn("delta", sign * F.col("quantity"))
    out = running_total(signed, ["sku"], [F.col("moved_at"), F.col("movement_id")], {"stock_after": "delta"}, few_groups=False)
    return out.withColumn("stock_before", F.col("stock_after") - F.col("delta"))
