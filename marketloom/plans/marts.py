"""BI marts: executive summary, geography, inventory, forecast against actual, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators.latest import latest_by


def order_key() -> Column:
    """The row value counts orders even when a part is null, unlike a multi-column distinct count."""
    return F.struct("platform", "order_id")


def exact_ratio(total: Column, n: Column) -> Column:
    """Money per unit at two places, decimal all the way."""
    return F.round(total.cast("decimal(26,2)") / F.nullif(n, F.lit(0)).cast("decimal(11,0)"), 2)


def executive_summary(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Daily totals by platform of the lines that were not cancelled."""
    orders = F.count_distinct(order_key())
    # The calendar has one row per day, which bounds the broadcast.
    joined = fact.filter(~F.col("is_cancelled")).join(F.broadcast(dates), "date_key")
    return joined.groupBy(
        F.col("full_date").alias("order_date"), "year", "month", F.dayofmonth("full_date").alias("day"), "day_name",
        "is_weekend", "is_mega_sale", "platform",
    ).agg(
        orders.alias("total_orders"), F.sum("quantity").alias("total_units_sold"), F.sum("buyer_total_amount").alias("total_revenue"),
        F.sum("seller_discount").alias("total_seller_discount"), F.sum("platform_discount").alias("total_platform_discount"),
        exact_ratio(F.sum("buyer_total_amount"), orders).alias("average_order_value"),
        F.sum(F.coalesce("subtotal", F.col("quantity") * F.col("original_price"))).alias("gross_revenue"),
        F.sum(F.coalesce("seller_discount", F.lit(0)) + F.coalesce("platform_discount", F.lit(0))).alias("discounts"))


def geographic_sales(fact: DataFrame, geography: DataFrame) -> DataFrame:
    joined = fact.filter(~F.col("is_cancelled")).join(geography, "geo_key")
    return joined.groupBy("state", "region", "platform").agg(
        F.count_distinct(order_key()).alias("order_count"), F.sum("quantity").alias("total_units"), F.sum("buyer_total_amount").alias("total_revenue"))


def geography_totals(fact: DataFrame, geography: DataFrame) -> DataFrame:
    """Totals per place; places without a valid line are left out after the outer join.

    Lines are summed per key before the join, so the join handles one row per place.
    """
    per_key = fact.filter(~F.col("is_cancelled")).groupBy("geo_key").agg(
        F.sum("buyer_total_amount").alias("r"), F.sum("quantity").alias("u"), F.count_distinct(order_key()).alias("o"), F.count(F.lit(1)).alias("n"))
    return geography.join(per_key, "geo_key", "left").filter(F.coalesce("n", F.lit(0)) > 0).select(
        "geo_key", "state", "region", F.coalesce("r", F.lit(0)).alias("total_revenue"), F.coalesce("u", F.lit(0)).alias("total_units"),
        F.coalesce("o", F.lit(0)).alias("total_orders"))


def product_mart(products: DataFrame, segments: DataFrame) -> DataFrame:
    chosen = segments.select("sku", F.round("mean_demand_exact", 2).alias("m"), F.round("std_demand_exact", 2).alias("s"), F.col("matrix_segment").alias("g"))
    return products.join(chosen, "sku", "left").select(
        "product_key", "sku", "product_name", "category", F.coalesce("m", F.lit(0.0)).alias("base_demand"),
        F.coalesce("s", F.lit(0.0)).alias("sigma"), F.coalesce("g", F.lit("NA")).alias("matrix_segment"))


def history_daily(history: DataFrame) -> DataFrame:
    return history.filter(~F.col("is_cancelled")).groupBy(
        F.col("create_time").cast("date").alias("order_date"), "sku", "platform", "data_origin", "source_dataset",
    ).agg(F.max("product_name").alias("product_name"), F.sum("quantity").alias("units_sold"))


# ---- forecast against actual ------------------------------------------------------------

def eligible_forecasts(issued: DataFrame) -> DataFrame:
    """Forecasts worth auditing: trained model, warehouse history, known origin, target after the history.

    Predictions are clamped at zero and the dataset list is brought to its canonical form.
    """
    datasets = S.dataset_list(F.col("source_datasets"))
    known = F.col("data_origin").isin(*V.LIVE_ORIGINS, V.HISTORY_ORIGIN)
    return issued.filter(
        F.col("model_source").isin(*V.TRAINED_SOURCES) & (F.col("history_source") == "warehouse") & known
        & ((F.col("data_origin") != V.HISTORY_ORIGIN) | (F.size(datasets) > 0)) & (F.col("target_date") > F.col("history_end_date"))
    ).withColumns({"source_datasets": datasets, "predicted_quantity": F.greatest(F.col("predicted_quantity"), F.lit(0))})


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """Last issue per product, day and provenance, issued before the target's business day."""
    usable = forecasts.filter(
        F.col("model_source").isin(*V.TRAINED_SOURCES) & (F.col("history_source") == "warehouse")
        & (F.col("target_date") > S.business_date(F.col("forecast_generated_at"))))
    return latest_by(usable, ["product_key", "target_date", "data_origin", "source_datasets"],
                     [F.col("forecast_generated_at").desc(), F.col("forecast_id").desc()])


def coverage_sets(coverage: DataFrame) -> DataFrame:
    """The datasets confirmed for each origin and day, as one set a day: at most one row for each origin and calendar day."""
    return coverage.groupBy("data_origin", "full_date").agg(F.collect_set("source_dataset").alias("_confirmed"))


def needed_datasets() -> Column:
    """What must be confirmed for a forecast: the live confirmation, or every dataset of imported history; null for other origins."""
    return F.when(F.col("data_origin").isin(*V.LIVE_ORIGINS), F.array(F.lit(""))).when(F.col("data_origin") == V.HISTORY_ORIGIN, F.array_distinct("source_datasets"))


def coverage_complete(forecasts: DataFrame, coverage: DataFrame, today: Column) -> DataFrame:
    """Flag per forecast: the target day is past and fully confirmed for its provenance.

    Confirmed days are sets of datasets, so "every needed dataset" is a test within the row that one join brings.
    """
    sets = coverage_sets(coverage).withColumnRenamed("full_date", "target_date")
    needed = needed_datasets()
    every = (F.size(needed) > 0) & (F.size(F.array_except(needed, F.coalesce("_confirmed", F.array().cast("array<string>")))) == 0)
    return forecasts.join(sets, ["data_origin", "target_date"], "left").withColumn(
        "actual_complete", F.coalesce(every, F.lit(False)) & (F.col("target_date") < today)).drop("_confirmed")


def observed_by_day(live: DataFrame, history: DataFrame) -> DataFrame:
    """Sold quantity per SKU and day: live, and imported by dataset. ``live``: sku, order_date, quantity; ``history`` also data_origin and
    source_dataset. Lines are summed by dataset before a day's few datasets are packed into a map."""
    one = live.select("sku", F.col("order_date").alias("target_date"), F.lit(None).cast("string").alias("_set"), "quantity")
    two = history.filter((F.col("data_origin") == V.HISTORY_ORIGIN) & F.col("source_dataset").isNotNull()).select("sku", F.col("order_date").alias("target_date"), F.col("source_dataset").alias("_set"), "quantity")
    summed = one.unionByName(two).groupBy("sku", "target_date", "_set").agg(F.sum("quantity").alias("_q"))
    pair = F.when(F.col("_set").isNotNull(), F.struct("_set", "_q"))
    return summed.groupBy("sku", "target_date").agg(F.max(F.when(F.col("_set").isNull(), F.col("_q"))).alias("_live"), F.map_from_entries(F.collect_list(pair)).alias("_sets"))


def observed_demand(forecasts: DataFrame, live: DataFrame, history: DataFrame) -> DataFrame:
    """Sold quantity for the SKU and day of each forecast, from the source that matches its origin; null where nothing was sold."""
    rows = forecasts.join(observed_by_day(live, history), ["sku", "target_date"], "left")
    found = F.filter(F.transform(F.array_distinct("source_datasets"), lambda s: F.try_element_at("_sets", s)), lambda q: q.isNotNull())
    total = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("decimal(38,4)"), lambda a, q: (a + q.cast("decimal(38,4)")).cast("decimal(38,4)")))
    return rows.withColumn("observed_demand", F.when(F.col("data_origin").isin(*V.LIVE_ORIGINS), F.col("_live").cast("double")).when(
        F.col("data_origin") == V.HISTORY_ORIGIN, total.cast("double"))).drop("_live", "_sets")


def forecast_vs_actual(forecasts: DataFrame, products: DataFrame, coverage: DataFrame, live: DataFrame, history: DataFrame,
                       segments: DataFrame, today: Column) -> DataFrame:
    """Latest forecast per target next to the actual, which is only known where coverage is confirmed."""
    latest = latest_forecasts(forecasts).join(products.select("product_key", "sku", "product_name", "category"), "product_key")
    rows = observed_demand(coverage_complete(latest, coverage, today), live, history)
    rows = rows.withColumn("_origin", F.when(F.col("data_origin") == "warehouse_live", "unverified_warehouse").otherwise(F.col("data_origin")))
    named = segments.select("sku", F.col("data_origin").alias("_origin"), F.col("matrix_segment").alias("_segment"))
    rows = rows.join(named, ["sku", "_origin"], "left")
    actual = F.when(F.col("actual_complete"), F.coalesce(F.col("observed_demand").cast("double"), F.lit(0.0)))
    gap = actual - F.col("predicted_quantity").cast("double")
    return rows.select(
        "forecast_id", "product_key", F.col("target_date").alias("date"), "sku", F.coalesce("_segment", F.lit("NA")).alias("matrix_segment"),
        actual.alias("actual_demand"), F.col("predicted_quantity").cast("double").alias("forecast_demand"),
        F.abs(gap).alias("absolute_error"), (gap * gap).alias("squared_error"), "model_name", "model_version", "data_origin",
        S.dataset_json(F.col("source_datasets")).alias("source_datasets"), "actual_complete")


def forecast_accuracy(rows: DataFrame, groups: list[str]) -> DataFrame:
    """WAPE, accuracy and bias over rows with a known actual only."""
    known = F.col("actual_demand").isNotNull()
    e, y = F.sum(F.when(known, F.col("absolute_error"))), F.sum(F.when(known, F.col("actual_demand")))
    b = F.sum(F.when(known, F.col("forecast_demand") - F.col("actual_demand")))
    wape = e / F.nullif(y, F.lit(0.0))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("rows_with_actual"), F.round(wape, 6).alias("wape"),
        F.round(F.when(wape.isNotNull(), F.greatest(F.lit(0.0), 1 - wape)), 6).alias("accuracy"),
        F.round(b / F.nullif(y, F.lit(0.0)), 6).alias("bias"))


def judged_confirmations(requests: DataFrame, history: DataFrame, today: Column) -> DataFrame:
    """Confirmation requests with the ``reason`` they are refused for, empty if they may be stored: the day must be a past business day, a live
    origin names no dataset, and an import names one that was imported."""
    known = history.select("data_origin", "source_dataset").distinct().withColumn("_known", F.lit(True))
    rows = requests.join(known, ["data_origin", "source_dataset"], "left")
    live, imported = F.col("data_origin").isin(*V.LIVE_ORIGINS), F.col("data_origin") == V.HISTORY_ORIGIN
    named = F.coalesce("source_dataset", F.lit("")) != ""
    reason = (F.when(F.col("full_date").isNull() | (F.col("full_date") >= today), "DAY_NOT_OVER").when(F.coalesce(imported & ~named, F.lit(False)), "DATASET_MISSING")
              .when(F.coalesce(imported & F.col("_known").isNull(), F.lit(False)), "DATASET_UNKNOWN").when(F.coalesce(imported, F.lit(False)), "")
              .when(F.coalesce(live & ~named, F.lit(False)), "").otherwise("ORIGIN_NOT_SUPPORTED"))
    return rows.withColumn("reason", reason).drop("_known")


def confirm_coverage(requests: DataFrame, history: DataFrame, today: Column) -> DataFrame:
    """Coverage confirmations that may be stored: past day, supported origin, dataset known for imports."""
    return judged_confirmations(requests, history, today).filter("reason = ''").drop("reason").distinct()


# ---- measures ---------------------------------------------------------------------------

def sales_measures(summary: DataFrame) -> DataFrame:
    """Totals and the average order value as a ratio of totals, from the daily summary; one row."""
    revenue, orders = F.sum("total_revenue"), F.sum("total_orders")
    part = lambda p: F.sum(F.when(F.col("platform") == p, F.col("total_revenue")).otherwise(0))
    return summary.agg(
        revenue.alias("total_revenue"), F.sum("total_units_sold").alias("total_units"), orders.alias("total_orders"),
        exact_ratio(revenue, orders).alias("average_order_value"), part("shopee").alias("shopee_revenue"), part("tiktok").alias("tiktok_revenue"),
        F.round(part("shopee").cast("double") / revenue.cast("double"), 6).alias("shopee_share"))


def raw_measures(fact: DataFrame) -> DataFrame:
    """The same from order lines, counting orders by (platform, order)."""
    valid = fact.filter(~F.col("is_cancelled"))
    orders = F.count_distinct(order_key())
    return valid.agg(F.sum("buyer_total_amount").alias("raw_revenue"), F.sum("quantity").alias("raw_units"), orders.alias("raw_orders"),
                     exact_ratio(F.sum("buyer_total_amount"), orders).alias("raw_aov"))


def period_demand(summary: DataFrame, first: Column, last: Column) -> DataFrame:
    """Mean and sample deviation of daily units over the selected dates, and their ratio."""
    days = summary.filter(F.col("order_date").between(first, last)).groupBy("order_date").agg(F.sum("total_units_sold").cast("double").alias("u"))
    mean, std = S.statistics_from_sums(F.count("u"), F.sum("u"), F.sum(F.col("u") * F.col("u")))
    return days.agg(F.count("u").alias("days"), F.round(mean, 6).alias("avg_daily_demand"), F.round(std, 6).alias("std_daily_demand"),
                    F.round(std / F.nullif(mean, F.lit(0.0)), 6).alias("cv_volatility"))
