"""Daily demand, the dense SKU x day series, and ABC/XYZ segmentation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators.prefix import running_total
from marketloom.session import materialise


@dataclass(frozen=True)
class SegmentPolicy:
    """Thresholds and stock policy; the defaults are the warehouse view, ``CLASSIFIER`` the model side."""

    pareto_a: float = 0.80
    pareto_b: float = 0.95
    cv_x: float = 0.50
    cv_y: float = 1.00
    z: float = 1.645
    lead_time: float = 3
    floor: bool = True


WAREHOUSE = SegmentPolicy()
CLASSIFIER = SegmentPolicy(z=S.z_for_classifier(0.95), floor=False)


def demand_rows(live: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Live and historical demand with aligned types and an origin label; cancelled lines left out."""
    rows = live.filter(~F.col("is_cancelled")).select(
        F.lit("unverified_warehouse").alias("data_origin"), F.lit("").alias("source_dataset"),
        "sku", "product_name", "category", F.col("create_time").cast("date").alias("order_date"),
        F.col("quantity").cast("decimal(18,0)").alias("quantity"),
        F.col("buyer_total_amount").cast("decimal(18,2)").alias("revenue"),
    )
    if history is None:
        return rows
    old = history.filter(~F.col("is_cancelled")).select(
        "data_origin", "source_dataset", "sku", "product_name", F.lit(None).cast("string").alias("category"),
        F.col("create_time").cast("date").alias("order_date"),
        F.col("quantity").cast("decimal(18,0)").alias("quantity"),
        F.lit(0).cast("decimal(18,2)").alias("revenue"),
    )
    return rows.unionByName(old)


def daily_metrics(lines: DataFrame, order_key: list[str] | None = ("platform", "order_id"), key: str = "sku") -> DataFrame:
    """Demand, revenue, mean price, discount and order count per SKU and day.

    ``order_key`` counts an order once however many lines it has; None counts lines, for sources
    whose order ids are reused.
    """
    order_count = F.count_distinct(F.struct(*order_key)) if order_key else F.count(F.lit(1))
    discount = F.sum("seller_discount") if "seller_discount" in lines.columns else F.count("quantity")
    return (
        lines.filter(~F.col("is_cancelled"))
        .groupBy(key, F.col("create_time").cast("date").alias("date"))
        .agg(
            F.sum("quantity").cast("double").alias("daily_demand"),
            F.sum("buyer_total_amount").cast("double").alias("daily_revenue"),
            (F.sum("original_price").cast("double") / F.count("original_price")).alias("avg_unit_price"),
            discount.cast("double").alias("total_discount"),
            order_count.cast("double").alias("order_count"),
        )
    )


def date_bounds(lines: DataFrame) -> tuple[Column, Column]:
    """First and last active day as scalar subqueries over the two columns they need."""
    days = lines.filter(~F.col("is_cancelled")).select(F.col("create_time").cast("date").alias("d"))
    bounds = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return bounds.select("lo").scalar(), bounds.select("hi").scalar()


def dense_daily(daily: DataFrame, first: Column | None, last: Column, key: str = "sku", price_fill: str = "forward") -> DataFrame:
    """One row per SKU and calendar day between ``first`` and ``last``; unsold days are zero.

    Every sold day produces the unsold days up to the next sold day (and the first one also the
    days before it), so no calendar is joined and the rows stay distributed by SKU for the windows
    that follow. ``price_fill``: ``forward`` then zero for training, ``both`` for serving history.
    """
    by_day = Window.partitionBy(key).orderBy("date")
    spans = daily.withColumns({
        "_from": F.col("date") if first is None
        else F.when(F.lag("date").over(by_day).isNull(), first).otherwise(F.col("date")),
        "_to": F.coalesce(F.date_sub(F.lead("date").over(by_day), 1), last),
    })
    day = F.explode(F.sequence("_from", "_to", F.expr("interval 1 day"))).alias("_day")
    rows = spans.select("*", day)
    sold = F.col("_day") == F.col("date")
    zeros = {c: F.when(sold, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
             for c in ("daily_demand", "daily_revenue", "total_discount", "order_count") if c in daily.columns}
    out = rows.withColumns({**zeros, "avg_unit_price": F.when(sold, F.col("avg_unit_price"))}) \
        if "avg_unit_price" in daily.columns else rows.withColumns(zeros)
    out = out.drop("date", "_from", "_to").withColumnRenamed("_day", "date")
    if "avg_unit_price" not in daily.columns:
        return out
    upto = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    price = F.last("avg_unit_price", ignorenulls=True).over(upto)
    if price_fill == "both":
        # Only days before the first price are still open, so they take the SKU's first price.
        whole = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        price = F.coalesce(price, F.first("avg_unit_price", ignorenulls=True).over(whole))
    return out.withColumn("avg_unit_price", F.coalesce(price, F.lit(0.0)))


def recent_dense(lines: DataFrame, days: int, order_key: list[str] | None = ("platform", "order_id"), key: str = "sku") -> DataFrame:
    """The last ``days`` days of ``dense_daily(daily_metrics(lines))``, without the days before them.

    Older lines are only asked which SKUs there are and what their last price was; a scan of lines that are stored by day reads three of
    their columns.
    """
    first, last = date_bounds(lines)
    start = F.greatest(first, F.date_sub(last, days - 1))
    day = F.col("create_time").cast("date")
    recent = daily_metrics(lines.filter(day >= start), order_key, key)
    older = lines.filter(~F.col("is_cancelled") & (day < start)).groupBy(key, day.alias("date")).agg(
        (F.sum("original_price").cast("double") / F.count("original_price")).alias("p"))
    seed = older.groupBy(key).agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("date"))).alias("avg_unit_price")).select(
        key, F.date_sub(start, 1).alias("date"), "avg_unit_price", *[F.lit(0.0).alias(c) for c in ("daily_demand", "daily_revenue", "total_discount", "order_count")])
    # The day before the first one only carries the price over.
    return dense_daily(recent.unionByName(seed), F.date_sub(start, 1), last, key).filter(F.col("date") >= start)


def recent_totals(lines: DataFrame, spans: dict[str, tuple[int, int]], order_key: list[str] | None = None, key: str = "sku") -> DataFrame:
    """Per SKU and span (days back from the last active day, both ends included): ``<name>_days``, ``_sum``, ``_squares`` and, with an
    ``order_key``, ``_orders``.

    Unsold days add nothing to the sums, so the series is never built: lines within the longest span are reduced to SKU-days, older ones to
    one row for each SKU, which so has a row without recent sales too.
    """
    first, last = date_bounds(lines)
    day = F.col("create_time").cast("date")
    back = F.datediff(last, day)
    near = F.when(back <= max(b for _, b in spans.values()), back)
    orders = F.count_distinct(F.when(F.col("_back").isNotNull(), F.struct(*order_key))) if order_key else F.lit(0)
    sold = lines.filter(~F.col("is_cancelled")).withColumn("_back", near).groupBy(key, "_back").agg(
        F.sum("quantity").cast("double").alias("q"), orders.cast("double").alias("o"))
    inside = {n: (F.col("_back") >= a) & (F.col("_back") <= b) for n, (a, b) in spans.items()}
    total = lambda value, i: F.coalesce(F.sum(F.when(i, value)), F.lit(0.0))
    sums = sold.groupBy(key).agg(*[x for n, i in inside.items() for x in (
        total(F.col("q"), i).alias(f"{n}_sum"), total(F.col("q") * F.col("q"), i).alias(f"{n}_squares"), total(F.col("o"), i).alias(f"{n}_orders"))])
    length = F.datediff(last, first) + 1
    return sums.withColumns({f"{n}_days": F.greatest(F.lit(0), F.least(F.lit(b + 1), length) - a) for n, (a, b) in spans.items()})


def abc_xyz(rows: DataFrame, policy: SegmentPolicy = WAREHOUSE) -> DataFrame:
    """ABC/XYZ by origin from ``demand_rows``.

    Mean and deviation of the zero-filled series follow from the number of calendar days and two
    integer sums, so the SKU x day grid is never built. Lines are first reduced to SKU-days, which
    bounds a hot SKU by the calendar; sums are hashed, as the greatest names, which would make a
    task sort all its lines, are found among the distinct ones. The cumulative share runs over range
    slices, because one origin can hold every SKU.
    """
    daily = rows.groupBy("data_origin", "sku", "order_date").agg(F.sum("quantity").alias("q"), F.sum("revenue").alias("r"))
    names = rows.select("data_origin", "sku", "product_name", "category").distinct()
    totals = materialise(
        daily.unionByName(names, allowMissingColumns=True).groupBy("data_origin", "sku").agg(
            F.max("product_name").alias("product_name"), F.max("category").alias("category"),
            F.sum("r").cast("decimal(30,2)").alias("revenue"), F.sum("q").cast("decimal(20,0)").alias("total_units"),
            F.sum(F.col("q").cast("double") * F.col("q").cast("double")).alias("_sq"),
            F.min("order_date").alias("_lo"), F.max("order_date").alias("_hi"),
        ),
        "sku-totals",
    )
    # One row per origin, a fixed vocabulary of three, hence the broadcast.
    origin = totals.groupBy("data_origin").agg(
        F.sum("revenue").alias("_all_revenue"), F.sum("total_units").alias("_all_units"),
        (F.datediff(F.max("_hi"), F.min("_lo")) + 1).alias("_days"),
    )
    weighted = totals.join(F.broadcast(origin), "data_origin").withColumns({
        "abc_weight": F.when(F.col("_all_revenue") > 0, F.col("revenue")).otherwise(F.col("total_units")).cast("decimal(30,2)"),
        "_total_weight": F.when(F.col("_all_revenue") > 0, F.col("_all_revenue")).otherwise(F.col("_all_units")).cast("decimal(34,2)"),
    })
    summed = running_total(weighted, ["data_origin"], [F.col("abc_weight").desc(), F.col("sku")], {"cum_weight": "abc_weight"})
    mean, std = S.statistics_from_sums(F.col("_days"), F.col("total_units"), F.col("_sq"))
    total = F.nullif(F.col("_total_weight").cast("double"), F.lit(0.0))
    out = summed.withColumns({"mean_demand_exact": mean, "std_demand_exact": std})
    out = out.withColumns({
        "cv": S.volatility(F.col("std_demand_exact"), F.col("mean_demand_exact")),
        "abc_class": S.abc_class(
            F.coalesce((F.col("cum_weight") - F.col("abc_weight")).cast("double") / total, F.lit(0.0)),
            policy.pareto_a, policy.pareto_b),
        "weight_share": F.coalesce(F.col("abc_weight").cast("double") / total, F.lit(0.0)),
        "cum_share": F.coalesce(F.col("cum_weight").cast("double") / total, F.lit(0.0)),
    }).withColumn("xyz_class", S.xyz_class(F.col("cv"), policy.cv_x, policy.cv_y))
    out = out.withColumns({
        "matrix_segment": F.concat("abc_class", "xyz_class"),
        "safety_stock": S.safety_stock(F.col("std_demand_exact"), policy.z, policy.lead_time, policy.floor),
    }).withColumn("reorder_point", S.reorder_point(F.col("mean_demand_exact"), F.col("safety_stock"), policy.lead_time, policy.floor))
    return out.select(
        "data_origin", "sku", "product_name", "category", "revenue", "total_units", "abc_weight", "weight_share",
        "cum_share", "abc_class", "mean_demand_exact", "std_demand_exact", "cv", "xyz_class", "matrix_segment",
        "safety_stock", "reorder_point",
    )


def nine_box_summary(segments: DataFrame) -> DataFrame:
    """Count, share of SKUs, share of weight and mean CV per ABC class, XYZ class and cell.

    All classes are listed, also empty ones.
    """
    cells = segments.groupBy("abc_class", "xyz_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("abc_weight").alias("w"), F.sum("cv").alias("c"))
    levels = F.array(
        F.struct(F.lit("abc").alias("level"), F.col("abc_class").alias("name")),
        F.struct(F.lit("xyz").alias("level"), F.col("xyz_class").alias("name")),
        F.struct(F.lit("matrix").alias("level"), F.concat("abc_class", "xyz_class").alias("name")),
    )
    per_level = cells.select(F.inline(levels), "n", "w", "c").groupBy("level", "name").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("c").alias("c"))
    spark = segments.sparkSession
    listed = spark.createDataFrame(
        [("abc", a) for a in "ABC"] + [("xyz", x) for x in "XYZ"] + [("matrix", a + x) for a in "ABC" for x in "XYZ"],
        "level string, name string")
    whole = cells.agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    n_all, w_all = whole.select("n").scalar(), whole.select("w").scalar()
    return listed.join(per_level, ["level", "name"], "left").select(
        "level", "name", F.coalesce("n", F.lit(0)).alias("sku_count"),
        F.round(F.coalesce(F.col("n") * F.lit(100.0) / n_all, F.lit(0.0)), 2).alias("sku_pct"),
        F.when(w_all > 0, F.round(F.coalesce(F.col("w").cast("double") * 100 / w_all.cast("double"), F.lit(0.0)), 2)).otherwise(0.0).alias("revenue_pct"),
        F.round(F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)), 2).alias("avg_cv"),
    )


def nine_box_pivot(segments: DataFrame) -> DataFrame:
    """SKU counts and revenue percent, three fixed columns and three fixed rows."""
    classes = segments.sparkSession.createDataFrame([(a,) for a in "ABC"], "abc_class string")
    pivot = segments.groupBy("abc_class").pivot("xyz_class", ["X", "Y", "Z"]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("abc_weight").alias("w"))
    whole = segments.agg(F.sum("abc_weight").cast("double").alias("w")).scalar()
    out = classes.join(pivot, "abc_class", "left")
    return out.select(
        "abc_class",
        *[F.coalesce(F.col(f"{x}_n"), F.lit(0).cast("long")).alias(f"skus_{x.lower()}") for x in "XYZ"],
        *[F.coalesce(F.round(F.col(f"{x}_w").cast("double") * 100 / F.nullif(whole, F.lit(0.0)), 1), F.lit(0.0)).alias(f"revenue_pct_{x.lower()}") for x in "XYZ"],
    )


def with_recommendation(segments: DataFrame) -> DataFrame:
    return segments.withColumns({
        "strategy_recommendation": S.nine_box_text(F.col("matrix_segment"), 0),
        "recommended_model": S.nine_box_text(F.col("matrix_segment"), 1),
    })
