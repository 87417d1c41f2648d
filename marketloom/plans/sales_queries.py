"""Sales reports, calendar, profile and shares over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators import star
from marketloom.operators.prefix import exact_quantiles
from marketloom.plans import marts
from marketloom.plans.registry import query
from marketloom.plans.sql_parts import LINES
from marketloom.sources import tables as T


def calendar_of(spark: SparkSession, d: str) -> DataFrame:
    bounds = T.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("x")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return star.calendar(spark, bounds.select("lo").scalar(), bounds.select("hi").scalar())


def dated_lines(spark: SparkSession, d: str, dates: DataFrame, **more) -> DataFrame:
    # One row per calendar day, so the lookup table is bounded by the calendar.
    keys = dates.select(F.col("full_date").alias("order_date"), "date_key")
    return T.order_lines(spark, d, **more).join(F.broadcast(keys), "order_date", "left")


def summary_of(spark: SparkSession, d: str) -> DataFrame:
    dates = calendar_of(spark, d)
    return marts.executive_summary(dated_lines(spark, d, dates), dates)


SUMMARY_SQL = LINES + """,
summary AS (
  SELECT order_date, year(order_date) AS year, month(order_date) AS month, day(order_date) AS day, dayname(order_date) AS day_name,
    dayofweek(order_date) IN (0, 6) AS is_weekend, day(order_date) = month(order_date) AS is_mega_sale, platform,
    count(DISTINCT (platform, order_id)) AS total_orders, sum(quantity) AS total_units_sold, sum(buyer_total_amount) AS total_revenue,
    sum(seller_discount) AS total_seller_discount, sum(platform_discount) AS total_platform_discount,
    sum(subtotal) AS gross_revenue, sum(seller_discount + platform_discount) AS discounts
  FROM lines WHERE NOT is_cancelled GROUP BY ALL)"""
# Half-up division of cents by a count, in whole numbers.
def cents_ratio(total: str, n: str) -> str:
    return f"CAST((2 * CAST({total} * 100 AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / 100"


@query("exec_daily_summary", f"""WITH {SUMMARY_SQL}
SELECT CAST(order_date AS VARCHAR) AS order_date, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CAST(day AS BIGINT) AS day, day_name, is_weekend,
  is_mega_sale, platform, total_orders, CAST(total_units_sold AS BIGINT) AS total_units_sold, CAST(total_revenue AS DOUBLE) AS total_revenue,
  CAST(total_seller_discount AS DOUBLE) AS total_seller_discount, CAST(total_platform_discount AS DOUBLE) AS total_platform_discount,
  {cents_ratio('total_revenue', 'total_orders')} AS average_order_value, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(discounts AS DOUBLE) AS discounts FROM summary""")
def exec_daily_summary(spark, d):
    return summary_of(spark, d).orderBy("order_date", "platform")


@query("exec_aov", f"""WITH {SUMMARY_SQL}
SELECT CAST(sum(total_revenue) AS DOUBLE) AS total_revenue, CAST(sum(total_units_sold) AS BIGINT) AS total_units, CAST(sum(total_orders) AS BIGINT) AS total_orders,
  {cents_ratio('sum(total_revenue)', 'CAST(sum(total_orders) AS HUGEINT)')} AS average_order_value,
  CAST(sum(total_revenue) FILTER (platform = 'shopee') AS DOUBLE) AS shopee_revenue, CAST(sum(total_revenue) FILTER (platform = 'tiktok') AS DOUBLE) AS tiktok_revenue,
  round(CAST(sum(total_revenue) FILTER (platform = 'shopee') AS DOUBLE) / CAST(sum(total_revenue) AS DOUBLE), 6) AS shopee_share FROM summary""")
def exec_aov(spark, d):
    return marts.sales_measures(summary_of(spark, d))


@query("raw_measures", f"""WITH {LINES}
SELECT CAST(sum(buyer_total_amount) AS DOUBLE) AS raw_revenue, CAST(sum(quantity) AS BIGINT) AS raw_units, count(DISTINCT (platform, order_id)) AS raw_orders,
  {cents_ratio('sum(buyer_total_amount)', 'count(DISTINCT (platform, order_id))')} AS raw_aov FROM lines WHERE NOT is_cancelled""")
def raw_measures(spark, d):
    return marts.raw_measures(T.order_lines(spark, d))


def summary_against_source(summary: DataFrame, lines: DataFrame) -> DataFrame:
    """Revenue and orders of a summary beside those of its lines, and whether they agree."""
    a = marts.sales_measures(summary).select(F.col("total_revenue").alias("summary_revenue"), F.col("total_orders").alias("summary_orders"))
    b = marts.raw_measures(lines)
    rows = a.select("*", b.select("raw_revenue").scalar().alias("source_revenue"), b.select("raw_orders").scalar().alias("source_orders"))
    return rows.withColumn("consistent", (F.abs(F.col("summary_revenue") - F.col("source_revenue")) <= 0.01) & (F.col("summary_orders") == F.col("source_orders")))


@query("aov_consistency", f"""WITH {SUMMARY_SQL},
a AS (SELECT CAST(sum(total_revenue) AS DOUBLE) AS r, CAST(sum(total_orders) AS BIGINT) AS o FROM summary),
b AS (SELECT CAST(sum(buyer_total_amount) AS DOUBLE) AS r, count(DISTINCT (platform, order_id)) AS o FROM lines WHERE NOT is_cancelled)
SELECT a.r AS summary_revenue, b.r AS source_revenue, a.o AS summary_orders, b.o AS source_orders, abs(a.r - b.r) <= 0.01 AND a.o = b.o AS consistent FROM a, b""")
def aov_consistency(spark, d):
    """Summary totals against source totals (an order has one day, so both count it once)."""
    return summary_against_source(summary_of(spark, d), T.order_lines(spark, d))


@query("period_demand", f"""WITH {SUMMARY_SQL}, days AS (SELECT order_date, CAST(sum(total_units_sold) AS DOUBLE) AS u FROM summary
  WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1)
SELECT count(*) AS days, round(avg(u), 6) AS avg_daily_demand, round(stddev_samp(u), 6) AS std_daily_demand, round(stddev_samp(u) / avg(u), 6) AS cv_volatility FROM days""")
def period_demand(spark, d):
    return marts.period_demand(summary_of(spark, d), F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date"))


@query("geo_sales", f"""WITH {LINES} SELECT state, region, platform, count(DISTINCT (platform, order_id)) AS order_count, CAST(sum(quantity) AS BIGINT) AS total_units,
  CAST(sum(buyer_total_amount) AS DOUBLE) AS total_revenue FROM lines WHERE NOT is_cancelled GROUP BY ALL""")
def geo_sales(spark, d):
    lines = T.order_lines(spark, d).join(T.places(spark, d).select("cust_key", "geo_key"), "cust_key")
    return marts.geographic_sales(lines, T.geographies(spark, d))


@query("geo_totals", f"""WITH {LINES} SELECT CAST(n.n_nationkey AS BIGINT) AS geo_key, n.n_name AS state, r.r_name AS region, CAST(coalesce(sum(l.buyer_total_amount), 0) AS DOUBLE) AS total_revenue,
  CAST(coalesce(sum(l.quantity), 0) AS BIGINT) AS total_units, count(DISTINCT (l.platform, l.order_id)) FILTER (l.order_id IS NOT NULL) AS total_orders
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN lines l ON l.geo_key = n.n_nationkey AND NOT l.is_cancelled GROUP BY ALL HAVING count(l.order_id) > 0""")
def geo_totals(spark, d):
    lines = T.order_lines(spark, d).join(T.places(spark, d).select("cust_key", "geo_key"), "cust_key")
    return marts.geography_totals(lines, T.geographies(spark, d)).orderBy(F.col("total_revenue").desc(), "geo_key")


CALENDAR_SQL = """cal AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)"""


@query("calendar_dim", f"""WITH {CALENDAR_SQL} SELECT CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS date_key, CAST(d AS VARCHAR) AS full_date, dayofweek(d) AS day_of_week,
  dayname(d) AS day_name, weekofyear(d) AS week_of_year, month(d) AS month, monthname(d) AS month_name, quarter(d) AS quarter, year(d) AS year,
  dayofweek(d) IN (0, 6) AS is_weekend, day(d) = month(d) AS is_mega_sale FROM cal""")
def calendar_dim(spark, d):
    return calendar_of(spark, d)


@query("calendar_extend", f"""WITH {CALENDAR_SQL}, more AS (SELECT d, row_number() OVER (ORDER BY d) AS k, 0 AS part FROM cal),
late AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT d FROM cal)),
allrows AS (SELECT d, k FROM more UNION ALL SELECT d, row_number() OVER (ORDER BY d) + (SELECT max(k) FROM more) FROM late)
SELECT CAST(k AS BIGINT) AS date_key, CAST(d AS VARCHAR) AS full_date, dayofweek(d) AS day_of_week, dayname(d) AS day_name, weekofyear(d) AS week_of_year,
  year(d) AS year FROM allrows""")
def calendar_extend(spark, d):
    """Ship dates beyond the order calendar are appended with the following keys."""
    ship = T.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("full_date"))
    out = star.extend_calendar(calendar_of(spark, d), ship)
    return out.select("date_key", "full_date", "day_of_week", "day_name", "week_of_year", "year")


@query("totals_card", f"""WITH {LINES} SELECT count(*) AS lines, count(DISTINCT (platform, order_id)) AS orders, CAST(sum(quantity) AS BIGINT) AS units FROM lines""")
def totals_card(spark, d):
    return T.order_lines(spark, d).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(marts.order_key()).alias("orders"), F.sum("quantity").alias("units"))


@query("tagged_batch", f"""WITH {LINES} SELECT platform, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS units FROM lines WHERE starts_with(order_id, '12') GROUP BY 1""")
def tagged_batch(spark, d):
    """Rows and units by platform of the orders whose id starts with one batch tag."""
    return T.order_lines(spark, d).filter(F.col("order_id").startswith("12")).groupBy("platform").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"))


@query("batch_drilldown", f"""WITH {LINES} SELECT order_id, source_line_id, sku, CAST(quantity AS BIGINT) AS quantity, order_status FROM lines WHERE starts_with(order_id, '12')
ORDER BY order_id, source_line_id, sku, quantity, subtotal LIMIT 60""")
def batch_drilldown(spark, d):
    """First 60 lines of one tagged batch."""
    lines = T.order_lines(spark, d, product=True).filter(F.col("order_id").startswith("12"))
    return lines.orderBy("order_id", "source_line_id", "sku", "quantity", "subtotal").limit(60).select(
        "order_id", "source_line_id", "sku", "quantity", "order_status")


@query("sku_catalog", f"""WITH {LINES} SELECT sku, max(product_name) AS product_name, CAST(max(order_date) AS VARCHAR) AS last_date, count(DISTINCT (platform, order_id)) AS order_count FROM lines GROUP BY 1""")
def sku_catalog(spark, d):
    return _catalog(spark, d)


def _catalog(spark, d):
    return T.order_lines(spark, d, product=True).groupBy("sku").agg(
        F.max("product_name").alias("product_name"), F.max("order_date").alias("last_date"), F.count_distinct(marts.order_key()).alias("order_count"))


@query("top_skus", f"""WITH {LINES} SELECT sku, max(product_name) AS product_name, CAST(max(order_date) AS VARCHAR) AS last_date, count(DISTINCT (platform, order_id)) AS order_count
FROM lines GROUP BY 1 ORDER BY order_count DESC, sku LIMIT 40""")
def top_skus(spark, d):
    """The 40 SKUs with most orders."""
    return _catalog(spark, d).orderBy(F.col("order_count").desc(), "sku").limit(40)


@query("status_share", """WITH s AS (SELECT CASE WHEN o_orderkey % 20 < 11 THEN 'shopee' ELSE 'tiktok' END AS platform,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'SHIPPED' ELSE 'CANCELLED' END AS order_status, count(*) AS orders FROM orders GROUP BY ALL)
SELECT platform, order_status, orders, round(orders / (SELECT sum(orders) FROM s) * 100.0, 4) AS share_pct,
  round(sum(CASE WHEN order_status = 'CANCELLED' THEN orders ELSE 0 END) OVER (PARTITION BY platform) / sum(orders) OVER (PARTITION BY platform) * 100.0, 4) AS platform_cancel_pct FROM s""")
def status_share(spark, d):
    """Orders by platform and status, share of all and cancel rate per platform."""
    o = T.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "SHIPPED").otherwise("CANCELLED")
    counts = o.groupBy(T.platform_of(F.col("o_orderkey")).alias("platform"), status.alias("order_status")).agg(F.count(F.lit(1)).alias("orders"))
    total = counts.agg(F.sum("orders").alias("n")).scalar()
    # Two platforms and twelve statuses: the counts are a fixed-size table.
    per = Window.partitionBy("platform")
    cancelled = F.sum(F.when(F.col("order_status") == "CANCELLED", F.col("orders")).otherwise(0)).over(per)
    return counts.select("platform", "order_status", "orders", F.round(F.col("orders") / total * 100.0, 4).alias("share_pct"),
                         F.round(cancelled / F.sum("orders").over(per) * 100.0, 4).alias("platform_cancel_pct"))


@query("hourly_weekday", """WITH h AS (SELECT 'hour' AS kind, hour(ts) AS slot, CASE WHEN hour(ts) IN (12, 20, 21) THEN 'flash' ELSE 'normal' END AS label, count(*) AS events FROM events GROUP BY ALL),
w AS (SELECT 'weekday' AS kind, isodow(ts) - 1 AS slot, dayname(ts) AS label, count(*) AS events FROM events GROUP BY ALL)
SELECT kind, CAST(slot AS BIGINT) AS slot, label, events FROM h UNION ALL SELECT kind, CAST(slot AS BIGINT), label, events FROM w""")
def hourly_weekday(spark, d):
    """Events by hour (with the flash-sale hours marked) and by weekday, Monday first."""
    e = T.table(spark, d, "events").select("ts")
    slots = F.array(
        F.struct(F.lit("hour").alias("kind"), F.hour("ts").alias("slot"), F.when(S.is_flash_hour(F.col("ts")), "flash").otherwise("normal").alias("label")),
        F.struct(F.lit("weekday").alias("kind"), S.weekday_monday0(F.col("ts")).alias("slot"), F.date_format("ts", "EEEE").alias("label")))
    return e.select(F.inline(slots)).groupBy("kind", "slot", "label").agg(F.count(F.lit(1)).alias("events")).orderBy("kind", "slot")


@query("missing_pct", """SELECT 'quality' AS column_name, round(count(*) FILTER (l.quality IS NULL) * 100.0 / count(*), 4) AS missing_pct FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'toxic', round(count(*) FILTER (l.toxic IS NULL) * 100.0 / count(*), 4) FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'n_chars', round(count(*) FILTER (d.n_chars IS NULL) * 100.0 / count(*), 4) FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_pct(spark, d):
    """Share of missing values per column, one pass and unpivoted."""
    rows = T.table(spark, d, "documents").select("doc_id", "n_chars").join(T.table(spark, d, "labels"), "doc_id", "left")
    return missing_share(rows, ["quality", "toxic", "n_chars"])


def missing_share(rows: DataFrame, columns: list[str]) -> DataFrame:
    one = rows.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100.0, 4).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "missing_pct")


@query("describe", """SELECT 'l_quantity' AS measure, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min,
  round(quantile_cont(l_quantity, 0.5), 6) AS median, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), round(avg(l_extendedprice), 6), round(stddev_samp(l_extendedprice), 6), min(l_extendedprice), round(quantile_cont(l_extendedprice, 0.5), 6), max(l_extendedprice) FROM lineitem""")
def describe(spark, d):
    """Mean, deviation, extremes and the exact median; the median is ranked over range slices."""
    li = T.table(spark, d, "lineitem")
    long = li.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("l_quantity", "l_extendedprice")])))
    stats = long.groupBy("measure").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"),
                                        F.min("value").alias("min"), F.max("value").alias("max"))
    median = exact_quantiles(long, ["measure"], "value", {"median": 0.5})
    return stats.join(median, "measure").select("measure", "n", "mean", "std", "min", F.round("median", 6).alias("median"), "max")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]))
def corr_matrix(spark, d):
    """Pairwise correlation of six measures, all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]
    one = T.table(spark, d, "lineitem").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])
    return one.select(F.inline(rows))


@query("demand_rows_union", f"""WITH {LINES}, u AS (
SELECT 'unverified_warehouse' AS data_origin, sku, category, order_date, quantity, buyer_total_amount AS revenue FROM lines WHERE NOT is_cancelled AND platform = 'shopee'
UNION ALL SELECT 'public_anonymized_historical_csv', sku, NULL, order_date, quantity, 0 FROM lines WHERE NOT is_cancelled AND platform = 'tiktok')
SELECT data_origin, sku, CAST(order_date AS VARCHAR) AS order_date, count(*) AS rows, count(category) AS with_category, CAST(sum(quantity) AS BIGINT) AS units,
  CAST(sum(revenue) AS DOUBLE) AS revenue FROM u GROUP BY ALL""")
def demand_rows_union(spark, d):
    """Live and historical demand rows side by side, counted per origin, SKU and day."""
    rows = two_origins(spark, d)
    return rows.groupBy("data_origin", "sku", "order_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count("category").alias("with_category"), F.sum("quantity").cast("long").alias("units"), F.sum("revenue").alias("revenue"))


def two_origins(spark: SparkSession, d: str) -> DataFrame:
    """One platform plays the live warehouse, the other the imported history."""
    from marketloom.functions import vocab as V
    from marketloom.operators import demand as D

    lines = T.order_lines(spark, d, product=True)
    live = lines.filter("platform = 'shopee'")
    history = lines.filter("platform = 'tiktok'").withColumns({"data_origin": F.lit(V.HISTORY_ORIGIN), "source_dataset": F.lit("tiktok:all")})
    return D.demand_rows(live, history)


@query("fee_amounts", f"""WITH {LINES}, f AS (SELECT *, CAST(round(subtotal * 0.05, 2) AS DECIMAL(14,2)) AS commission, CAST(round(subtotal * 0.02, 2) AS DECIMAL(14,2)) AS service,
  CAST(round(subtotal * 0.01, 2) AS DECIMAL(14,2)) AS txn, CAST(line_number * 1000 AS DECIMAL(14,2)) AS ship, greatest(subtotal - seller_discount - platform_discount, 0) AS due FROM lines)
SELECT platform, CAST(sum(due) AS DOUBLE) AS buyer_total, CAST(sum(due - commission - service) AS DOUBLE) AS net_revenue,
  CAST(sum(greatest(round(due - commission - service - txn + ship * 0.5, 0), 0)) AS DOUBLE) AS escrow,
  count(*) FILTER (due <> buyer_total_amount) AS inconsistent FROM f GROUP BY 1""")
def fee_amounts(spark, d):
    """Buyer total, net revenue and payout from fees, and how often the supplied total disagrees."""
    share = lambda rate: F.round(F.col("subtotal") * F.lit(rate).cast("decimal(3,2)"), 2).cast(T.MONEY)
    lines = T.order_lines(spark, d).withColumns({
        "commission": share("0.05"), "service": share("0.02"), "txn": share("0.01"), "ship": (F.col("line_number") * 1000).cast(T.MONEY),
        "due": S.buyer_total(F.col("subtotal"), F.col("seller_discount"), F.col("platform_discount"))})
    return lines.groupBy("platform").agg(
        F.sum("due").alias("buyer_total"), F.sum(S.net_revenue(F.col("due"), F.col("commission"), F.col("service"))).alias("net_revenue"),
        F.sum(S.escrow(F.col("due"), F.col("commission"), F.col("service"), F.col("txn"), F.col("ship"))).alias("escrow"),
        F.count_if(F.col("due") != F.col("buyer_total_amount")).alias("inconsistent"))


@query("demand_drivers", f"""WITH {CALENDAR_SQL}, f AS (SELECT d, [0.95, 0.62, 0.86, 0.97, 1.12, 1.03, 0.88, 1.16, 1.32, 1.18, 1.65, 1.5][month(d)] AS season, exp(0.1 * (dayofyear(d) - 1) / 365.0) AS growth,
  CASE WHEN day(d) = month(d) THEN 2.5 WHEN day(d) - month(d) IN (-2, -1) THEN 1.33 WHEN day(d) - month(d) IN (1, 2) THEN 0.82 ELSE 1 END AS campaign,
  CASE WHEN day(d) IN (15, 25, 26, 27, 28) THEN 1.15 ELSE 1 END AS payday, CASE WHEN isodow(d) >= 6 THEN 1.12 ELSE 1 END AS weekend FROM cal)
SELECT CAST(d AS VARCHAR) AS full_date, round(CAST(season AS DOUBLE) * growth * CAST(campaign AS DOUBLE) * CAST(payday AS DOUBLE) * CAST(weekend AS DOUBLE), 6) AS multiplier FROM f""")
def demand_drivers(spark, d):
    """Expected-demand multiplier per calendar day."""
    return calendar_of(spark, d).select("full_date", F.round(S.demand_multiplier(F.col("full_date")), 6).alias("multiplier"))
