"""Demand series, segmentation, inventory and time-series features over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators import demand as D
from marketloom.operators import features as X
from marketloom.operators import inventory as I
from marketloom.operators import latest as L
from marketloom.operators import reconcile as R
from marketloom.plans import marts
from marketloom.plans.registry import query
from marketloom.plans.sales_queries import two_origins
from marketloom.plans.sql_parts import DAILY, DEMAND, LINES, LIVE_DEMAND, SNAPSHOTS, segments
from marketloom.session import materialise
from marketloom.sources import tables as T


def sku_lines(spark: SparkSession, d: str) -> DataFrame:
    return T.order_lines(spark, d, product=True)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return X.daily_history(sku_lines(spark, d))


def live_segments(spark: SparkSession, d: str, policy: D.SegmentPolicy = D.WAREHOUSE) -> DataFrame:
    return D.abc_xyz(D.demand_rows(sku_lines(spark, d)), policy)


@query("dense_daily_demand", f"""WITH {DAILY} SELECT sku, CAST(date AS VARCHAR) AS date, daily_demand, daily_revenue, round(avg_unit_price, 6) AS avg_unit_price, total_discount, order_count FROM daily""")
def dense_daily_demand(spark, d):
    """One row per SKU and calendar day; unsold days are zero, the price is carried forward."""
    return daily(spark, d).select("sku", "date", "daily_demand", "daily_revenue", F.round("avg_unit_price", 6).alias("avg_unit_price"), "total_discount", "order_count")


@query("price_ffill", f"""WITH {DAILY}, b AS (SELECT g.sku, g.date, s.avg_unit_price AS p FROM grid g LEFT JOIN sold s ON s.sku = g.sku AND s.date = g.date)
SELECT sku, CAST(date AS VARCHAR) AS date, round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY sku ORDER BY date ROWS UNBOUNDED PRECEDING), 0), 6) AS forward_price,
  round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY sku ORDER BY date ROWS UNBOUNDED PRECEDING),
    first_value(p IGNORE NULLS) OVER (PARTITION BY sku ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS served_price FROM b""")
def price_ffill(spark, d):
    """Training fill (forward, then zero) and serving fill (forward, then backward)."""
    lines = sku_lines(spark, d)
    first, last = D.date_bounds(lines)
    sold = D.daily_metrics(lines).select("sku", "date", "avg_unit_price")
    both = D.dense_daily(sold, first, last).select("sku", "date", F.round("avg_unit_price", 6).alias("forward_price"))
    served = D.dense_daily(sold, first, last, price_fill="both").select("sku", "date", F.round("avg_unit_price", 6).alias("served_price"))
    return both.join(served, ["sku", "date"])


SEG_OUT = """data_origin, sku, product_name, category, CAST(revenue AS DOUBLE) AS revenue, CAST(total_units AS BIGINT) AS total_units, cum_share, abc_class,
  round(mean_demand, 6) AS avg_daily_demand, round(std_demand, 6) AS std_daily_demand, round(cv, 6) AS cv_volatility, xyz_class, matrix_segment, CAST(safety_stock AS BIGINT) AS safety_stock, CAST(reorder_point AS BIGINT) AS reorder_point"""


def segment_columns(s: DataFrame) -> DataFrame:
    return s.select(
        "data_origin", "sku", "product_name", "category", "revenue", F.col("total_units").cast("long").alias("total_units"), "cum_share", "abc_class",
        F.round("mean_demand_exact", 6).alias("avg_daily_demand"), F.round("std_demand_exact", 6).alias("std_daily_demand"), F.round("cv", 6).alias("cv_volatility"), "xyz_class",
        "matrix_segment", "safety_stock", "reorder_point")


@query("abc_xyz_by_origin", f"WITH {DEMAND}, {segments('demand')} SELECT {SEG_OUT} FROM segments")
def abc_xyz_by_origin(spark, d):
    """ABC/XYZ of the live origin (by revenue) and of the imported origin (by units)."""
    return segment_columns(D.abc_xyz(two_origins(spark, d)))


@query("abc_xyz_classifier", f"WITH {LIVE_DEMAND}, {segments('demand', z='1.65', floor=False)} SELECT {SEG_OUT} FROM segments")
def abc_xyz_classifier(spark, d):
    """The same segmentation with the classifier's policy: Z 1.65 and no floors."""
    return segment_columns(live_segments(spark, d, D.CLASSIFIER))


@query("abc_xyz_summary", f"""WITH {LIVE_DEMAND}, {segments('demand')}, l AS (SELECT 'abc' AS level, abc_class AS name, abc_weight, cv FROM segments UNION ALL SELECT 'xyz', xyz_class, abc_weight, cv FROM segments
  UNION ALL SELECT 'matrix', matrix_segment, abc_weight, cv FROM segments),
listed AS (SELECT 'abc' AS level, unnest(['A', 'B', 'C']) AS name UNION ALL SELECT 'xyz', unnest(['X', 'Y', 'Z']) UNION ALL SELECT 'matrix', unnest(['AX', 'AY', 'AZ', 'BX', 'BY', 'BZ', 'CX', 'CY', 'CZ']))
SELECT d.level, d.name, count(l.cv) AS sku_count, round(count(l.cv) * 100.0 / (SELECT count(*) FROM segments), 2) AS sku_pct,
  round(coalesce(CAST(sum(l.abc_weight) AS DOUBLE), 0) * 100 / (SELECT CAST(sum(abc_weight) AS DOUBLE) FROM segments), 2) AS revenue_pct, round(coalesce(avg(l.cv), 0), 2) AS avg_cv FROM listed d LEFT JOIN l USING (level, name) GROUP BY 1, 2""")
def abc_xyz_summary(spark, d):
    """Counts and shares of the classes and of all nine cells."""
    return D.nine_box_summary(materialise(live_segments(spark, d), "segments"))


@query("abc_xyz_pivot", f"""WITH {LIVE_DEMAND}, {segments('demand')}, t AS (SELECT CAST(sum(abc_weight) AS DOUBLE) AS w FROM segments)
SELECT a.abc_class, """ + ", ".join(f"count(*) FILTER (s.xyz_class = '{x}') AS skus_{x.lower()}, coalesce(round(CAST(sum(s.abc_weight) FILTER (s.xyz_class = '{x}') AS DOUBLE) * 100 / (SELECT w FROM t), 1), 0) AS revenue_pct_{x.lower()}" for x in "XYZ")
       + " FROM (SELECT unnest(['A', 'B', 'C']) AS abc_class) a LEFT JOIN segments s USING (abc_class) GROUP BY 1")
def abc_xyz_pivot(spark, d):
    return D.nine_box_pivot(materialise(live_segments(spark, d), "segments"))


@query("sku_recommendation", f"""WITH {LIVE_DEMAND}, {segments('demand')} SELECT sku, matrix_segment, CAST(CASE WHEN xyz_class = 'X' THEN 1.645 ELSE 1.96 END AS DOUBLE) AS stability_z,
  CASE abc_class || xyz_class WHEN 'AX' THEN 'LightGBM / ARIMA / Exponential Smoothing (Độ chính xác rất cao)' WHEN 'AY' THEN 'XGBoost / LightGBM tích hợp feature khuyến mãi, ngày đôi' WHEN 'AZ' THEN 'Deep Learning (LSTM/GRU) hoặc Mô hình tổng hợp Ensemble'
  WHEN 'BX' THEN 'LightGBM Baseline / Random Forest' WHEN 'BY' THEN 'LightGBM / Prophet với đặc trưng chuỗi thời gian' WHEN 'BZ' THEN 'XGBoost kết hợp phân loại xác suất phát sinh nhu cầu (Two-stage)' WHEN 'CX' THEN 'Heuristic trung bình trượt / Moving Average'
  WHEN 'CY' THEN 'Mô hình giản đơn hoặc phân tích mùa vụ đơn giản' ELSE 'Phát hiện nhu cầu gián đoạn (Croston''s Method) hoặc tồn kho tối thiểu' END AS recommended_model FROM segments""")
def sku_recommendation(spark, d):
    out = D.with_recommendation(live_segments(spark, d))
    return out.select("sku", "matrix_segment", S.z_for_stability(F.col("xyz_class")).alias("stability_z"), "recommended_model")


@query("class_a_policy", f"WITH {LIVE_DEMAND}, {segments('demand')} SELECT sku, matrix_segment, CAST(safety_stock AS BIGINT) AS safety_stock, CAST(reorder_point AS BIGINT) AS reorder_point FROM segments WHERE abc_class = 'A' ORDER BY revenue DESC, sku LIMIT 10")
def class_a_policy(spark, d):
    """Policy of the ten strongest class-A SKUs."""
    return live_segments(spark, d).filter("abc_class = 'A'").orderBy(F.col("revenue").desc(), "sku").limit(10).select("sku", "matrix_segment", "safety_stock", "reorder_point")


@query("mart_products", f"""WITH {LIVE_DEMAND}, {segments('demand')}, k AS (SELECT p_brand || ' ' || p_type AS sku, min(p_partkey) AS product_key, max(p_name) AS product_name, min(p_type) AS category FROM part GROUP BY 1)
SELECT k.product_key, k.sku, k.product_name, k.category, coalesce(round(s.mean_demand, 2), 0) AS base_demand, coalesce(round(s.std_demand, 2), 0) AS sigma, coalesce(s.matrix_segment, 'NA') AS matrix_segment FROM k LEFT JOIN segments s USING (sku)""")
def mart_products(spark, d):
    """Product mart with segment, NA where a product never sold."""
    return marts.product_mart(product_table(spark, d), live_segments(spark, d))


def product_table(spark, d) -> DataFrame:
    return T.products(spark, d).groupBy("sku").agg(F.min("part_key").alias("product_key"), F.max("product_name").alias("product_name"), F.min("category").alias("category"))


# ---- inventory --------------------------------------------------------------------------

@query("inventory_latest", f"WITH {SNAPSHOTS} SELECT sku, CAST(current_stock AS BIGINT) AS current_stock, CAST(last_audited_date AS VARCHAR) AS last_audited_date FROM stock")
def inventory_latest(spark, d):
    return I.latest_stock(I.daily_snapshots(T.snapshots(spark, d), ["event_id"]))


@query("inventory_latest_ranked", f"WITH {SNAPSHOTS} SELECT sku, CAST(current_stock AS BIGINT) AS current_stock, CAST(last_audited_date AS VARCHAR) AS last_audited_date FROM stock")
def inventory_latest_ranked(spark, d):
    """The same stock by row number."""
    return I.latest_stock_ranked(I.daily_snapshots(T.snapshots(spark, d), ["event_id"]))


HEALTH_SQL = f"""{LIVE_DEMAND}, {segments('demand')}, {SNAPSHOTS},
health AS (SELECT i.sku, s.product_name, s.category, s.matrix_segment, i.current_stock, s.mean_demand, s.safety_stock, s.reorder_point,
  CASE WHEN i.current_stock <= s.safety_stock THEN 'CRITICAL' WHEN i.current_stock <= s.reorder_point THEN 'WARNING' ELSE 'NORMAL' END AS alert_level,
  i.current_stock <= s.reorder_point AS needs_reorder, round(i.current_stock / nullif(s.mean_demand, 0) + 1e-9, 1) AS days_until_stockout,
  CASE WHEN i.current_stock <= s.reorder_point THEN greatest(0, s.reorder_point + ceil(round(s.mean_demand * 7, 9)) - i.current_stock) ELSE 0 END AS qty, i.last_audited_date
  FROM stock i JOIN segments s USING (sku))"""


def health(spark, d) -> DataFrame:
    stock = I.latest_stock(I.daily_snapshots(T.snapshots(spark, d), ["event_id"]))
    return I.health(stock, live_segments(spark, d))


@query("inventory_health", f"""WITH {HEALTH_SQL} SELECT sku, product_name, category, matrix_segment, CAST(current_stock AS BIGINT) AS current_stock, round(mean_demand, 6) AS avg_daily_demand, CAST(safety_stock AS BIGINT) AS safety_stock,
  CAST(reorder_point AS BIGINT) AS reorder_point, alert_level, needs_reorder, days_until_stockout, CAST(qty AS BIGINT) AS recommended_reorder_qty, CAST(last_audited_date AS VARCHAR) AS last_audited_date FROM health""")
def inventory_health(spark, d):
    """Stock against the SQL policy, most urgent first."""
    return health(spark, d).withColumn("avg_daily_demand", F.round("avg_daily_demand", 6)).orderBy(*I.alert_order())


@query("alert_counts", f"""WITH {HEALTH_SQL} SELECT count(*) AS total_skus, count(*) FILTER (alert_level <> 'NORMAL') AS skus_needing_reorder, count(*) FILTER (alert_level = 'CRITICAL') AS critical_count,
  count(*) FILTER (alert_level = 'WARNING') AS warning_count, count(*) FILTER (alert_level = 'NORMAL') AS normal_count, CAST(sum(current_stock) AS BIGINT) AS total_stock, CAST(sum(qty) AS BIGINT) AS total_reorder_qty FROM health""")
def alert_counts(spark, d):
    return I.alert_summary(health(spark, d))


RECENT_SQL = """last AS (SELECT max(date) AS d FROM daily), recent AS (SELECT sku, avg(daily_demand) AS hist_mean, coalesce(stddev_samp(daily_demand), 0) AS hist_std FROM daily, last WHERE date > last.d - 28 GROUP BY 1)"""


@query("reorder_alerts", f"""WITH {DAILY}, {RECENT_SQL}, {SNAPSHOTS}, f AS (SELECT sku, avg(daily_demand) AS fm FROM daily, last WHERE date > last.d - 8 AND date <= last.d - 1 GROUP BY 1 HAVING sum(daily_demand) > 0),
asked AS (SELECT DISTINCT sku, CAST(40 AS INTEGER) AS q FROM recent WHERE starts_with(sku, 'Brand#7 ')),
j AS (SELECT r.sku, coalesce(f.fm, r.hist_mean) AS m, r.hist_std AS sg, CASE WHEN f.fm IS NOT NULL THEN 'model_forecast' ELSE 'warehouse_history' END AS demand_source, coalesce(a.q, s.current_stock) AS stock,
  CASE WHEN a.q IS NOT NULL THEN 'request' WHEN s.current_stock IS NOT NULL THEN 'warehouse_snapshot:' || CAST(s.last_audited_date AS VARCHAR) ELSE 'none' END AS stock_source
  FROM recent r LEFT JOIN f USING (sku) LEFT JOIN stock s USING (sku) LEFT JOIN asked a USING (sku)),
p AS (SELECT *, greatest(1, ceil(round(1.645 * sg * sqrt(3), 9))) AS ss FROM j), q AS (SELECT *, greatest(ss + 1, ceil(round(m * 3 + ss, 9))) AS rop FROM p)
SELECT sku, CAST(stock AS BIGINT) AS current_stock, round(m, 1) AS avg_daily_demand, CAST(ss AS BIGINT) AS safety_stock, CAST(rop AS BIGINT) AS reorder_point, stock <= rop AS needs_reorder,
  CASE WHEN stock IS NULL THEN 'NO_DATA' WHEN stock <= ss THEN 'CRITICAL' WHEN stock <= rop THEN 'WARNING' ELSE 'NORMAL' END AS alert_level, round(stock / greatest(m, 0.1) + 1e-9, 1) AS days_until_stockout,
  CAST(CASE WHEN stock <= rop THEN greatest(0, rop + ceil(round(m * 7, 9)) - stock) ELSE 0 END AS BIGINT) AS recommended_reorder_qty, stock_source, demand_source FROM q""")
def reorder_alerts(spark, d):
    """Reorder evaluation of every SKU: moving-average forecast mean where there is one, 28-day deviation, requested stock first."""
    demand, skus = policy_demand(spark, d)
    stock = I.latest_stock(I.daily_snapshots(T.snapshots(spark, d), ["event_id"]))
    asked = skus.filter(F.col("sku").startswith("Brand#7 ")).select("sku", F.lit(40).alias("current_stock"))
    return I.reorder_evaluation(demand, I.stock_source(skus, stock, asked)).orderBy(*I.alert_order())


def policy_demand(spark, d) -> tuple[DataFrame, DataFrame]:
    recent = materialise(I.recent_demand(sku_lines(spark, d)), "recent")
    return I.demand_source(recent.drop("forecast_mean"), recent.select("sku", "forecast_mean")), recent.select("sku")


@query("policy_demand_source", f"""WITH {DAILY}, {RECENT_SQL}, f AS (SELECT sku, avg(daily_demand) AS fm FROM daily, last WHERE date > last.d - 8 AND date <= last.d - 1 GROUP BY 1 HAVING sum(daily_demand) > 0)
SELECT r.sku, round(coalesce(f.fm, r.hist_mean), 6) AS avg_demand, round(r.hist_std, 6) AS sigma, CASE WHEN f.fm IS NOT NULL THEN 'model_forecast' ELSE 'warehouse_history' END AS demand_source FROM recent r LEFT JOIN f USING (sku)""")
def policy_demand_source(spark, d):
    demand, _ = policy_demand(spark, d)
    return demand.select("sku", F.round("avg_demand", 6).alias("avg_demand"), F.round("sigma", 6).alias("sigma"), "demand_source")


@query("policy_table", """WITH l AS (SELECT unnest([0.50, 0.80, 0.83, 0.85, 0.90, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995]) AS level),
z AS (SELECT level, CASE WHEN level <= 0.80 THEN 0.842 WHEN level <= 0.85 THEN 1.036 WHEN level <= 0.90 THEN 1.282 WHEN level <= 0.95 THEN 1.645 WHEN level <= 0.98 THEN 2.054 WHEN level <= 0.99 THEN 2.326 ELSE 1.645 END AS z FROM l)
SELECT p_partkey AS part_key, CAST(level AS DOUBLE) AS service_level, CAST(z AS DOUBLE) AS z, CAST(greatest(1, ceil(round(z * p_size * sqrt(p_partkey % 30 + 1), 9))) AS BIGINT) AS safety_stock FROM part, z WHERE CAST(p_partkey % 11 AS INTEGER) + 1 = list_position([0.50, 0.80, 0.83, 0.85, 0.90, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995], level)""")
def policy_table(spark, d):
    """Safety stock with per-row service level and lead time."""
    levels = F.array(*[F.lit(x) for x in (0.50, 0.80, 0.83, 0.85, 0.90, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995)])
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), "p_size", F.element_at(levels, (F.col("p_partkey") % 11 + 1).cast("int")).alias("service_level"))
    z = S.z_for_service(F.col("service_level"))
    lead = (F.col("part_key") % 30 + 1).cast("double")
    return p.select("part_key", "service_level", z.alias("z"), S.safety_stock(F.col("p_size").cast("double"), z, lead).alias("safety_stock"))


@query("stock_ledger", f"""WITH m AS (SELECT event_id AS movement_id, {'{}'} AS sku, ts, event_type, CAST(floor(value) AS BIGINT) AS q FROM events),
s AS (SELECT *, CASE event_type WHEN 'purchase' THEN -q WHEN 'error' THEN 0 ELSE q END AS delta FROM m)
SELECT movement_id, sku, CAST(sum(delta) OVER w AS BIGINT) AS stock_after, CAST(sum(delta) OVER w - delta AS BIGINT) AS stock_before FROM s WINDOW w AS (PARTITION BY sku ORDER BY ts, movement_id ROWS UNBOUNDED PRECEDING)""".format(
    __import__("marketloom.plans.sql_parts", fromlist=["USER_SKU"]).USER_SKU))
def stock_ledger(spark, d):
    """Running stock balance before and after every movement."""
    return I.stock_ledger(T.movements(spark, d)).select("movement_id", "sku", "stock_after", "stock_before")


# ---- features ---------------------------------------------------------------------------

ROLL = ", ".join(
    f"round(avg(daily_demand) OVER r{n}, 6) AS rolling_mean_{n}, round(coalesce(stddev_samp(daily_demand) OVER r{n}, 0), 6) AS rolling_std_{n}, max(daily_demand) OVER r{n} AS rolling_max_{n}, min(daily_demand) OVER r{n} AS rolling_min_{n}"
    for n in (7, 14, 28))
LAGS = ", ".join(f"lag(daily_demand, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28))
WINDOWS = "WINDOW w AS (PARTITION BY sku ORDER BY date), " + ", ".join(f"r{n} AS (PARTITION BY sku ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 28))
FEATURES_SQL = f"""{DAILY}, features AS (SELECT *, {LAGS}, {ROLL}, lead(daily_demand) OVER w AS target_t_plus_1 FROM daily {WINDOWS})"""


def rounded(df: DataFrame) -> DataFrame:
    """Six places; exponential averages are dyadic and would tie, so they get a margin above float noise."""
    return df.withColumns({c: F.round(F.col(c) + (1e-10 if c.startswith("ema") else 0.0), 6) for c in df.columns if c.startswith(("rolling_mean", "rolling_std", "growth", "ema", "avg_unit_price", "cv"))})


@query("ts_features", f"WITH {FEATURES_SQL} SELECT CAST(date AS VARCHAR) AS date, * EXCLUDE (date, daily_revenue, avg_unit_price, total_discount, order_count), round((lag_1 - lag_7) / (lag_7 + 1.0), 6) AS growth_wow FROM features")
def ts_features(spark, d):
    """Lags, rolling statistics of previous days, growth and next-day target."""
    out = X.window_features(daily(spark, d).select("sku", "date", "daily_demand"))
    return rounded(out)


def _ema_step(s: int) -> str:
    return f"e.ema_{s} * {1 - 2 / (s + 1)!r} + o.y * {2 / (s + 1)!r}"


@query("ts_ema", f"""WITH RECURSIVE {DAILY}, o AS (SELECT sku, date, CAST(daily_demand AS DOUBLE) AS y, row_number() OVER (PARTITION BY sku ORDER BY date) AS k FROM daily),
e AS (SELECT sku, k, y AS ema_7, y AS ema_14 FROM o WHERE k = 1 UNION ALL SELECT o.sku, o.k, {_ema_step(7)}, {_ema_step(14)} FROM e JOIN o ON o.sku = e.sku AND o.k = e.k + 1)
SELECT o.sku, CAST(o.date AS VARCHAR) AS date, round(e.ema_7 + 1e-10, 6) AS ema_7, round(e.ema_14 + 1e-10, 6) AS ema_14 FROM o LEFT JOIN e ON e.sku = o.sku AND e.k = o.k - 1""")
def ts_ema(spark, d):
    """Exponential averages of all previous days."""
    return rounded(X.ema_features(daily(spark, d).select("sku", "date", "daily_demand"))).select("sku", "date", "ema_7", "ema_14")


@query("ts_calendar", f"""WITH {DAILY}, t AS (SELECT DISTINCT date, date + 1 AS t FROM daily) SELECT CAST(date AS VARCHAR) AS date, isodow(date) - 1 AS day_of_week, CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, day(date) AS day_of_month, month(date) AS month, quarter(date) AS quarter,
  CAST(day(date) = month(date) AS BIGINT) AS is_mega_sale, isodow(t) - 1 AS target_day_of_week, CAST(isodow(t) >= 6 AS BIGINT) AS target_is_weekend, day(t) AS target_day_of_month, CAST(day(t) = month(t) AS BIGINT) AS target_is_mega_sale FROM t""")
def ts_calendar(spark, d):
    """Calendar features of each day and of the day after it."""
    return X.calendar_features(daily(spark, d).select("date").distinct())


@query("ts_target", f"""WITH {DAILY}, f AS (SELECT sku, date, lead(daily_demand) OVER (PARTITION BY sku ORDER BY date) AS t FROM daily), v AS (SELECT * FROM f WHERE t IS NOT NULL)
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS without_next_day, CAST(0 AS BIGINT) AS different FROM v""")
def ts_target(spark, d):
    """The stored target equals the demand of the following day."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    return R.target_check(X.window_features(series, lags=(1,), windows=()).dropna(subset=["target_t_plus_1"]), series)


CUT_SQL = f"""fit AS (SELECT 'x' AS data_origin, sku, product_name, category, order_date, CAST(quantity AS DECIMAL(18,0)) AS q, CAST(buyer_total_amount AS DECIMAL(18,2)) AS r FROM lines
  WHERE NOT is_cancelled AND order_date < (SELECT max(order_date) - 49 FROM lines)), {segments('fit', z='1.65', floor=False, prefix='fit_')}"""


@query("segment_cutoff", f"WITH {LINES} SELECT CAST(min(order_date) AS VARCHAR) AS first_day, CAST(max(order_date) AS VARCHAR) AS last_day, CAST(max(order_date) - 49 AS VARCHAR) AS cutoff FROM lines")
def segment_cutoff(spark, d):
    """Last day segments may be fitted on."""
    lines = T.order_lines(spark, d)
    return lines.agg(F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day")).withColumn("cutoff", X.segment_cutoff(lines))


@query("encode_segments", f"""WITH {LINES}, {CUT_SQL}, s AS (SELECT DISTINCT sku, category FROM lines) SELECT s.sku, s.category, coalesce(abc_class, 'C') AS abc_class, coalesce(xyz_class, 'Z') AS xyz_class, coalesce(matrix_segment, 'CZ') AS matrix_class,
  CAST(list_position(['A', 'B', 'C'], coalesce(abc_class, 'C')) - 1 AS BIGINT) AS abc_class_code, CAST(list_position(['X', 'Y', 'Z'], coalesce(xyz_class, 'Z')) - 1 AS BIGINT) AS xyz_class_code,
  CAST(list_position(['AX', 'AY', 'AZ', 'BX', 'BY', 'BZ', 'CX', 'CY', 'CZ'], coalesce(matrix_segment, 'CZ')) - 1 AS BIGINT) AS matrix_class_code, dense_rank() OVER (ORDER BY s.category) - 1 AS category_code FROM s LEFT JOIN fit_segments USING (sku)""")
def encode_segments(spark, d):
    """Segments fitted before the hold-out, with their fixed codes, and the category code."""
    lines = sku_lines(spark, d)
    fitted = D.abc_xyz(D.demand_rows(lines.filter(F.col("create_time").cast("date") < X.segment_cutoff(lines))), D.CLASSIFIER)
    coded = X.encode_segments(X.attach_segments(lines.select("sku", "category").distinct(), fitted))
    return X.encode_category(coded).drop("cv", "safety_stock")


LINE_ORDER = ("order_key", "line_number", "part_key")


def feature_store(spark, d) -> DataFrame:
    return X.build_feature_store(sku_lines(spark, d), order=LINE_ORDER)


STORE_SQL = f"""{FEATURES_SQL}, {CUT_SQL}, store AS (SELECT f.*, date + 1 AS target_date, coalesce(abc_class, 'C') AS abc_class, coalesce(xyz_class, 'Z') AS xyz_class, coalesce(matrix_segment, 'CZ') AS matrix_class, coalesce(cv, 0) AS cv,
  CAST(coalesce(safety_stock, 0) AS DOUBLE) AS safety_stock FROM features f LEFT JOIN (SELECT sku, abc_class, xyz_class, matrix_segment, cv, safety_stock FROM fit_segments) USING (sku) WHERE lag_28 IS NOT NULL AND target_t_plus_1 IS NOT NULL)"""


# Everything the store holds: recursion for the exponential averages, plain windows for the rest.
WHOLE_STORE_SQL = f"""{STORE_SQL}, ord AS (SELECT sku, date, CAST(daily_demand AS DOUBLE) AS y, row_number() OVER (PARTITION BY sku ORDER BY date) AS k FROM daily),
e AS (SELECT sku, k, y AS ema_7, y AS ema_14 FROM ord WHERE k = 1 UNION ALL SELECT o.sku, o.k, {_ema_step(7)}, {_ema_step(14)} FROM e JOIN ord o ON o.sku = e.sku AND o.k = e.k + 1),
names AS (SELECT sku, product_name, category FROM lines QUALIFY row_number() OVER (PARTITION BY sku ORDER BY order_key, line_number, part_key) = 1),
coded AS (SELECT *, dense_rank() OVER (ORDER BY category) - 1 AS category_code FROM names),
whole AS (SELECT s.* EXCLUDE (target_date, date, avg_unit_price, cv), s.date, round(s.avg_unit_price, 6) AS avg_unit_price, round(s.cv, 6) AS cv, round((lag_1 - lag_7) / (lag_7 + 1.0), 6) AS growth_wow, round(e.ema_7 + 1e-10, 6) AS ema_7, round(e.ema_14 + 1e-10, 6) AS ema_14,
  isodow(s.date) - 1 AS day_of_week, CAST(isodow(s.date) >= 6 AS BIGINT) AS is_weekend, day(s.date) AS day_of_month, month(s.date) AS month, quarter(s.date) AS quarter, CAST(day(s.date) = month(s.date) AS BIGINT) AS is_mega_sale,
  isodow(s.target_date) - 1 AS target_day_of_week, CAST(isodow(s.target_date) >= 6 AS BIGINT) AS target_is_weekend, day(s.target_date) AS target_day_of_month, CAST(day(s.target_date) = month(s.target_date) AS BIGINT) AS target_is_mega_sale,
  CAST(list_position(['A', 'B', 'C'], s.abc_class) - 1 AS BIGINT) AS abc_class_code, CAST(list_position(['X', 'Y', 'Z'], s.xyz_class) - 1 AS BIGINT) AS xyz_class_code,
  CAST(list_position(['AX', 'AY', 'AZ', 'BX', 'BY', 'BZ', 'CX', 'CY', 'CZ'], s.matrix_class) - 1 AS BIGINT) AS matrix_class_code, c.product_name, c.category, c.category_code
  FROM store s JOIN ord o ON o.sku = s.sku AND o.date = s.date JOIN e ON e.sku = s.sku AND e.k = o.k - 1 JOIN coded c ON c.sku = s.sku)"""


@query("feature_store", f"""WITH RECURSIVE {WHOLE_STORE_SQL} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM whole""")
def feature_store_query(spark, d):
    """All columns of the feature store, burn-in removed."""
    return rounded(feature_store(spark, d))


@query("sku_profile", f"""WITH {STORE_SQL} SELECT sku, abc_class, xyz_class, matrix_class, round(cv, 6) AS cv, safety_stock FROM store QUALIFY row_number() OVER (PARTITION BY sku ORDER BY date DESC) = 1""")
def sku_profile(spark, d):
    return rounded(X.sku_profiles(feature_store(spark, d))).drop("product_name", "category")


FEATURE_COLUMNS = ",".join([
    "daily_demand", "daily_revenue", "avg_unit_price", "total_discount", "order_count", *[f"lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28)],
    *[f"rolling_{s}_{n}" for n in (7, 14, 28) for s in ("mean", "std", "max", "min")], "growth_wow", "ema_7", "ema_14", "day_of_week", "is_weekend", "day_of_month", "month", "quarter", "is_mega_sale",
    "target_day_of_week", "target_is_weekend", "target_day_of_month", "target_is_mega_sale", "cv", "safety_stock", "abc_class_code", "xyz_class_code", "matrix_class_code", "category_code"])


@query("feature_contract", f"""WITH {STORE_SQL}, names AS (SELECT sku, product_name, category FROM lines QUALIFY row_number() OVER (PARTITION BY sku ORDER BY order_key, line_number, part_key) = 1),
coded AS (SELECT *, dense_rank() OVER (ORDER BY category) - 1 AS code FROM names),
p AS (SELECT s.sku, abc_class, xyz_class, matrix_class, CAST(round(cv * 1000000) AS BIGINT) AS cv, CAST(safety_stock AS BIGINT) AS stock FROM store s QUALIFY row_number() OVER (PARTITION BY s.sku ORDER BY date DESC) = 1)
SELECT 'sku' AS kind, p.sku AS entry, concat_ws('|', c.product_name, c.category, abc_class, xyz_class, matrix_class, CAST(cv AS VARCHAR), CAST(stock AS VARCHAR)) AS told FROM p JOIN coded c ON c.sku = p.sku
UNION ALL SELECT DISTINCT 'category', c.category, CAST(c.code AS VARCHAR) FROM coded c JOIN p ON p.sku = c.sku
UNION ALL SELECT 'contract', 'contract', concat_ws('|', 'target_t_plus_1', '{FEATURE_COLUMNS}', '1,2,3,7,14,21,28', '7,14,28', '7,14', 'ds-1,ds-2', '2 1 8', CAST((SELECT max(order_date) - 49 FROM lines) AS VARCHAR), 'warehouse', 'unverified_warehouse')""")
def feature_contract(spark, d):
    """Feature contract: header with columns, parameters, codes and source, codes of the categories, one profile per SKU."""
    store = materialise(feature_store(spark, d), "features")
    source = X.Source("warehouse", "unverified_warehouse", ("ds-2", "ds-1", "ds-2"))
    rows = X.feature_contract(store, X.segment_cutoff(T.order_lines(spark, d)), source, generated_at=F.lit("2024-01-01").cast("timestamp"))
    head = F.from_json("body", "target_column string, feature_columns array<string>, lags array<string>, rolling_windows array<string>, ema_spans array<string>, source_datasets array<string>, "
                               "category_mappings struct<abc_class: map<string, string>, xyz_class: map<string, string>, matrix_class: map<string, string>>, segment_cutoff_date string, data_source string, data_origin string")
    one = F.from_json("body", "product_name string, category string, abc_class string, xyz_class string, matrix_class string, cv double, safety_stock double")
    text = lambda c: F.array_join(c, ",")
    codes = head["category_mappings"]
    told = F.when(F.col("kind") == "category", F.get_json_object("body", "$.code")).when(F.col("kind") == "sku", F.concat_ws(
        "|", one["product_name"], one["category"], one["abc_class"], one["xyz_class"], one["matrix_class"], F.round(one["cv"] * 1_000_000).cast("long").cast("string"), one["safety_stock"].cast("long").cast("string"))).otherwise(F.concat_ws(
            "|", head["target_column"], *[text(head[c]) for c in ("feature_columns", "lags", "rolling_windows", "ema_spans", "source_datasets")],
            F.concat_ws(" ", codes["abc_class"]["C"], codes["xyz_class"]["Y"], codes["matrix_class"]["CZ"]), head["segment_cutoff_date"], head["data_source"], head["data_origin"]))
    return rows.select("kind", "entry", told.alias("told"))


@query("zero_demand", f"WITH {DAILY} SELECT count(*) AS rows, count(DISTINCT sku) AS skus, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, round(avg(CASE WHEN daily_demand = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction FROM daily")
def zero_demand(spark, d):
    """Extent of the daily series and the share of days without demand."""
    return daily(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sku").alias("skus"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                               F.round(F.avg((F.col("daily_demand") == 0).cast("int")), 6).alias("zero_fraction"))


@query("history_consistency", f"""WITH {DAILY} SELECT count(*) FILTER (date > (SELECT lo + 27 FROM span) AND date < (SELECT hi FROM span)) AS rows, CAST(0 AS BIGINT) AS without_source, CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS not_close FROM daily""")
def history_consistency(spark, d):
    """Feature rows against the daily history, one to one."""
    series = materialise(daily(spark, d), "daily")
    store = X.window_features(series).dropna(subset=["lag_28", "target_t_plus_1"])
    return R.consistency(store, series)


@query("seq_windows", f"""WITH {DAILY}, s AS (SELECT sku, date, daily_demand AS target, list(daily_demand) OVER w AS a, list(order_count) OVER w AS b FROM daily WINDOW w AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT sku, CAST(date AS VARCHAR) AS date, target, array_to_string(list_transform(a, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS demand_steps, array_to_string(list_transform(b, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS order_steps FROM s WHERE len(a) = 14""")
def seq_windows(spark, d):
    """Sliding windows of 14 days with the following day's demand as target."""
    w = X.sequence_windows(daily(spark, d), ["daily_demand", "order_count"])
    text = lambda i: F.array_join(F.transform("steps", lambda s: s[i].cast("long").cast("string")), ",")
    return w.select("sku", "date", "target", text(0).alias("demand_steps"), text(1).alias("order_steps"))
