"""Back-tests, metrics, forecasts against actuals, readiness, drift and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators import demand as D
from marketloom.operators import drift as DR
from marketloom.operators import features as X
from marketloom.operators import forecast as P
from marketloom.operators import merge as M
from marketloom.operators import models
from marketloom.operators import monitor
from marketloom.operators.inventory import recent_demand
from marketloom.plans import marts
from marketloom.plans.demand_queries import DAILY, LINES, RECENT_SQL, STORE_SQL, daily, live_segments, sku_lines
from marketloom.plans.registry import query
from marketloom.plans.sql_parts import LIVE_DEMAND, RATIO_SQL, segments
from marketloom.session import materialise, new_folder
from marketloom.sources import tables as T
from marketloom.sources import warehouse as W

FOLDS_SQL = """days AS (SELECT target_date, row_number() OVER (ORDER BY target_date DESC) - 1 AS back, count(*) OVER () AS n FROM (SELECT DISTINCT date + 1 AS target_date FROM {src})),
folds AS (SELECT d.target_date, i + 1 AS fold, CASE WHEN back < 14 * i THEN NULL WHEN back < 14 * (i + 1) THEN 'test' WHEN back < 14 * (i + 1) + 7 THEN 'validation' ELSE 'train' END AS role
  FROM days d, (SELECT unnest([0, 1, 2]) AS i) WHERE n > 14 * (i + 1) + 7)"""
BASE_SQL = DAILY + """, base AS (SELECT sku, date, daily_demand, lag(daily_demand, 1) OVER w AS lag_1, lag(daily_demand, 7) OVER w AS lag_7, avg(daily_demand) OVER (PARTITION BY sku ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
  lag(daily_demand, 28) OVER w AS lag_28, lead(daily_demand) OVER w AS target_t_plus_1 FROM daily WINDOW w AS (PARTITION BY sku ORDER BY date)), ok AS (SELECT * FROM base WHERE lag_28 IS NOT NULL AND target_t_plus_1 IS NOT NULL)"""


def base_store(spark, d) -> tuple[DataFrame, DataFrame]:
    """Feature rows that the baselines need, and the written daily series behind them."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    rows = X.window_features(series, lags=(1, 7, 28), windows=(7,)).dropna(subset=["lag_28", "target_t_plus_1"])
    return rows, series


@query("walk_forward_roles", f"""WITH {BASE_SQL}, {FOLDS_SQL.format(src='ok')}
SELECT CAST(f.fold AS BIGINT) AS fold, f.role, count(*) AS rows, CAST(min(o.date + 1) AS VARCHAR) AS first_target, CAST(max(o.date + 1) AS VARCHAR) AS last_target, CAST(sum(o.target_t_plus_1) AS DOUBLE) AS demand FROM ok o JOIN folds f ON f.target_date = o.date + 1 WHERE f.role IS NOT NULL GROUP BY 1, 2""")
def walk_forward_roles(spark, d):
    """Rows per fold and role of the expanding walk-forward split."""
    rows, _ = base_store(spark, d)
    split = P.walk_forward(rows.withColumn("target_date", F.date_add("date", 1)))
    return split.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target"), F.sum("target_t_plus_1").alias("demand"))


@query("fold_fit_set", f"""WITH {BASE_SQL}, {FOLDS_SQL.format(src='ok')} SELECT CAST(f.fold AS BIGINT) AS fold, count(*) AS rows, count(DISTINCT o.sku) AS skus, CAST(max(o.date + 1) AS VARCHAR) AS fit_end FROM ok o JOIN folds f ON f.target_date = o.date + 1 WHERE f.role IN ('train', 'validation') GROUP BY 1""")
def fold_fit_set(spark, d):
    """Train and validation together, per fold."""
    rows, _ = base_store(spark, d)
    fit = P.fit_set(P.walk_forward(rows.withColumn("target_date", F.date_add("date", 1))))
    return fit.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sku").alias("skus"), F.max("target_date").alias("fit_end"))


@query("baseline_forecasts", f"""WITH {BASE_SQL} SELECT sku, CAST(date AS VARCHAR) AS date, coalesce(lag_1, 0) AS naive, coalesce(lag_7, 0) AS seasonal_naive, round(coalesce(rolling_mean_7, 0), 6) AS moving_average, target_t_plus_1 AS actual FROM ok""")
def baseline_forecasts(spark, d):
    """One-step predictions of the three baselines."""
    rows, _ = base_store(spark, d)
    return P.baseline_columns(rows).select("sku", "date", "naive", "seasonal_naive", F.round("moving_average", 6).alias("moving_average"), F.col("target_t_plus_1").alias("actual"))


METRIC_COLUMNS = """count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p) / (y + 1)) * 100, 2) AS mape,
  round(CASE WHEN sum(y) = 0 THEN 0 ELSE sum(abs(y - p)) / sum(y) * 100 END, 2) AS wape, round(CASE WHEN sum(y * y) - sum(y) * sum(y) / count(*) > 0 THEN 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) ELSE 0 END, 4) AS r2,
  round(CASE WHEN sum(y) = 0 THEN 0 ELSE sum(p - y) / sum(y) * 100 END, 2) AS bias"""
# Recursion in the check SQL: one list per SKU and fold, extended day by day.
RECURSIVE_SQL = f"""{BASE_SQL}, {FOLDS_SQL.format(src='ok')}, origin AS (SELECT fold, min(target_date) - 1 AS o FROM folds WHERE role = 'test' GROUP BY 1),
hist AS (SELECT g.fold, d.sku, g.o, list(d.daily_demand ORDER BY d.date) AS h FROM daily d JOIN origin g ON d.date <= g.o AND d.date > g.o - 120 GROUP BY ALL HAVING sum(d.daily_demand) > 0 AND max(d.date) = g.o),
steps AS (SELECT fold, sku, o, m.model, h, 0 AS k, CAST(NULL AS DOUBLE) AS p FROM hist, (SELECT unnest(['naive', 'seasonal_naive', 'moving_average']) AS model) m
  UNION ALL SELECT fold, sku, o, model, list_append(h, nxt), k + 1, nxt FROM (SELECT *, greatest(0, CASE model WHEN 'naive' THEN coalesce(h[-2], 0) WHEN 'seasonal_naive' THEN coalesce(h[-8], 0) ELSE list_avg(h[-8:-2]) END) AS nxt FROM steps WHERE k < 14)),
scored AS (SELECT s.fold, s.sku, s.model, s.k AS horizon, s.o + s.k AS target_date, s.p, k.target_t_plus_1 AS y FROM steps s JOIN ok k ON k.sku = s.sku AND k.date + 1 = s.o + s.k WHERE s.k > 0)"""


def backtest(spark, d) -> DataFrame:
    rows, series = base_store(spark, d)
    return P.recursive_backtest(rows, series)


@query("recursive_moving_average", f"WITH RECURSIVE {RECURSIVE_SQL} SELECT CAST(fold AS BIGINT) AS fold, sku, model, CAST(horizon AS BIGINT) AS horizon, CAST(target_date AS VARCHAR) AS target_date, round(p, 6) AS prediction, y AS actual FROM scored")
def recursive_moving_average(spark, d):
    """Recursive multi-step forecasts of the three baselines over all folds."""
    return backtest(spark, d).select("fold", "sku", "model", "horizon", "target_date", F.round("prediction", 6).alias("prediction"), "actual")


@query("metrics_by_fold", f"WITH RECURSIVE {RECURSIVE_SQL} SELECT model, CAST(fold AS BIGINT) AS fold, {METRIC_COLUMNS} FROM scored GROUP BY 1, 2")
def metrics_by_fold(spark, d):
    return P.metrics(backtest(spark, d), ["model", "fold"])


@query("metrics_by_horizon", f"WITH RECURSIVE {RECURSIVE_SQL} SELECT model, CAST(horizon AS BIGINT) AS horizon, {METRIC_COLUMNS} FROM scored GROUP BY 1, 2")
def metrics_by_horizon(spark, d):
    return P.metrics(backtest(spark, d), ["model", "horizon"])


@query("model_comparison", f"""WITH RECURSIVE {RECURSIVE_SQL}, f AS (SELECT model, fold, {METRIC_COLUMNS} FROM scored GROUP BY 1, 2), pooled AS (SELECT model, {METRIC_COLUMNS} FROM scored GROUP BY 1)
SELECT f.model, count(*) AS folds, round(avg(f.wape) + 1e-9, 2) AS mean_fold_wape, round(avg(f.mae) + 1e-9, 4) AS mean_fold_mae, max(p.wape) AS pooled_wape, max(p.mae) AS pooled_mae, max(p.rmse) AS pooled_rmse FROM f JOIN pooled p USING (model) GROUP BY 1""")
def model_comparison(spark, d):
    """Fold means next to pooled metrics per model."""
    return models.compare_models(materialise(backtest(spark, d), "scored"))


@query("champion", f"""WITH RECURSIVE {RECURSIVE_SQL}, pooled AS (SELECT model, {METRIC_COLUMNS} FROM scored GROUP BY 1) SELECT model, wape, mae, 'recursive_walk_forward' AS strategy FROM pooled ORDER BY wape, model LIMIT 1""")
def champion(spark, d):
    """Best run among those that used the required evaluation strategy."""
    runs = P.metrics(backtest(spark, d), ["model"]).select("model", "wape", "mae").withColumn("strategy", F.lit("recursive_walk_forward"))
    one_step = runs.withColumns({"model": F.concat("model", F.lit("_one_step")), "wape": F.col("wape") - 100, "strategy": F.lit("one_step")})
    return P.champion(runs.unionByName(one_step), strategy="recursive_walk_forward")


@query("segment_wape", f"""WITH RECURSIVE {RECURSIVE_SQL}, {segments('live', prefix='g_')}, j AS (SELECT s.*, g.matrix_segment, g.abc_class FROM scored s JOIN g_segments g USING (sku))
SELECT model, """ + ", ".join(f"round(CASE WHEN sum(y) FILTER ({c}) > 0 THEN sum(abs(y - p)) FILTER ({c}) / sum(y) FILTER ({c}) * 100 ELSE 0 END, 4) AS {n}" for n, c in (
    ("wape_ax_ay", "matrix_segment IN ('AX', 'AY')"), ("wape_az_bz", "matrix_segment IN ('AZ', 'BZ')"), ("wape_group_c", "abc_class = 'C'"))) + " FROM j GROUP BY 1")
def segment_wape(spark, d):
    """WAPE by segment group per model."""
    named = live_segments(spark, d).select("sku", "abc_class", F.col("matrix_segment").alias("matrix_class"))
    return P.segment_wape(backtest(spark, d).join(named, "sku"), ["model"])


# The live demand rows have to stand before the segments that read them.
from marketloom.plans.registry import ORACLES  # noqa: E402

ORACLES["segment_wape"] = ORACLES["segment_wape"].replace("g_bounds AS", """live AS (SELECT 'unverified_warehouse' AS data_origin, sku, product_name, category, order_date, CAST(quantity AS DECIMAL(18,0)) AS q,
  CAST(buyer_total_amount AS DECIMAL(18,2)) AS r FROM lines WHERE NOT is_cancelled),
g_bounds AS""", 1)


@query("scored_rows", f"WITH RECURSIVE {RECURSIVE_SQL} SELECT CAST(fold AS BIGINT) AS fold, count(*) AS scored_rows, count(DISTINCT sku) AS scored_skus, CAST(min(target_date) AS VARCHAR) AS test_start, CAST(max(target_date) AS VARCHAR) AS test_end FROM scored WHERE model = 'naive' GROUP BY 1")
def scored_rows(spark, d):
    """How many test rows received a prediction per fold."""
    return backtest(spark, d).filter("model = 'naive'").groupBy("fold").agg(
        F.count(F.lit(1)).alias("scored_rows"), F.count_distinct("sku").alias("scored_skus"), F.min("target_date").alias("test_start"), F.max("target_date").alias("test_end"))


# ---- trained models ---------------------------------------------------------------------

def trained(spark, d) -> tuple[DataFrame, DataFrame]:
    lines = sku_lines(spark, d)
    days = X.sku_days(lines, X.FIRST_LINE)
    series = materialise(X.daily_history(lines, days=days), "daily")
    return materialise(X.build_feature_store(lines, series, days=days), "features"), series


@query("ridge_forecast")
def ridge_forecast(spark, d):
    """Ridge regression in the recursive walk-forward back-test, metrics per fold."""
    store, series = trained(spark, d)
    return P.metrics(models.backtest_model(store, series, "ridge"), ["model", "fold"])


@query("gbt_forecast")
def gbt_forecast(spark, d):
    """Boosted trees in the recursive walk-forward back-test, metrics per fold."""
    store, series = trained(spark, d)
    return P.metrics(models.backtest_model(store, series, "gbt", {"trees": 20, "depth": 4}), ["model", "fold"])


@query("forest_forecast")
def forest_forecast(spark, d):
    """Random forest in the recursive walk-forward back-test, metrics per fold."""
    store, series = trained(spark, d)
    return P.metrics(models.backtest_model(store, series, "forest", {"trees": 20, "depth": 5}), ["model", "fold"])


@query("grid_search")
def grid_search(spark, d):
    """Walk-forward WAPE of several ridge penalties, best first."""
    store, series = trained(spark, d)
    return models.grid_search(store, series, "ridge", {"alpha": [0.1, 10.0, 1000.0]})


@query("trained_comparison")
def trained_comparison(spark, d):
    """Ridge regression and a forest next to the baselines, on the same folds and horizons."""
    store, series = trained(spark, d)
    columns = ["sku", "fold", "horizon", "target_date", "model", "prediction", "actual"]
    runs = [P.recursive_backtest(store, series), models.backtest_model(store, series, "ridge"), models.backtest_model(store, series, "forest", {"trees": 10, "depth": 5})]
    scored = runs[0].select(*columns).unionByName(runs[1].select(*columns)).unionByName(runs[2].select(*columns))
    return models.compare_models(materialise(scored, "scored"))


@query("tree_search")
def tree_search(spark, d):
    """Walk-forward errors of forests of several depths, best first."""
    store, series = trained(spark, d)
    return models.grid_search(store, series, "forest", {"trees": [8], "depth": [3, 6]})


# ---- batch forecasts --------------------------------------------------------------------

REQUEST_SQL = """req AS (SELECT p_partkey AS request_id, p_brand || ' ' || p_type AS sku, (SELECT d FROM last) + 1 - CAST(p_partkey % 5 AS INTEGER) AS from_date, (SELECT d FROM last) + CAST(p_partkey % 30 AS INTEGER) + 1 AS to_date FROM part),
win AS (SELECT r.*, least(r.from_date - 1, (SELECT d FROM last)) AS history_end FROM req r),
hist AS (SELECT w.request_id, w.sku, w.from_date, w.to_date, w.history_end, list(d.daily_demand ORDER BY d.date) AS h FROM win w JOIN daily d ON d.sku = w.sku AND d.date <= w.history_end AND d.date > w.history_end - 120 GROUP BY ALL HAVING sum(d.daily_demand) > 0),
st AS (SELECT *, list_avg(h[-28:]) AS m, coalesce(list_stddev_samp(h[-28:]), 0) AS sg FROM hist)"""


def requests(spark, d, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = series.agg(F.max("date").alias("m")).scalar()
    n = F.col("p_partkey")
    rows = T.table(spark, d, "part").select(
        n.alias("request_id"), F.concat_ws(" ", "p_brand", "p_type").alias("sku"), F.date_sub(F.date_add(last, 1), (n % 5).cast("int")).alias("from_date"), F.date_add(last, (n % 30 + 1).cast("int")).alias("to_date"))
    return rows, last


ITEM_SQL = "round(greatest(0, round(q - 1.96 * sg * w, 1)), 1) AS lower_bound, round(q + 1.96 * sg * w, 1) AS upper_bound"


@query("heuristic_forecast", f"""WITH {DAILY}, last AS (SELECT max(date) AS d FROM daily), {REQUEST_SQL.replace(" HAVING sum(d.daily_demand) > 0", "")}, i AS (SELECT *, CAST(unnest(generate_series(from_date, to_date, INTERVAL 1 DAY)) AS DATE) AS date FROM st),
f AS (SELECT *, round(greatest(0, m * CAST([0.95, 0.98, 1.02, 1.00, 1.10, 1.35, 1.25][isodow(date)] AS DOUBLE) * CASE WHEN day(date) = month(date) THEN 3.5 ELSE 1 END * CAST(CASE WHEN day(date) BETWEEN 25 AND 28 THEN 1.15 ELSE 1 END AS DOUBLE)) + 1e-9, 1) AS q,
  sqrt(CASE WHEN day(date) = month(date) THEN 3.5 ELSE 1 END) AS w FROM i)
SELECT request_id, sku, CAST(date AS VARCHAR) AS date, q AS predicted_quantity, round(greatest(0, q - 1.96 * sg * w) + 1e-9, 1) AS lower_bound, round(q + 1.96 * sg * w + 1e-9, 1) AS upper_bound FROM f""")
def heuristic_forecast(spark, d):
    """Heuristic forecast of every requested SKU and range with its interval."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    rows, last = requests(spark, d, series)
    return P.batch_forecast(rows, series, last, "heuristic").filter("history_source = 'warehouse'").select("request_id", "sku", "date", "predicted_quantity", "lower_bound", "upper_bound")


@query("batch_forecast", f"""WITH RECURSIVE {DAILY}, last AS (SELECT max(date) AS d FROM daily), {REQUEST_SQL},
steps AS (SELECT request_id, sku, from_date, to_date, history_end, h, 0 AS k, CAST(NULL AS DOUBLE) AS p FROM st
  UNION ALL SELECT request_id, sku, from_date, to_date, history_end, list_append(h, list_avg(h[-8:-2])), k + 1, list_avg(h[-8:-2]) FROM steps WHERE history_end + k < to_date),
i AS (SELECT *, round(p + 1e-9, 1) AS q FROM steps WHERE k > 0 AND history_end + k >= from_date)
SELECT request_id, sku, 'local_joblib' AS model_source, 'warehouse' AS history_source, round(sum(q), 1) AS total_quantity, count(*) AS days FROM i GROUP BY 1, 2""")
def batch_forecast(spark, d):
    """Recursive forecasts for a table of requests, totals per request."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    rows, last = requests(spark, d, series)
    return P.forecast_totals(P.batch_forecast(rows, series, last, source="local_joblib").filter("model_source = 'local_joblib'"))


@query("batch_forecast_refused", f"""WITH {DAILY}, last AS (SELECT max(date) AS d FROM daily)
SELECT p_partkey AS request_id, ['TOO_MANY_STEPS', 'RANGE_REVERSED', 'RANGE_OVER_90_DAYS', ''][CAST(p_partkey % 4 AS INTEGER) + 1] AS reason, CASE WHEN p_partkey % 4 = 3 THEN 3 ELSE 0 END AS days FROM part""")
def batch_forecast_refused(spark, d):
    """Requests that break a rule come back with the rule, beside those that are answered."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    last = series.agg(F.max("date").alias("m")).scalar()
    n = F.col("p_partkey")
    pick = lambda *days: F.date_add(last, F.element_at(F.array(*map(F.lit, days)), (n % 4 + 1).cast("int")))
    rows = T.table(spark, d, "part").select(n.alias("request_id"), F.concat_ws(" ", "p_brand", "p_type").alias("sku"),
                                            pick(195, 5, 1, 1).alias("from_date"), pick(200, 2, 120, 3).alias("to_date"))
    return P.batch_forecast(rows, series, last).groupBy("request_id", "reason").agg(F.count("date").alias("days"))


@query("batch_forecast_fallback", f"""WITH {DAILY}, e AS (SELECT min(date) AS lo, max(date) AS hi FROM daily), s AS (SELECT sku, sum(daily_demand) FILTER (date = e.lo) AS first_day, sum(daily_demand) FILTER (date > e.hi - 120) AS latest FROM daily, e GROUP BY 1)
SELECT p_partkey AS request_id, CASE WHEN p_partkey % 3 = 0 OR s.sku IS NULL THEN 'heuristic_catalog' WHEN CASE WHEN p_partkey % 3 = 1 THEN first_day ELSE latest END > 0 THEN 'spark_baseline' ELSE 'heuristic_history' END AS model_source,
  CASE WHEN p_partkey % 3 = 0 OR s.sku IS NULL THEN 'none' ELSE 'warehouse' END AS history_source, CAST(2 AS BIGINT) AS days
FROM part LEFT JOIN s ON s.sku = p_brand || ' ' || p_type""")
def batch_forecast_fallback(spark, d):
    """Requests without demand in their window or without any history are answered by the labelled heuristic."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    ends = series.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    first, last = ends.select("lo").scalar(), ends.select("hi").scalar()
    n = F.col("p_partkey")
    start = F.when(n % 3 == 1, F.date_add(first, 1)).otherwise(F.date_add(last, 1))
    rows = T.table(spark, d, "part").select(n.alias("request_id"), F.when(n % 3 == 0, "no such sku").otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("sku"),
                                            start.alias("from_date"), F.date_add(start, 1).alias("to_date"))
    return P.batch_forecast(rows, series, last).groupBy("request_id", "model_source", "history_source").agg(F.count("date").alias("days"))


@query("asof_history", f"""WITH {DAILY}, last AS (SELECT max(date) AS d FROM daily), {REQUEST_SQL} SELECT request_id, sku, CAST(history_end AS VARCHAR) AS history_end, CAST(len(h) AS BIGINT) AS days, CAST(list_sum(h) AS DOUBLE) AS demand FROM hist""")
def asof_history(spark, d):
    """History window that each request may use."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    rows, last = requests(spark, d, series)
    asked = rows.withColumn("history_end", F.least(F.date_sub("from_date", 1), last))
    out = P.history_as_of(asked, series).withColumn("w", F.transform("history", lambda r: r["daily_demand"])).filter(F.exists("w", lambda y: y > 0))
    return out.select("request_id", "sku", "history_end", F.size("w").alias("days"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("demand"))


@query("recovered_history", f"""WITH {BASE_SQL}, own AS (SELECT sku, date, daily_demand, 1 AS r FROM ok), lagged AS (SELECT sku, date - 28 AS date, lag_28 AS daily_demand, 0 AS r FROM ok), u AS (SELECT * FROM own UNION ALL SELECT * FROM lagged)
SELECT sku, CAST(date AS VARCHAR) AS date, daily_demand FROM u QUALIFY row_number() OVER (PARTITION BY sku, date ORDER BY r DESC) = 1""")
def recovered_history(spark, d):
    """Daily history read back from a feature store through its largest lag."""
    series = materialise(daily(spark, d), "daily")
    store = X.window_features(series, lags=(28,), windows=()).dropna(subset=["lag_28", "target_t_plus_1"])
    return P.history_from_features(store).select("sku", "date", "daily_demand")


@query("complete_history", f"""WITH {DAILY}, f AS (SELECT sku, min(date) AS lo FROM sold GROUP BY 1), g AS (SELECT sku, CAST(unnest(generate_series(lo, (SELECT hi FROM span), INTERVAL 1 DAY)) AS DATE) AS date FROM f)
SELECT g.sku, CAST(g.date AS VARCHAR) AS date, coalesce(s.daily_demand, 0) AS daily_demand, coalesce(s.order_count, 0) AS order_count, round(last_value(s.avg_unit_price IGNORE NULLS) OVER (PARTITION BY g.sku ORDER BY g.date ROWS UNBOUNDED PRECEDING), 6) AS avg_unit_price FROM g LEFT JOIN sold s ON s.sku = g.sku AND s.date = g.date""")
def complete_history(spark, d):
    """Gap-free history per SKU from its own first day."""
    from marketloom.operators import demand as D

    lines = sku_lines(spark, d)
    _, last = D.date_bounds(lines)
    return P.complete_history(D.daily_metrics(lines), last).select("sku", "date", "daily_demand", "order_count", F.round("avg_unit_price", 6).alias("avg_unit_price"))


@query("units_per_order", f"""WITH {DAILY}, last AS (SELECT max(date) AS d FROM daily) SELECT sku, round(CASE WHEN sum(order_count) > 0 THEN sum(daily_demand) / sum(order_count) ELSE 1 END, 6) AS units_per_order, CAST(sum(order_count) AS DOUBLE) AS orders FROM daily, last WHERE date > last.d - 28 GROUP BY 1""")
def units_per_order(spark, d):
    """Units per order over the last 28 days."""
    sums = D.recent_totals(sku_lines(spark, d), {"h": (0, 27)}, ["platform", "order_id"])
    q, o = F.col("h_sum"), F.col("h_orders")
    return sums.select("sku", F.round(F.when(o > 0, q / o).otherwise(1.0), 6).alias("units_per_order"), o.alias("orders"))


@query("recent_statistics", f"WITH {DAILY}, {RECENT_SQL} SELECT sku, round(hist_mean, 6) AS hist_mean, round(hist_std, 6) AS hist_std FROM recent")
def recent_stats(spark, d):
    """Mean and deviation of the last 28 days per SKU."""
    out = recent_demand(sku_lines(spark, d))
    return out.select("sku", F.round("hist_mean", 6).alias("hist_mean"), F.round("hist_std", 6).alias("hist_std"))


# ---- forecast against actual ------------------------------------------------------------

ISSUED_SQL = """prod AS (SELECT p_brand || ' ' || p_type AS sku, min(p_partkey) AS product_key FROM part GROUP BY 1),
bysku AS (SELECT sku, order_date, CAST(sum(quantity) AS DOUBLE) AS q FROM lines WHERE NOT is_cancelled GROUP BY 1, 2),
i0 AS (SELECT b.sku, p.product_key, b.order_date + 7 AS target_date, b.q AS predicted_quantity, CAST(p.product_key % 4 AS INTEGER) AS o, date_diff('day', DATE '1995-01-01', b.order_date) AS dn, v.v FROM bysku b JOIN prod p USING (sku), (SELECT unnest([0, 1]) AS v) v),
issued AS (SELECT *, dn * 1000000 + product_key * 2 + v AS forecast_id, CASE o WHEN 0 THEN 'unverified_warehouse' WHEN 1 THEN 'warehouse_live' WHEN 2 THEN 'public_anonymized_historical_csv' ELSE 'other' END AS data_origin,
  CASE WHEN o = 2 THEN ['ds-a', 'ds-b'] ELSE [] END AS source_datasets, target_date - 3 + v AS issue_day, CASE WHEN dn % 9 = 0 THEN 'heuristic_history' ELSE 'local_joblib' END AS model_source, predicted_quantity + v AS pq FROM i0),
eligible AS (SELECT * FROM issued WHERE model_source = 'local_joblib' AND o <> 3),
latest AS (SELECT * FROM eligible WHERE target_date > issue_day QUALIFY row_number() OVER (PARTITION BY product_key, target_date, data_origin ORDER BY issue_day DESC, forecast_id DESC) = 1),
cal AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
coverage AS (SELECT 'unverified_warehouse' AS data_origin, '' AS ds, d FROM cal WHERE day(d) % 3 <> 0 UNION ALL SELECT 'public_anonymized_historical_csv', 'ds-a', d FROM cal UNION ALL SELECT 'public_anonymized_historical_csv', 'ds-b', d FROM cal WHERE day(d) % 2 = 0),
hist AS (SELECT *, CASE line_number % 3 WHEN 0 THEN 'ds-a' WHEN 1 THEN 'ds-b' ELSE 'ds-c' END AS ds FROM lines WHERE NOT is_cancelled),
prodkey AS (SELECT p_partkey AS part_key, p_brand || ' ' || p_type AS sku FROM part),
flag AS (SELECT l.*, target_date < DATE '2001-06-01' AND CASE WHEN o IN (0, 1) THEN EXISTS (SELECT 1 FROM coverage c WHERE c.data_origin = l.data_origin AND c.ds = '' AND c.d = l.target_date)
  ELSE NOT EXISTS (SELECT 1 FROM (SELECT unnest(['ds-a', 'ds-b']) AS need) x WHERE NOT EXISTS (SELECT 1 FROM coverage c WHERE c.data_origin = l.data_origin AND c.ds = x.need AND c.d = l.target_date)) END AS actual_complete FROM latest l),
live_q AS (SELECT sku, order_date, sum(quantity) AS q FROM lines WHERE NOT is_cancelled GROUP BY 1, 2), hist_q AS (SELECT sku, order_date, sum(quantity) AS q FROM hist WHERE ds IN ('ds-a', 'ds-b') GROUP BY 1, 2),
actuals AS (SELECT f.*, CASE WHEN actual_complete THEN coalesce(CAST(CASE WHEN o IN (0, 1) THEN lq.q ELSE hq.q END AS DOUBLE), 0) END AS actual_demand FROM flag f LEFT JOIN live_q lq ON lq.sku = f.sku AND lq.order_date = f.target_date LEFT JOIN hist_q hq ON hq.sku = f.sku AND hq.order_date = f.target_date)"""


def sold_days(spark, d) -> DataFrame:
    """Sold quantity and revenue per SKU, day and dataset, written once: everything that is compared reads this and no line."""
    n = F.col("line_number") % 3
    dataset = F.when(n == 0, "ds-a").when(n == 1, "ds-b").otherwise("ds-c")
    sold = sku_lines(spark, d).filter("not is_cancelled").groupBy("sku", "order_date", dataset.alias("source_dataset")).agg(
        F.sum("quantity").alias("quantity"), F.sum("buyer_total_amount").alias("revenue"), F.max("product_name").alias("product_name"), F.max("category").alias("category"))
    return materialise(sold, "sold-days")


def issued_forecasts(spark, d, sold: DataFrame | None = None) -> DataFrame:
    """Seasonal-naive forecasts of every sold SKU-day, issued twice, over four kinds of provenance."""
    sold = sku_lines(spark, d).filter("not is_cancelled") if sold is None else sold
    by_sku = sold.groupBy("sku", "order_date").agg(F.sum("quantity").cast("double").alias("q"))
    rows = by_sku.join(product_keys(spark, d), "sku").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    kind, number = F.col("product_key") % 4, F.datediff("order_date", F.lit("1995-01-01"))
    target = F.date_add("order_date", 7)
    origin = F.when(kind == 0, "unverified_warehouse").when(kind == 1, "warehouse_live").when(kind == 2, V.HISTORY_ORIGIN).otherwise("other")
    return rows.select(
        (number.cast("long") * 1000000 + F.col("product_key") * 2 + F.col("v")).alias("forecast_id"), "product_key", target.alias("target_date"), (F.col("q") + F.col("v")).alias("predicted_quantity"),
        F.lit("seasonal_naive").alias("model_name"), F.lit("1").alias("model_version"), F.when(number % 9 == 0, "heuristic_history").otherwise("local_joblib").alias("model_source"),
        F.lit("warehouse").alias("history_source"), F.col("order_date").alias("history_end_date"),
        # Issue time is an instant: 02:00 UTC is 09:00 of the same business day.
        F.to_timestamp(F.concat(F.date_add(F.date_sub(target, 3), F.col("v")).cast("string"), F.lit("T02:00:00Z"))).alias("forecast_generated_at"), origin.alias("data_origin"),
        F.when(kind == 2, F.array(F.lit("ds-b"), F.lit("ds-a"), F.lit("ds-a"))).otherwise(F.array().cast("array<string>")).alias("source_datasets"))


def product_keys(spark, d) -> DataFrame:
    return T.products(spark, d).groupBy("sku").agg(F.min("part_key").alias("product_key"), F.max("product_name").alias("product_name"), F.min("category").alias("category"))


def coverage_rows(spark) -> DataFrame:
    days = spark.range(1).select(F.explode(F.expr("sequence(date'1995-01-01', date'2001-12-31', interval 1 day)")).alias("full_date"))
    dom = F.dayofmonth("full_date")
    live = days.filter(dom % 3 != 0).select(F.lit("unverified_warehouse").alias("data_origin"), F.lit("").alias("source_dataset"), "full_date")
    a = days.select(F.lit(V.HISTORY_ORIGIN).alias("data_origin"), F.lit("ds-a").alias("source_dataset"), "full_date")
    b = days.filter(dom % 2 == 0).select(F.lit(V.HISTORY_ORIGIN).alias("data_origin"), F.lit("ds-b").alias("source_dataset"), "full_date")
    return live.unionByName(a).unionByName(b)



def compared(spark, d) -> DataFrame:
    sold = sold_days(spark, d)
    history = sold.withColumn("data_origin", F.lit(V.HISTORY_ORIGIN))
    demand = sold.select(F.lit("unverified_warehouse").alias("data_origin"), "sku", "product_name", "category", "order_date",
                         F.col("quantity").cast("decimal(18,0)").alias("quantity"), F.col("revenue").cast("decimal(18,2)").alias("revenue"))
    forecasts = marts.eligible_forecasts(issued_forecasts(spark, d, sold))
    return marts.forecast_vs_actual(forecasts, product_keys(spark, d), coverage_rows(spark), sold, history, D.abc_xyz(demand), F.lit("2001-06-01").cast("date"))


@query("forecast_vs_actual", f"""WITH {LIVE_DEMAND}, {segments('demand')}, {ISSUED_SQL}
SELECT a.forecast_id, a.product_key, CAST(a.target_date AS VARCHAR) AS date, a.sku, coalesce(CASE WHEN o IN (0, 1) THEN s.matrix_segment END, 'NA') AS matrix_segment, actual_demand, pq AS forecast_demand, abs(actual_demand - pq) AS absolute_error,
  (actual_demand - pq) * (actual_demand - pq) AS squared_error, 'seasonal_naive' AS model_name, '1' AS model_version, a.data_origin, CASE WHEN o = 2 THEN '["ds-a","ds-b"]' ELSE '[]' END AS source_datasets, actual_complete FROM actuals a LEFT JOIN segments s USING (sku)""")
def forecast_vs_actual(spark, d):
    """Latest issued forecast per target next to the confirmed actual."""
    return compared(spark, d)


@query("forecast_accuracy", f"""WITH {LINES}, {ISSUED_SQL} SELECT data_origin, count(*) AS rows, count(actual_demand) AS rows_with_actual, round(sum(abs(actual_demand - pq)) / nullif(sum(actual_demand), 0), 6) AS wape,
  round(CASE WHEN sum(actual_demand) <> 0 THEN greatest(0, 1 - sum(abs(actual_demand - pq)) / sum(actual_demand)) END, 6) AS accuracy, round(sum(CASE WHEN actual_demand IS NOT NULL THEN pq - actual_demand END) / nullif(sum(actual_demand), 0), 6) AS bias FROM actuals GROUP BY 1""")
def forecast_accuracy(spark, d):
    return marts.forecast_accuracy(compared(spark, d), ["data_origin"])


@query("coverage_forall", f"WITH {LINES}, {ISSUED_SQL} SELECT data_origin, count(*) AS forecasts, count(*) FILTER (actual_complete) AS complete FROM flag GROUP BY 1")
def coverage_forall(spark, d):
    """How many forecasts have every needed dataset confirmed."""
    latest = marts.latest_forecasts(marts.eligible_forecasts(issued_forecasts(spark, d)))
    done = marts.coverage_complete(latest, coverage_rows(spark), F.lit("2001-06-01").cast("date"))
    return done.groupBy("data_origin").agg(F.count(F.lit(1)).alias("forecasts"), F.count_if("actual_complete").alias("complete"))


@query("forecast_audit_append", f"""WITH {LINES}, {ISSUED_SQL}, k AS (SELECT DISTINCT product_key, target_date, data_origin FROM eligible) SELECT data_origin, count(*) AS rows FROM k GROUP BY 1""")
def forecast_audit_append(spark, d):
    """Issued forecasts appended once per key; a second issue with the same key changes nothing."""
    keys = ["product_key", "target_date", "model_name", "model_version", "history_end_date", "data_origin", "source_datasets"]
    rows = marts.eligible_forecasts(issued_forecasts(spark, d))
    stored = materialise(rows.filter("forecast_id % 2 = 0"), "issued")
    return M.append_forecasts(stored, rows, keys).groupBy("data_origin").agg(F.count(F.lit(1)).alias("rows"))


CONFIRM_SQL = f"""WITH {LINES}, r AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'unverified_warehouse' WHEN o_orderkey % 3 = 1 THEN 'public_anonymized_historical_csv' ELSE 'elsewhere' END AS data_origin,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ds-1' ELSE 'ds-9' END AS source_dataset, CAST(o_orderdate AS DATE) AS full_date FROM orders)
SELECT data_origin, source_dataset, CAST(full_date AS VARCHAR) AS full_date FROM r WHERE full_date < DATE '2000-01-01' AND ((data_origin = 'unverified_warehouse' AND source_dataset = '') OR (data_origin = 'public_anonymized_historical_csv' AND source_dataset IN ('ds-1', 'ds-2', 'ds-3')))"""


@query("confirm_coverage", CONFIRM_SQL)
def confirm_coverage(spark, d):
    """Confirmations that may be stored: past days, supported origins, known datasets."""
    return marts.confirm_coverage(*confirmations(spark, d), F.lit("2000-01-01").cast("date"))


def confirmations(spark, d) -> tuple[DataFrame, DataFrame]:
    """Requests to confirm the days of orders, and the imported datasets."""
    n = F.col("o_orderkey")
    asked = T.table(spark, d, "orders").select(
        F.when(n % 3 == 0, "unverified_warehouse").when(n % 3 == 1, V.HISTORY_ORIGIN).otherwise("elsewhere").alias("data_origin"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "ds-1").otherwise("ds-9").alias("source_dataset"), F.col("o_orderdate").cast("date").alias("full_date"))
    known = T.table(spark, d, "lineitem").filter("l_linenumber <= 3").select(F.lit(V.HISTORY_ORIGIN).alias("data_origin"), F.concat(F.lit("ds-"), F.col("l_linenumber").cast("string")).alias("source_dataset"))
    return asked, known


@query("coverage_ledger", CONFIRM_SQL)
def coverage_ledger(spark, d):
    """The same days confirmed twice, the second time with more of them: the ledger has each once."""
    asked, known = confirmations(spark, d)
    table = W.confirmation_table(spark, new_folder(spark, "confirmed"))
    allowed = materialise(marts.confirm_coverage(asked, known, F.lit("2000-01-01").cast("date")), "allowed")
    for rows in (allowed.filter("dayofmonth(full_date) % 2 = 0"), allowed, allowed):
        W.confirm(table, rows, F.current_timestamp())
    return table.read().select("data_origin", "source_dataset", "full_date")


@query("coverage_refused", f"""WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unverified_warehouse' WHEN o_orderkey % 3 = 1 THEN 'public_anonymized_historical_csv' ELSE 'elsewhere' END AS data_origin,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ds-1' ELSE 'ds-9' END AS source_dataset, CAST(o_orderdate AS DATE) AS full_date FROM orders)
SELECT CASE WHEN full_date >= DATE '2000-01-01' THEN 'DAY_NOT_OVER' WHEN data_origin LIKE 'public%' AND source_dataset = '' THEN 'DATASET_MISSING' WHEN data_origin LIKE 'public%' AND source_dataset = 'ds-9' THEN 'DATASET_UNKNOWN'
  WHEN data_origin LIKE 'public%' OR (data_origin = 'unverified_warehouse' AND source_dataset = '') THEN '' ELSE 'ORIGIN_NOT_SUPPORTED' END AS reason, count(*) AS requests FROM r GROUP BY 1""")
def coverage_refused(spark, d):
    """Why confirmations are refused."""
    judged = marts.judged_confirmations(*confirmations(spark, d), F.lit("2000-01-01").cast("date"))
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


# ---- readiness --------------------------------------------------------------------------

@query("readiness_orders", f"""WITH {LINES}, a AS (SELECT count(*) AS r, count(DISTINCT sku) AS s, count(DISTINCT order_date) AS n, min(order_date) AS lo, max(order_date) AS hi FROM lines WHERE NOT is_cancelled)
SELECT r AS row_count, s AS sku_count, n AS active_source_days, CAST(lo AS VARCHAR) AS history_start, CAST(hi AS VARCHAR) AS history_end, CAST(hi - lo + 1 AS BIGINT) AS calendar_span_days, n AS available_history_days, CAST(92 AS BIGINT) AS required_history_days,
  greatest(0, 92 - n) AS missing_history_days, greatest(0, n - 29) AS evaluation_days_available, CAST(63 AS BIGINT) AS evaluation_days_required, n >= 92 AND n - 29 >= 63 AS data_sufficient, CASE WHEN n >= 92 AND n - 29 >= 63 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status FROM a""")
def readiness_orders(spark, d):
    """Whether the order history is long enough to train."""
    return P.order_readiness(sku_lines(spark, d))


@query("readiness_features", f"""WITH {BASE_SQL}, a AS (SELECT count(*) AS r, count(DISTINCT sku) AS s, count(DISTINCT date) AS n, min(date) + 1 AS lo, max(date) + 1 AS hi FROM ok)
SELECT r AS row_count, s AS sku_count, n AS active_source_days, CAST(lo AS VARCHAR) AS history_start, CAST(hi AS VARCHAR) AS history_end, n + 29 AS available_history_days, CAST(92 AS BIGINT) AS required_history_days, greatest(0, 92 - n - 29) AS missing_history_days,
  n AS evaluation_days_available, CAST(63 AS BIGINT) AS evaluation_days_required, n >= 63 AS data_sufficient, CASE WHEN n >= 63 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status FROM a""")
def readiness_features(spark, d):
    rows, _ = base_store(spark, d)
    return P.feature_readiness(rows)


@query("status_transitions", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey % 5 AS grp, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN n >= 28 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status, greatest(0, 28 - n) AS miss FROM m)
SELECT grp, month, status, lag(status) OVER w AS previous_status, (lag(status) OVER w IS DISTINCT FROM status) OR (lag(n) OVER w IS DISTINCT FROM n) OR (lag(miss) OVER w IS DISTINCT FROM miss) AS changed,
  coalesce(lag(status) OVER w = 'INSUFFICIENT_DATA' AND status = 'READY', false) AS recovered FROM s WINDOW w AS (PARTITION BY grp ORDER BY month)""")
def status_transitions(spark, d):
    """Changes and recoveries in a history of readiness reports."""
    o = T.table(spark, d, "orders")
    n = F.count_distinct(F.col("o_orderdate").cast("date"))
    reports = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_custkey") % 5).alias("grp")).agg(n.alias("available_history_days")).withColumns({
        "status": F.when(F.col("available_history_days") >= 28, "READY").otherwise("INSUFFICIENT_DATA"), "missing_history_days": F.greatest(F.lit(0).cast("long"), 28 - F.col("available_history_days"))})
    return P.status_transitions(reports, ["grp"], "month").select("grp", "month", "status", "previous_status", "changed", "recovered")


# ---- drift ------------------------------------------------------------------------------

DRIFT_SQL = f"""{STORE_SQL}, lim AS (SELECT max(date) AS m FROM store),
lab AS (SELECT s.*, CASE WHEN date >= m - 6 THEN 1 ELSE 0 END AS cur FROM store s, lim WHERE date >= m - 34),
long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(coalesce({c}, 0) AS DOUBLE) AS value, cur FROM lab" for c in DR.MONITORED) + """),
hist AS (SELECT feature, value, count(*) FILTER (cur = 0) AS r, count(*) FILTER (cur = 1) AS c FROM long GROUP BY 1, 2),
tot AS (SELECT feature, sum(r) AS tr, sum(c) AS tc, min(value) AS lo, max(value) AS hi, sum(value * r) / sum(r) AS mr, sum(value * c) / sum(c) AS mc FROM hist GROUP BY 1),
cum AS (SELECT h.feature, abs(CAST(sum(r) OVER w AS DOUBLE) / tr - CAST(sum(c) OVER w AS DOUBLE) / tc) AS gap, tr, tc FROM hist h JOIN tot USING (feature) WINDOW w AS (PARTITION BY h.feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT feature, max(gap) AS d, sqrt(max(tr) * max(tc) / (max(tr) + max(tc))) AS n FROM cum GROUP BY 1),
ks AS (SELECT feature, round(d, 4) AS ks_statistic, round(CASE WHEN d <= 0 THEN 1 ELSE least(1, greatest(0, 2 * exp(-2 * power((n + 0.12 + 0.11 / n) * d, 2)))) END, 4) AS p_value FROM dd),
bins AS (SELECT feature, least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS b, sum(r) AS r, sum(c) AS c FROM hist JOIN tot USING (feature) WHERE hi > lo GROUP BY 1, 2),
dense AS (SELECT feature, tr, tc, lo, hi, unnest(range(10)) AS b FROM tot),
pp AS (SELECT d.feature, d.lo = d.hi AS flat, coalesce(x.r, 0) / tr + 1e-4 AS pr, coalesce(x.c, 0) / tc + 1e-4 AS pc FROM dense d LEFT JOIN bins x ON x.feature = d.feature AND x.b = d.b),
psi AS (SELECT feature, round(sum(CASE WHEN flat THEN 0 ELSE (pc - pr) * ln(pc / pr) END), 4) AS psi FROM pp GROUP BY 1),
drift AS (SELECT feature, ks_statistic, p_value, psi, round(mr, 2) AS ref_mean, round(mc, 2) AS curr_mean, p_value < 0.05 AS drift_detected FROM ks JOIN psi USING (feature) JOIN tot USING (feature))"""


def histogram(spark, d) -> DataFrame:
    store = materialise(X.recent_features(sku_lines(spark, d), DR.DAYS).select("date", *DR.MONITORED), "drift-store")
    return DR.histogram(DR.require_windows(DR.windows(store)), DR.MONITORED)


@query("drift_ks", f"WITH {DRIFT_SQL} SELECT * FROM ks")
def drift_ks(spark, d):
    """Two-sample KS of the last 7 days against the 28 days before them."""
    return DR.ks(materialise(histogram(spark, d), "hist"))


@query("drift_psi", f"WITH {DRIFT_SQL} SELECT * FROM psi")
def drift_psi(spark, d):
    return DR.psi(materialise(histogram(spark, d), "hist"))


@query("drift_features", f"WITH {DRIFT_SQL} SELECT * FROM drift")
def drift_features(spark, d):
    return DR.feature_drift(histogram(spark, d))


@query("drift_summary", f"""WITH {DRIFT_SQL}, s AS (SELECT count(*) FILTER (feature <> 'daily_demand') AS nf, count(*) FILTER (feature <> 'daily_demand' AND drift_detected) AS nd,
  coalesce(array_to_string(list_sort(list(feature) FILTER (feature <> 'daily_demand' AND drift_detected)), ','), '') AS names, coalesce(bool_or(drift_detected) FILTER (feature = 'daily_demand'), false) AS t FROM drift)
SELECT nf AS number_of_features, nd AS number_of_drifted_features, names AS drifted_features, t AS target_drift_detected, round(nd / greatest(nf, 1), 3) AS drift_share, round(nd / greatest(nf, 1), 3) >= 0.30 AS dataset_drift_detected,
  round(nd / greatest(nf, 1), 3) >= 0.30 OR t AS drift_detected FROM s""")
def drift_summary(spark, d):
    """Data drift by share of features, target drift separately."""
    return DR.summary(DR.feature_drift(histogram(spark, d))).withColumn("drifted_features", F.array_join("drifted_features", ","))


@query("retrain_decision", """WITH e AS (SELECT event_id, event_id % 2 = 0 AS det, CASE WHEN event_id % 7 = 0 THEN 'synthetic_demo' ELSE 'feature_store' END AS src, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'warehouse_live' END AS mo,
  CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'warehouse_live' END AS dorig, CASE WHEN event_id % 13 = 0 THEN 'file' ELSE 'warehouse' END AS fds, event_id % 3 = 0 AS odd FROM events),
d AS (SELECT CASE WHEN det AND src = 'synthetic_demo' THEN 'SKIPPED_SYNTHETIC' WHEN NOT det THEN 'SKIPPED_HEALTHY' WHEN mo IS NULL THEN 'FAILED_NO_ORIGIN' WHEN dorig <> mo OR fds <> 'warehouse' OR odd THEN 'FAILED_PROVENANCE' ELSE 'RETRAIN' END AS decision FROM e)
SELECT decision, CASE WHEN decision = 'RETRAIN' THEN 'data_drift' END AS "trigger", count(*) AS n FROM d GROUP BY 1, 2""")
def retrain_decision(spark, d):
    """Decision table over drift summaries and deployed models."""
    n = F.col("event_id")
    e = T.table(spark, d, "events")
    summaries = e.select(
        n.cast("string").alias("model_name"), (n % 2 == 0).alias("drift_detected"), F.when(n % 7 == 0, "synthetic_demo").otherwise("feature_store").alias("data_source"),
        F.when(n % 11 == 0, "other").otherwise("warehouse_live").alias("drift_origin"), F.array(F.lit("b"), F.lit("a")).alias("drift_datasets"), F.when(n % 13 == 0, "file").otherwise("warehouse").alias("feature_data_source"))
    deployed = e.select(n.cast("string").alias("model_name"), F.when(n % 5 != 0, F.lit("warehouse_live")).alias("model_origin"), F.when(n % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("model_datasets"))
    return DR.retrain_decision(summaries, deployed).groupBy("decision", "trigger").agg(F.count(F.lit(1)).alias("n"))


# ---- monitoring -------------------------------------------------------------------------

@query("window_ratio", RATIO_SQL)
def window_ratio(spark, d):
    """Error share in sliding six-hour windows, hourly slide."""
    e = T.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return monitor.window_ratio(e, "ts", F.col("event_type") == "error", "6 hours", "1 hour")


@query("latency_quantiles", """SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) / 86400.0::DOUBLE AS rate FROM events GROUP BY ALL""")
def latency_quantiles(spark, d):
    """Interpolated quantiles and rate per day and event type."""
    e = T.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = monitor.latency_quantiles(e, "ts", "event_type", "value", "1 day")
    return out.select("window_start", "event_type", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], "rate")


@query("staleness", "SELECT CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_date, CAST(DATE '2024-02-10' - CAST(max(ts) AS DATE) AS BIGINT) AS age_days, DATE '2024-02-10' - CAST(max(ts) AS DATE) > 7 AS stale FROM events")
def staleness(spark, d):
    e = T.table(spark, d, "events").select(F.col("ts").cast("date").alias("day"))
    return monitor.staleness(e, "day", F.lit("2024-02-10").cast("date"))


@query("heartbeat", "SELECT CASE WHEN arg_max(event_type, ts) = 'error' THEN 'failed' ELSE 'healthy' END AS status, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(max(ts))) AS BIGINT) AS age_seconds, arg_max(event_type, ts) <> 'error' AND floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(max(ts))) < 180 AS ok FROM events")
def heartbeat(spark, d):
    """Latest status row: healthy and fresh."""
    e = T.table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("healthy").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    return monitor.heartbeat(e, "at", F.to_timestamp(F.lit("2024-01-31T00:00:00Z")))
