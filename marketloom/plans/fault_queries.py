"""Checks on data with planted faults: each fault follows from the keys of a row, so the SQL counts it without the check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators import features as X
from marketloom.operators import reconcile as R
from marketloom.plans import marts
from marketloom.plans.demand_queries import daily
from marketloom.plans.registry import query
from marketloom.plans.sales_queries import calendar_of, dated_lines, summary_against_source
from marketloom.plans.sql_parts import DAILY, LINES
from marketloom.session import materialise
from marketloom.sources import lake
from marketloom.sources import tables as T


def fault_of(sku: str = "sku", date: str = "date") -> Column:
    """Number of the fault of a SKU and day, 0 to 10."""
    return (F.dayofyear(date) + F.char_length(sku)) % 11


def fault_sql(date: str = "date") -> str:
    return f"(dayofyear({date}) + length(sku)) % 11"


def damaged(series: DataFrame) -> DataFrame:
    """A daily history in which a day is lost (0), stands twice (1), is wrong by one unit (2) or by less than the tolerance (3)."""
    k = fault_of()
    copies = F.when(k == 0, 0).when(k == 1, 2).otherwise(1)
    shift = F.when(k == 2, 1.0).when(k == 3, 1e-10).otherwise(0.0)
    return series.select("sku", "date", (F.col("daily_demand") + shift).alias("daily_demand"), F.explode(F.array_repeat(F.lit(1), copies))).drop("col")


@query("history_faults", f"""WITH {DAILY}, k AS (SELECT {fault_sql()} AS k FROM daily)
SELECT count(*) AS rows, count(*) FILTER (k = 0) AS without_source, count(*) FILTER (k = 1) AS duplicate_keys, count(*) FILTER (k = 2) AS not_close FROM k""")
def history_faults(spark, d):
    """Lost, repeated and wrong days of a history are found; differences below the tolerance are not."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    return R.consistency(series, damaged(series))


@query("target_faults", f"""WITH {DAILY}, f AS (SELECT sku, date, lead(date) OVER (PARTITION BY sku ORDER BY date) AS next_date FROM daily),
v AS (SELECT {fault_sql('next_date')} AS k FROM f WHERE next_date IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (k = 0) AS without_next_day, count(*) FILTER (k = 2) AS different FROM v""")
def target_faults(spark, d):
    """Stored targets against a history whose following day is lost or wrong."""
    series = materialise(daily(spark, d).select("sku", "date", "daily_demand"), "daily")
    store = X.window_features(series, lags=(1,), windows=()).dropna(subset=["target_t_plus_1"])
    # A day that stands twice would show its row twice, and any difference counts here.
    history = damaged(series.where(~fault_of().isin(1, 3))).unionByName(series.where(fault_of().isin(1, 3)))
    return R.target_check(store, history)


@query("partition_faults", """SELECT count(*) AS rows, count(*) FILTER (l_orderkey % 13 IN (0, 1)) AS disagreeing FROM lineitem""")
def partition_faults(spark, d):
    """Rows that lie in the folder of another day, or in one whose month cannot be read."""
    order = F.floor(F.col("_source_row").cast("long") / 10)
    rows = lake.with_partitions(T.raw_events(spark, d), F.lit("2000-01-01").cast("timestamp"))
    event = S.business_date(F.coalesce(S.to_instant(F.col("create_time")), S.to_instant(F.col("created_time"))))
    moved = F.lpad((F.col("day").cast("int") % 28 + 1).cast("string"), 2, "0")
    rows = rows.withColumns({"day": F.when(order % 13 == 0, moved).otherwise(F.col("day")), "month": F.when(order % 13 != 1, F.col("month"))})
    return R.partition_agreement(rows, event)


@query("replay_faults", f"""WITH {LINES}, b AS (SELECT count(*) AS l, CAST(sum(quantity) AS BIGINT) AS u, sum(subtotal) AS s FROM lines),
g AS (SELECT count(*) AS l, CAST(sum(quantity) AS BIGINT) AS u, sum(subtotal) AS s FROM lines WHERE quantity >= 49),
c AS (SELECT 'as_before' AS replay, 0 AS n, 0 AS cent UNION ALL SELECT 'twice', 1, 0 UNION ALL SELECT 'lost', -1, 0 UNION ALL SELECT 'amount', 0, 1)
SELECT replay, b.l + n * g.l AS after_lines, b.u + n * g.u AS after_units, CAST(b.s + n * g.s + CAST(cent * 0.01 AS DECIMAL(4,2)) * b.l AS DOUBLE) AS after_subtotal,
  n = 0 AND cent = 0 AS unchanged FROM b, g, c""")
def replay_faults(spark, d):
    """A replay that changes nothing, one that inserts lines again, one that loses lines, and one that changes amounts only."""
    lines = T.order_lines(spark, d).select("quantity", "subtotal")
    large = lines.where("quantity >= 49")
    after = {"as_before": lines, "twice": lines.unionByName(large), "lost": lines.where("quantity < 49"),
             "amount": lines.withColumn("subtotal", F.col("subtotal") + F.lit("0.01").cast("decimal(4,2)"))}
    told = [R.replay_unchanged(lines, rows).select(F.lit(name).alias("replay"), "after_lines", "after_units", "after_subtotal", "unchanged") for name, rows in after.items()]
    return reduce(DataFrame.unionByName, told)


@query("aov_faults", f"""WITH {LINES}, sold AS (SELECT * FROM lines WHERE NOT is_cancelled), kept AS (SELECT * FROM sold WHERE day(order_date) <> 13),
a AS (SELECT CAST(sum(buyer_total_amount) AS DOUBLE) AS r, count(DISTINCT (platform, order_id)) AS o FROM kept),
b AS (SELECT CAST(sum(buyer_total_amount) AS DOUBLE) AS r, count(DISTINCT (platform, order_id)) AS o FROM sold)
SELECT a.r AS summary_revenue, b.r AS source_revenue, a.o AS summary_orders, b.o AS source_orders, abs(a.r - b.r) <= 0.01 AND a.o = b.o AS consistent FROM a, b""")
def aov_faults(spark, d):
    """A calendar without the thirteenth of each month loses lines of the summary, which the totals tell."""
    dates = calendar_of(spark, d)
    summary = marts.executive_summary(dated_lines(spark, d, dates), dates.where(F.dayofmonth("full_date") != 13))
    return summary_against_source(summary, T.order_lines(spark, d))
