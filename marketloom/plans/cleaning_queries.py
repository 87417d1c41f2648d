"""Unify, validate, quarantine, deduplicate and merge over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators import inventory as I
from marketloom.operators import latest as L
from marketloom.operators import merge as M
from marketloom.operators import monitor
from marketloom.operators import reconcile as R
from marketloom.operators import rules, star, unify
from marketloom.plans.registry import query
from marketloom.plans.sql_parts import LINES, RAW, SNAPSHOTS, USER_SKU
from marketloom.session import materialise
from marketloom.sources import tables as T


def typed(spark: SparkSession, d: str) -> DataFrame:
    return unify.normalise(unify.unify(T.raw_events(spark, d)))


def checked(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows with their errors; a query computes what it shows of them and stores nothing."""
    rows = typed(spark, d)
    return rules.with_errors(rows, rules.order_line_rules(rows))


@query("unified_lines", f"""WITH {RAW} SELECT t_platform AS platform, t_order_id AS order_id, t_sku AS sku, source_line_id, t_quantity AS quantity, t_price AS original_price,
  CASE WHEN other THEN NULL WHEN is_a THEN category END AS category, CASE WHEN NOT other THEN CAST(supp_key AS VARCHAR) END AS shop_id,
  CASE WHEN NOT other AND is_a THEN CASE WHEN x = 14 THEN '-1' ELSE '0.5' END END AS weight_kg, CASE WHEN NOT other THEN 'VN' END AS country,
  CASE WHEN NOT other THEN carrier_name END AS carrier_name, CASE WHEN NOT other THEN state END AS state, strftime(c_created, '%Y-%m-%dT%H:%M:%SZ') AS create_time,
  strftime(c_paid, '%Y-%m-%dT%H:%M:%SZ') AS pay_time, t_updated AS source_updated_at, CASE WHEN other THEN NULL WHEN is_a AND x = 15 THEN NULL WHEN is_a THEN '0.0' ELSE '0' END AS voucher_total FROM raw""")
def unified_lines(spark, d):
    """Two source layouts in one canonical layout, values as supplied."""
    return unify.unify(T.raw_events(spark, d)).select(
        "platform", "order_id", "sku", "source_line_id", "quantity", "original_price", "category", "shop_id", "weight_kg", "country",
        "carrier_name", "state", "create_time", "pay_time", "source_updated_at", "voucher_total")


@query("line_keys", """WITH k AS (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_linenumber AS VARCHAR) END AS a, CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_linenumber AS VARCHAR) || '.0' END AS b,
  CASE WHEN l_linenumber % 4 = 2 THEN 'kept-' || CAST(l_linenumber AS VARCHAR) WHEN l_linenumber % 4 = 3 THEN ' ' END AS c FROM lineitem)
SELECT coalesce('id:' || a, 'id:' || replace(b, '.0', ''), nullif(CASE WHEN trim(c) <> '' THEN c END, ''), 'sku:' || CAST(l_partkey AS VARCHAR)) AS line_key, count(*) AS rows FROM k GROUP BY 1""")
def line_keys(spark, d):
    """The four ways a line gets its key; integral numbers lose their .0."""
    n = F.col("l_linenumber")
    text = n.cast("string")
    key = S.line_key(F.when(n % 4 == 0, text), F.when(n % 4 == 1, F.concat(text, F.lit(".0"))),
                     F.when(n % 4 == 2, F.concat(F.lit("kept-"), text)).when(n % 4 == 3, F.lit(" ")), F.col("l_partkey").cast("string"), numeric=True)
    return T.table(spark, d, "lineitem").select(key.alias("line_key")).groupBy("line_key").agg(F.count(F.lit(1)).alias("rows"))


TYPED_SQL = """t_platform AS platform, t_order_id AS order_id, t_sku AS sku, source_line_id, n_status AS order_status, CASE WHEN isnan(n_quantity) THEN NULL ELSE n_quantity END AS quantity,
  n_price AS original_price, CAST(l_created AS VARCHAR) AS create_time, CAST(l_version AS VARCHAR) AS source_updated_at, CAST(l_date AS VARCHAR) AS order_date, n_status = 'CANCELLED' AS is_cancelled"""


@query("normalised_lines", f"WITH {RAW} SELECT {TYPED_SQL} FROM typed")
def normalised_lines(spark, d):
    """Typed values, business-local times and the cancelled flag."""
    return typed(spark, d).select("platform", "order_id", "sku", "source_line_id", "order_status", "quantity", "original_price", "create_time",
                                  "source_updated_at", "order_date", "is_cancelled")


@query("clean_lines", f"""WITH {RAW}, latest AS (SELECT * FROM typed WHERE t_order_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t_order_id, t_platform, source_line_id ORDER BY l_version DESC NULLS LAST, source_object DESC, source_row DESC, part_key DESC, subtotal DESC) = 1)
SELECT {TYPED_SQL} FROM latest WHERE t_sku IS NOT NULL AND n_quantity BETWEEN 1 AND 100 AND n_price >= 0""")
def clean_lines(spark, d):
    """Analysis path: latest version per line, complete keys, plausible quantity and price."""
    raw = T.raw_events(spark, d)
    rows = unify.normalise(unify.unify(raw).withColumn("_part", F.get_json_object("raw_payload", "$._part").cast("long")))
    # Only these columns are shuffled: the key, the order of versions, and what is shown or judged.
    ties = ["source_object", "source_row", "_part", "subtotal"]
    shown = ["platform", "order_id", "sku", "source_line_id", "order_status", "quantity", "original_price", "create_time", "source_updated_at", "order_date", "is_cancelled"]
    kept = L.deduplicate_lines(rows.select(*shown, *ties), ties=ties)
    good = kept.dropna(subset=["order_id", "sku"]).filter(F.col("quantity").between(1, 100) & (F.col("original_price") >= 0))
    return good.select(*shown)


@query("cleaning_report", f"""WITH {RAW}, latest AS (SELECT * FROM typed WHERE t_order_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t_order_id, t_platform, source_line_id ORDER BY l_version DESC NULLS LAST, source_object DESC, source_row DESC, part_key DESC, subtotal DESC) = 1),
a AS (SELECT count(*) AS o FROM typed), b AS (SELECT count(*) AS c FROM latest WHERE t_sku IS NOT NULL AND n_quantity BETWEEN 1 AND 100 AND n_price >= 0)
SELECT o AS original_rows, c AS clean_rows, o - c AS removed_total, CAST((2 * c * 1000 + o) // (2 * o) AS DOUBLE) / 10 AS clean_pct FROM a, b""")
def cleaning_report(spark, d):
    return rules.cleaning_report(typed(spark, d).select("platform"), clean_lines(spark, d).select("platform"))


@query("rule_errors", f"""WITH {RAW} SELECT source_object, source_row, part_key, array_to_string(errors, '; ') AS rejection_reasons FROM checked WHERE len(errors) > 0""")
def rule_errors(spark, d):
    """Rejected rows with all their reasons in report order."""
    _, rejected = rules.split(rules.evaluated(checked(spark, d)))
    return rejected.select("source_object", "source_row", F.get_json_object("raw_payload", "$._part").cast("long").alias("part_key"), "rejection_reasons")


@query("rejection_reasons", f"""WITH {RAW} SELECT array_to_string(errors, '; ') AS reason, count(*) AS n FROM checked WHERE len(errors) > 0 GROUP BY 1""")
def rejection_reasons(spark, d):
    # The filter reads an aggregate, so it stays above the grouping and the rules are evaluated once.
    counted = checked(spark, d).groupBy("errors").agg(F.max("errors").alias("reason"), F.count(F.lit(1)).alias("n"))
    return counted.filter("reason <> ''").select("reason", "n")


@query("error_counts", f"""WITH {RAW} SELECT unnest(errors) AS error_code, count(*) AS n FROM checked GROUP BY 1""")
def error_counts(spark, d):
    return rules.error_counts(checked(spark, d))


@query("scorecard", f"""WITH {RAW} SELECT count(*) AS total_records, count(*) FILTER (len(errors) = 0) AS valid_records, count(*) FILTER (len(errors) > 0) AS invalid_records,
  round(count(*) FILTER (len(errors) = 0) / count(*), 6) AS pass_rate FROM checked""")
def scorecard(spark, d):
    return rules.scorecard(checked(spark, d))


@query("accounting", f"""WITH {RAW}, good AS (SELECT * FROM checked WHERE len(errors) = 0)
SELECT (SELECT count(*) FROM checked) AS raw_records, count(DISTINCT (t_order_id, t_platform, source_line_id)) AS valid_records,
  count(*) - count(DISTINCT (t_order_id, t_platform, source_line_id)) AS duplicate_records, (SELECT count(*) FROM checked WHERE len(errors) > 0) AS rejected_records, true AS balanced FROM good""")
def accounting(spark, d):
    """raw = valid + duplicates + rejected."""
    return rules.accounting(checked(spark, d), L.LINE_KEY)


@query("quarantine", f"""WITH {RAW} SELECT 'run-1' AS run_id, 'rejected' AS status, source_object, source_row, CAST(CASE WHEN n_price = 'inf'::DOUBLE THEN 'inf' ELSE NULL END AS VARCHAR) AS non_finite_price,
  array_to_string(errors, '; ') AS rejection_reasons, CAST(order_key % 24 AS BIGINT) AS created_hour FROM checked WHERE len(errors) > 0""")
def quarantine(spark, d):
    """Rejected rows written as JSON lines and read back: reasons, position, payload and non-finite price."""
    from marketloom.session import new_folder
    from marketloom.sources import quarantine as Q

    _, rejected = rules.split(rules.evaluated(checked(spark, d)))
    kept = rejected.select("source_object", "source_row", "original_price", "rejection_reasons", "raw_payload")
    target = Q.write(kept, new_folder(spark, "quarantine"), "run-1")
    back = Q.read(spark, target, "status string, source_object string, source_row long, original_price string, rejection_reasons string, raw_payload string")
    created = F.coalesce(F.get_json_object("raw_payload", "$.create_time"), F.get_json_object("raw_payload", "$.created_time"))
    return back.select(F.lit("run-1").alias("run_id"), "status", "source_object", "source_row",
                       F.when(F.col("original_price").isin("inf", "nan", "-inf"), F.col("original_price")).alias("non_finite_price"), "rejection_reasons",
                       F.substring(created, 12, 2).cast("long").alias("created_hour"))


@query("rejects_in_quarantine", f"""WITH {RAW}, r AS (SELECT DISTINCT source_object, source_row FROM checked WHERE len(errors) > 0),
q AS (SELECT DISTINCT source_object, source_row FROM checked WHERE len(errors) > 0 AND NOT list_contains(errors, 'INVALID_PLATFORM'))
SELECT count(*) AS rejected_positions, count(q.source_row) AS found, count(*) - count(q.source_row) AS not_found FROM r LEFT JOIN q ON r.source_object = q.source_object AND r.source_row = q.source_row""")
def rejects_in_quarantine(spark, d):
    """Which rejected positions an incomplete quarantine holds (here one reason was not stored)."""
    # Both sides read the rejected positions, so these are stored once and the rules are evaluated once.
    _, found = rules.split(rules.evaluated(checked(spark, d)))
    rows = materialise(found.select("source_object", "source_row", F.col("rejection_reasons").alias("errors")), "rejected")
    _, rejected = rules.split(rows)
    _, held = rules.split(rows.filter(~F.array_contains(rules.error_list(), "INVALID_PLATFORM")))
    return R.rejects_found(rejected, held)


@query("snapshot_rules", f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 1 THEN ' ' ELSE {USER_SKU} END AS sku, CASE event_id % 7 WHEN 0 THEN '-1' WHEN 1 THEN '1.5' WHEN 2 THEN NULL ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS stock,
  event_id % 13 = 3 AS bad_time, CASE WHEN event_id % 17 = 5 THEN 'x' END AS safety FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN bad_time THEN 'INVALID_LOADED_AT' END, CASE WHEN trim(sku) = '' THEN 'MISSING_SKU' END,
  CASE WHEN stock IS NULL OR CAST(stock AS DOUBLE) < 0 OR CAST(stock AS DOUBLE) % 1 <> 0 THEN 'INVALID_STOCK_ON_HAND' END, CASE WHEN safety IS NOT NULL THEN 'INVALID_SAFETY_STOCK' END], lambda e: e IS NOT NULL), '; ') AS reasons FROM s""")
def snapshot_rules(spark, d):
    """Row-level rules over a mixed snapshot batch; an empty text means accepted."""
    e, n = T.table(spark, d, "events"), F.col("event_id")
    rows = e.select(
        "event_id", F.when(n % 11 == 1, " ").otherwise(T.sku_of_user(F.col("user_id"))).alias("sku"),
        F.when(n % 7 == 0, "-1").when(n % 7 == 1, "1.5").when(n % 7 == 2, F.lit(None)).otherwise(F.floor("value").cast("int").cast("string")).alias("stock_on_hand"),
        F.when(n % 13 == 3, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("loaded_at"),
        F.when(n % 17 == 5, "x").alias("safety_stock"))
    return rules.with_errors(rows, rules.snapshot_rules(rows)).select("event_id", F.col("errors").alias("reasons"))


@query("request_rules", """WITH r AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS from_date, CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 AS INTEGER) - 10 AS to_date, CAST(o_orderkey % 40 AS BIGINT) AS lead_time,
  (o_orderkey % 60 + 45) / 100.0 AS level, CAST(o_custkey % 50 AS BIGINT) - 5 AS stock FROM orders)
SELECT request_id, array_to_string(list_filter([CASE WHEN from_date > to_date THEN 'RANGE_REVERSED' END, CASE WHEN date_diff('day', from_date, to_date) + 1 > 90 THEN 'RANGE_OVER_90_DAYS' END,
  CASE WHEN date_diff('day', DATE '2000-12-31', to_date) > 180 THEN 'TOO_MANY_STEPS' END, CASE WHEN lead_time NOT BETWEEN 1 AND 30 THEN 'LEAD_TIME_OUT_OF_RANGE' END,
  CASE WHEN CAST(level AS DECIMAL(5,2)) NOT BETWEEN 0.50 AND 0.99 THEN 'SERVICE_LEVEL_OUT_OF_RANGE' END, CASE WHEN stock < 0 THEN 'NEGATIVE_STOCK' END], lambda e: e IS NOT NULL), '; ') AS reasons FROM r""")
def request_rules(spark, d):
    """Forecast and policy request tables checked by the same rule framework."""
    o = T.table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    rows = o.select(
        F.col("o_orderkey").alias("request_id"), day.alias("from_date"), F.date_add(day, (F.col("o_custkey") % 120 - 10).cast("int")).alias("to_date"),
        (F.col("o_orderkey") % 40).alias("lead_time_days"), ((F.col("o_orderkey") % 60 + 45) / 100).cast("decimal(5,2)").alias("service_level"),
        (F.col("o_custkey") % 50 - 5).alias("current_stock"))
    found = rules.with_errors(rows, rules.forecast_request_rules(F.lit("2000-12-31").cast("date")) + rules.policy_request_rules())
    return found.select("request_id", F.col("errors").alias("reasons"))


# ---- one record per key -----------------------------------------------------------------

TIES = "ORDER BY source_updated_at DESC NULLS LAST, part_key DESC, supp_key DESC, subtotal DESC, quantity DESC"
LINE_TIES = ["part_key", "supp_key", "subtotal", "quantity"]


@query("dedupe_latest", f"""WITH {LINES} SELECT order_id, platform, source_line_id, part_key, supp_key, CAST(quantity AS BIGINT) AS quantity, CAST(subtotal AS DOUBLE) AS subtotal FROM lines
QUALIFY row_number() OVER (PARTITION BY order_id, platform, source_line_id {TIES}) = 1""")
def dedupe_latest(spark, d):
    """Latest version per order line."""
    return L.deduplicate_lines(T.order_lines(spark, d), ties=LINE_TIES).select(
        "order_id", "platform", "source_line_id", "part_key", "supp_key", "quantity", "subtotal")


@query("snapshot_latest", f"""WITH {SNAPSHOTS} SELECT sku, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(stock_on_hand AS BIGINT) AS stock_on_hand, event_id FROM snap_day""")
def snapshot_latest(spark, d):
    return I.daily_snapshots(T.snapshots(spark, d), ["event_id"]).select("sku", "snapshot_date", "stock_on_hand", "event_id")


@query("first_meta", f"""WITH {LINES} SELECT sku, product_name, category FROM lines QUALIFY row_number() OVER (PARTITION BY sku ORDER BY order_key, line_number, part_key) = 1""")
def first_meta(spark, d):
    """Name and category of the first line per SKU."""
    return L.first_by(T.order_lines(spark, d, product=True), ["sku"], ["order_key", "line_number", "part_key"], ["product_name", "category"])


@query("distinct_places", f"""WITH {LINES} SELECT state, '' AS city, '' AS district, 'VN' AS country, 'Bắc' AS region, min(region) AS source_region FROM lines GROUP BY 1""")
def distinct_places(spark, d):
    """Distinct geography rows with the stored empty text for absent parts, next to their source region."""
    lines = T.order_lines(spark, d, place=True).withColumns({c: F.lit(None).cast("string") for c in ("city", "district", "country")})
    source = lines.groupBy("state").agg(F.min("region").alias("source_region"))
    return star.geography_rows(lines).join(source, "state").select("state", "city", "district", "country", "region", "source_region")


# ---- merges -----------------------------------------------------------------------------

FACT_COLUMNS = ["order_id", "platform", "source_line_id", "date_key", "order_status", "cancel_reason", "quantity", "subtotal", "create_time",
                "pay_time", "shipped_time", "completed_time", "cancel_time", "source_updated_at"]


def fact_batch(lines: DataFrame, second: bool) -> DataFrame:
    """Fact-shaped rows of one batch; the second batch differs in versions and in which times it knows."""
    day = F.date_format("create_time", "yyyyMMdd").cast("int")
    n = F.col("line_number")
    empty = F.lit(None).cast("timestamp_ntz")
    shifted = F.col("source_updated_at") + F.make_dt_interval(days=F.when(F.col("part_key") % 2 == 0, 30).otherwise(-30))
    version = shifted if second else F.when(n % 7 != 3, F.col("source_updated_at"))
    return lines.select(
        "order_id", "platform", "source_line_id", F.when(F.lit(second) | (n % 5 != 0), day).alias("date_key"), "order_status",
        F.when(F.col("is_cancelled") & (F.lit(not second) | (n % 2 == 0)), F.lit("second" if second else "first")).alias("cancel_reason"),
        (F.col("quantity") + (1 if second else 0)).alias("quantity"), "subtotal", (F.col("create_time") + F.make_dt_interval(hours=F.lit(1 if second else 0))).alias("create_time"),
        F.when(n % 3 == (1 if second else 0), F.col("create_time")).otherwise(empty).alias("pay_time"),
        F.col("ship_date").alias("shipped_time"), empty.alias("completed_time"), empty.alias("cancel_time"), version.alias("source_updated_at"))


FACT_INPUT = ["order_id", "platform", "source_line_id", "line_number", "create_time", "order_status", "is_cancelled", "quantity", "subtotal", "part_key", "ship_date",
              "source_updated_at"]


def two_batches(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two batches from the latest version of every line, which is found and stored once."""
    needed = T.order_lines(spark, d).select(*FACT_INPUT, *[c for c in LINE_TIES if c not in FACT_INPUT])
    lines = materialise(L.deduplicate_lines(needed, ties=LINE_TIES).select(*FACT_INPUT), "latest-lines", "zstd")
    return fact_batch(lines.filter("part_key % 3 <> 0"), False), fact_batch(lines.filter("part_key % 3 = 0 or part_key % 5 = 0"), True)


MERGE_SQL = LINES + f""",
latest AS (SELECT *, CAST(strftime(create_time, '%Y%m%d') AS INTEGER) AS day_key FROM lines QUALIFY row_number() OVER (PARTITION BY order_id, platform, source_line_id {TIES}) = 1),
stored AS (SELECT order_id, platform, source_line_id, CASE WHEN line_number % 5 <> 0 THEN day_key END AS date_key, order_status, CASE WHEN is_cancelled THEN 'first' END AS cancel_reason, quantity, subtotal,
  create_time, CASE WHEN line_number % 3 = 0 THEN create_time END AS pay_time, ship_date AS shipped_time, CASE WHEN line_number % 7 <> 3 THEN source_updated_at END AS v FROM latest WHERE part_key % 3 <> 0),
incoming AS (SELECT order_id, platform, source_line_id, day_key AS date_key, order_status, CASE WHEN is_cancelled AND line_number % 2 = 0 THEN 'second' END AS cancel_reason, quantity + 1 AS quantity, subtotal,
  create_time + INTERVAL 1 HOUR AS create_time, CASE WHEN line_number % 3 = 1 THEN create_time END AS pay_time, ship_date AS shipped_time,
  source_updated_at + CASE WHEN part_key % 2 = 0 THEN INTERVAL 30 DAY ELSE INTERVAL '-30' DAY END AS v FROM latest WHERE part_key % 3 = 0 OR part_key % 5 = 0),
pairs AS (SELECT s.order_id IS NULL AS fresh, n.order_id IS NOT NULL AND (s.order_id IS NULL OR n.v >= coalesce(s.v, greatest(s.create_time, s.pay_time, s.shipped_time))) AS applies, s, n
  FROM stored s FULL OUTER JOIN incoming n ON s.order_id = n.order_id AND s.platform = n.platform AND s.source_line_id = n.source_line_id),
merged AS (SELECT coalesce(s.order_id, n.order_id) AS order_id, coalesce(s.platform, n.platform) AS platform, coalesce(s.source_line_id, n.source_line_id) AS source_line_id,
  CASE WHEN applies THEN coalesce(s.date_key, n.date_key) ELSE s.date_key END AS date_key, CASE WHEN applies THEN n.order_status ELSE s.order_status END AS order_status,
  CASE WHEN applies THEN coalesce(n.cancel_reason, s.cancel_reason) ELSE s.cancel_reason END AS cancel_reason, CASE WHEN applies THEN n.quantity ELSE s.quantity END AS quantity,
  CASE WHEN applies THEN n.subtotal ELSE s.subtotal END AS subtotal, CASE WHEN fresh THEN n.create_time ELSE s.create_time END AS create_time,
  CASE WHEN applies THEN coalesce(n.pay_time, s.pay_time) ELSE s.pay_time END AS pay_time, CASE WHEN applies THEN n.v ELSE s.v END AS source_updated_at FROM pairs)"""
MERGE_OUT = ("order_id, platform, source_line_id, CAST(date_key AS BIGINT) AS date_key, order_status, cancel_reason, CAST(quantity AS BIGINT) AS quantity, CAST(subtotal AS DOUBLE) AS subtotal, "
             "CAST(create_time AS VARCHAR) AS create_time, CAST(pay_time AS VARCHAR) AS pay_time, CAST(source_updated_at AS VARCHAR) AS source_updated_at")


@query("merge_fact", f"WITH {MERGE_SQL} SELECT {MERGE_OUT} FROM merged")
def merge_fact(spark, d):
    """Version-gated upsert of a second batch of order lines."""
    stored, incoming = two_batches(spark, d)
    return M.merge_fact(stored, incoming).select(*[c for c in FACT_COLUMNS if c not in ("shipped_time", "completed_time", "cancel_time")])


@query("merge_replay", f"""WITH {MERGE_SQL}, t AS (SELECT count(*) AS l, CAST(sum(quantity) AS BIGINT) AS u, CAST(sum(subtotal) AS DOUBLE) AS s FROM merged)
SELECT l AS before_lines, u AS before_units, s AS before_subtotal, l AS after_lines, u AS after_units, s AS after_subtotal, true AS unchanged FROM t""")
def merge_replay(spark, d):
    """The same batch merged again changes nothing."""
    stored, incoming = two_batches(spark, d)
    once = materialise(M.merge_fact(stored, incoming), "merged-once", "zstd")
    return R.replay_unchanged(once, M.merge_fact(once, incoming))


@query("merge_dim", f"""WITH {LINES}, b AS (SELECT sku, product_name, category, CAST(original_price AS DOUBLE) AS unit_cost, platform, row_number() OVER (PARTITION BY sku, platform ORDER BY order_id, source_line_id, part_key, subtotal) AS k FROM lines),
s AS (SELECT *, row_number() OVER (ORDER BY sku) AS product_key FROM b WHERE k = 1 AND platform = 'shopee'), n AS (SELECT * FROM b WHERE k = 1 AND platform = 'tiktok'),
f AS (SELECT n.*, row_number() OVER (ORDER BY sku) + (SELECT count(*) FROM s) AS product_key FROM n WHERE sku NOT IN (SELECT sku FROM s))
SELECT s.product_key, s.sku, coalesce(n.product_name, s.product_name) AS product_name, s.category || '!' AS category, coalesce(n.unit_cost, s.unit_cost) AS unit_cost FROM s LEFT JOIN n USING (sku)
UNION ALL SELECT product_key, sku, product_name, category, unit_cost FROM f""")
def merge_dim(spark, d):
    """Product dimension: name and cost follow the newest batch, category keeps its stored value."""
    lines = T.order_lines(spark, d, product=True)

    def batch(p: str) -> DataFrame:
        return L.first_by(lines.filter(F.col("platform") == p), ["sku"], ["order_id", "source_line_id", "part_key", "subtotal"],
                          ["product_name", "category", "original_price"]).select("sku", "product_name", "category", F.col("original_price").cast("double").alias("unit_cost"))

    empty = spark.createDataFrame([], "product_key long, sku string, product_name string, category string, unit_cost double")
    stored = materialise(M.merge_scd1(empty, batch("shopee"), ["sku"], [], "product_key"), "products").withColumn("category", F.concat("category", F.lit("!")))
    return M.merge_scd1(stored, batch("tiktok"), ["sku"], ["product_name", "unit_cost"], "product_key")


@query("insert_missing", f"""WITH {LINES}, a AS (SELECT DISTINCT supp_key FROM lines WHERE platform = 'shopee'), s AS (SELECT supp_key, row_number() OVER (ORDER BY supp_key) AS shop_key FROM a),
f AS (SELECT supp_key, row_number() OVER (ORDER BY supp_key) + (SELECT count(*) FROM s) AS shop_key FROM (SELECT DISTINCT supp_key FROM lines WHERE platform = 'tiktok' AND supp_key NOT IN (SELECT supp_key FROM s)))
SELECT supp_key, shop_key FROM s UNION ALL SELECT supp_key, shop_key FROM f""")
def insert_missing(spark, d):
    """Keys that are not stored yet are appended with the following surrogate numbers."""
    lines = T.order_lines(spark, d).select("supp_key", "platform")
    empty = spark.createDataFrame([], "supp_key long, shop_key long")
    stored = materialise(M.insert_missing(empty, lines.filter("platform = 'shopee'"), ["supp_key"], "shop_key"), "shops")
    return M.insert_missing(stored, lines.filter("platform = 'tiktok'"), ["supp_key"], "shop_key")


@query("merge_snapshots", f"""WITH {SNAPSHOTS}, s AS (SELECT sku, snapshot_date, snapshot_at, stock_on_hand FROM snap_day WHERE event_id % 2 = 0),
n AS (SELECT sku, snapshot_date, snapshot_at, stock_on_hand FROM snaps WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY sku, snapshot_date ORDER BY snapshot_at DESC) = 1)
SELECT coalesce(s.sku, n.sku) AS sku, CAST(coalesce(s.snapshot_date, n.snapshot_date) AS VARCHAR) AS snapshot_date,
  CAST(CASE WHEN s.sku IS NULL OR n.snapshot_at >= s.snapshot_at THEN n.stock_on_hand ELSE s.stock_on_hand END AS BIGINT) AS stock_on_hand FROM s FULL OUTER JOIN n ON s.sku = n.sku AND s.snapshot_date = n.snapshot_date""")
def merge_snapshots(spark, d):
    """Newer snapshots win, older replays are ignored."""
    snaps = T.snapshots(spark, d)
    stored = I.daily_snapshots(snaps, ["event_id"]).filter("event_id % 2 = 0").select("sku", "snapshot_date", "snapshot_at", "stock_on_hand")
    incoming = snaps.filter("event_id % 3 = 0").select("sku", "snapshot_date", "snapshot_at", "stock_on_hand")
    return M.merge_snapshots(stored, incoming, ["sku", "snapshot_date"]).select("sku", "snapshot_date", "stock_on_hand")


# ---- loaders ----------------------------------------------------------------------------

def two_loads(spark, load, lines: DataFrame, schema: str) -> DataFrame:
    """An empty dimension loaded with two thirds of the orders, then with the other third."""
    stored = materialise(load(spark.createDataFrame([], schema), lines.filter("order_key % 3 <> 0")), "dimension")
    return load(stored, lines.filter("order_key % 3 = 0"))


@query("load_shops", f"""WITH {LINES}, b AS (SELECT DISTINCT CASE WHEN supp_key % 10 = 0 THEN '' ELSE CAST(supp_key AS VARCHAR) END AS shop_id, platform, order_key % 3 <> 0 AS first FROM lines),
k AS (SELECT shop_id, platform, bool_or(first) AS old, bool_or(NOT first) AS renamed FROM b GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY NOT old, shop_id, platform) AS shop_key, shop_id, platform, CASE WHEN shop_id = '' THEN 'Shop' ELSE 'Shop ' || shop_id || CASE WHEN renamed THEN ' (2)' ELSE '' END END AS shop_name FROM k""")
def load_shops(spark, d):
    """Shops by shop and platform from two batches; the second renames those it knows, and lines without a shop share one."""
    shop = F.when(F.col("supp_key") % 10 != 0, F.col("supp_key").cast("string"))
    name = F.concat(F.lit("Shop "), shop, F.when(F.col("order_key") % 3 == 0, " (2)").otherwise(""))
    lines = T.order_lines(spark, d).withColumns({"shop_id": shop, "shop_name": name})
    return two_loads(spark, star.load_shops, lines, "shop_key long, shop_id string, platform string, shop_name string")


@query("load_geography", f"""WITH {LINES}, b AS (SELECT state, CASE WHEN line_number % 2 = 0 THEN carrier_name ELSE '' END AS city, CASE WHEN line_number % 4 = 0 THEN CAST(line_number AS VARCHAR) ELSE '' END AS district, bool_or(order_key % 3 <> 0) AS old FROM lines GROUP BY 1, 2, 3)
SELECT row_number() OVER (ORDER BY NOT old, state, city, district) AS geo_key, state, city, district, 'VN' AS country, 'Bắc' AS region FROM b""")
def load_geography(spark, d):
    """Places from two batches; absent parts are empty text on both sides, and no place comes twice."""
    lines = T.order_lines(spark, d, place=True).drop("geo_key", "region").withColumns({
        "city": F.when(F.col("line_number") % 2 == 0, F.col("carrier_name")), "district": F.when(F.col("line_number") % 4 == 0, F.col("line_number").cast("string")), "country": F.lit(None).cast("string")})
    return two_loads(spark, star.load_geography, lines, "geo_key long, state string, city string, district string, country string, region string")


@query("load_products", f"""WITH {LINES}, b AS (SELECT sku, order_key % 3 <> 0 AS first, CASE WHEN part_key % 5 = 0 THEN sku WHEN part_key % 5 = 1 THEN sku ELSE product_name END AS product_name, CASE WHEN part_key % 7 = 0 THEN 'Chung' ELSE category END AS category,
  CASE WHEN part_key % 11 = 0 THEN 0 ELSE CAST(original_price AS DOUBLE) END AS unit_cost, CASE WHEN part_key % 3 = 0 THEN 0.1 ELSE 0.25 END AS weight_kg FROM lines
  QUALIFY row_number() OVER (PARTITION BY sku, order_key % 3 <> 0 ORDER BY order_id, source_line_id, part_key, subtotal) = 1),
j AS (SELECT coalesce(o.sku, n.sku) AS sku, o.sku IS NOT NULL AS old, coalesce(n.product_name, o.product_name) AS product_name, coalesce(o.category, n.category) AS category, coalesce(n.unit_cost, o.unit_cost) AS unit_cost,
  CAST(coalesce(n.weight_kg, o.weight_kg) AS DOUBLE) AS weight_kg FROM (SELECT * FROM b WHERE first) o FULL JOIN (SELECT * FROM b WHERE NOT first) n ON o.sku = n.sku)
SELECT row_number() OVER (ORDER BY NOT old, sku) AS product_key, sku, product_name, category, unit_cost, weight_kg FROM j""")
def load_products(spark, d):
    """Products from two batches with absent and 'nan' values: names fall back to the SKU, the rest to documented defaults."""
    n = F.col("part_key")
    lines = T.order_lines(spark, d, product=True).withColumns({
        "product_name": F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "NaN").otherwise(F.col("product_name")), "category": F.when(n % 7 != 0, F.col("category")),
        "original_price": F.when(n % 11 == 0, F.lit("nan").cast("double")).otherwise(F.col("original_price").cast("double")), "weight_kg": F.when(n % 3 != 0, 0.25)})
    order = ("order_id", "source_line_id", "part_key", "subtotal")
    return two_loads(spark, lambda stored, rows: star.load_products(stored, rows, order), lines,
                     "product_key long, sku string, product_name string, category string, unit_cost double, weight_kg double")


@query("platform_inference", f"""WITH {LINES} SELECT platform, count(*) AS rows, count(DISTINCT order_id) AS orders FROM lines GROUP BY 1 UNION ALL SELECT 'unknown', count(*), CAST(0 AS BIGINT) FROM lines WHERE line_number = 1""")
def platform_inference(spark, d):
    """Batches that do not say where they come from: the layout tells, or the platform stays unknown."""
    lines = T.order_lines(spark, d).select("platform", "order_id", F.col("quantity").cast("string").alias("quantity"), "line_number")
    batches = [lines.filter("platform = 'shopee'").select(F.col("order_id").alias("order_sn"), "quantity"), lines.filter("platform = 'tiktok'").select("order_id", "quantity"),
               lines.filter("line_number = 1").select("quantity")]
    unified = [unify.unify(unify.with_platform(b)).select("platform", "order_id") for b in batches]
    return unified[0].unionByName(unified[1]).unionByName(unified[2]).groupBy("platform").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("order_id").alias("orders"))


# ---- star lookup ------------------------------------------------------------------------

def star_dimensions(spark, d) -> dict[str, DataFrame]:
    """Dimensions from the provided tables; one carrier and one shop in ten are missing on purpose."""
    from marketloom.plans.sales_queries import calendar_of

    lines = T.table(spark, d, "lineitem")
    both = F.explode(F.array(F.lit("shopee"), F.lit("tiktok"))).alias("platform")
    return {
        "products": T.products(spark, d).select("sku").distinct().join(
            T.products(spark, d).groupBy("sku").agg(F.min("part_key").alias("product_key")), "sku"),
        "shops": T.table(spark, d, "supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").cast("string").alias("shop_id"), both, F.col("s_suppkey").alias("shop_key")),
        "geography": T.table(spark, d, "nation").select(F.col("n_name").alias("state"), F.lit("").alias("city"), F.lit("").alias("district"), F.col("n_nationkey").alias("geo_key")),
        "dates": calendar_of(spark, d),
        "payments": T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("payment_method")).distinct().withColumn("payment_key", F.ascii("payment_method")),
        "carriers": lines.select(F.col("l_returnflag").alias("carrier_name")).distinct().filter("carrier_name <> 'R'").withColumn("carrier_key", F.ascii("carrier_name")),
    }


def star_fact(spark, d) -> DataFrame:
    lines = T.order_lines(spark, d, product=True, place=True).drop("geo_key").withColumns({
        "shop_id": F.col("supp_key").cast("string"), "city": F.lit(None).cast("string"), "district": F.lit(None).cast("string"),
        "carrier_name": F.when(F.col("line_number") != 7, F.col("carrier_name"))})
    return star.resolve_fact_keys(lines, star_dimensions(spark, d))


STAR_SQL = LINES + """,
pk AS (SELECT p_brand || ' ' || p_type AS sku, min(p_partkey) AS product_key FROM part GROUP BY 1),
fact AS (SELECT l.*, pk.product_key, CASE WHEN supp_key % 10 <> 0 THEN supp_key END AS shop_key,
  date_diff('day', (SELECT CAST(min(o_orderdate) AS DATE) FROM orders), order_date) + 1 AS date_key, ascii(payment_method) AS payment_key,
  CASE WHEN line_number <> 7 THEN carrier_name END AS carrier, CASE WHEN line_number <> 7 AND carrier_name <> 'R' THEN ascii(carrier_name) END AS carrier_key
  FROM lines l LEFT JOIN pk USING (sku))"""


@query("fact_star_lookup", f"""WITH {STAR_SQL} SELECT order_id, platform, source_line_id, product_key, shop_key, CAST(geo_key AS BIGINT) AS geo_key, CAST(date_key AS BIGINT) AS date_key,
  CAST(payment_key AS BIGINT) AS payment_key, CAST(carrier_key AS BIGINT) AS carrier_key, CAST(quantity AS BIGINT) AS quantity FROM fact""")
def fact_star_lookup(spark, d):
    """Order lines with their six dimension keys."""
    return star.require_keys(star_fact(spark, d)).select("order_id", "platform", "source_line_id", "product_key", "shop_key", "geo_key", "date_key", "payment_key", "carrier_key", "quantity")


@query("unresolved_dims", f"""WITH {STAR_SQL} SELECT count(*) FILTER (carrier_key IS NULL AND carrier IS NULL) AS carrier_key_source_blank, count(*) FILTER (carrier_key IS NULL AND carrier IS NOT NULL) AS carrier_key_unresolved,
  CAST(0 AS BIGINT) AS shop_key_source_blank, count(*) FILTER (shop_key IS NULL) AS shop_key_unresolved, CAST(0 AS BIGINT) AS product_key_source_blank, count(*) FILTER (product_key IS NULL) AS product_key_unresolved FROM fact""")
def unresolved_dims(spark, d):
    """Null keys, split by whether the source value was blank."""
    return star.unresolved(star_fact(spark, d), {"carrier_key": "carrier_name", "shop_key": "shop_id", "product_key": "sku"})


@query("region_labels", """SELECT n_name AS state, CASE WHEN n_nationkey % 3 = 0 THEN 'Nam' WHEN n_nationkey % 3 = 1 THEN 'Trung' ELSE 'Bắc' END AS load_region,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Miền Nam' WHEN n_nationkey % 3 = 1 THEN 'Miền Trung' ELSE 'Khác' END AS seed_region FROM nation""")
def region_labels(spark, d):
    """Both region labellings over a province assigned to each nation."""
    n = F.col("n_nationkey")
    province = F.when(n % 3 == 0, "Cần Thơ").when(n % 3 == 1, "Đà Nẵng").otherwise("Lào Cai")
    return T.table(spark, d, "nation").select(F.col("n_name").alias("state"), S.region_of(province).alias("load_region"), S.region_of(province, "seed").alias("seed_region"))


@query("state_as_of", f"""WITH {LINES}, s AS (SELECT platform, is_cancelled, create_time + INTERVAL 1 DAY AS pay, ship_date AS ship, CASE WHEN order_status = 'COMPLETED' THEN ship_date + INTERVAL 3 DAY END AS deliver,
  CASE WHEN order_status = 'COMPLETED' THEN ship_date + INTERVAL 5 DAY END AS done, CASE WHEN is_cancelled THEN create_time + INTERVAL 2 DAY END AS cancel, TIMESTAMP '1998-06-01' AS cut FROM lines)
SELECT platform, CASE WHEN cancel <= cut THEN 'CANCELLED' WHEN done <= cut THEN 'COMPLETED' WHEN platform <> 'shopee' AND deliver <= cut THEN 'DELIVERED' WHEN ship <= cut THEN 'SHIPPED'
  WHEN pay <= cut THEN CASE WHEN platform = 'shopee' THEN 'READY_TO_SHIP' ELSE 'AWAITING_SHIPMENT' END ELSE 'UNPAID' END AS order_status, count(*) AS n, count(*) FILTER (cancel <= cut) AS with_reason FROM s GROUP BY ALL""")
def state_as_of(spark, d):
    """Order state as it was known at a cutoff."""
    day = lambda c, n: F.col(c) + F.make_dt_interval(days=F.lit(n))
    done = F.col("order_status") == "COMPLETED"
    rows = T.order_lines(spark, d).withColumns({
        "pay_time": day("create_time", 1), "shipped_time": F.col("ship_date"), "delivered_time": F.when(done, day("ship_date", 3)),
        "completed_time": F.when(done, day("ship_date", 5)), "cancel_time": F.when(F.col("is_cancelled"), day("create_time", 2)), "cancel_reason": F.when(F.col("is_cancelled"), "buyer")})
    out = unify.state_as_of(rows, F.lit("1998-06-01").cast("timestamp_ntz"))
    return out.groupBy("platform", "order_status").agg(F.count(F.lit(1)).alias("n"), F.count("cancel_reason").alias("with_reason"))


# ---- reconciliation ---------------------------------------------------------------------

@query("source_vs_target", f"""WITH {MERGE_SQL}, e AS (SELECT order_id, platform, source_line_id, quantity, order_status, subtotal FROM latest),
j AS (SELECT e.order_id AS eo, m.order_id AS mo, e.quantity AS eq, m.quantity AS mq, e.order_status AS es, m.order_status AS ms, e.subtotal AS et, m.subtotal AS mt FROM e FULL OUTER JOIN merged m ON e.order_id = m.order_id AND e.platform = m.platform AND e.source_line_id = m.source_line_id)
SELECT count(eo) AS expected_rows, count(mo) AS actual_rows, count(*) FILTER (mo IS NULL) AS missing_in_target, count(*) FILTER (eo IS NULL) AS unexpected_in_target,
  count(*) FILTER (eo IS NOT NULL AND mo IS NOT NULL AND (eq <> mq OR es <> ms OR et <> mt)) AS rows_with_mismatch, count(*) FILTER (eo IS NOT NULL AND mo IS NOT NULL AND eq <> mq) AS mismatch_quantity,
  count(*) FILTER (eo IS NOT NULL AND mo IS NOT NULL AND es <> ms) AS mismatch_order_status, count(*) FILTER (eo IS NOT NULL AND mo IS NOT NULL AND et <> mt) AS mismatch_subtotal FROM j""")
def source_vs_target(spark, d):
    """Deduplicated source lines against the merged fact, field by field."""
    stored, incoming = two_batches(spark, d)
    source = L.deduplicate_lines(T.order_lines(spark, d), ties=LINE_TIES)
    return R.source_vs_target(source, M.merge_fact(stored, incoming), L.LINE_KEY, ["quantity", "order_status"], ["subtotal"])


@query("key_diff", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS missing, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS unexpected, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS common""")
def key_diff(spark, d):
    li = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return R.key_difference(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), ["k"])


@query("absent_products", """SELECT DISTINCT l_partkey AS part_key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def absent_products(spark, d):
    """Products sold but absent from a product list."""
    known = T.table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("part_key"))
    return T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part_key")).distinct().join(known, "part_key", "left_anti")


@query("multiset_diff", """WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL OUTER JOIN b ON a.k = b.k) SELECT k, greatest(d, 0) AS missing, greatest(-d, 0) AS extra FROM j WHERE d <> 0""")
def multiset_diff(spark, d):
    """Occurrences per id compared between two event sets."""
    li = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linestatus")
    return R.multiset_difference(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"), ["k"])


@query("table_fingerprint", """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)), 1, 12) AS BIGINT)) AS VARCHAR) AS hash_sum FROM orders""")
def table_fingerprint(spark, d):
    """Order-free fingerprint of a table."""
    return R.fingerprint(T.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "md5")


@query("warehouse_audit", f"""WITH {STAR_SQL} SELECT count(*) AS lines, count(DISTINCT (platform, order_id)) AS orders, count(*) FILTER (is_cancelled) AS cancelled_lines, CAST(sum(quantity) AS BIGINT) AS units,
  count(*) FILTER (quantity <= 0) AS non_positive_quantity, count(*) FILTER (product_key IS NULL) AS null_product_key, count(*) FILTER (shop_key IS NULL) AS null_shop_key, count(*) FILTER (carrier_key IS NULL) AS null_carrier_key,
  CAST(min(create_time) AS VARCHAR) AS first_time, CAST(max(create_time) AS VARCHAR) AS last_time FROM fact""")
def warehouse_audit(spark, d):
    return R.warehouse_audit(star_fact(spark, d), ["product_key", "shop_key", "carrier_key"])


@query("transition_sanity", f"""WITH {LINES} SELECT count(*) FILTER (greatest(create_time, ship_date) > TIMESTAMP '1999-01-01') AS after_cutoff,
  count(*) FILTER (order_status = 'COMPLETED' AND line_number % 4 = 0) AS missing_completed_time FROM lines""")
def transition_sanity(spark, d):
    rows = T.order_lines(spark, d).withColumn("completed_time", F.when((F.col("order_status") == "COMPLETED") & (F.col("line_number") % 4 != 0), F.lit("1995-01-01").cast("timestamp_ntz")))
    return R.transition_sanity(rows, F.lit("1999-01-01").cast("timestamp_ntz"), ["create_time", "ship_date", "completed_time"])


@query("missing_days", """WITH days AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT CAST(d AS VARCHAR) AS order_date FROM days WHERE NOT EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderdate AS DATE) = d)""")
def missing_days(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("order_date"))
    return R.missing_days(rows, F.lit("1994-12-01").cast("date"), F.lit("2001-12-31").cast("date"))


@query("stage_counts", f"""WITH {RAW}, g AS (SELECT source_row, bool_or(len(errors) = 0) AS v, bool_or(len(errors) > 0) AS r FROM checked GROUP BY 1)
SELECT count(*) AS sent_events, count(*) AS lake_events, count(*) FILTER (v) AS valid_events, count(*) FILTER (r) AS rejected_events, round((count(*) - count(*) FILTER (v)) * 100.0 / count(*), 4) AS loss_pct FROM g""")
def stage_counts(spark, d):
    """How many sent events reached each stage, and the loss between first and last."""
    # Three stages and the total read these two columns, so they are stored once.
    rows = materialise(checked(spark, d).select(F.col("source_row"), "errors"), "stages")
    stages = {"lake": rows, "valid": rows.filter("errors = ''"), "rejected": rows.filter("errors <> ''")}
    sent = T.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row"))
    out = R.stage_counts(sent, stages, "source_row")
    return out.withColumn("loss_pct", F.round(monitor.loss_percent(F.col("sent_events"), F.col("valid_events")), 4))


@query("import_checks", f"""WITH {LINES}, v AS (SELECT *, quantity <= 45 AS valid FROM lines), a AS (SELECT * FROM v WHERE valid AND NOT is_cancelled)
SELECT v.platform, count(*) AS source_rows, count(*) FILTER (valid) AS valid_rows, count(*) FILTER (NOT valid) AS rejected_rows, count(*) FILTER (valid AND is_cancelled) AS cancelled_rows,
  count(DISTINCT CASE WHEN valid AND NOT is_cancelled THEN sku END) AS active_skus, count(DISTINCT CASE WHEN valid AND NOT is_cancelled THEN order_date END) AS active_days,
  CAST(min(CASE WHEN valid AND NOT is_cancelled THEN order_date END) AS VARCHAR) AS active_start, CAST(max(CASE WHEN valid AND NOT is_cancelled THEN order_date END) AS VARCHAR) AS active_end,
  max((SELECT count(*) FROM (SELECT order_key % 500 AS g FROM a WHERE a.platform = v.platform GROUP BY 1 HAVING count(DISTINCT order_date) > 1))) AS order_ids_reused_across_dates FROM v GROUP BY v.platform""")
def import_checks(spark, d):
    """Summary of an import, with order ids that are reused across dates."""
    from marketloom.sources import history as H

    rows = T.order_lines(spark, d, product=True).withColumns({"valid": F.col("quantity") <= 45, "source_order_id": (F.col("order_key") % 500).cast("string")})
    return H.import_summary(rows)
