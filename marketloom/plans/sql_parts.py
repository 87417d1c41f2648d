"""Common table expressions shared by the check SQL."""

LINES = """
lines AS (
  SELECT o.o_orderkey AS order_key, CAST(o.o_orderkey AS VARCHAR) AS order_id, o.o_custkey AS cust_key,
    CASE WHEN o.o_orderkey % 20 < 11 THEN 'shopee' ELSE 'tiktok' END AS platform,
    'id:' || CAST(l.l_linenumber AS VARCHAR) AS source_line_id, l.l_linenumber AS line_number,
    l.l_partkey AS part_key, l.l_suppkey AS supp_key, CAST(l.l_quantity AS INTEGER) AS quantity,
    CAST(l.l_extendedprice AS DECIMAL(14,2)) AS subtotal,
    CAST(CAST((2 * CAST(round(l.l_extendedprice * 100) AS BIGINT) + CAST(l.l_quantity AS BIGINT)) // (2 * CAST(l.l_quantity AS BIGINT)) AS DECIMAL(16,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS original_price,
    CAST(round(CAST(l.l_extendedprice AS DECIMAL(14,2)) * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS seller_discount,
    CAST(round(CAST(l.l_extendedprice AS DECIMAL(14,2)) * CAST(l.l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS platform_discount,
    CAST(CAST(l.l_extendedprice AS DECIMAL(14,2)) - CAST(round(CAST(l.l_extendedprice AS DECIMAL(14,2)) * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS DECIMAL(14,2)) AS buyer_total_amount,
    l.l_returnflag AS carrier_name, l.l_shipdate AS ship_date, l.l_shipdate AS source_updated_at,
    CASE o.o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'SHIPPED' ELSE 'CANCELLED' END AS order_status,
    o.o_orderstatus = 'P' AS is_cancelled, o.o_orderdate AS create_time, CAST(o.o_orderdate AS DATE) AS order_date,
    o.o_orderpriority AS payment_method,
    p.p_brand || ' ' || p.p_type AS sku, p.p_name AS product_name, p.p_type AS category,
    n.n_nationkey AS geo_key, n.n_name AS state, r.r_name AS region
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
    JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey)"""

DAILY = LINES + """,
span AS (SELECT min(order_date) AS lo, max(order_date) AS hi FROM lines WHERE NOT is_cancelled),
sold AS (
  SELECT sku, order_date AS date, CAST(sum(quantity) AS DOUBLE) AS daily_demand, CAST(sum(buyer_total_amount) AS DOUBLE) AS daily_revenue,
    CAST(sum(original_price) AS DOUBLE) / count(original_price) AS avg_unit_price, CAST(sum(seller_discount) AS DOUBLE) AS total_discount,
    CAST(count(DISTINCT (platform, order_id)) AS DOUBLE) AS order_count
  FROM lines WHERE NOT is_cancelled GROUP BY ALL),
grid AS (
  SELECT s.sku, CAST(t.d AS DATE) AS date FROM (SELECT DISTINCT sku FROM sold) s
    CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM span) t),
daily AS (
  SELECT g.sku, g.date, coalesce(s.daily_demand, 0) AS daily_demand, coalesce(s.daily_revenue, 0) AS daily_revenue,
    coalesce(last_value(s.avg_unit_price IGNORE NULLS) OVER (PARTITION BY g.sku ORDER BY g.date ROWS UNBOUNDED PRECEDING), 0) AS avg_unit_price,
    coalesce(s.total_discount, 0) AS total_discount, coalesce(s.order_count, 0) AS order_count
  FROM grid g LEFT JOIN sold s ON s.sku = g.sku AND s.date = g.date)"""

# Segments of one origin from demand(data_origin, sku, product_name, category, order_date, q, r), on the full grid.
def segments(source: str, z: str = "1.645", floor: bool = True, prefix: str = "") -> str:
    p = prefix
    low = ("greatest(1, {0})", "greatest({1} + 1, {0})") if floor else ("{0}", "{0}")
    stock = low[0].format(f"ceil(round({z} * std_demand * sqrt(3), 9))")
    point = low[1].format("ceil(round(mean_demand * 3 + safety_stock, 9))", "safety_stock")
    return f"""
{p}bounds AS (SELECT data_origin, min(order_date) AS lo, max(order_date) AS hi FROM {source} GROUP BY 1),
{p}totals AS (SELECT data_origin, sku, max(product_name) AS product_name, max(category) AS category, sum(r) AS revenue, sum(q) AS total_units FROM {source} GROUP BY 1, 2),
{p}weights AS (SELECT *, CASE WHEN sum(revenue) OVER (PARTITION BY data_origin) > 0 THEN CAST(revenue AS DECIMAL(30,2)) ELSE CAST(total_units AS DECIMAL(30,2)) END AS abc_weight FROM {p}totals),
{p}cum AS (SELECT *, sum(abc_weight) OVER (PARTITION BY data_origin) AS total_weight,
  sum(abc_weight) OVER (PARTITION BY data_origin ORDER BY abc_weight DESC, sku ROWS UNBOUNDED PRECEDING) AS cum_weight FROM {p}weights),
{p}perday AS (SELECT data_origin, sku, order_date, CAST(sum(q) AS DOUBLE) AS q FROM {source} GROUP BY 1, 2, 3),
{p}days AS (SELECT t.data_origin, t.sku, CAST(unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) AS DATE) AS d FROM {p}totals t JOIN {p}bounds b USING (data_origin)),
{p}stats AS (SELECT g.data_origin, g.sku, avg(coalesce(x.q, 0)) AS mean_demand, coalesce(stddev_samp(coalesce(x.q, 0)), 0) AS std_demand
  FROM {p}days g LEFT JOIN {p}perday x ON x.data_origin = g.data_origin AND x.sku = g.sku AND x.order_date = g.d GROUP BY 1, 2),
{p}classed AS (SELECT c.*, s.mean_demand, s.std_demand, CASE WHEN s.mean_demand > 0 THEN s.std_demand / s.mean_demand ELSE 999 END AS cv,
  coalesce(CAST(cum_weight - abc_weight AS DOUBLE) / nullif(CAST(total_weight AS DOUBLE), 0), 0) AS prev_share,
  coalesce(CAST(cum_weight AS DOUBLE) / nullif(CAST(total_weight AS DOUBLE), 0), 0) AS cum_share
  FROM {p}cum c JOIN {p}stats s USING (data_origin, sku)),
{p}named AS (SELECT *, CASE WHEN prev_share < 0.80 THEN 'A' WHEN prev_share < 0.95 THEN 'B' ELSE 'C' END AS abc_class,
  CASE WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz_class, {stock} AS safety_stock FROM {p}classed),
{p}segments AS (SELECT *, abc_class || xyz_class AS matrix_segment, {point} AS reorder_point FROM {p}named)"""


DEMAND = LINES + """,
demand AS (
  SELECT 'unverified_warehouse' AS data_origin, sku, product_name, category, order_date, CAST(quantity AS DECIMAL(18,0)) AS q,
    CAST(buyer_total_amount AS DECIMAL(18,2)) AS r FROM lines WHERE NOT is_cancelled AND platform = 'shopee'
  UNION ALL
  SELECT 'public_anonymized_historical_csv', sku, product_name, NULL, order_date, CAST(quantity AS DECIMAL(18,0)), CAST(0 AS DECIMAL(18,2))
  FROM lines WHERE NOT is_cancelled AND platform = 'tiktok')"""

LIVE_DEMAND = LINES + """,
demand AS (
  SELECT 'unverified_warehouse' AS data_origin, sku, product_name, category, order_date, CAST(quantity AS DECIMAL(18,0)) AS q,
    CAST(buyer_total_amount AS DECIMAL(18,2)) AS r FROM lines WHERE NOT is_cancelled)"""

USER_SKU = ("'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) || ' ' || "
            "(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])[CAST((user_id // 25) % 6 + 1 AS INTEGER)]")

SNAPSHOTS = f"""
snaps AS (SELECT event_id, {USER_SKU} AS sku, ts AS snapshot_at, CAST(ts AS DATE) AS snapshot_date, CAST(floor(value) AS INTEGER) AS stock_on_hand FROM events),
snap_day AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY sku, snapshot_date ORDER BY snapshot_at DESC, event_id DESC) = 1),
stock AS (SELECT sku, stock_on_hand AS current_stock, snapshot_date AS last_audited_date FROM snap_day
  QUALIFY row_number() OVER (PARTITION BY sku ORDER BY snapshot_date DESC) = 1)"""

# Spoilt source rows in canonical form, x is the case number.
RAW = LINES + """,
base AS (SELECT *, (order_key * 7 + line_number * 13 + part_key) % 101 AS x, create_time + to_hours(CAST(order_key % 24 AS INTEGER)) AS created FROM lines),
raw AS (
  SELECT b.*, x = 0 AS other, platform = 'shopee' AS is_a,
    CASE WHEN x = 0 THEN 'Lazada' ELSE platform END AS t_platform, CASE WHEN x = 1 THEN CASE WHEN x = 0 THEN NULL ELSE '' END ELSE order_id END AS t_order_id,
    CASE WHEN x IN (0, 2) THEN NULL ELSE sku END AS t_sku, CASE WHEN x = 0 THEN NULL WHEN x = 13 THEN repeat('n', 501) ELSE product_name END AS t_name,
    CASE x WHEN 3 THEN 'bad' WHEN 4 THEN '-5' WHEN 5 THEN '1.5' WHEN 6 THEN '500' ELSE CAST(quantity AS VARCHAR) END AS t_quantity,
    CASE x WHEN 0 THEN NULL WHEN 7 THEN '-99000.00' WHEN 8 THEN 'oops' WHEN 9 THEN 'inf' ELSE CAST(original_price AS VARCHAR) END AS t_price,
    CASE WHEN x = 12 THEN 'WEIRD' WHEN x % 3 = 0 THEN ' ' || lower(order_status) ELSE order_status END AS t_status,
    CASE WHEN x = 10 THEN 'not-a-time' ELSE strftime(ship_date + to_hours(line_number), '%Y-%m-%dT%H:%M:%SZ') END AS t_updated,
    CASE WHEN x = 0 AND platform <> 'shopee' THEN NULL ELSE created END AS c_created,
    CASE WHEN x = 0 THEN NULL WHEN x = 11 THEN created - INTERVAL 24 HOUR ELSE created + INTERVAL 1 HOUR END AS c_paid,
    CASE WHEN x = 0 THEN NULL ELSE created + INTERVAL 48 HOUR END AS c_shipped,
    CASE WHEN x <> 0 AND order_status = 'COMPLETED' THEN created + INTERVAL 120 HOUR END AS c_done,
    CASE WHEN x <> 0 AND is_cancelled THEN created + INTERVAL 3 HOUR END AS c_cancel
  FROM base b),
typed AS (
  SELECT *, TRY_CAST(t_quantity AS DOUBLE) AS n_quantity, TRY_CAST(t_price AS DOUBLE) AS n_price, upper(trim(t_status)) AS n_status,
    c_created + INTERVAL 7 HOUR AS l_created, CAST(c_created + INTERVAL 7 HOUR AS DATE) AS l_date,
    coalesce(CASE WHEN x <> 10 THEN ship_date + to_hours(line_number) END, greatest(c_created, c_paid, c_shipped, c_done, c_cancel)) + INTERVAL 7 HOUR AS l_version,
    'lines/part-' || CAST(order_key % 16 AS VARCHAR) AS source_object, order_key * 10 + line_number AS source_row
  FROM raw),
checked AS (
  SELECT *, list_filter([
    CASE WHEN x = 15 AND is_a THEN 'INVALID_VOUCHER_TOTAL_TYPE' END,
    CASE WHEN x = 10 THEN 'INVALID_SOURCE_UPDATED_AT_TYPE' END,
    CASE WHEN x = 1 THEN 'MISSING_ORDER_ID' END,
    CASE WHEN t_sku IS NULL THEN 'MISSING_SKU' END,
    CASE WHEN c_created IS NULL THEN 'MISSING_CREATE_TIME' END,
    CASE WHEN length(t_name) > 500 THEN 'TOO_LONG_PRODUCT_NAME' END,
    CASE WHEN lower(t_platform) NOT IN ('shopee', 'tiktok') THEN 'INVALID_PLATFORM' END,
    CASE WHEN n_status NOT IN ('UNPAID', 'READY_TO_SHIP', 'SHIPPED', 'COMPLETED', 'CANCELLED', 'IN_CANCEL', 'TO_RETURN', 'AWAITING_SHIPMENT', 'AWAITING_COLLECTION', 'DELIVERED', 'IN_TRANSIT', 'CANCEL_REQUESTED') THEN 'INVALID_ORDER_STATUS' END,
    CASE WHEN n_quantity IS NULL OR n_quantity <= 0 THEN 'NON_POSITIVE_QUANTITY' WHEN n_quantity > 100 THEN 'OUTLIER_QUANTITY' WHEN n_quantity % 1 <> 0 THEN 'NON_INTEGER_QUANTITY' END,
    CASE WHEN n_price IS NULL THEN 'INVALID_ORIGINAL_PRICE_TYPE' WHEN n_price < 0 THEN 'NEGATIVE_ORIGINAL_PRICE' WHEN n_price > 1e9 THEN 'OUTLIER_ORIGINAL_PRICE' END,
    CASE WHEN other THEN 'INVALID_SUBTOTAL_TYPE' END,
    CASE WHEN other THEN 'INVALID_BUYER_TOTAL_AMOUNT_TYPE' END,
    CASE WHEN x = 14 AND is_a THEN 'INVALID_WEIGHT_KG' END,
    CASE WHEN c_created IS NULL THEN 'INVALID_CREATE_TIMESTAMP' END,
    CASE WHEN c_paid < c_created THEN 'PAY_TIME_BEFORE_CREATE_TIME' END], lambda e: e IS NOT NULL) AS errors
  FROM typed)"""

# Share of errors in sliding windows of six hours.
RATIO_SQL = """WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS slot, count(*) AS n, count(*) FILTER (event_type = 'error') AS h FROM events GROUP BY 1),
w AS (SELECT slot - to_hours(CAST(k AS INTEGER)) AS ws, n, h FROM s, (SELECT unnest(range(6)) AS k)), g AS (SELECT ws, sum(n) AS n, sum(h) AS h FROM w GROUP BY 1)
SELECT CAST(ws AS VARCHAR) AS window_start, CAST(n AS BIGINT) AS n, CAST(h AS BIGINT) AS hits, round(h / n, 6) AS share, h / n > 0.10 AS alert FROM g"""
