"""Lake, CSV, JSON, mart files and streams, driven by the provided tables."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators import forecast as P
from marketloom.operators import monitor
from marketloom.operators import reconcile as R
from marketloom.plans import marts
from marketloom.plans.demand_queries import live_segments, product_table, segment_columns, sku_lines
from marketloom.plans.registry import query
from marketloom.plans.sales_queries import SUMMARY_SQL, cents_ratio, summary_of
from marketloom.plans.sql_parts import DAILY, LINES, LIVE_DEMAND, RATIO_SQL, RAW, USER_SKU, segments
from marketloom.plans.demand_queries import SEG_OUT
from marketloom.session import materialise, new_folder, release
from marketloom.sources import history as H
from marketloom.sources import lake
from marketloom.sources import tables as T
from marketloom.sources import warehouse as W
from marketloom.streaming import jobs


def lake_schema(spark, d) -> T_.StructType:
    """Columns of the order lake, declared rather than read from its files."""
    return lake.stored_schema(T.raw_events(spark, d).schema)


def order_lake(spark, d) -> str:
    """Raw events written to the lake."""
    path = new_folder(spark, "lake")
    lake.write_lake(lake.with_partitions(T.raw_events(spark, d)), path)
    return path


PARTS = "CASE WHEN x = 0 THEN 'unknown' ELSE platform END AS platform, CAST(created + INTERVAL 7 HOUR AS DATE) AS local_day"


@query("lake_day_scan", f"""WITH {RAW}, p AS (SELECT {PARTS}, t_quantity FROM raw) SELECT platform, count(*) AS rows, count(t_quantity) AS with_quantity FROM p WHERE local_day = DATE '1997-03-15' GROUP BY 1""")
def lake_day_scan(spark, d):
    """One business day over all platforms; only its directories are read."""
    rows = lake.scan_day(spark, order_lake(spark, d), dt.date(1997, 3, 15), lake_schema(spark, d))
    return rows.groupBy("platform").agg(F.count(F.lit(1)).alias("rows"), F.count("quantity").alias("with_quantity"))


@query("lake_partitions", f"""WITH {RAW}, p AS (SELECT {PARTS} FROM raw) SELECT platform, CAST(year(local_day) AS BIGINT) AS year, CAST(month(local_day) AS BIGINT) AS month, count(*) AS rows, count(DISTINCT local_day) AS days FROM p GROUP BY ALL""")
def lake_partitions(spark, d):
    """Lake partitions by platform and local event month."""
    return lake.scan(spark, order_lake(spark, d), lake_schema(spark, d)).groupBy("platform", "year", "month").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("day").alias("days"))


@query("partition_check", """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS disagreeing FROM lineitem""")
def partition_check(spark, d):
    """Partition columns agree with the business date of every stored event."""
    rows = lake.scan(spark, order_lake(spark, d), lake_schema(spark, d))
    event = S.business_date(F.coalesce(S.to_instant(F.col("create_time")), S.to_instant(F.col("created_time"))))
    return R.partition_agreement(rows, event)


@query("lake_mixed_union", """SELECT o_orderpriority AS priority, count(*) AS rows, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS with_status, count(CASE WHEN o_orderkey % 2 = 1 THEN 1 END) AS with_price FROM orders GROUP BY 1""")
def lake_mixed_union(spark, d):
    """Files with differing columns read as one table."""
    o = T.table(spark, d, "orders")
    root = new_folder(spark, "mixed")
    o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderpriority", "o_orderstatus").write.parquet(f"{root}/batch=1")
    o.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_orderpriority", "o_totalprice").write.parquet(f"{root}/batch=2")
    merged = lake.scan_objects(spark, [f"{root}/batch=1", f"{root}/batch=2"], root)
    return merged.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("o_orderstatus").alias("with_status"), F.count("o_totalprice").alias("with_price"))


@query("lake_provenance", f"""WITH {RAW} SELECT CASE WHEN x = 0 THEN 'unknown' ELSE platform END AS path_platform, count(*) AS rows, count(*) AS positions FROM raw GROUP BY 1""")
def lake_provenance(spark, d):
    """Every stored row has a position (file, row) that is its own, and its path names the platform."""
    rows = lake.with_provenance(lake.scan(spark, order_lake(spark, d), lake_schema(spark, d)))
    return rows.groupBy(F.col("_path_platform").alias("path_platform")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct("_source_object", "_source_row")).alias("positions"))


def messages(spark, d) -> DataFrame:
    """Event texts; some are no JSON object, some name no known platform."""
    e, n = T.table(spark, d, "events"), F.col("event_id")
    body = F.concat(F.lit('{"_platform":"'), F.when(n % 5 == 0, "shopee").when(n % 5 < 4, "tiktok").otherwise("other"), F.lit('","order_id":"'), n.cast("string"),
                    F.lit('","total_amount":'), F.floor("value").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}"))
    return e.select("event_id", F.when(n % 17 == 0, F.lit("{broken")).when(n % 19 == 0, F.lit("[1,2]")).otherwise(body).alias("value"))


@query("json_route", """SELECT CASE WHEN event_id % 17 = 0 THEN 'quarantine' WHEN event_id % 19 = 0 THEN 'unmatched' WHEN event_id % 5 = 0 THEN 'shopee' WHEN event_id % 5 < 4 THEN 'tiktok' ELSE 'unmatched' END AS route, count(*) AS rows,
  count(CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN 1 END) AS with_order, CAST(sum(CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN CAST(floor(value) AS BIGINT) END) AS BIGINT) AS amount FROM events GROUP BY 1""")
def json_route(spark, d):
    """Messages routed by a field of their JSON text and written by route."""
    path = new_folder(spark, "routes")
    lake.write_routes(lake.routed(messages(spark, d)), path, F.lit("2024-02-01").cast("date"))
    back = spark.read.schema("event_id long, value string, order_ref string, total_amount string, created_at string, route string, ingest_date string").json(path)
    return back.groupBy("route").agg(F.count(F.lit(1)).alias("rows"), F.count("order_ref").alias("with_order"), F.sum(F.col("total_amount").cast("long")).alias("amount"))


@query("json_decode", """SELECT CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'INVALID_JSON_OBJECT' END AS ingest_error, count(*) AS rows, count(CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN 1 END) AS with_order,
  CAST(sum(CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def json_decode(spark, d):
    """Tolerant decoding: objects become columns, anything else is kept with an error mark."""
    schema = T_.StructType.fromDDL("_platform string, order_id string, total_amount string, props struct<k: long>")
    rows = lake.decode(messages(spark, d), schema)
    return rows.groupBy(F.col("_ingest_error").alias("ingest_error")).agg(F.count(F.lit(1)).alias("rows"), F.count("order_id").alias("with_order"), F.sum("props.k").alias("k_sum"))


@query("json_fallback", """SELECT o_orderstatus AS status, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS cust_sum, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS from_json FROM orders GROUP BY 1""")
def json_fallback(spark, d):
    """Columns restored from the JSON text of rows that were stored untyped."""
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    typed = o.filter("o_orderkey % 3 <> 0")
    untyped = lake.to_fallback(o.filter("o_orderkey % 3 = 0"))
    both = lake.union_by_name([typed, untyped])
    back = lake.expand_fallback(both, T_.StructType.fromDDL("o_orderkey long, o_custkey long, o_orderstatus string"))
    return back.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("cust_sum"), F.count("_raw_payload_json").alias("from_json"))


@query("keyed_messages", f"""WITH {RAW} SELECT coalesce(CASE WHEN trim(CASE WHEN x = 1 THEN '' ELSE order_id END) <> '' THEN order_id END, CASE WHEN x <> 2 THEN sku END) AS key, count(*) AS n FROM raw GROUP BY 1""")
def keyed_messages(spark, d):
    """Message key: order first, then SKU."""
    return jobs.keyed_messages(T.raw_events(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# ---- history ----------------------------------------------------------------------------

def history_csv(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both platforms' lines written as CSV exports and imported again (every 40th quantity is text)."""
    lines = sku_lines(spark, d)
    bad = (F.col("order_key") + F.col("line_number")) % 40 == 0
    base = lines.withColumns({"q": F.when(bad, "n/a").otherwise(F.col("quantity").cast("string")), "t": F.date_format("create_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    frames = []
    for platform in V.PLATFORMS:
        r, path = H.ROLES[platform], new_folder(spark, f"csv-{platform}")
        export = base.filter(F.col("platform") == platform).select(
            F.col("order_id").alias(r["order"]), F.col("sku").alias(r["sku"]), F.col("product_name").alias(r["name"]), F.col("t").alias(r["time"]), F.col("q").alias("quantity"),
            "order_status", F.lit("private").alias("buyer_phone"))
        # Files of about 50 MB, so that each is read in one slice.
        export.write.option("header", True).option("maxRecordsPerFile", 400_000).csv(path)
        frames.append(H.imported(spark, path, platform))
    return frames[0], frames[1]


@query("history_import", f"""WITH {LINES} SELECT platform, count(*) FILTER ((order_key + line_number) % 40 <> 0) AS valid_rows, count(*) FILTER ((order_key + line_number) % 40 = 0) AS rejected_rows,
  count(*) FILTER ((order_key + line_number) % 40 <> 0 AND is_cancelled) AS cancelled_rows, CAST(sum(CASE WHEN (order_key + line_number) % 40 <> 0 THEN quantity END) AS BIGINT) AS units, true AS named FROM lines GROUP BY 1""")
def history_import(spark, d):
    """CSV import of both platforms: allow-listed columns, validity, dataset fingerprint."""
    a, b = history_csv(spark, d)
    return a.unionByName(b).groupBy("platform").agg(
        F.count_if("valid").alias("valid_rows"), F.count_if(~F.col("valid")).alias("rejected_rows"), F.count_if(F.col("valid") & F.col("is_cancelled")).alias("cancelled_rows"),
        F.sum(F.when(F.col("valid"), F.col("quantity"))).alias("units"), F.bool_and(F.col("source_dataset").rlike("^[a-z]+:sha256:[0-9a-f]{64}$")).alias("named"))


@query("history_upsert", f"""WITH {LINES}, v AS (SELECT *, (order_key + line_number) % 40 <> 0 AS ok FROM lines)
SELECT platform, count(*) FILTER (ok) AS records, CAST(sum(quantity) FILTER (ok) AS BIGINT) AS units, count(*) FILTER (ok AND is_cancelled) AS cancelled, count(*) AS numbered, true AS dense FROM v GROUP BY 1""")
def history_upsert(spark, d):
    """Both exports imported into the stored history, and all of it once more: records are the same, and rows are numbered without gaps in each file."""
    rows = materialise(DataFrame.unionByName(*history_csv(spark, d)), "imported", "zstd")
    once = materialise(H.merge_history(rows.drop("valid").limit(0), rows.filter("platform = 'shopee'")), "history", "zstd")
    twice = materialise(H.merge_history(once, rows), "history", "zstd")
    stored = H.merge_history(twice, rows)
    at = F.substring_index("source_record_id", ":", -1).cast("long")
    # Distinct numbers of a file are counted as bits of longs, which add up before the shuffle.
    bits = rows.groupBy("platform", "source_dataset", F.shiftright(at, 6).alias("_word")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("seen"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    files = bits.groupBy("platform", "source_dataset").agg(F.sum("n").alias("n"), F.sum(F.bit_count("seen")).alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    source = files.groupBy("platform").agg(F.sum("n").alias("numbered"), F.bool_and((F.col("n") == F.col("k")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("dense"))
    kept = stored.groupBy("platform").agg(F.count(F.lit(1)).alias("records"), F.sum("quantity").alias("units"), F.count_if("is_cancelled").alias("cancelled"))
    return kept.join(source, "platform")


def history_lines(spark, d) -> DataFrame:
    lines = sku_lines(spark, d)
    return lines.withColumns({"data_origin": F.lit(V.HISTORY_ORIGIN), "source_dataset": F.concat(F.lit("ds-"), (F.col("line_number") % 3).cast("string"))})


@query("history_daily", f"""WITH {LINES} SELECT CAST(order_date AS VARCHAR) AS order_date, sku, platform, 'ds-' || CAST(line_number % 3 AS VARCHAR) AS source_dataset, max(product_name) AS product_name, CAST(sum(quantity) AS BIGINT) AS units_sold, 'public_anonymized_historical_csv' AS data_origin
FROM lines WHERE NOT is_cancelled GROUP BY ALL""")
def history_daily(spark, d):
    """Historical units by day, SKU, platform and dataset."""
    return marts.history_daily(history_lines(spark, d))


@query("history_selection", f"""WITH {LINES} SELECT 'ds-' || CAST(line_number % 3 AS VARCHAR) AS source_dataset, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS units FROM lines WHERE line_number % 3 IN (0, 2) GROUP BY 1""")
def history_selection(spark, d):
    """Historical lines of one origin and a list of datasets."""
    return W.historical_lines(history_lines(spark, d), datasets=["ds-0", "ds-2"]).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"))


@query("sku_history", f"""WITH {DAILY} SELECT sku, count(*) AS days, CAST(sum(daily_demand) AS DOUBLE) AS demand, CAST(max(date) AS VARCHAR) AS last_day, CAST(sum(CASE WHEN daily_demand > 0 THEN 1 ELSE 0 END) AS BIGINT) AS sold_days FROM daily GROUP BY 1""")
def sku_history(spark, d):
    """Ordered daily history of every SKU at once, one array per SKU."""
    from marketloom.operators import features as X

    series = P.sku_series(X.daily_history(sku_lines(spark, d)).select("sku", "date", "daily_demand"))
    return series.select(
        "sku", F.size("series").alias("days"), F.aggregate("series", F.lit(0.0), lambda a, r: a + r["daily_demand"]).alias("demand"),
        F.element_at("series", -1)["date"].alias("last_day"), F.size(F.filter("series", lambda r: r["daily_demand"] > 0)).alias("sold_days"))


@query("orders_for_features", f"""WITH {LINES} SELECT sku, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS units, 'unverified_warehouse' AS data_origin, 'warehouse' AS data_source FROM lines WHERE NOT is_cancelled GROUP BY 1""")
def orders_for_features(spark, d):
    """Warehouse scan for features; the first source with rows is used and named."""
    fact = T.order_lines(spark, d).withColumnRenamed("part_key", "product_key")
    products = T.products(spark, d).withColumnRenamed("part_key", "product_key")
    chosen = W.first_available([("clean_file", None), ("warehouse", W.orders_for_features(fact, products)), ("raw_file", T.raw_events(spark, d))])
    return chosen.groupBy("sku", "data_origin", "data_source").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"))


@query("store_roundtrip", f"""WITH {DAILY} SELECT sku, count(*) AS rows, CAST(sum(daily_demand) AS DOUBLE) AS demand, CAST(min(date) AS VARCHAR) AS first_day FROM daily GROUP BY 1""")
def store_roundtrip(spark, d):
    """Daily history written by month and read back."""
    from marketloom.operators import features as X

    path = new_folder(spark, "store")
    W.write_feature_store(X.daily_history(sku_lines(spark, d)), path)
    return W.read_feature_store(spark, path).groupBy("sku").agg(F.count(F.lit(1)).alias("rows"), F.sum("daily_demand").alias("demand"), F.min("date").alias("first_day"))


def history_columns(rows: DataFrame) -> DataFrame:
    return rows.select("order_date", "sku", "platform", "data_origin", "source_dataset", "product_name", "units_sold")


# ---- mart files -------------------------------------------------------------------------

@query("mart_export", f"""WITH {SUMMARY_SQL} SELECT CAST(order_date AS VARCHAR) AS order_date, platform, total_orders, CAST(total_units_sold AS BIGINT) AS units_sold, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(discounts AS DOUBLE) AS discounts,
  CAST(total_revenue AS DOUBLE) AS net_revenue, {cents_ratio('total_revenue', 'total_orders')} AS aov FROM summary""")
def mart_export(spark, d):
    """Order mart as CSV, read back from the file."""
    columns = ["order_date", "platform", "total_orders", "units_sold", "gross_revenue", "discounts", "net_revenue", "aov"]
    mart = summary_of(spark, d).withColumnsRenamed({"total_units_sold": "units_sold", "total_revenue": "net_revenue", "average_order_value": "aov"})
    past = history_columns(marts.history_daily(history_lines(spark, d)))
    path = new_folder(spark, "marts")
    W.publish_marts({"orders": (mart.orderBy("order_date", "platform"), columns), "history": (past, past.columns)}, path, ("orders", "history"))
    return spark.read.option("header", True).schema("order_date string, platform string, total_orders long, units_sold long, gross_revenue double, discounts double, net_revenue double, aov double").csv(f"{path}/orders")


@query("mart_file_check", f"""WITH {SUMMARY_SQL} SELECT count(*) AS rows, count(*) AS matching FROM summary""")
def mart_file_check(spark, d):
    """Exported mart against the warehouse summary, row by row with a tolerance."""
    exported = mart_export(spark, d).select("order_date", "platform", F.col("net_revenue").alias("f"), F.col("total_orders").alias("fo"))
    summary = summary_of(spark, d).select(F.col("order_date").cast("string").alias("order_date"), "platform", F.col("total_revenue").cast("double").alias("w"), "total_orders")
    joined = summary.join(exported, ["order_date", "platform"], "full_outer")
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.abs(F.col("f") - F.col("w")) <= 0.01) & (F.col("fo") == F.col("total_orders"))).alias("matching"))


@query("policy_csv", f"WITH {LIVE_DEMAND}, {segments('demand')} SELECT sku, matrix_segment, CAST(safety_stock AS BIGINT) AS safety_stock, CAST(reorder_point AS BIGINT) AS reorder_point FROM segments")
def policy_csv(spark, d):
    """Segmentation policy as CSV, read back from the file."""
    columns = ["sku", "matrix_segment", "safety_stock", "reorder_point"]
    path = new_folder(spark, "policy")
    W.export_csv(segment_columns(live_segments(spark, d)), path, columns)
    return spark.read.option("header", True).schema("sku string, matrix_segment string, safety_stock long, reorder_point long").csv(path)


# ---- streams ----------------------------------------------------------------------------

def event_stream(spark, d) -> DataFrame:
    schema = T.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(query) -> None:
    jobs.drain(query)


class Stopped(RuntimeError):
    """A drill stops a stream between the write and the commit of a batch."""


def _stop(_: int) -> None:
    raise Stopped("drill")


DELIVERIES = 4


def deliver(rows: DataFrame, second: Column, folder: str, start, stop: int | None = None, last: DataFrame | None = None) -> None:
    """Appends rows to a folder in ``DELIVERIES`` parts by the ``second`` of their arrival and runs ``start(stream, after)`` over each, on one checkpoint.

    ``last`` is delivered after all others. At the delivery ``stop`` the stream is stopped after the sink was written, and started again.
    """
    spark = rows.sparkSession
    span = rows.agg(F.min(second).alias("lo"), F.max(second).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    number = F.floor((second - lo) * DELIVERIES / (hi - lo + 1))
    parts = [rows.filter(number == k) for k in range(DELIVERIES)] + ([last] if last is not None else [])
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        if k == stop:
            try:
                run(start(stream, _stop))
            except StreamingQueryException as e:
                if "Stopped" not in str(e):
                    raise
        run(start(stream, None))


def late_events(spark, d) -> tuple[DataFrame, Column, DataFrame]:
    """Events, the second at which each arrives (up to a day late), and a heartbeat long after them that lets every window close."""
    e = T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    beat = e.agg((F.max("ts") + F.expr("interval 60 days")).alias("ts"))
    columns = [F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema.fields]
    return e, arrival, beat.select(*columns)


#: Events arrive up to a day late, so with this delay none is lost.
DELAY = "25 hours"


def closed(spark, d, windows, table) -> DataFrame:
    """Runs a windowed stream over late events in four deliveries and a heartbeat, stopped once, and reads the closed windows."""
    e, arrival, beat = late_events(spark, d)
    checkpoint = new_folder(spark, "cp")
    deliver(e, arrival, new_folder(spark, "arrivals"), lambda s, after: jobs.store_closed(windows(s.withWatermark("ts", DELAY)), table, checkpoint, True, after), 2, beat)
    return table.read()


def raw_deliveries(spark, d, each) -> None:
    """Raw events as JSON text, delivered by event day with every tenth order a delivery late; ``each(inbox, after)`` runs after each delivery."""
    raw = T.raw_events(spark, d)
    created = F.to_timestamp(F.coalesce("create_time", "created_time"))
    late = F.when(F.pmod(F.xxhash64("order_sn", "order_id"), F.lit(10)) == 0, F.lit(400 * 86_400)).otherwise(F.lit(0))
    # The span of the seconds is read from the stored ones, not from the lines and their joins once more.
    rows = materialise(raw.select(F.to_json(F.struct("*")).alias("value"), (F.unix_timestamp(created) + late).alias("second")), "raw-deliveries", "zstd")
    lo, hi = rows.agg(F.min("second"), F.max("second")).first()
    number = F.floor((F.col("second") - F.lit(lo)) * DELIVERIES / (F.lit(hi) - F.lit(lo) + 1))
    numbered = rows.select("value", F.coalesce(number, F.lit(0)).alias("number"))
    inbox = new_folder(spark, "inbox")
    release(spark)
    for k in range(DELIVERIES):
        numbered.filter(F.col("number") == k).select("value").write.mode("append").text(inbox, compression="gzip")
        each(inbox, k)


def bronze_folder(spark, d) -> tuple[str, T_.StructType]:
    """Raw events published as JSON text files and landed by the bronze stream."""
    raw = T.raw_events(spark, d)
    inbox, path = new_folder(spark, "inbox"), new_folder(spark, "bronze")
    raw.select(F.to_json(F.struct("*")).alias("value")).write.text(inbox, compression="gzip")
    # The shuffles that made the messages go before the lake grows. The inbox is this run's own, and what is landed is not read again.
    release(spark)
    run(jobs.bronze(jobs.read_messages(spark, inbox, 50, spent="delete"), raw.schema, path, new_folder(spark, "cp"), once=True))
    return path, raw.schema


@query("stream_bronze", f"""WITH {RAW}, p AS (SELECT {PARTS} FROM raw) SELECT platform, CAST(year(local_day) AS BIGINT) AS year, CAST(month(local_day) AS BIGINT) AS month, count(*) AS rows, count(DISTINCT local_day) AS days FROM p GROUP BY ALL""")
def stream_bronze(spark, d):
    """Message stream landed by platform and event date."""
    path, _ = bronze_folder(spark, d)
    return lake.scan(spark, path, merge=False).groupBy("platform", "year", "month").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("day").alias("days"))


def loaded(spark, d) -> tuple[DataFrame, str]:
    """Messages in four deliveries through bronze into the fact; the load is stopped once between write and commit."""
    raw = T.raw_events(spark, d).schema
    path, rejects, cp, cp2 = (new_folder(spark, n) for n in ("bronze", "rejects", "cp", "cp"))
    # Seven years of few orders: a folder a month.
    fact = jobs.fact_table(spark, new_folder(spark, "fact"), "date_format(create_time, 'yyyy-MM')")

    known: list[T_.StructType] = []

    def each(inbox: str, k: int) -> None:
        run(jobs.bronze(jobs.read_messages(spark, inbox), raw, path, cp, once=True))
        if not known:
            known.append(spark.read.parquet(path).schema)
        drop = ("platform", "year", "month", "day", "_raw_payload_json", "_ingest_error", "_source_platform")
        start = lambda after: jobs.incremental_load(spark.readStream.schema(known[0]).parquet(path).drop(*drop), fact, rejects, cp2, True, after)
        if k == 1:
            try:
                run(start(_stop))
            except StreamingQueryException as e:
                if "Stopped" not in str(e):
                    raise
        run(start(None))

    raw_deliveries(spark, d, each)
    return fact.read(), rejects


@query("stream_incremental_etl", f"""WITH {RAW}, good AS (SELECT * FROM checked WHERE len(errors) = 0)
SELECT t_order_id AS order_id, t_platform AS platform, source_line_id, CAST(max(l_version) AS VARCHAR) AS source_updated_at, any_value(n_status) AS order_status FROM good GROUP BY 1, 2, 3""")
def stream_incremental_etl(spark, d):
    """Bronze to warehouse in micro-batches, stopped and started again: validated, deduplicated, merged by version."""
    fact, _ = loaded(spark, d)
    return fact.select("order_id", "platform", "source_line_id", "source_updated_at", "order_status")


@query("stream_quarantine", f"""WITH {RAW} SELECT array_to_string(errors, '; ') AS rejection_reasons, count(*) AS n FROM checked WHERE len(errors) > 0 GROUP BY 1""")
def stream_quarantine(spark, d):
    """Rejects stored by the incremental load."""
    _, rejects = loaded(spark, d)
    return spark.read.schema("rejection_reasons string").json(f"{rejects}/run_id=*").groupBy("rejection_reasons").agg(F.count(F.lit(1)).alias("n"))


SNAPSHOT_UPSERT_SQL = f"""WITH s AS (SELECT {USER_SKU} AS sku, ts + INTERVAL 7 HOUR AS t, CAST(floor(value) AS BIGINT) AS stock, event_id FROM events WHERE event_id % 10 <> 0)
SELECT sku, CAST(CAST(t AS DATE) AS VARCHAR) AS snapshot_date, stock AS stock_on_hand FROM s QUALIFY row_number() OVER (PARTITION BY sku, CAST(t AS DATE) ORDER BY t DESC, event_id DESC) = 1"""


def snapshot_messages(events: DataFrame) -> DataFrame:
    """Snapshot texts of events; one in ten is malformed."""
    return events.select(T.sku_of_user(F.col("user_id")).alias("sku"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("loaded_at"),
                         F.when(F.col("event_id") % 10 == 0, "-1").otherwise(F.floor("value").cast("string")).alias("stock_on_hand"))


@query("stream_snapshot_upsert", SNAPSHOT_UPSERT_SQL)
def stream_snapshot_upsert(spark, d):
    """Snapshot stream merged per SKU and business day, malformed snapshots quarantined."""
    table = jobs.snapshot_table(spark, new_folder(spark, "snapshots"))
    run(jobs.snapshot_upsert(snapshot_messages(event_stream(spark, d)), table, new_folder(spark, "rejects"), new_folder(spark, "cp"), once=True))
    return table.read().select("sku", "snapshot_date", "stock_on_hand")


@query("stream_snapshot_restart", SNAPSHOT_UPSERT_SQL)
def stream_snapshot_restart(spark, d):
    """The same from four deliveries out of order, the stream stopped after a write and before its commit."""
    e, arrival, _ = late_events(spark, d)
    table, rejects, checkpoint = jobs.snapshot_table(spark, new_folder(spark, "snapshots")), new_folder(spark, "rejects"), new_folder(spark, "cp")
    deliver(e, arrival, new_folder(spark, "arrivals"), lambda s, after: jobs.snapshot_upsert(snapshot_messages(s), table, rejects, checkpoint, True, after), 1)
    return table.read().select("sku", "snapshot_date", "stock_on_hand")


@query("stream_tumbling", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """Hourly counts from late events, each window once and when it is closed."""
    table = jobs.window_table(spark, new_folder(spark, "windows"), "event_type", "string", n="long", total="long")
    return closed(spark, d, lambda e: jobs.windowed_counts(e, "ts", "event_type", F.floor("value")), table)


@query("stream_sliding", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)) AS ws, event_type, value FROM events, (SELECT unnest(range(3)) AS k))
SELECT CAST(ws AS VARCHAR) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM w GROUP BY ALL""")
def stream_sliding(spark, d):
    """Three-hour windows with an hourly slide."""
    table = jobs.window_table(spark, new_folder(spark, "windows"), "event_type", "string", n="long", total="long")
    return closed(spark, d, lambda e: jobs.windowed_counts(e, "ts", "event_type", F.floor("value"), "3 hours", "1 hour"), table)


@query("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    """Activity sessions per user with a twelve-hour gap."""
    kind = T.table(spark, d, "events").schema["user_id"].dataType.typeName()
    table = jobs.window_table(spark, new_folder(spark, "sessions"), "user_id", kind, "session_start", session_end="timestamp", n="long")
    return closed(spark, d, lambda e: jobs.sessions(e, "ts", "user_id", "12 hours"), table)


@query("stream_window_ratio", RATIO_SQL)
def stream_window_ratio(spark, d):
    """Error share in sliding six-hour windows of a stream, each window once and when it is closed."""
    table = W.PartedTable(spark, new_folder(spark, "ratios"), ["window_start"], jobs.RATIO_SCHEMA, "cast(window_start as date)")
    return closed(spark, d, lambda e: monitor.window_ratio(e, "ts", F.coalesce(F.col("event_type") == "error", F.lit(False)), "6 hours", "1 hour"), table)


@query("stream_dedupe", "SELECT count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) AS lines FROM events")
def stream_dedupe(spark, d):
    """Repeated deliveries dropped by key within the watermark."""
    path = new_folder(spark, "unique")
    keyed = event_stream(spark, d).withColumn("day", F.to_date("ts"))
    once = jobs.unique_lines(keyed, "ts", ["user_id", "event_type", "day"], "40 days")
    run(once.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_folder(spark, "cp")).trigger(availableNow=True).start())
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("lines"))


@query("stream_stock_state", f"""SELECT {USER_SKU} AS sku, CAST(sum(CASE event_type WHEN 'purchase' THEN -floor(value) WHEN 'error' THEN 0 ELSE floor(value) END) AS BIGINT) AS balance, count(*) AS movements FROM events GROUP BY 1""")
def stream_stock_state(spark, d):
    """Stock balance per SKU kept as streaming state."""
    v = F.floor("value")
    delta = F.when(F.col("event_type") == "purchase", -v).when(F.col("event_type") == "error", F.lit(0)).otherwise(v).cast("long")
    rows = event_stream(spark, d).select(T.sku_of_user(F.col("user_id")).alias("sku"), delta.alias("delta"), F.lit(1).cast("long").alias("n"))
    table = jobs.balance_table(spark, new_folder(spark, "balances"), 8)
    run(jobs.store_balances(jobs.stock_state(rows), table, new_folder(spark, "cp")))
    return table.read()
