"""Adapter from the provided star-schema tables to canonical order lines, snapshots and raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import compiled

MONEY = "decimal(14,2)"
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deals rows to as many tasks as the setting ``spark.marketloom.rawPartitions`` names; without it the plan has no shuffle here.

    For heavy per-row work on one machine, where a small file is one split. A cluster leaves it unset: its inputs have splits enough.
    """
    parts = df.sparkSession.conf.get("spark.marketloom.rawPartitions", None)
    return df.repartition(int(parts), *keys) if parts else df


def platform_of(order_key: Column) -> Column:
    return F.when(order_key % 20 < 11, "shopee").otherwise("tiktok")


def order_lines(spark: SparkSession, folder: str, product: bool = False, place: bool = False) -> DataFrame:
    """Canonical order lines.

    ``product`` adds SKU, name and category; ``place`` adds state and region. Joins that a report
    does not need are not in its plan.
    """
    if product and place:
        return _whole_lines(spark, folder)
    lines, orders = table(spark, folder, "lineitem").select(*_line_columns()), table(spark, folder, "orders").select(*_order_columns())
    if not place:
        out = lines.join(orders, "order_key")
        return out.join(products(spark, folder), "part_key") if product else out
    # Places meet the orders, which are fewer than the lines.
    where = places(spark, folder)
    out = lines.join(orders.join(where, "cust_key"), "order_key")
    found = [c for c in where.columns if c != "cust_key"]
    return out.select("cust_key", *[c for c in out.columns if c not in where.columns], *found)


def _line_columns() -> list[Column]:
    ext = F.col("l_extendedprice").cast(MONEY)
    share = lambda c: F.round(ext * F.col(c).cast("decimal(4,2)"), 2).cast(MONEY)
    return [
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        F.concat(F.lit("id:"), F.col("l_linenumber").cast("string")).alias("source_line_id"),
        F.col("l_quantity").cast("int").alias("quantity"), ext.alias("subtotal"),
        F.round(ext / F.col("l_quantity").cast("decimal(10,0)"), 2).cast(MONEY).alias("original_price"),
        share("l_discount").alias("seller_discount"), share("l_tax").alias("platform_discount"),
        (ext - share("l_discount")).cast(MONEY).alias("buyer_total_amount"),
        F.col("l_returnflag").alias("carrier_name"), F.col("l_shipdate").alias("ship_date"),
        F.col("l_shipdate").alias("source_updated_at")]


def _order_columns() -> list[Column]:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "SHIPPED").otherwise("CANCELLED")
    return [
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"),
        F.col("o_orderkey").cast("string").alias("order_id"), platform_of(F.col("o_orderkey")).alias("platform"),
        status.alias("order_status"), (F.col("o_orderstatus") == "P").alias("is_cancelled"),
        F.col("o_orderdate").alias("create_time"), F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("payment_method")]


def _whole_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with product and place. The stored columns are joined and the others made behind the joins, as they are more and wider.

    Orders come last, so the lines of an order lie side by side afterwards, and what they have in common compresses well in later shuffles and files.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").join(
        table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    out = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        F.broadcast(geographies(spark, folder)), F.col("c_nationkey") == F.col("geo_key"))
    whole = out.select(*_line_columns(), *_order_columns()[1:], *_product_columns()[1:], "geo_key", "state", "region")
    first = ["cust_key", "part_key", "order_key"]
    return whole.select(*first, *[c for c in whole.columns if c not in first])


def _product_columns() -> list[Column]:
    return [F.col("p_partkey").alias("part_key"), F.concat_ws(" ", "p_brand", "p_type").alias("sku"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category")]


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(*_product_columns())


def geographies(spark: SparkSession, folder: str) -> DataFrame:
    """geo_key, state and region of every nation."""
    return table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("geo_key"), F.col("n_name").alias("state"), F.col("r_name").alias("region"))


def places(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cust_key"), F.col("n_nationkey").alias("geo_key"), F.col("n_name").alias("state"), F.col("r_name").alias("region"))


def sku_of_user(user: Column) -> Column:
    """Events carry a user id; as stock movements it names one of the demand SKUs."""
    kinds = F.array(*[F.lit(t) for t in PART_TYPES])
    return F.concat(F.lit("Brand#"), (user % 25 + 1).cast("string"), F.lit(" "),
                    F.element_at(kinds, (F.floor(user / 25) % 6 + 1).cast("int")))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory snapshots from events: value is the stock seen at the time."""
    return table(spark, folder, "events").select(
        "event_id", sku_of_user(F.col("user_id")).alias("sku"), F.col("ts").alias("snapshot_at"),
        F.col("ts").cast("date").alias("snapshot_date"), F.floor("value").cast("int").alias("stock_on_hand"))


def movements(spark: SparkSession, folder: str) -> DataFrame:
    """Stock movements from events, one movement type per event type."""
    kind = (
        F.when(F.col("event_type") == "purchase", "OUTBOUND_SALE").when(F.col("event_type") == "view", "INBOUND_RESTOCK")
        .when(F.col("event_type") == "click", "RETURN_RESTOCK").when(F.col("event_type") == "signup", "CANCEL_RELEASE")
        .otherwise("OUT_OF_STOCK_REJECT"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("movement_id"), sku_of_user(F.col("user_id")).alias("sku"), kind.alias("movement_type"),
        F.floor("value").cast("int").alias("quantity"), F.col("ts").alias("moved_at"))


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Source-shaped text rows of both layouts, with about one row in six spoilt in a known way.

    ``_case`` says how a row is spoilt; it is derived from the keys of the row.
    """
    compiled(spark)
    lines = dealt(order_lines(spark, folder, product=True, place=True), ["order_key", "line_number", "part_key"])
    case = (F.col("order_key") * 7 + F.col("line_number") * 13 + F.col("part_key")) % 101
    lines = lines.withColumn("_case", case)
    hour = F.expr("interval 1 hour")
    created = F.col("create_time") + (F.col("order_key") % 24).cast("int") * hour
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    hours = lambda c, n: c + (n if isinstance(n, Column) else F.lit(n)) * hour

    def spoil(default: Column, **cases) -> Column:
        out = default.cast("string")
        for number, text in cases.items():
            out = F.when(F.col("_case") == int(number[1:]), F.lit(text).cast("string")).otherwise(out)
        return out

    is_a = F.col("platform") == "shopee"
    status = spoil(F.when(F.col("_case") % 3 == 0, F.concat(F.lit(" "), F.lower("order_status"))).otherwise(F.col("order_status")), c12="WEIRD")
    order_id, sku = spoil(F.col("order_id"), c1=""), spoil(F.col("sku"), c2=None)
    name, price = spoil(F.col("product_name"), c13="n" * 501), spoil(F.col("original_price"), c7="-99000.00", c8="oops", c9="inf")
    paid = iso(F.when(F.col("_case") == 11, hours(created, -24)).otherwise(hours(created, 1)))
    done = F.when(F.col("order_status") == "COMPLETED", iso(hours(created, 120)))
    dropped = F.when(F.col("is_cancelled"), iso(hours(created, 3)))
    a = lambda c: F.when(is_a, c).cast("string")
    b = lambda c: F.when(~is_a, c).cast("string")
    return lines.select(
        spoil(F.col("platform"), c0="Lazada").alias("_platform"), F.col("line_number").cast("string").alias("order_line_id"),
        a(order_id).alias("order_sn"), b(order_id).alias("order_id"), a(sku).alias("item_sku"), b(sku).alias("seller_sku"),
        a(name).alias("item_name"), b(name).alias("product_name"), a(F.col("category")).alias("model_name"),
        F.col("supp_key").cast("string").alias("shop_id"), F.concat(F.lit("Shop "), F.col("supp_key").cast("string")).alias("shop_name"),
        status.alias("order_status"), spoil(F.col("quantity"), c3="bad", c4="-5", c5="1.5", c6="500").alias("quantity"),
        a(price).alias("original_price"), b(price).alias("item_original_price"), a(F.col("subtotal")).alias("total_order_value"),
        b(F.col("subtotal")).alias("sub_total"), a(F.col("buyer_total_amount")).alias("buyer_total_amount"),
        b(F.col("buyer_total_amount")).alias("total_amount"), F.col("seller_discount").cast("string").alias("seller_discount"),
        a(F.col("platform_discount")).alias("shopee_discount"), b(F.col("platform_discount")).alias("platform_discount"),
        a(spoil(F.lit("0"), c15="abc", c16=None)).alias("voucher_from_seller"), a(F.lit("0")).alias("voucher_from_shopee"),
        F.col("payment_method").alias("payment_method"), a(F.col("carrier_name")).alias("shipping_carrier"),
        b(F.col("carrier_name")).alias("shipping_provider"), a(F.col("state")).alias("state"), b(F.col("state")).alias("region_state"),
        a(spoil(F.lit("0.5"), c14="-1")).alias("item_weight"), a(iso(created)).alias("create_time"), b(iso(created)).alias("created_time"),
        a(paid).alias("pay_time"), b(paid).alias("paid_time"), iso(hours(created, 48)).alias("shipped_time"), done.alias("completed_time"),
        a(dropped).alias("cancel_time"), b(dropped).alias("cancelled_time"),
        spoil(iso(hours(F.col("ship_date"), F.col("line_number"))), c10="not-a-time").alias("update_time"),
        F.concat(F.lit("lines/part-"), (F.col("order_key") % 16).cast("string")).alias("_source_object"),
        (F.col("order_key") * 10 + F.col("line_number")).cast("string").alias("_source_row"),
        F.col("part_key").alias("_part"))
