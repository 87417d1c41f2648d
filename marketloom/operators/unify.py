"""Two marketplace layouts to one canonical order line, then typed and normalised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators.latest import deduplicate_lines

# Canonical column -> (source column, value when the source lacks the column).
LAYOUT_A = {
    "order_id": ("order_sn", None), "sku": ("item_sku", None), "product_name": ("item_name", None),
    "category": ("model_name", None), "shop_id": ("shop_id", ""), "shop_name": ("shop_name", None),
    "order_status": ("order_status", None), "cancel_reason": ("cancel_reason", None),
    "quantity": ("quantity", "0"), "original_price": ("original_price", "0"),
    "discounted_price": ("model_discounted_price", None), "subtotal": ("total_order_value", "0"),
    "buyer_total_amount": ("buyer_total_amount", "0"), "seller_discount": ("seller_discount", "0"),
    "platform_discount": ("shopee_discount", "0"), "commission_fee": ("commission_fee", "0"),
    "service_fee": ("service_fee", "0"), "transaction_fee": ("transaction_fee", "0"),
    "shipping_fee": ("actual_shipping_fee", "0"), "original_shipping": ("estimated_shipping_fee", "0"),
    "payment_method": ("payment_method", None), "carrier_name": ("shipping_carrier", None),
    "state": ("state", None), "city": ("city", None), "district": ("district", None),
    "country": ("country", "VN"), "weight_kg": ("item_weight", None), "create_time": ("create_time", None),
    "pay_time": ("pay_time", None), "shipped_time": ("shipped_time", None),
    "completed_time": ("completed_time", None), "cancel_time": ("cancel_time", None), "is_cod": ("cod", None),
}
LAYOUT_B = {
    "order_id": ("order_id", None), "sku": ("seller_sku", None), "product_name": ("product_name", None),
    "shop_name": ("shop_name", None), "order_status": ("order_status", None),
    "cancel_reason": ("item_cancel_reason", None), "quantity": ("quantity", "0"),
    "original_price": ("item_original_price", "0"), "discounted_price": ("item_sale_price", None),
    "subtotal": ("sub_total", "0"), "buyer_total_amount": ("total_amount", "0"),
    "seller_discount": ("seller_discount", "0"), "platform_discount": ("platform_discount", "0"),
    "shipping_fee": ("shipping_fee", "0"), "original_shipping": ("original_shipping_fee", "0"),
    "tax_amount": ("tax_amount", "0"), "payment_method": ("payment_method", None),
    "carrier_name": ("shipping_provider", None), "state": ("region_state", None),
    "city": ("city_town", None), "district": ("district", None), "create_time": ("created_time", None),
    "pay_time": ("paid_time", None), "shipped_time": ("shipped_time", None),
    "completed_time": ("completed_time", None), "cancel_time": ("cancelled_time", None),
    "is_cod": ("is_cod", None),
}
# Other platforms keep only what is needed to reject them with evidence.
LAYOUT_OTHER = {
    "sku": ("sku", None), "create_time": ("create_time", None), "quantity": ("quantity", None),
    "order_status": ("order_status", None),
}
CANONICAL = list(LAYOUT_A) + ["tax_amount", "voucher_total", "shipping_carrier"]
_ZERO = ("tax_amount", "commission_fee", "service_fee", "transaction_fee")


class _Source:
    """Source columns by name, with the documented value for columns a batch does not have."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def text(self, name: str, absent: str | None = None) -> Column:
        return F.col(f"`{name}`").cast("string") if name in self.names else F.lit(absent).cast("string")


def with_platform(df: DataFrame) -> DataFrame:
    """Platform from the columns present, for batches that do not say."""
    if "_platform" in df.columns:
        return df
    if "order_sn" in df.columns:
        return df.withColumn("_platform", F.lit("shopee"))
    return df.withColumn("_platform", F.lit("tiktok" if "order_id" in df.columns else "unknown"))


def unify(df: DataFrame, numeric_ids: bool = False) -> DataFrame:
    """Canonical order lines, all values still as supplied text.

    One projection decides per row which layout applies, so the input is scanned once and nothing
    is shuffled.
    """
    df = with_platform(df)
    src = _Source(df)
    platform = src.text("_platform")
    is_a, is_b = platform == "shopee", platform == "tiktok"

    def pick(name: str) -> Column:
        a = LAYOUT_A.get(name)
        b = LAYOUT_B.get(name)
        c = LAYOUT_OTHER.get(name)
        from_a = src.text(*a) if a else F.lit("0" if name in _ZERO else None).cast("string")
        from_b = src.text(*b) if b else F.lit("0" if name in _ZERO else None).cast("string")
        from_c = src.text(*c) if c else F.lit(None).cast("string")
        if name == "shop_id":
            from_a = F.coalesce(from_a, F.lit(""))
            from_b = F.coalesce(S.first_filled(src.text("shop_id"), src.text("shop_name")), F.lit(""))
        elif name == "country":
            from_b = F.lit("VN")
        elif name == "order_id":
            from_c = S.first_filled(src.text("order_id"), src.text("order_sn"))
        elif name == "shipping_carrier":
            from_a, from_b = src.text("shipping_carrier"), src.text("shipping_provider")
        elif name == "voucher_total":
            parts = [src.text("voucher_from_seller"), src.text("voucher_from_shopee")]
            from_a = (S.optional_amount(parts[0]) + S.optional_amount(parts[1])).cast("string")
            from_b = F.lit("0")
        return F.when(is_a, from_a).when(is_b, from_b).otherwise(from_c).alias(name)

    vouchers = [src.text("voucher_from_seller"), src.text("voucher_from_shopee")]
    sku_part = src.text("sku") if "sku" in src.names else F.when(is_a, src.text("item_sku")).otherwise(src.text("seller_sku"))
    return df.select(
        platform.alias("platform"),
        *[pick(name) for name in CANONICAL],
        S.line_key(src.text("order_line_id"), src.text("line_id"), src.text("source_line_id"), sku_part,
                   numeric=numeric_ids).alias("source_line_id"),
        S.first_filled(src.text("update_time"), src.text("updated_time"), src.text("updatedAt"))
        .alias("source_updated_at"),
        src.text("_source_object").alias("source_object"),
        src.text("_source_row").cast("long").alias("source_row"),
        F.coalesce(S.is_malformed(vouchers[0]) | S.is_malformed(vouchers[1]), F.lit(False))
        .alias("_invalid_voucher_total"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        .alias("raw_payload"),
    )


def normalise(df: DataFrame) -> DataFrame:
    """Typed values plus one flag per optional value that was supplied but unreadable."""
    numbers = {name: S.as_number(F.col(name)) for name in ("quantity", *V.MANDATORY_AMOUNTS)}
    numbers |= {name: S.optional_amount(F.col(name)) for name in V.OPTIONAL_AMOUNTS}
    times = [*V.LIFECYCLE, "source_updated_at"]
    kept = df.columns
    # Each time is parsed once, for its value and for its flag.
    df = df.withColumns({f"_at_{t}": S.to_instant(F.col(t)) for t in times})
    typed = df.select(
        *[c for c in kept if c not in {*numbers, *times, "discounted_price", "weight_kg",
                                             "order_status", "payment_method", "carrier_name"}],
        *[value.alias(name) for name, value in numbers.items()],
        S.as_number(F.col("discounted_price")).alias("discounted_price"),
        S.is_malformed(F.col("discounted_price")).alias("_invalid_discounted_price"),
        F.trim("weight_kg").try_cast("double").alias("weight_kg"),
        (F.col("weight_kg").isNotNull() & ~S.finite(F.trim("weight_kg").try_cast("double"))).alias("_invalid_weight_kg"),
        *[S.business_time(F.col(f"_at_{t}")).alias(t) for t in times],
        *[(F.col(t).isNotNull() & F.col(f"_at_{t}").isNull()).alias(f"_invalid_{t}") for t in times],
        F.upper(F.trim("order_status")).alias("order_status"),
        F.trim("payment_method").alias("payment_method"),
        F.trim("carrier_name").alias("carrier_name"),
    )
    return typed.withColumns({
        "source_updated_at": F.coalesce("source_updated_at", S.last_transition(*[F.col(t) for t in V.LIFECYCLE])),
        "order_date": F.col("create_time").cast("date"),
        "is_cancelled": S.is_cancelled(F.col("order_status")),
    })


def clean_for_analysis(df: DataFrame) -> DataFrame:
    """Analysis path: latest version per line, complete keys, plausible quantity and price."""
    kept = deduplicate_lines(df).dropna(subset=["order_id", "sku"])
    return kept.filter(F.col("quantity").between(1, V.MAX_QUANTITY) & (F.col("original_price") >= 0))


def state_as_of(df: DataFrame, cutoff: Column, platform: str = "platform") -> DataFrame:
    """Remove lifecycle transitions after the cutoff and recompute the reachable status."""
    times = ("pay_time", "shipped_time", "delivered_time", "completed_time", "cancel_time")
    present = [t for t in times if t in df.columns]
    df = df.withColumns({t: F.when(F.col(t) <= cutoff, F.col(t)) for t in present})
    is_a = F.col(platform) == "shopee"

    def reached(name: str) -> Column:
        return F.col(name).isNotNull() if name in present else F.lit(False)

    status = (
        F.when(reached("cancel_time"), "CANCELLED")
        .when(reached("completed_time"), "COMPLETED")
        .when(~is_a & reached("delivered_time"), "DELIVERED")
        .when(reached("shipped_time"), "SHIPPED")
        .when(reached("pay_time"), F.when(is_a, "READY_TO_SHIP").otherwise("AWAITING_SHIPMENT"))
        .otherwise("UNPAID")
    )
    out = df.withColumn("order_status", status)
    if "cancel_reason" in out.columns:
        out = out.withColumn("cancel_reason", F.when(status == "CANCELLED", F.col("cancel_reason")))
    return out
