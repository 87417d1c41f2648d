"""Validation rules as one text column of codes, and what follows from it: split, scorecard, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V


def _code(condition: Column, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(code))


def order_line_rules(df: DataFrame, raw_quantity: bool = False) -> list[Column]:
    """Rules in report order; every element is the error code or null.

    ``raw_quantity`` is for input that was not normalised: text that is no number gets its own code.
    """
    names = set(df.columns)
    col = F.col
    rules: list[Column] = []

    for name in ("discounted_price", "voucher_total", "source_updated_at", "pay_time", "shipped_time",
                 "completed_time", "cancel_time"):
        if f"_invalid_{name}" in names:
            rules.append(_code(col(f"_invalid_{name}"), f"INVALID_{name.upper()}_TYPE"))

    for name in V.REQUIRED:
        missing = col(name).isNull() | (F.trim(col(name).cast("string")) == "") if name in names else F.lit(True)
        rules.append(_code(missing, f"MISSING_{name.upper()}"))
    for name, limit in V.LENGTH_LIMITS.items():
        if name in names:
            rules.append(_code(F.length(col(name).cast("string")) > limit, f"TOO_LONG_{name.upper()}"))

    rules.append(_code(~F.coalesce(F.lower("platform").isin(*V.PLATFORMS), F.lit(False)), "INVALID_PLATFORM"))
    rules.append(_code(~F.coalesce(F.upper("order_status").isin(*V.STATUSES), F.lit(False)), "INVALID_ORDER_STATUS"))

    # Only text has to be read as a number.
    quantity = col("quantity") if dict(df.dtypes)["quantity"] == "double" else col("quantity").cast("string").try_cast("double")
    unreadable = col("quantity").isNull() | quantity.isNull() if raw_quantity else F.lit(False)
    rules.append(
        F.when(unreadable, "INVALID_QUANTITY_TYPE")
        .when(quantity.isNull() | F.isnan(quantity) | (quantity <= 0), "NON_POSITIVE_QUANTITY")
        .when(quantity > V.MAX_QUANTITY, "OUTLIER_QUANTITY")
        .when(quantity % 1 != 0, "NON_INTEGER_QUANTITY")
    )

    for name in ("original_price", "discounted_price", "subtotal", "buyer_total_amount", *V.OPTIONAL_AMOUNTS):
        if name not in names:
            continue
        amount = col(name).cast("double")
        empty = amount.isNull() | F.isnan(amount)
        if name != "discounted_price":
            rules.append(_code(empty, f"INVALID_{name.upper()}_TYPE"))
        rules.append(
            F.when(empty, F.lit(None))
            .when(amount < 0, f"NEGATIVE_{name.upper()}")
            .when(amount > V.MAX_AMOUNT, f"OUTLIER_{name.upper()}")
        )

    if "weight_kg" in names:
        weight = col("weight_kg").cast("double")
        bad = weight.isNotNull() & (~S.finite(weight) | (weight < 0) | (weight >= 100000))
        if "_invalid_weight_kg" in names:
            bad = bad | col("_invalid_weight_kg")
        rules.append(_code(bad, "INVALID_WEIGHT_KG"))

    create = col("create_time")
    cod = F.lower(col("is_cod").cast("string")).isin("true", "1", "t") if "is_cod" in names else F.lit(False)
    rules += [
        _code(create.isNull(), "INVALID_CREATE_TIMESTAMP"),
        _code(col("pay_time") < create, "PAY_TIME_BEFORE_CREATE_TIME"),
        _code(create.isNotNull() & (col("shipped_time") < col("pay_time")) & ~F.coalesce(cod, F.lit(False)),
              "SHIP_TIME_BEFORE_PAY_TIME"),
        _code(create.isNotNull() & (col("completed_time") < col("shipped_time")), "COMPLETE_TIME_BEFORE_SHIP_TIME"),
        _code(col("cancel_time") < create, "CANCEL_TIME_BEFORE_CREATE_TIME"),
    ]
    return rules


def snapshot_rules(df: DataFrame) -> list[Column]:
    """Inventory snapshots: identity, time, lengths and non-negative 32-bit whole numbers."""
    names = set(df.columns)
    rules = [
        _code(F.length(F.col(name).cast("string")) > limit, f"TOO_LONG_{name.upper()}")
        for name, limit in (("sku", 50), ("product_name", 500), ("category", 100)) if name in names
    ]
    rules.append(_code(S.to_instant(F.col("loaded_at")).isNull(), "INVALID_LOADED_AT"))
    rules.append(_code(F.col("sku").isNull() | (F.trim(F.col("sku").cast("string")) == ""), "MISSING_SKU"))
    for name in ("stock_on_hand", "safety_stock", "reorder_point"):
        if name not in names:
            continue
        number = S.as_number(F.col(name))
        supplied = F.lit(True) if name == "stock_on_hand" else F.col(name).isNotNull()
        bad = number.isNull() | (number < 0) | (number > 2_147_483_647) | (number % 1 != 0)
        rules.append(_code(supplied & bad, f"INVALID_{name.upper()}"))
    return rules


def forecast_request_rules(history_end: Column) -> list[Column]:
    """Request table with from_date and to_date, scored in one batch."""
    start, end = F.col("from_date"), F.col("to_date")
    return [
        _code(start > end, "RANGE_REVERSED"),
        _code(F.datediff(end, start) + 1 > 90, "RANGE_OVER_90_DAYS"),
        _code(F.datediff(end, history_end) > V.MAX_FORECAST_STEPS, "TOO_MANY_STEPS"),
    ]


def policy_request_rules() -> list[Column]:
    return [
        _code(~F.col("lead_time_days").between(1, 30), "LEAD_TIME_OUT_OF_RANGE"),
        _code(~F.col("service_level").between(0.50, 0.99), "SERVICE_LEVEL_OUT_OF_RANGE"),
        _code(F.col("current_stock") < 0, "NEGATIVE_STOCK"),
    ]


def with_errors(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Codes joined in report order; an empty text means accepted.

    One text is cheaper than an array per row: null codes are skipped by the join itself, without
    a lambda, and the accepted rows carry an empty value.
    """
    return df.withColumn("errors", F.concat_ws("; ", *rules))


def error_list() -> Column:
    return F.when(F.col("errors") != "", F.split("errors", "; ")).otherwise(F.array().cast("array<string>"))


def evaluated(df: DataFrame) -> DataFrame:
    """Checked rows whose errors a filter above does not evaluate a second time.

    A filter on a computed column is moved below its computation, rules and all. It stays above a row number that is drawn anew in each
    evaluation, so nothing has to be stored in between, and the payload of accepted rows is never written.
    """
    return df.withColumn("_drawn", F.rand()).filter((F.col("_drawn") >= 0) & F.col("errors").isNotNull())


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reasons in one text."""
    accepted = df.filter("errors = ''").drop("errors")
    rejected = df.filter("errors <> ''").withColumnRenamed("errors", "rejection_reasons")
    return accepted, rejected


def scorecard(df: DataFrame) -> DataFrame:
    """Totals and pass rate, one row."""
    valid = F.count_if(F.col("errors") == "")
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_records"), valid.alias("valid_records"), (total - valid).alias("invalid_records"),
        F.when(total > 0, F.round(valid / total, 6)).otherwise(1.0).alias("pass_rate"),
    )


def error_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(error_list()).alias("error_code")).groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


def accounting(df: DataFrame, keys: list[str]) -> DataFrame:
    """raw = valid + duplicates + rejected, from one pass over the checked rows.

    Valid lines are the distinct complete keys among the accepted rows (plus accepted rows without
    a complete key), duplicates are the accepted rest.
    """
    accepted = F.col("errors") == ""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    one = df.select(
        accepted.alias("ok"), whole.alias("whole"), F.when(accepted & whole, F.struct(*keys)).alias("key"),
    ).agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if(~F.col("ok")).alias("rejected_records"),
        F.count_if("ok").alias("_accepted"),
        (F.count_distinct("key") + F.count_if(F.col("ok") & ~F.col("whole"))).alias("valid_records"),
    )
    counted = one.withColumn("duplicate_records", F.col("_accepted") - F.col("valid_records"))
    return counted.select(
        "raw_records", "valid_records", "duplicate_records", "rejected_records",
        (F.col("raw_records") == F.col("valid_records") + F.col("duplicate_records") + F.col("rejected_records"))
        .alias("balanced"),
    )


def cleaning_report(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows before and after cleaning and the share kept."""
    before = original.agg(F.count(F.lit(1)).alias("original_rows"))
    after = cleaned.agg(F.count(F.lit(1)).alias("clean_rows"))
    return before.select(
        "original_rows", after.select("clean_rows").scalar().alias("clean_rows"),
    ).select(
        "original_rows", "clean_rows",
        F.greatest(F.col("original_rows") - F.col("clean_rows"), F.lit(0).cast("long")).alias("removed_total"),
        F.when(F.col("original_rows") > 0,
               F.round((F.col("clean_rows") * 100).cast("decimal(20,0)") / F.col("original_rows").cast("decimal(18,0)"), 1)
               .cast("double")).otherwise(0.0).alias("clean_pct"),
    )
