"""Dimensions of the star schema and the resolution of fact keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators.latest import first_by
from marketloom.operators.merge import insert_missing, merge_scd1


def calendar(spark: SparkSession, first: Column, last: Column) -> DataFrame:
    """Calendar dimension between two dates; weekday is stored with Sunday as 0."""
    days = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("full_date"))
    return calendar_columns(days, first)


def calendar_columns(days: DataFrame, first: Column) -> DataFrame:
    d = F.col("full_date")
    return days.select(
        (F.datediff(d, first) + 1).cast("int").alias("date_key"), d,
        (F.dayofweek(d) - 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter"), F.year(d).alias("year"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"), S.is_sale_day(d).alias("is_mega_sale"),
    )


def extend_calendar(stored: DataFrame, dates: DataFrame) -> DataFrame:
    """Add the unseen dates of ``dates(full_date)`` after the highest stored key."""
    unseen = dates.select("full_date").filter("full_date is not null").distinct().join(stored, "full_date", "left_anti")
    highest = stored.agg(F.coalesce(F.max("date_key"), F.lit(0)).alias("m")).scalar()
    # Distinct calendar days, so this ordering is bounded by the calendar, not by the data.
    from pyspark.sql import Window

    numbered = unseen.withColumn("_n", F.row_number().over(Window.orderBy("full_date")))
    rows = calendar_columns(numbered.select("full_date"), F.lit("1970-01-01").cast("date")).drop("date_key")
    rows = rows.join(numbered, "full_date").withColumn("date_key", (F.col("_n") + highest).cast("int")).drop("_n")
    return stored.unionByName(rows.select(*stored.columns))


def product_rows(lines: DataFrame, order: tuple[str, ...] = ("order_id", "source_line_id")) -> DataFrame:
    """One row per SKU with the documented defaults, first line wins."""
    first = first_by(lines.filter("sku is not null"), ["sku"], list(order), ["product_name", "category", "original_price", "weight_kg"])
    return first.select(
        "sku", S.clean_default(F.col("product_name"), None).alias("_name"),
        S.clean_default(F.col("category"), "Chung").alias("category"),
        S.clean_default(F.col("original_price"), 0.0).cast("double").alias("unit_cost"),
        S.clean_default(F.col("weight_kg"), 0.1).cast("double").alias("weight_kg"),
    ).withColumn("product_name", F.coalesce("_name", "sku")).drop("_name")


def shop_rows(lines: DataFrame, order: tuple[str, ...] = ("order_id", "source_line_id")) -> DataFrame:
    """One row per shop and platform; an absent shop is stored as empty text, an absent name as ``Shop``. Lines without a platform name none."""
    known = lines.filter("platform is not null").withColumn("shop_id", F.coalesce(S.clean_default(F.col("shop_id").cast("string"), None), F.lit("")))
    first = first_by(known, ["shop_id", "platform"], list(order), ["shop_name"])
    return first.select("shop_id", "platform", S.clean_default(F.col("shop_name"), "Shop").alias("shop_name"))


def geography_rows(lines: DataFrame) -> DataFrame:
    """Distinct places; an absent city or district is stored as empty text on both sides."""
    return lines.filter("state is not null").select(
        "state", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("district", F.lit("")).alias("district"),
        F.coalesce("country", F.lit("VN")).alias("country"), S.region_of(F.col("state")).alias("region"),
    ).dropDuplicates(["state", "city", "district"])


def load_products(stored: DataFrame, lines: DataFrame, order: tuple[str, ...] = ("order_id", "source_line_id")) -> DataFrame:
    """Products with those of a batch: new SKUs get the next keys, known ones the batch's name, cost and weight."""
    return merge_scd1(stored, product_rows(lines, order), ["sku"], ["product_name", "unit_cost", "weight_kg"], "product_key")


def load_shops(stored: DataFrame, lines: DataFrame, order: tuple[str, ...] = ("order_id", "source_line_id")) -> DataFrame:
    """Shops with those of a batch, by shop and platform; a known shop takes the batch's name."""
    return merge_scd1(stored, shop_rows(lines, order), ["shop_id", "platform"], ["shop_name"], "shop_key")


def load_geography(stored: DataFrame, lines: DataFrame) -> DataFrame:
    """Places with the new ones of a batch; a known place stays as it is."""
    return insert_missing(stored, geography_rows(lines), ["state", "city", "district"], "geo_key")


def load_carriers(stored: DataFrame, lines: DataFrame) -> DataFrame:
    names = lines.select(S.blank_to_null(F.trim("carrier_name")).alias("carrier_name")).filter("carrier_name is not null").distinct()
    return insert_missing(stored, names, ["carrier_name"], "carrier_key")


def resolve_fact_keys(lines: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Surrogate keys of the six dimensions, left joins so that nothing disappears.

    No broadcast is forced: products and shops grow with the data, so the size measured at run
    time decides, and a skewed product key is split by the adaptive skew join.
    """
    out = lines
    if "products" in dims:
        out = out.join(dims["products"].select("sku", "product_key"), "sku", "left")
    if "shops" in dims:
        out = out.withColumn("shop_id", F.coalesce("shop_id", F.lit(""))).join(
            dims["shops"].select("shop_id", "platform", "shop_key"), ["shop_id", "platform"], "left")
    if "geography" in dims:
        place = dims["geography"].select("state", "city", "district", "geo_key")
        out = out.withColumns({"city": F.coalesce("city", F.lit("")), "district": F.coalesce("district", F.lit(""))})
        out = out.join(place, ["state", "city", "district"], "left")
    if "dates" in dims:
        out = out.join(dims["dates"].select(F.col("full_date").alias("order_date"), "date_key"), "order_date", "left")
    if "payments" in dims:
        out = out.join(dims["payments"].select("payment_method", "payment_key"), "payment_method", "left")
    if "carriers" in dims:
        out = out.join(dims["carriers"].select("carrier_name", "carrier_key"), "carrier_name", "left")
    return out


def require_keys(fact: DataFrame, required: tuple[str, ...] = ("product_key", "date_key")) -> DataFrame:
    """Fail the job when a required key is unresolved, while rows stream through."""
    out = fact
    for name in required:
        checked = F.when(F.col(name).isNull(), F.raise_error(
            F.concat(F.lit(f"unresolved {name} for order "), F.coalesce("order_id", F.lit("?")))).cast(fact.schema[name].dataType)
        ).otherwise(F.col(name))
        out = out.withColumn(name, checked)
    return out


def unresolved(fact: DataFrame, source_of: dict[str, str]) -> DataFrame:
    """Null keys split by whether the source value was blank (allowed) or present (an error)."""
    aggregates: list[Column] = []
    for key, source in source_of.items():
        blank = F.col(source).isNull() | (F.trim(F.col(source).cast("string")) == "")
        aggregates.append(F.count_if(F.col(key).isNull() & blank).alias(f"{key}_source_blank"))
        aggregates.append(F.count_if(F.col(key).isNull() & ~blank).alias(f"{key}_unresolved"))
    return fact.agg(*aggregates)
