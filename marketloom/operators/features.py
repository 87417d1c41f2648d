"""Leak-free time-series features over the dense SKU x day series."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators import demand as D
from marketloom.operators.latest import first_by
from marketloom.operators.prefix import number_rows
from marketloom.session import materialise

TARGET = "target_t_plus_1"
# Columns that are not features.
NOT_FEATURES = ("sku", "date", "target_date", "product_name", "category", "abc_class", "xyz_class", "matrix_class", TARGET)


def calendar_features(df: DataFrame) -> DataFrame:
    """Calendar of day t and of the target day t+1; weekday with Monday as 0."""
    d = F.col("date")
    t = F.date_add(d, 1)
    flag = lambda c: c.cast("int")
    return df.withColumns({
        "day_of_week": S.weekday_monday0(d), "is_weekend": flag(S.weekday_monday0(d) >= 5),
        "day_of_month": F.dayofmonth(d), "month": F.month(d), "quarter": F.quarter(d),
        "is_mega_sale": flag(S.is_sale_day(d)),
        "target_day_of_week": S.weekday_monday0(t), "target_is_weekend": flag(S.weekday_monday0(t) >= 5),
        "target_day_of_month": F.dayofmonth(t), "target_is_mega_sale": flag(S.is_sale_day(t)),
    })


def window_features(df: DataFrame, y: str = "daily_demand", key: str = "sku", lags=V.DEFAULT_LAGS,
                    windows=V.ROLLING_WINDOWS) -> DataFrame:
    """Lags, rolling statistics of previous days, week-on-week growth and the next-day target.

    All windows share one partitioning and one ordering, hence one shuffle and one sort.
    """
    w = Window.partitionBy(key).orderBy("date")
    value = F.col(y)
    columns: dict[str, Column] = {f"lag_{k}": F.lag(value, k).over(w) for k in lags}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        count, total, squares = F.count(value).over(frame), F.sum(value).over(frame), F.sum(value * value).over(frame)
        mean, std = S.statistics_from_sums(count, total, squares)
        columns[f"rolling_mean_{n}"] = F.when(count > 0, mean)
        columns[f"rolling_std_{n}"] = F.when(count > 1, std).otherwise(0.0)
        columns[f"rolling_max_{n}"] = F.max(value).over(frame)
        columns[f"rolling_min_{n}"] = F.min(value).over(frame)
    columns[TARGET] = F.lead(value, 1).over(w)
    out = df.withColumns(columns)
    if 1 in lags and 7 in lags:
        out = out.withColumn("growth_wow", (F.col("lag_1") - F.col("lag_7")) / (F.col("lag_7") + 1.0))
    return out


LONGEST_BLOCK = 512


def block_length(q: float) -> int:
    """Days over which ``q ** -position`` stays far inside the range of doubles."""
    return max(1, min(LONGEST_BLOCK, int(150 / -math.log10(q))))


def _decayed_sum(factor: float):
    return lambda total, value: total * F.lit(factor) + value


def ema_features(df: DataFrame, y: str = "daily_demand", key: str = "sku", spans=V.EMA_SPANS) -> DataFrame:
    """Exponential averages of all previous days (recursive form, first value as start), for any span.

    The recursion is unrolled into a running sum of values weighted by (1 - alpha) ** -position, which only ever adds positive weights.
    Positions restart with every block of days so the weights stay in range; the ends of all blocks before, one number for each block, are
    folded in order, and their decayed average is added. All windows reuse the distribution by SKU: no extra shuffle.
    """
    by_day = Window.partitionBy(key).orderBy("date")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_i", F.row_number().over(by_day) - 1)
    kept = []
    for s in spans:
        a = 2.0 / (s + 1)
        q = 1.0 - a
        if q <= 0:
            out = out.withColumn(f"_ema_{s}", F.col(y))
        else:
            n = block_length(q)
            in_block = Window.partitionBy(key, F.floor(F.col("_i") / n)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
            p = F.col("_i") % n
            weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(a)) * F.pow(F.lit(q), -p)
            out = out.withColumn(f"_own_{s}", F.sum(F.col(y) * weight).over(in_block) * F.pow(F.lit(q), p))
            ends = F.collect_list(F.when(p == n - 1, F.col(f"_own_{s}"))).over(earlier)
            whole = F.aggregate(ends, F.lit(0.0), _decayed_sum(q ** n))
            out = out.withColumn(f"_ema_{s}", F.col(f"_own_{s}") + whole * F.pow(F.lit(q), p + 1))
            kept.append(f"_own_{s}")
    out = out.withColumns({f"ema_{s}": F.lag(f"_ema_{s}", 1).over(by_day) for s in spans})
    return out.drop("_i", *kept, *[f"_ema_{s}" for s in spans])


def segment_cutoff(lines: DataFrame, holdout_days: int = 49, min_fit_days: int = 14) -> Column:
    """Day before which segments may be fitted, so that hold-out days cannot leak into features."""
    bounds = lines.select(F.col("create_time").cast("date").alias("d")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    cut = F.date_sub("hi", holdout_days)
    middle = F.date_add("lo", F.floor(F.datediff("hi", "lo") / 2).cast("int"))
    return bounds.select(F.when(F.datediff(cut, "lo") < min_fit_days, middle).otherwise(cut).alias("cutoff")).scalar()


def attach_segments(features: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment columns per SKU; a SKU first seen after the cutoff is C/Z."""
    chosen = segments.select(
        "sku", "abc_class", "xyz_class", F.col("matrix_segment").alias("matrix_class"), "cv",
        F.col("safety_stock").cast("double").alias("safety_stock"))
    return features.join(chosen, "sku", "left").fillna(
        {"abc_class": "C", "xyz_class": "Z", "matrix_class": "CZ", "cv": 0.0, "safety_stock": 0.0})


# Vocabularies of the segment columns; a code is a position in them.
SEGMENT_WORDS = {"abc_class": list("ABC"), "xyz_class": list("XYZ"), "matrix_class": [a + x for a in "ABC" for x in "XYZ"]}


def encode_segments(df: DataFrame) -> DataFrame:
    """Integer codes from the fixed vocabularies."""
    return df.withColumns({f"{c}_code": S.vocab_code(F.col(c), v) for c, v in SEGMENT_WORDS.items() if c in df.columns})


def category_codes(rows: DataFrame, column: str = "category") -> DataFrame:
    """(word, code): positions of the sorted distinct words, from 0.

    The vocabulary is numbered by the distributed counter, so it may be of any size.
    """
    words = rows.select(F.col(column).alias("word")).filter("word is not null").distinct()
    return number_rows(words, [F.col("word")], "code", -1)


def encode_category(df: DataFrame, column: str = "category") -> DataFrame:
    """Position in the sorted distinct categories, -1 when absent."""
    codes = category_codes(df, column).select(F.col("word").alias(column), F.col("code").alias(f"{column}_code"))
    return df.join(codes, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)).cast("int"))


def sku_days(lines: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Lines reduced to a row for each SKU, day and whether cancelled, and stored: quantity and revenue, greatest and (with ``order``) first names.

    Bounds, cutoff, segments and names of a feature store follow from it, so the lines are read once for all of them. Its columns have the names
    of line columns, so it stands for the lines wherever sums, greatest and first values of them are asked.
    """
    named = {"product_name", "category"} <= set(lines.columns)
    names = [F.max(c).alias(c) for c in ("product_name", "category") if named]
    first = [F.min_by(F.struct(F.struct(*order).alias("at"), F.struct("product_name", "category").alias("named")), F.struct(*order)).alias("_first")] if named and order else []
    days = lines.groupBy("sku", F.col("create_time").cast("date").alias("create_time"), "is_cancelled").agg(
        F.sum(F.col("quantity").cast("decimal(18,0)")).alias("quantity"), F.sum(F.col("buyer_total_amount").cast("decimal(18,2)")).alias("buyer_total_amount"), *names, *first)
    return materialise(days, "sku-days")


def sku_names(lines: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Name, category and category code of the first line of each SKU; ``lines`` may also be ``sku_days``."""
    if "_first" in lines.columns:
        lines = lines.select("sku", "_first.at", "_first.named.*")
        order = ("at",)
    return encode_category(first_by(lines, ["sku"], list(order), ["product_name", "category"]))


def daily_history(lines: DataFrame, order_key=("platform", "order_id"), days: DataFrame | None = None) -> DataFrame:
    """The dense series of every SKU; with ``sku_days`` of the lines the calendar's ends are taken from there."""
    first, last = D.date_bounds(days if days is not None else lines)
    return D.dense_daily(D.daily_metrics(lines, order_key), first, last)


def recent_features(lines: DataFrame, days: int, lags=V.DEFAULT_LAGS, windows=V.ROLLING_WINDOWS) -> DataFrame:
    """Lags, rolling statistics, growth and target of the last ``days`` feature days.

    The last day is known before any window runs, so only these days, the longest lag or window before them and the next day of the last one
    are read and filled. Exponential averages, which look back to the first day, are not among them.
    """
    reach = max([*lags, *windows])
    features = window_features(D.recent_dense(lines, days + reach + 1), lags=lags, windows=windows)
    return features.dropna(subset=[f"lag_{max(lags)}", TARGET])


FIRST_LINE = ("create_time", "order_id", "source_line_id")


def build_feature_store(lines: DataFrame, daily: DataFrame | None = None, lags=V.DEFAULT_LAGS,
                        holdout_days: int = 49, order: tuple[str, ...] = FIRST_LINE, days: DataFrame | None = None) -> DataFrame:
    """Feature rows (SKU, day t) for target t+1 with segments, name and category, burn-in rows removed.

    Name and category are those of a SKU's first line in ``order``. An input too short for the largest lag plus the target yields no
    rows; callers check with ``require_rows`` before training. ``days``: the ``sku_days`` of the lines, where they are stored already.
    """
    days = days if days is not None else sku_days(lines, order)
    daily = daily if daily is not None else daily_history(lines, days=days)
    features = ema_features(window_features(daily, lags=lags))
    cutoff = segment_cutoff(days, holdout_days)
    fitted = D.abc_xyz(D.demand_rows(days.filter(F.col("create_time") < cutoff)), D.CLASSIFIER)
    full = encode_segments(attach_segments(calendar_features(features), fitted))
    if {"product_name", "category"} <= set(lines.columns):
        full = full.join(sku_names(days, order), "sku", "left").withColumn("category_code", F.coalesce("category_code", F.lit(-1)))
    return full.dropna(subset=[f"lag_{max(lags)}", TARGET])


def require_rows(store: DataFrame, max_lag: int = 28) -> DataFrame:
    if store.isEmpty():
        raise ValueError(f"feature store has no training rows: at least {max_lag + 2} consecutive days are needed")
    return store


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def sku_profiles(store: DataFrame) -> DataFrame:
    """Latest profile per SKU, for the feature contract."""
    from marketloom.operators.latest import latest_by

    keep = [c for c in ("sku", "product_name", "category", "abc_class", "xyz_class", "matrix_class", "cv", "safety_stock") if c in store.columns]
    return latest_by(store, ["sku"], [F.col("date").desc()]).select(*keep)


@dataclass(frozen=True)
class Source:
    """Where the orders behind a feature store come from."""

    data_source: str = "unknown"
    data_origin: str = "unknown"
    datasets: tuple[str, ...] = ()


def feature_contract(store: DataFrame, cutoff: Column, source: Source = Source(), lags=V.DEFAULT_LAGS, generated_at: Column | None = None) -> DataFrame:
    """What serving must know to build the same features: ``kind``, ``entry`` and a JSON ``body``.

    One ``contract`` row (target, columns in order, parameters, fixed codes, segment cutoff, source, time), one ``category`` row for each
    word with its code, and one ``sku`` row for each profile. Categories and profiles stay distributed, as they grow with the catalogue.
    """
    spark = store.sparkSession
    at = generated_at if generated_at is not None else F.current_timestamp()
    lists = {"feature_columns": feature_columns(store), "lags": [*lags], "rolling_windows": [*V.ROLLING_WINDOWS], "ema_spans": [*V.EMA_SPANS], "source_datasets": sorted(set(source.datasets))}
    fixed = F.struct(*[F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))]).alias(c) for c, words in SEGMENT_WORDS.items()])
    listed = [(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")).alias(name) for name, values in lists.items()]
    header = spark.range(1).select(F.lit("contract").alias("kind"), F.lit("contract").alias("entry"), F.to_json(F.struct(
        F.lit(TARGET).alias("target_column"), *listed, fixed.alias("category_mappings"), cutoff.cast("string").alias("segment_cutoff_date"),
        F.lit(source.data_source).alias("data_source"), F.lit(source.data_origin).alias("data_origin"), at.alias("generated_at"))).alias("body"))
    profiles = sku_profiles(store).select(F.lit("sku").alias("kind"), F.col("sku").alias("entry"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
    if "category_code" not in store.columns:
        return header.unionByName(profiles)
    words = store.filter("category is not null").groupBy("category").agg(F.min("category_code").alias("code"))
    return header.unionByName(words.select(F.lit("category").alias("kind"), F.col("category").alias("entry"), F.to_json(F.struct("code")).alias("body"))).unionByName(profiles)


def sequence_windows(daily: DataFrame, columns: list[str], length: int = 14, y: str = "daily_demand") -> DataFrame:
    """Sliding windows of the previous ``length`` days with the day's value as target.

    A SKU with too few days gives one window, left-padded with its first row.
    """
    w = Window.partitionBy("sku").orderBy("date")
    frame = w.rowsBetween(-length, -1)
    step = F.array(*[F.col(c).cast("double") for c in columns])
    rows = daily.withColumns({
        "steps": F.collect_list(step).over(frame), "_n": F.count(F.lit(1)).over(Window.partitionBy("sku")),
        "_first": F.first(step).over(w), "_last": F.lead("date").over(w).isNull(), "target": F.col(y),
    })
    full = F.size("steps") == length
    short = (F.col("_n") <= length) & F.col("_last")
    padded = F.concat(F.array_repeat("_first", F.greatest(F.lit(0), length - F.size("steps"))), "steps")
    return rows.filter(full | short).select("sku", "date", F.when(full, F.col("steps")).otherwise(padded).alias("steps"), "target")
