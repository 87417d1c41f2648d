"""End-to-end reconciliation between stages and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_vs_target(expected: DataFrame, actual: DataFrame, keys: list[str], exact: list[str], money: list[str]) -> DataFrame:
    """Missing, unexpected and differing rows on unique keys; money is compared at two places."""
    e = expected.select(*keys, F.lit(1).alias("_in_e"), *[F.col(c).alias(f"e_{c}") for c in exact + money])
    a = actual.select(*keys, F.lit(1).alias("_in_a"), *[F.col(c).alias(f"a_{c}") for c in exact + money])
    joined = e.join(a, keys, "full_outer")
    both = F.col("_in_e").isNotNull() & F.col("_in_a").isNotNull()
    two = lambda c: F.round(c.cast("decimal(20,4)"), 2)
    differs: dict[str, Column] = {c: ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")) for c in exact}
    differs |= {c: ~two(F.col(f"e_{c}")).eqNullSafe(two(F.col(f"a_{c}"))) for c in money}
    any_differs = reduce(lambda x, y: x | y, differs.values())
    return joined.agg(
        F.count_if(F.col("_in_e").isNotNull()).alias("expected_rows"),
        F.count_if(F.col("_in_a").isNotNull()).alias("actual_rows"),
        F.count_if(F.col("_in_a").isNull()).alias("missing_in_target"), F.count_if(F.col("_in_e").isNull()).alias("unexpected_in_target"),
        F.count_if(both & any_differs).alias("rows_with_mismatch"),
        *[F.count_if(both & d).alias(f"mismatch_{c}") for c, d in differs.items()])


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys only on one side and keys on both, counted in one pass over the union."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_key = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("missing"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("unexpected"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("common"))


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Ids whose number of occurrences differs, with the surplus on either side.

    Both sides are counted map-side, so many copies of one id do not meet in one task.
    """
    tagged = left.select(*keys, F.lit(1).alias("d")).unionByName(right.select(*keys, F.lit(-1).alias("d")))
    net = tagged.groupBy(*keys).agg(F.sum("d").alias("d")).filter("d <> 0")
    return net.select(*keys, F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("extra"))


def fingerprint(df: DataFrame, columns: list[str], algorithm: str = "xxhash64") -> DataFrame:
    """Row count and an order-free hash of the chosen columns."""
    if algorithm == "xxhash64":
        row = F.xxhash64(*columns)
        return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(row).alias("hash_xor"))
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    row = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("hash_sum"))


def warehouse_audit(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Conditional counts, distinct orders, null keys and time range of the fact table, one row."""
    order = F.struct("platform", "order_id")
    return fact.agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct(order).alias("orders"), F.count_if("is_cancelled").alias("cancelled_lines"),
        F.sum("quantity").cast("long").alias("units"), F.count_if(F.col("quantity") <= 0).alias("non_positive_quantity"),
        *[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys],
        F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


def transition_sanity(fact: DataFrame, cutoff: Column, times: list[str]) -> DataFrame:
    """Rows with a transition after the cutoff, and completed rows without a completion time."""
    return fact.agg(
        F.count_if(F.greatest(*[F.col(t) for t in times]) > cutoff).alias("after_cutoff"),
        F.count_if((F.col("order_status") == "COMPLETED") & F.col("completed_time").isNull()).alias("missing_completed_time"))


def missing_days(fact: DataFrame, first: Column, last: Column, day: str = "order_date") -> DataFrame:
    """Calendar days of the range without a single row."""
    spark = fact.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(day))
    return days.join(fact.select(day).distinct(), day, "left_anti")


def rejects_found(rejected: DataFrame, quarantine: DataFrame) -> DataFrame:
    """How many rejected source rows are present in the quarantine, by source position."""
    position = ["source_object", "source_row"]
    stored = quarantine.select(*position).distinct().withColumn("_q", F.lit(1))
    return rejected.select(*position).distinct().join(stored, position, "left").agg(
        F.count(F.lit(1)).alias("rejected_positions"), F.count("_q").alias("found"),
        (F.count(F.lit(1)) - F.count("_q")).alias("not_found"))


def partition_agreement(rows: DataFrame, event_date: Column) -> DataFrame:
    """Rows whose partition columns disagree with the business date of the event."""
    path_day = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~path_day.eqNullSafe(event_date)).alias("disagreeing"))


def stage_counts(sent: DataFrame, stages: dict[str, DataFrame], key: str, prefix: str | None = None) -> DataFrame:
    """Per stage, how many of the sent events arrived.

    Every stage is reduced to distinct ids first; the stages are tagged and counted in one union,
    so the number of shuffles does not grow with the number of stages.
    """
    def ids(df: DataFrame) -> DataFrame:
        return df.filter(F.col(key).startswith(prefix)) if prefix else df

    names = list(stages)
    tagged = ids(sent).select(F.col(key), F.lit("sent").alias("stage"))
    for name in names:
        tagged = tagged.unionByName(ids(stages[name]).select(F.col(key), F.lit(name).alias("stage")))
    per_id = tagged.groupBy(key).agg(*[F.bool_or(F.col("stage") == n).alias(n) for n in ["sent", *names]])
    return per_id.filter("sent").agg(*[F.count_if(n).alias(f"{n}_events") for n in ["sent", *names]])


def replay_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Totals of a table before and after a replayed batch, and whether they are equal."""
    def totals(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("long").alias("units"),
                      F.sum("subtotal").cast("decimal(24,2)").alias("subtotal")).withColumn("side", F.lit(tag))

    both = totals(before, "before").unionByName(totals(after, "after"))
    return both.groupBy().pivot("side", ["before", "after"]).agg(
        F.first("lines").alias("lines"), F.first("units").alias("units"), F.first("subtotal").alias("subtotal")
    ).withColumn("unchanged", (F.col("before_lines") == F.col("after_lines")) & (F.col("before_units") == F.col("after_units"))
                 & (F.col("before_subtotal") == F.col("after_subtotal")))


def consistency(features: DataFrame, daily: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Feature rows against the daily history, one to one, all close."""
    dup = daily.groupBy("sku", "date").agg(F.count(F.lit(1)).alias("n"), F.min("daily_demand").alias("source"))
    joined = features.select("sku", "date", "daily_demand").join(dup, ["sku", "date"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("source").isNull()).alias("without_source"), F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.count_if(F.abs(F.col("daily_demand") - F.col("source")) > tolerance).alias("not_close"))


def target_check(store: DataFrame, daily: DataFrame) -> DataFrame:
    """The stored target against the demand of the following day."""
    following = daily.select("sku", F.date_sub("date", 1).alias("date"), F.col("daily_demand").alias("next_day"))
    return store.select("sku", "date", "target_t_plus_1").join(following, ["sku", "date"], "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("next_day").isNull()).alias("without_next_day"),
        F.count_if(F.col("next_day") != F.col("target_t_plus_1")).alias("different"))
