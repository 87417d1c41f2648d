"""Running totals and dense numbering over orderings that are too large for one task.

A plain window without (or with very few) partition keys sends every row to one task. Here the
rows are range-partitioned on the ordering instead; each slice is summed on its own and receives
the total of the slices before it, which is a table of one row per slice and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialise


def _slices(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_total(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    values: dict[str, str],
    few_groups: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add ``{out: running sum of value}`` along ``order`` inside each of the ``groups``.

    ``order`` must be a total order within a group. The offsets table has at most slices + number
    of groups rows. ``few_groups`` says that the groups are a small fixed domain (origins, monitored
    features), so the offsets may be broadcast; otherwise the size seen at run time decides.
    """
    # The slice number is written with the rows, so both readers below see the same slices even
    # when tasks are run again.
    ranged = df.repartitionByRange(slices or _slices(df), *[F.col(g) for g in groups], *order)
    cut = materialise(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*groups, "_slice").agg(
        *[F.sum(value).alias(f"_sum_{out}") for out, value in values.items()]
    )
    offsets = totals.select(
        *groups, "_slice",
        *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_off_{out}") for out in values],
    )
    within = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = cut.join(F.broadcast(offsets) if few_groups else offsets, [*groups, "_slice"])
    for out, value in values.items():
        joined = joined.withColumn(out, F.sum(value).over(within) + F.col(f"_off_{out}"))
    return joined.drop("_slice", *[f"_off_{out}" for out in values])


def number_rows(df: DataFrame, order: list[Column], out: str, start: Column | int = 0) -> DataFrame:
    """Dense numbers ``start + 1, start + 2, ...`` along ``order`` without a single-task window."""
    numbered = running_total(df.withColumn("_one", F.lit(1).cast("long")), [], order, {out: "_one"})
    begin = start if isinstance(start, Column) else F.lit(start)
    return numbered.withColumn(out, F.col(out) + begin).drop("_one")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float],
                    few_groups: bool = False) -> DataFrame:
    """Linearly interpolated quantiles per group, without holding a group's values in one task.

    Values are reduced to counts map-side, ranked by the sliced running total, and the two
    neighbours of each quantile are picked by an ordinary aggregation.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, groups, [F.col("_v")], {"_c": "_n"}, few_groups)
    totals = ranked.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    if not groups:
        ranked = ranked.withColumn("_total", totals.select("_total").scalar())
    else:
        ranked = ranked.join(F.broadcast(totals) if few_groups else totals, groups)
    picks = []
    for name, p in probabilities.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("_c") > F.floor(at), F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_c") > F.ceil(at), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_w_{name}"),
        ]
    picked = ranked.groupBy(*groups).agg(F.max("_total").alias("n"), *picks)
    return picked.select(*groups, "n", *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probabilities])
