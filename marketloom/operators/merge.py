"""Upserts on plain tables: each returns the new version of the stored table.

Both sides carry unique keys when they meet (incoming rows are reduced first, map-side), so the
full outer joins have no hot key. Writing the result to a new folder and switching to it is the
caller's step; see ``sources.warehouse.PartedTable``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import vocab as V
from marketloom.operators.latest import latest_by
from marketloom.operators.prefix import number_rows

FACT_KEY = ["order_id", "platform", "source_line_id"]
FACT_KEEP_OLD = ("create_time",)                      # written once, never updated
FACT_OLD_FIRST = ("date_key",)                        # stored value wins, incoming fills a gap
FACT_NEW_FIRST = ("cancel_reason", "pay_time", "shipped_time", "completed_time", "cancel_time")


KEY = "_key"


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns as one struct, which compares null-safely: an absent city or district is a value of the key.

    Rows that were reduced by the struct are where the merge needs them, so they are not shuffled twice.
    """
    return df if KEY in df.columns else df.select(F.struct(*keys).alias(KEY), *[c for c in df.columns if c not in keys])


def _joined(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, Callable[[str], Column], Callable[[str], Column]]:
    """Rows with the same key side by side, and the column of a name on the stored and on the incoming side; ``in_old`` and ``in_new`` tell
    which of the two there are.

    Columns travel one by one and the key once, so what is not read later is not shuffled.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})

    def column(prefix: str) -> Callable[[str], Column]:
        return lambda name: F.col(f"{prefix}{KEY}").getField(name) if name in keys else F.col(f"{prefix}{name}")

    pairs = side(packed(stored, keys), "o_").join(side(packed(incoming, keys), "n_"), F.col(f"o_{KEY}") == F.col(f"n_{KEY}"), "full_outer")
    return pairs.withColumns({"in_old": F.col(f"o_{KEY}").isNotNull(), "in_new": F.col(f"n_{KEY}").isNotNull()}), column("o_"), column("n_")


def merge_scd1(stored: DataFrame, incoming: DataFrame, keys: list[str], update: list[str],
               surrogate: str | None = None) -> DataFrame:
    """Insert new keys, overwrite only ``update`` columns of known keys."""
    pairs, old, new = _joined(stored, incoming, keys)

    def value(name: str) -> Column:
        if name == surrogate:
            return old(name).alias(name)
        overwrite = F.col("in_new") & (F.lit(name in update) | ~F.col("in_old"))
        return F.when(overwrite, new(name)).otherwise(old(name)).alias(name)

    if surrogate is None:
        return pairs.select(*[value(c) for c in stored.columns])
    known = pairs.filter("in_old").select(*[value(c) for c in stored.columns])
    fresh = pairs.filter("not in_old").select(*[new(c).alias(c) for c in stored.columns if c != surrogate])
    return known.unionByName(with_surrogate(stored, fresh, keys, surrogate).select(*stored.columns))


def with_surrogate(stored: DataFrame, fresh: DataFrame, order: list[str], surrogate: str) -> DataFrame:
    """Give new rows the numbers after the highest stored surrogate key."""
    highest = stored.agg(F.coalesce(F.max(surrogate), F.lit(0)).cast("long").alias("m")).scalar()
    return number_rows(fresh, [F.col(c).asc_nulls_first() for c in order], surrogate, highest)


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: list[str], surrogate: str | None = None) -> DataFrame:
    """Keep every stored row, append incoming rows whose key is not stored yet."""
    condition = None
    for k in keys:
        part = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        condition = part if condition is None else condition & part
    fresh = incoming.dropDuplicates(keys).alias("n").join(stored.select(*keys).alias("o"), condition, "left_anti")
    if surrogate:
        fresh = with_surrogate(stored, fresh, keys, surrogate)
    return stored.unionByName(fresh.select(*stored.columns))


def merge_versioned(
    stored: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    version: str,
    keep_old: tuple[str, ...] = (),
    old_first: tuple[str, ...] = (),
    new_first: tuple[str, ...] = (),
    stored_version: Callable[[Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """Version-gated upsert: an incoming row applies only if it is not older than the stored one.

    ``stored_version`` makes the effective version of an old row from its columns, given by name.
    """
    pairs, old, new = _joined(stored, incoming, keys)
    old_version = stored_version(old) if stored_version is not None else old(version)
    applies = F.coalesce(~F.col("in_old") | (F.col("in_new") & (new(version) >= old_version)), F.lit(False))

    def value(name: str) -> Column:
        if name in keep_old:
            result = F.when(~F.col("in_old"), new(name)).otherwise(old(name))
        elif name in old_first:
            result = F.when(applies, F.coalesce(old(name), new(name))).otherwise(old(name))
        elif name in new_first:
            result = F.when(applies, F.coalesce(new(name), old(name))).otherwise(old(name))
        else:
            result = F.when(applies, new(name)).otherwise(old(name))
        return result.alias(name)

    return pairs.select(*[value(c) for c in stored.columns])


def merge_fact(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Order fact: latest incoming version per line, gated against the stored version."""
    reduced = latest_by(packed(incoming, FACT_KEY), [KEY], [F.col("source_updated_at").desc_nulls_last()])
    return merge_versioned(stored, reduced, FACT_KEY, "source_updated_at", FACT_KEEP_OLD, FACT_OLD_FIRST, FACT_NEW_FIRST,
                           lambda old: F.coalesce(old("source_updated_at"), F.greatest(*[old(t) for t in V.LIFECYCLE])))


def merge_snapshots(stored: DataFrame, incoming: DataFrame, keys: list[str], at: str = "snapshot_at") -> DataFrame:
    """Inventory: newest snapshot per key, an older replay changes nothing."""
    return merge_versioned(stored, latest_by(packed(incoming, keys), [KEY], [F.col(at).desc()]), keys, at)


def append_forecasts(stored: DataFrame, issued: DataFrame, keys: list[str]) -> DataFrame:
    """Audit of issued forecasts: insert once, a repeated issue changes nothing."""
    return insert_missing(stored, issued, keys)
