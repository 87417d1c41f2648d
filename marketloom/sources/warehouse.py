"""Warehouse tables on plain files, order scans for features, and mart files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import vocab as V
from marketloom.sources.files import Files


def orders_for_features(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Valid order lines with product columns, labelled as the live origin."""
    return fact.filter(~F.col("is_cancelled")).join(products.select("product_key", "sku", "product_name", "category"), "product_key").withColumn(
        "data_origin", F.lit(V.LIVE_ORIGINS[0]))


def historical_lines(history: DataFrame, origin: str = V.HISTORY_ORIGIN, datasets: list[str] | None = None) -> DataFrame:
    rows = history.filter(F.col("data_origin") == origin)
    return rows.filter(F.col("source_dataset").isin(*datasets)) if datasets else rows


def first_available(candidates: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """First source with rows, labelled by its origin; only the first row of each is looked at."""
    for origin, df in candidates:
        if df is not None and not df.isEmpty():
            return df.withColumn("data_source", F.lit(origin))
    raise ValueError("no order source has rows")


def write_feature_store(store: DataFrame, path: str) -> None:
    store.withColumn("month_start", F.trunc("date", "month")).hint("rebalance", "month_start").write.mode("overwrite").partitionBy("month_start").parquet(path)


def read_feature_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month_start")


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Mart as CSV with a header and fixed columns; the folder is replaced as a whole."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


class NoSales(RuntimeError):
    """Neither live nor historical sales exist, so there is nothing to export."""


def publish_marts(marts: dict[str, tuple[DataFrame, list[str]]], root: str, sales: tuple[str, ...] = ()) -> None:
    """Marts (name: rows and columns) as CSV folders below ``root``, all of them or none.

    They are written beside the root and then take its place as a whole, so a failing write, and a refusal because none of the ``sales`` marts
    has a row, leave the old marts as they are. A stop between the two moves is mended by the next call or by ``restore_marts``.
    """
    spark = next(iter(marts.values()))[0].sparkSession
    files, root = Files(spark), root.rstrip("/")
    written, old = f"{root}.next", f"{root}.old"
    restore_marts(spark, root)
    files.delete(written)
    for name, (rows, columns) in marts.items():
        export_csv(rows, f"{written}/{name}", columns)
    if sales and all(spark.read.option("header", True).csv(f"{written}/{name}").isEmpty() for name in sales):
        files.delete(written)
        raise NoSales("no valid orders: nothing to export")
    if files.exists(root):
        files.move(root, old)
    files.move(written, root)
    files.delete(old)


def restore_marts(spark: SparkSession, root: str) -> None:
    """The old marts again, where a publication stopped after it had moved them away; what is left of a finished one goes."""
    files, root = Files(spark), root.rstrip("/")
    if files.exists(f"{root}.old"):
        if files.exists(root):
            files.delete(f"{root}.old")
        else:
            files.move(f"{root}.old", root)


PART = "_part"


class PartedTable:
    """A table with one folder for each day (or other part) of its rows, merged part by part.

    A batch is merged with the stored rows of the parts it touches. The new content of those parts is written beside the table first; once it
    is complete, each part's folder is replaced by it, and all other folders stay as they are. A stop at any point loses nothing: what is
    complete beside the table is put in place by the next merge, what is not is thrown away, and the batch is merged again.
    One writer at a time; a reader may meet a batch of which some parts are in place and some are not yet.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema, part: str, moving: bool = False):
        """``part``: SQL text of a row's part. ``moving``: versions of a key may name different parts; the stored one is then looked up
        by the key columns of the other parts, else only the parts of the batch are read."""
        self.spark, self.root, self.keys, self.schema, self.part, self.moving = spark, root.rstrip("/"), keys, schema, part, moving
        self.staged, self.ledger, self.files = f"{self.root}.staged", f"{self.root}.applied", Files(spark)

    def _parted(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, F.coalesce(F.expr(self.part).cast("string"), F.lit("none")))

    def _stored(self) -> DataFrame:
        from pyspark.sql import types as T

        schema = T.StructType([*self.schema.fields, T.StructField(PART, T.StringType())])
        if not any(n.startswith(f"{PART}=") for n in self.files.names(self.root)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.root)

    def read(self) -> DataFrame:
        return self._stored().drop(PART)

    def merge(self, incoming: DataFrame, merge, batch: tuple[str, int] | None = None) -> None:
        """``merge(stored, incoming)`` gets the stored rows of the touched parts only and returns their new content.

        ``batch`` is a stream and a number that grows within it; a batch that was applied before is left out.
        """
        self._put_in_place()
        if batch and batch[1] <= self.last_applied(batch[0]):
            return
        # At most one short text for each part reaches the driver.
        parts = {r[PART] for r in self._parted(incoming).select(PART).distinct().collect()}
        if parts:
            stored = self._stored()
            if self.moving:
                parts |= self._elsewhere(stored, incoming, parts)
            merged = merge(stored.filter(F.col(PART).isin(*parts)).drop(PART), incoming).select(*self.schema.fieldNames())
            self._parted(merged).hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(self.staged)
            self._mark(f"{self.staged}/_complete")
            self._put_in_place()
        if batch:
            self._note(*batch)

    def _elsewhere(self, stored: DataFrame, incoming: DataFrame, parts: set[str]) -> set[str]:
        wanted = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys])
        others = stored.filter(~F.col(PART).isin(*parts)).select(*self.keys, PART)
        return {r[PART] for r in others.join(wanted, same, "left_semi").select(PART).distinct().collect()}

    def _mark(self, text: str) -> None:
        self.files.mark(text)

    def _put_in_place(self) -> None:
        """Replaces the folders of the parts that are complete beside the table; leaves no rest."""
        names = self.files.names(self.staged)
        if "_complete" in names:
            self.files.make(self.root)
            for name in [n for n in names if n.startswith(f"{PART}=")]:
                self._replace(name)
        if names:
            self.files.delete(self.staged)

    def _replace(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}")
        self.files.move(f"{self.staged}/{name}", f"{self.root}/{name}")

    def last_applied(self, stream: str) -> int:
        """Number of the last batch of a stream that is in the table, -1 if none."""
        return max([int(n.rpartition("=")[2]) for n in self.files.names(self.ledger) if n.startswith(f"{stream}=")], default=-1)

    def _note(self, stream: str, number: int) -> None:
        self._mark(f"{self.ledger}/{stream}={number}")
        for n in self.files.names(self.ledger):
            if n.startswith(f"{stream}=") and int(n.rpartition("=")[2]) < number:
                self.files.delete(f"{self.ledger}/{n}")


CONFIRMED = ["data_origin", "source_dataset", "full_date"]


def confirmation_table(spark: SparkSession, root: str) -> PartedTable:
    """Days whose sales are confirmed to be complete, by month."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("data_origin", T.StringType()), T.StructField("source_dataset", T.StringType()), T.StructField("full_date", T.DateType()),
                           T.StructField("confirmed_at", T.TimestampType())])
    return PartedTable(spark, root, CONFIRMED, schema, "date_format(full_date, 'yyyy-MM')")


def confirm(table: PartedTable, allowed: DataFrame, at: Column, batch: tuple[str, int] | None = None) -> None:
    """Stores confirmations that ``marts.confirm_coverage`` allows. Confirming a day again adds no row; its time becomes the latest one."""
    from marketloom.operators.merge import merge_scd1

    rows = allowed.select(*CONFIRMED).distinct().withColumn("confirmed_at", at)
    table.merge(rows, lambda stored, new: merge_scd1(stored, new, CONFIRMED, ["confirmed_at"]), batch)
