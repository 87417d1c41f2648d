"""Import of historical order lines from CSV files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators.merge import KEY, merge_scd1, packed

# The only columns that may be read, and their roles.
ALLOWED = {
    "shopee": ["order_sn", "item_sku", "item_name", "create_time", "quantity", "order_status"],
    "tiktok": ["order_id", "seller_sku", "product_name", "created_time", "quantity", "order_status", "item_status"],
}
ROLES = {
    "shopee": {"order": "order_sn", "sku": "item_sku", "name": "item_name", "time": "create_time"},
    "tiktok": {"order": "order_id", "sku": "seller_sku", "name": "product_name", "time": "created_time"},
}


def read_allowed(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """Allow-listed columns, all as text, empty text kept; a byte-order mark in the header is ignored."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option(
        "emptyValue", "").csv(path)
    names = {c.lstrip("\ufeff").strip('"'): c for c in raw.columns}
    missing = [ROLES[platform][r] for r in ("order", "sku", "time") if ROLES[platform][r] not in names]
    missing += [c for c in ("quantity", "order_status") if c not in names]
    if missing:
        raise ValueError(f"{platform} CSV lacks required columns: {sorted(missing)}")
    return raw.select(*[F.col(f"`{names[c]}`").alias(c) for c in ALLOWED[platform] if c in names],
                      F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def numbered(raw: DataFrame) -> DataFrame:
    """Rows of ``read_allowed`` with ``_row``, their position among the data rows of their file from 0, whatever slices it was read in.

    Rows are counted per file slice; the slices before a row's own, and its place in its own, give its position. Only the counts, one for
    each slice, are shuffled and broadcast.
    """
    marked = raw.withColumn("_at", F.monotonically_increasing_id())
    slices = marked.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return marked.join(F.broadcast(starts), ["_file", "_block"]).withColumn("_row", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_first", "_before", "_block")


MARK = b"\xef\xbb\xbf"


def fingerprints(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """Dataset name per (uncompressed) file: platform and SHA-256 of its bytes.

    The lines of a file are streamed in order through one task, which holds a batch of them at a time, so a file may be of any size. Files
    that are read in one slice are hashed where they are read; only those of several slices are shuffled. What the line reader leaves out, a
    byte-order mark and the line break at the end, follows from the size of the file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("line"))
    sizes = lines.groupBy("_file").agg((F.max("_size") - F.sum(F.octet_length("line") + 1)).alias("_rest"), (F.min("_block") == F.max("_block")).alias("_whole"))
    sized = lines.join(F.broadcast(sizes), "_file")
    whole = sized.filter("_whole").select("_file", "_rest", "line")
    ordered = sized.filter("not _whole").repartition("_file").sortWithinPartitions("_file", "_block", "_at").select("_file", "_rest", "line")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rest, state, begun = None, 0, hashlib.sha256(), False

        def done() -> pa.RecordBatch:
            # Every line was followed by a line break, except perhaps the last one.
            if rest in (0, len(MARK)):
                state.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([state.hexdigest()])], ["_file", "sha256"])

        for batch in batches:
            for name, over, line in zip(*(batch.column(c).to_pylist() for c in ("_file", "_rest", "line"))):
                if name != file:
                    if begun:
                        yield done()
                    if over not in (-1, 0, len(MARK) - 1, len(MARK)):
                        raise ValueError(f"{name} is not a plain text file")
                    file, rest, state, begun = name, over, hashlib.sha256(MARK if over > 0 else b""), True
                else:
                    state.update(b"\n")
                state.update(line)
        if begun:
            yield done()

    hashed = [rows.mapInArrow(digest, "_file string, sha256 string") for rows in (whole, ordered)]
    return hashed[0].unionByName(hashed[1]).select("_file", F.concat(F.lit(f"{platform}:sha256:"), "sha256").alias("source_dataset"))


def imported(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """Normalised rows of CSV exports, identified by the content of their file and their row in it: importing a file again gives the same rows."""
    rows = numbered(read_allowed(spark, path, platform)).join(F.broadcast(fingerprints(spark, path, platform)), "_file")
    return normalise(rows, platform, F.concat(F.lit("row:"), F.col("_row").cast("string")), F.col("source_dataset"))


def normalise(raw: DataFrame, platform: str, record_id: Column, dataset: Column) -> DataFrame:
    """History rows with a validity flag; status and name are cut to their column lengths."""
    role = ROLES[platform]
    instant = S.to_instant(F.col(role["time"]))
    quantity = S.as_number(F.col("quantity"))
    sku = F.trim(role["sku"])
    status_source = F.coalesce("item_status", F.lit("")) if "item_status" in raw.columns else F.col("order_status")
    status = F.coalesce(S.blank_to_null(F.upper(F.trim(status_source))), F.lit("UNKNOWN"))
    name = F.coalesce(S.blank_to_null(F.trim(role["name"])), sku) if role["name"] in raw.columns else sku
    valid = instant.isNotNull() & (F.coalesce(sku, F.lit("")) != "") & F.coalesce(
        (quantity > 0) & (quantity <= V.MAX_QUANTITY) & (quantity % 1 == 0), F.lit(False))
    return raw.select(
        dataset.alias("source_dataset"), record_id.alias("source_record_id"), F.lit(V.HISTORY_ORIGIN).alias("data_origin"),
        S.blank_to_null(F.trim(role["order"])).alias("source_order_id"), F.lit(platform).alias("platform"), sku.alias("sku"),
        F.substring(name, 1, 500).alias("product_name"), F.substring(status, 1, 40).alias("order_status"),
        status.isin(*V.CANCELLED).alias("is_cancelled"), quantity.cast("int").alias("quantity"), S.business_time(instant).alias("create_time"), valid.alias("valid"))


def import_summary(rows: DataFrame) -> DataFrame:
    """One row per platform: counts, active range, and order ids seen on several dates."""
    active = F.col("valid") & ~F.col("is_cancelled")
    day = F.when(active, F.col("create_time").cast("date"))
    base = rows.groupBy("platform").agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if("valid").alias("valid_rows"), F.count_if(~F.col("valid")).alias("rejected_rows"),
        F.count_if(F.col("valid") & F.col("is_cancelled")).alias("cancelled_rows"),
        F.count_distinct(F.when(active, F.col("sku"))).alias("active_skus"), F.count_distinct(day).alias("active_days"),
        F.min(day).alias("active_start"), F.max(day).alias("active_end"))
    reused = rows.filter(active & F.col("source_order_id").isNotNull()).groupBy("platform", "source_order_id").agg(
        F.min(F.col("create_time").cast("date")).alias("lo"), F.max(F.col("create_time").cast("date")).alias("hi")).groupBy("platform").agg(
        F.count_if(F.col("lo") < F.col("hi")).alias("order_ids_reused_across_dates"))
    return base.join(reused, "platform", "left").fillna({"order_ids_reused_across_dates": 0})


RECORD = ["source_dataset", "platform", "source_record_id"]


def merge_history(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Valid rows of an import into the stored history; last write wins per (dataset, platform, record)."""
    # Copies of a record come from copies of its file, so none is hot; one shuffle by the packed key serves this and the merge.
    fresh = packed(incoming.filter("valid").drop("valid"), RECORD).repartition(KEY).dropDuplicates([KEY])
    return merge_scd1(stored, fresh, RECORD, [c for c in stored.columns if c not in RECORD])
