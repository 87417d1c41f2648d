"""Streaming entry points: bronze lake, incremental warehouse load, snapshots, windows, stock state.

Delivery is at least once and every sink is idempotent: bronze files are committed with the checkpoint, warehouse tables are merged by
version and keep a ledger of the batches of each stream that they hold, so a replayed batch changes nothing. Late rows of orders and
snapshots need no watermark, because they go to the partition of their own event date and merge by version; windows are closed by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketloom.functions import scalars as S
from marketloom.operators import latest as L
from marketloom.operators import merge as M
from marketloom.operators import rules, unify
from marketloom.session import few_listings, release
from marketloom.sources import lake, quarantine
from marketloom.sources.warehouse import PartedTable

ORDERS_TOPIC, INVENTORY_TOPIC = "ecom.orders.raw", "inventory.logs"
FLUSH_ROWS, FLUSH_AFTER, LOOK_EVERY = 500, "60s", "1 second"


# ---- sources and sinks ------------------------------------------------------------------

def topic_options(servers: str, topic: str, flush_rows: int = FLUSH_ROWS, flush_after: str = FLUSH_AFTER, most: int | None = None) -> dict[str, str]:
    """A batch begins once ``flush_rows`` messages wait or the oldest has waited ``flush_after``; it takes all that wait, or ``most``."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "minOffsetsPerTrigger": str(flush_rows),
               "maxTriggerDelay": flush_after}
    return options | ({"maxOffsetsPerTrigger": str(most)} if most else {})


def read_topic(spark: SparkSession, servers: str, topic: str, **flush) -> DataFrame:
    """Kafka topic from the earliest offset; offsets live in the query's checkpoint."""
    return (spark.readStream.format("kafka").options(**topic_options(servers, topic, **flush)).load()
            .select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("received_at")))


def read_messages(spark: SparkSession, path: str, max_files: int = 100, spent: str = "off") -> DataFrame:
    """The same messages from text files, a bounded number of files per batch. With ``spent`` as ``delete``, files go once their batch is committed."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).option("cleanSource", spent)
    return reader.text(path).withColumn("received_at", F.current_timestamp())


def keyed_messages(df: DataFrame) -> DataFrame:
    """Key and JSON value of an event; the key keeps all messages of an order or SKU in one partition."""
    names = [c for c in ("order_sn", "order_id", "item_sku", "seller_sku", "sku") if c in df.columns]
    return df.select(F.coalesce(S.message_key(*[F.col(c) for c in names]), F.lit(None)).alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return (keyed_messages(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("kafka.acks", "all").option("checkpointLocation", checkpoint).start())


def drain(query: StreamingQuery) -> None:
    """Wait for a bounded run; errors of the query are raised here. Shuffle files of a finished batch are let go while the next one runs."""
    seen = -1
    while not query.awaitTermination(5):
        last = query.lastProgress
        if last is not None and last["batchId"] > seen:
            seen = last["batchId"]
            release(SparkSession.active())


def _start(writer, once: bool, interval: str = LOOK_EVERY) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


# ---- bronze -----------------------------------------------------------------------------

def bronze(messages: DataFrame, schema: T.StructType, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Decoded messages to the lake by platform and event date; unreadable text is kept as a row."""
    # An event without a readable time belongs to the day it was received, also when its batch is delayed or repeated.
    placing = T.StructType([f for f in schema.fields if f.name in ("_platform", "create_time", "created_time")])
    placed = lake.with_partitions(lake.decode(messages, placing), F.col("received_at"))
    # One task per event day, not one file per task and day. Only the text goes there; it is decoded in full behind the shuffle.
    dealt = placed.select(F.col("_raw_payload_json").alias("value"), F.col("_ingest_error").alias("mark"), "_source_platform", *lake.PARTITIONS).hint("rebalance", *lake.PARTITIONS)
    rows = lake.decode(dealt, schema, keep=("_source_platform", *lake.PARTITIONS), mark="mark")
    # The text is stored beside its columns, so it is worth a stronger compression.
    writer = rows.writeStream.format("parquet").option("compression", "zstd").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*lake.PARTITIONS)
    return _start(writer, once)


def routes(messages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Raw messages to one folder per route and ingest date, failures to the quarantine route."""
    rows = lake.routed(messages).withColumn("ingest_date", S.business_date(F.current_timestamp()))
    writer = rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("route", "ingest_date")
    return _start(writer, once)


# ---- incremental warehouse load ---------------------------------------------------------

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
          "date": T.DateType(), "timestamp": T.TimestampType(),
          "timestamp_ntz": T.TimestampNTZType()}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


FACT_SCHEMA = _schema(
    order_id="string", platform="string", source_line_id="string", sku="string", date_key="int", order_status="string", is_cancelled="boolean",
    cancel_reason="string", quantity="double", original_price="double", subtotal="double", buyer_total_amount="double", create_time="timestamp_ntz",
    pay_time="timestamp_ntz", shipped_time="timestamp_ntz", completed_time="timestamp_ntz", cancel_time="timestamp_ntz", source_updated_at="timestamp_ntz")
SNAPSHOT_SCHEMA = _schema(sku="string", snapshot_date="date", snapshot_at="timestamp_ntz", stock_on_hand="int")
RATIO_SCHEMA = _schema(window_start="timestamp", n="long", hits="long", share="double", alert="boolean")
BALANCE_SCHEMA = _schema(sku="string", balance="long", movements="long")


def fact_table(spark: SparkSession, root: str, part: str = "cast(create_time as date)") -> PartedTable:
    """Order lines by the business day of their order (or a longer ``part``). A line keeps its first creation time, whatever day a later version names."""
    return PartedTable(spark, root, M.FACT_KEY, FACT_SCHEMA, part, moving=True)


def snapshot_table(spark: SparkSession, root: str) -> PartedTable:
    return PartedTable(spark, root, ["sku", "snapshot_date"], SNAPSHOT_SCHEMA, "snapshot_date")


def balance_table(spark: SparkSession, root: str, parts: int = 64) -> PartedTable:
    """One row for each SKU, which belongs to no day."""
    return PartedTable(spark, root, ["sku"], BALANCE_SCHEMA, f"pmod(xxhash64(sku), {parts})")


def window_table(spark: SparkSession, root: str, key: str, kind: str, start: str = "window_start", **values: str) -> PartedTable:
    """Closed windows of a key by the day on which they begin."""
    return PartedTable(spark, root, [start, key], _schema(**{start: "timestamp", key: kind}, **values), f"cast({start} as date)")


Apply = Callable[[DataFrame, "tuple[str, int]"], None]


def each_batch(frame: DataFrame, apply: Apply, checkpoint: str, mode: str = "append", once: bool = False, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Runs ``apply(batch, (stream, number))`` for every micro-batch. The stream is the identity that its checkpoint holds, so numbers of another
    checkpoint are never taken for its own. ``after`` is called between the write and the commit of a batch (a drill may stop there)."""
    known: list[str] = []

    def step(batch: DataFrame, number: int) -> None:
        if not known:
            known.append(batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"])
        apply(batch, (known[0], number))
        if after is not None:
            after(number)

    return _start(frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(step), once)


def load_batch(batch: DataFrame, number: tuple[str, int], fact: PartedTable, quarantine_path: str) -> None:
    """Unify, validate, store the rejects, then deduplicate and merge the accepted lines.

    Rejects are written before the merge, so a reject can never be lost by a failing merge; the
    folder is named by the stream and the batch, and a repeated batch replaces it. A batch that the fact holds has stored its rejects
    before, so its repetition does nothing.
    """
    if number[1] <= fact.last_applied(number[0]):
        return
    rows = unify.normalise(unify.unify(batch))
    told = ["order_id", "platform", "sku", "source_line_id", "original_price", "source_object", "source_row"]
    needed = dict.fromkeys([*told, *[c for c in FACT_SCHEMA.fieldNames() if c != "date_key"]])
    # Kept between the two writes: what they need, and the payload of rejects only.
    checked = rules.with_errors(rows, rules.order_line_rules(rows)).select(
        *needed, "errors", F.when(F.col("errors") != "", F.col("raw_payload")).alias("raw_payload")).persist()
    try:
        accepted, rejected = rules.split(checked)
        quarantine.write(rejected.select(*told, "rejection_reasons", "raw_payload"), quarantine_path, f"{number[0]}-{number[1]}")
        lines = L.deduplicate_lines(accepted).withColumn("date_key", F.date_format("create_time", "yyyyMMdd").cast("int"))
        _merge_once(lines.select(*FACT_SCHEMA.fieldNames()), fact, M.merge_fact, number)
    finally:
        checked.unpersist()


def incremental_load(bronze_rows: DataFrame, fact: PartedTable, quarantine_path: str, checkpoint: str, once: bool = False, after=None) -> StreamingQuery:
    few_listings(bronze_rows.sparkSession)
    return each_batch(bronze_rows, lambda batch, number: load_batch(batch, number, fact, quarantine_path), checkpoint, once=once, after=after)


# ---- inventory snapshots ----------------------------------------------------------------

def snapshot_batch(batch: DataFrame, number: tuple[str, int], table: PartedTable, quarantine_path: str) -> None:
    """Reject malformed snapshots one by one, keep the newest per SKU and business day."""
    checked = rules.with_errors(batch, rules.snapshot_rules(batch)).persist()
    try:
        accepted, rejected = rules.split(checked)
        quarantine.write(rejected, quarantine_path, f"{number[0]}-{number[1]}")
        at = S.business_time(S.to_instant(F.col("loaded_at")))
        rows = accepted.select("sku", at.cast("date").alias("snapshot_date"), at.alias("snapshot_at"), S.as_number(F.col("stock_on_hand")).cast("int").alias("stock_on_hand"))
        _merge_once(rows, table, lambda stored, new: M.merge_snapshots(stored, new, table.keys), number)
    finally:
        checked.unpersist()


def snapshot_upsert(snapshots: DataFrame, table: PartedTable, quarantine_path: str, checkpoint: str, once: bool = False, after=None) -> StreamingQuery:
    return each_batch(snapshots, lambda batch, number: snapshot_batch(batch, number, table, quarantine_path), checkpoint, once=once, after=after)


# ---- windows and state ------------------------------------------------------------------

def windowed_counts(events: DataFrame, ts: str, group: str, value: Column, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; a stream needs a watermark on its input."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(window.alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("window_start"), group, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of activity per key, closed after a gap; a stream needs a watermark on its input."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def unique_lines(events: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Drop repeated deliveries of a line within the watermark; bounds the state, not the correctness."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def store_closed(windows: DataFrame, table: PartedTable, checkpoint: str, once: bool = False, after=None) -> StreamingQuery:
    """Windows go to the table once the watermark has passed their end, and their state goes; a window that is there already stays."""
    return each_batch(windows, lambda batch, number: _merge_once(batch, table, lambda stored, new: M.insert_missing(stored, new, table.keys), number),
                      checkpoint, once=once, after=after)


def stock_state(deltas: DataFrame) -> DataFrame:
    """Current stock per SKU (balance, movements), emitted for the SKUs of each batch; movements are summed before they are shuffled.

    ``deltas``: sku, delta, n.
    """
    return deltas.groupBy("sku").agg(F.sum("delta").cast("long").alias("balance"), F.sum("n").cast("long").alias("movements"))


def store_balances(df: DataFrame, table: PartedTable, checkpoint: str, once: bool = True, after=None) -> StreamingQuery:
    return each_batch(df, lambda batch, number: _merge_once(batch, table, lambda stored, new: M.merge_versioned(stored, new, ["sku"], "movements"), number),
                      checkpoint, "update", once, after)


def _merge_once(batch: DataFrame, table: PartedTable, merge, number: tuple[str, int]) -> None:
    """A stateful batch is computed once, although the merge reads it for its days and for its rows."""
    if number[1] <= table.last_applied(number[0]):
        # The table has it, but the state that the stream keeps has to be brought to the same point.
        batch.write.format("noop").mode("overwrite").save()
        return
    kept = batch.persist()
    try:
        table.merge(kept, merge, number)
    finally:
        kept.unpersist()
