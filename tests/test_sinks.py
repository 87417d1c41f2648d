"""Tables that are merged part by part: what a batch rewrites, and what a stop at any point leaves."""

import datetime as dt
import itertools
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from marketloom.operators import merge as M
from marketloom.operators import monitor
from marketloom.sources.warehouse import PartedTable
from marketloom.streaming import jobs

DAY0 = dt.date(2026, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def snapshots(spark, rows):
    """(sku, day, hour, stock)"""
    full = [(s, day(d), dt.datetime(2026, 1, 1) + dt.timedelta(days=d, hours=h), k) for s, d, h, k in rows]
    return spark.createDataFrame(full, jobs.SNAPSHOT_SCHEMA)


def newest(stored, new):
    return M.merge_snapshots(stored, new, ["sku", "snapshot_date"])


def content(table):
    return sorted((r.sku, (r.snapshot_date - DAY0).days, r.snapshot_at.hour, r.stock_on_hand) for r in table.read().collect())


def files(root):
    return {p: sorted((f, os.stat(f"{root}/{p}/{f}").st_mtime_ns) for f in os.listdir(f"{root}/{p}")) for p in os.listdir(root)}


def test_a_batch_rewrites_its_days_only(spark, tmp_path):
    table = jobs.snapshot_table(spark, f"{tmp_path}/t")
    table.merge(snapshots(spark, [(s, d, 1, d) for d in range(100) for s in "AB"]), newest)
    before = files(table.root)
    assert len(before) == 100
    table.merge(snapshots(spark, [("A", 7, 2, 70), ("C", 7, 0, 71), ("A", 50, 0, 72)]), newest)
    after = files(table.root)
    assert {p for p in after if before.get(p) != after[p]} == {"_part=2026-01-08", "_part=2026-02-20"}
    rows = content(table)
    assert len(rows) == 201 and ("A", 7, 2, 70) in rows and ("C", 7, 0, 71) in rows and ("A", 50, 1, 50) in rows and ("B", 7, 1, 7) in rows


def test_batch_reads_its_days_only(spark, tmp_path):
    table = jobs.snapshot_table(spark, f"{tmp_path}/t")
    table.merge(snapshots(spark, [("A", d, 1, d) for d in range(20)]), newest)
    seen = []

    def look(stored, new):
        seen.append((stored.count(), stored._jdf.queryExecution().executedPlan().toString()))
        return newest(stored, new)

    table.merge(snapshots(spark, [("A", 3, 5, 1)]), look)
    assert seen[0][0] == 1 and "PartitionFilters: [isnotnull(_part" in seen[0][1]


BATCHES = [[("A", 0, 5, 1), ("B", 1, 3, 2)], [("A", 0, 3, 9), ("C", 0, 1, 3), ("B", 2, 1, 4)], [("A", 0, 7, 5), ("B", 1, 1, 9), ("D", 3, 0, 6)], [("B", 2, 0, 9), ("A", 3, 2, 7)]]
WHOLE = [("A", 0, 7, 5), ("A", 3, 2, 7), ("B", 1, 3, 2), ("B", 2, 1, 4), ("C", 0, 1, 3), ("D", 3, 0, 6)]


def test_any_order_of_batches_gives_the_same_table(spark, tmp_path):
    for k, order in enumerate(itertools.islice(itertools.permutations(range(4)), 0, 24, 7)):
        table = jobs.snapshot_table(spark, f"{tmp_path}/{k}")
        for i in order:
            table.merge(snapshots(spark, BATCHES[i]), newest)
        assert content(table) == WHOLE


@pytest.mark.parametrize("where, call", [("_mark", 1), ("_replace", 1), ("_replace", 2), ("_note", 1), ("_note", 3), ("_replace", 4)])
def test_stop_at_any_point_and_replay(spark, tmp_path, monkeypatch, where, call):
    """The writer dies before the named step; a new one repeats the batch that was not committed."""
    calls = itertools.count(1)
    whole = getattr(PartedTable, where)

    def dies(self, *args):
        if next(calls) == call:
            raise KeyboardInterrupt
        return whole(self, *args)

    monkeypatch.setattr(PartedTable, where, dies)
    stops = 0
    for k, rows in enumerate(BATCHES):
        while True:
            try:
                jobs.snapshot_table(spark, f"{tmp_path}/t").merge(snapshots(spark, rows), newest, ("s", k))
                break
            except KeyboardInterrupt:
                stops += 1
    table = jobs.snapshot_table(spark, f"{tmp_path}/t")
    assert stops == 1 and content(table) == WHOLE and table.last_applied("s") == 3 and not os.path.exists(table.staged)


def test_applied_batches_are_left_out(spark, tmp_path):
    table, merged = jobs.snapshot_table(spark, f"{tmp_path}/t"), []

    def count(stored, new):
        merged.append(1)
        return newest(stored, new)

    for stream, number in [("s", 0), ("s", 1), ("s", 1), ("s", 0), ("other", 0)]:
        table.merge(snapshots(spark, BATCHES[0]), count, (stream, number))
    assert len(merged) == 3 and (table.last_applied("s"), table.last_applied("other"), table.last_applied("none")) == (1, 0, -1)
    assert sorted(f for f in os.listdir(table.ledger) if not f.startswith(".")) == ["other=0", "s=1"]


def test_a_line_keeps_its_day(spark, tmp_path):
    """A later version that names another creation day updates the stored line where it lies."""
    names = jobs.FACT_SCHEMA.fieldNames()

    def lines(rows):
        full = [{**dict.fromkeys(names), "order_id": o, "platform": "p", "source_line_id": "l", "quantity": q, "create_time": t, "source_updated_at": v} for o, q, t, v in rows]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], jobs.FACT_SCHEMA)

    at = lambda d: dt.datetime(2026, 1, d)
    table = jobs.fact_table(spark, f"{tmp_path}/t")
    table.merge(lines([("1", 1.0, at(1), at(1)), ("2", 1.0, at(2), at(2)), ("3", 1.0, None, at(2))]), M.merge_fact)
    table.merge(lines([("1", 5.0, at(4), at(5)), ("3", 7.0, at(9), at(9)), ("4", 2.0, at(4), at(4))]), M.merge_fact)
    assert sorted((r.order_id, r.quantity, r.create_time and r.create_time.day) for r in table.read().collect()) == [("1", 5.0, 1), ("2", 1.0, 2), ("3", 7.0, None), ("4", 2.0, 4)]
    assert sorted(os.listdir(table.root)) == ["_part=2026-01-01", "_part=2026-01-02", "_part=2026-01-04", "_part=none"]


def test_empty_batches(spark, tmp_path):
    table = jobs.snapshot_table(spark, f"{tmp_path}/t")
    assert table.read().count() == 0
    table.merge(snapshots(spark, []), newest, ("s", 0))
    assert table.read().count() == 0 and table.last_applied("s") == 0


# ---- streams ----------------------------------------------------------------------------

def drive(spark, tmp_path, frames, start, stop=None):
    """Appends each frame to a folder and runs the stream over it; returns the progress of all runs."""
    folder, progress = f"{tmp_path}/in", []
    for k, frame in enumerate(frames):
        frame.write.mode("append").parquet(folder)
        if k == stop:
            with pytest.raises(StreamingQueryException):
                start(spark.readStream.schema(frame.schema).parquet(folder), lambda _: 1 / 0).awaitTermination()
        query = start(spark.readStream.schema(frame.schema).parquet(folder), None)
        query.awaitTermination()
        progress += query.recentProgress
    return progress


def hours(spark, rows):
    return spark.createDataFrame([(dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), g) for h, g in rows], "ts timestamp, g string")


def test_windows_close_and_their_state_goes(spark, tmp_path):
    frames = [hours(spark, [(10 * k + (7 * i) % 13, "ab"[i % 2]) for i in range(40)]) for k in range(8)]
    table = jobs.window_table(spark, f"{tmp_path}/t", "g", "string", n="long", total="long")
    counted = lambda s: jobs.windowed_counts(s.withWatermark("ts", "4 hours"), "ts", "g", F.lit(1).cast("long"))
    progress = drive(spark, tmp_path, frames, lambda s, after: jobs.store_closed(counted(s), table, f"{tmp_path}/cp", True, after), stop=3)
    rows = [(10 * k + (7 * i) % 13, "ab"[i % 2]) for k in range(8) for i in range(40)]
    # The watermark stands four hours before the latest event; windows that end by then are closed.
    expected = {}
    for h, g in rows:
        if h + 1 <= 82 - 4:
            expected[(h, g)] = expected.get((h, g), 0) + 1
    got = {(int((r.window_start - dt.datetime(2026, 1, 1)).total_seconds() // 3600), r.g): r.n for r in table.read().collect()}
    assert got == expected
    kept = [o["numRowsTotal"] for p in progress for o in map(lambda o: o.asDict() if hasattr(o, "asDict") else {"numRowsTotal": o.numRowsTotal}, p.stateOperators)]
    assert max(kept) <= 2 * 18 and kept[-1] <= 2 * 5 and all(o.numRowsDroppedByWatermark == 0 for p in progress for o in p.stateOperators)


def test_streamed_ratio_equals_the_batch(spark, tmp_path):
    frames = [hours(spark, [(10 * k + (7 * i) % 13, "error" if i % 9 == k else "ok") for i in range(30)]) for k in range(4)] + [hours(spark, [(2000, "ok")])]
    table = PartedTable(spark, f"{tmp_path}/t", ["window_start"], jobs.RATIO_SCHEMA, "cast(window_start as date)")
    ratio = lambda s: monitor.window_ratio(s, "ts", F.col("g") == "error", "6 hours", "1 hour")
    drive(spark, tmp_path, frames, lambda s, after: jobs.store_closed(ratio(s.withWatermark("ts", "4 hours")), table, f"{tmp_path}/cp", True, after), stop=2)
    whole = frames[0].union(frames[1]).union(frames[2]).union(frames[3])
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, ratio(whole).collect()))


def test_balances_after_a_stop(spark, tmp_path):
    frames = [spark.createDataFrame([(s, k + i) for i, s in enumerate("ABCA")], "sku string, delta long") for k in range(3)]
    table = jobs.balance_table(spark, f"{tmp_path}/t", 4)
    drive(spark, tmp_path, frames, lambda s, after: jobs.store_balances(jobs.stock_state(s.withColumn("n", F.lit(1).cast("long"))), table, f"{tmp_path}/cp", after=after), stop=1)
    assert sorted(map(tuple, table.read().collect())) == [("A", 15, 6), ("B", 6, 3), ("C", 9, 3)]
