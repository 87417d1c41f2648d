"""Bounded plans, mart publication, confirmations, file imports and closed-form models."""

import datetime as dt
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import demand as D
from marketloom.operators import drift as DR
from marketloom.operators import features as X
from marketloom.operators import forecast as P
from marketloom.operators import inventory as I
from marketloom.operators import latest as L
from marketloom.operators import merge as M
from marketloom.operators import models
from marketloom.plans import marts
from marketloom.sources import history as H
from marketloom.sources import warehouse as W

DAY0 = dt.date(2026, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- dedupe -----------------------------------------------------------------------------

def test_dedupe_combines_before_the_shuffle(spark, tmp_path):
    rows = [("1", "p", "id:1", v, v % 3) for v in range(50)] + [("2", "p", "id:1", None, 1), ("2", "p", "id:1", None, 1)] + [(None, "p", "id:1", 1, 1)] * 3 + [(None, "p", "id:1", 2, 1)]
    spark.createDataFrame(rows, "order_id string, platform string, source_line_id string, source_updated_at int, quantity int").write.parquet(f"{tmp_path}/lines")
    out = L.deduplicate_lines(spark.read.parquet(f"{tmp_path}/lines"))
    assert "partial_max_by" in plan(out) and plan(out).count("FileScan") == 1
    got = sorted((r.order_id or "", r.source_updated_at or 0, r.quantity) for r in out.collect())
    assert got == [("", 1, 1), ("", 1, 1), ("", 1, 1), ("", 2, 1), ("1", 49, 1), ("2", 0, 1)]


# ---- as-of histories --------------------------------------------------------------------

def test_a_request_meets_two_stretches_of_its_series(spark):
    daily = spark.createDataFrame([(s, day(i), float(i)) for s in "AB" for i in range(0, 900, 2)], "sku string, date date, daily_demand double")
    ends = [0, 1, 118, 119, 120, 121, 500, 899, 1500, -5]
    asked = spark.createDataFrame([(k, s, day(e)) for k, e in enumerate(ends) for s in "ABZ"], "request_id int, sku string, history_end date")
    out = P.history_as_of(asked, daily)
    for r in out.collect():
        expected = [] if r.sku == "Z" else [float(i) for i in range(0, 900, 2) if ends[r.request_id] - 120 < i <= ends[r.request_id]]
        assert [x.daily_demand for x in r.history] == expected
    # Rows of the series are packed before any request meets them, 120 days at most in one row.
    packed = daily.groupBy("sku", F.floor(F.unix_date("date") / 120)).count().agg(F.max("count")).first()[0]
    assert packed <= 120 and out.count() == asked.count() and "Generate" not in plan(out)


# ---- recent days ------------------------------------------------------------------------

def lines(spark, rows):
    """(sku, day, quantity, price, order)"""
    full = [(s, dt.datetime(2026, 1, 1) + dt.timedelta(days=d), q, p, str(o), "shopee", False) for s, d, q, p, o in rows]
    return spark.createDataFrame(full, "sku string, create_time timestamp_ntz, quantity int, original_price double, order_id string, platform string, is_cancelled boolean") \
        .withColumns({"buyer_total_amount": F.col("quantity").cast("decimal(14,2)"), "seller_discount": F.lit(1).cast("decimal(14,2)")})


SALES = [("A", d, 1 + d % 4, 10.0 + d, d) for d in range(0, 130, 3)] + [("OLD", 5, 2, 7.0, 1), ("OLD", 9, 1, None, 2), ("NEW", 125, 4, 3.0, 3), ("NEW", 125, 2, 5.0, 3), ("EDGE", 66, 1, 2.0, 4)]


@pytest.mark.parametrize("days", [1, 30, 64, 500])
def test_recent_days_equal_the_end_of_the_whole_series(spark, days):
    rows = lines(spark, SALES)
    whole = X.daily_history(rows)
    last = max(d for _, d, *_ in SALES)
    columns = ["sku", "date", "daily_demand", "daily_revenue", "avg_unit_price", "total_discount", "order_count"]
    expected = whole.filter(F.col("date") > F.lit(day(last - days))).select(*columns)
    got = D.recent_dense(rows, days).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_recent_features_read_their_days_only(spark):
    rows = lines(spark, SALES)
    got = X.recent_features(rows, DR.DAYS)
    whole = X.window_features(X.daily_history(rows)).dropna(subset=["lag_28", X.TARGET])
    last = whole.agg(F.max("date")).first()[0]
    expected = whole.filter(F.col("date") > F.lit(last - dt.timedelta(days=DR.DAYS)))
    columns = ["sku", "date", *DR.MONITORED]
    pick = lambda df: sorted((r.sku, r.date, *[round(float(r[c]), 9) for c in DR.MONITORED]) for r in df.select(*columns).collect())
    assert pick(got) == pick(expected) and len(pick(got)) == 4 * DR.DAYS
    assert D.recent_dense(rows, DR.DAYS + 29).select("date").distinct().count() == 64


def test_recent_demand_from_sold_days(spark):
    rows = lines(spark, SALES)
    whole = X.daily_history(rows)
    last = whole.agg(F.max("date")).first()[0]
    for r in I.recent_demand(rows).collect():
        values = [x.daily_demand for x in whole.filter((F.col("sku") == r.sku) & (F.col("date") > F.lit(last - dt.timedelta(days=28)))).orderBy("date").collect()]
        assert abs(r.hist_mean - np.mean(values)) < 1e-9 and abs(r.hist_std - np.std(values, ddof=1)) < 1e-9
        week = values[-8:-1]
        assert (r.forecast_mean is None) == (sum(week) == 0) and (r.forecast_mean is None or abs(r.forecast_mean - np.mean(week)) < 1e-9)


def test_drift_refuses_an_empty_window(spark):
    few = spark.createDataFrame([("A", day(i), 1.0) for i in range(5)], "sku string, date date, daily_demand double")
    with pytest.raises(ValueError, match="current window only"):
        DR.require_windows(DR.windows(few))


# ---- marts ------------------------------------------------------------------------------

def mart(spark, n):
    return spark.range(n).withColumn("name", F.lit("x")), ["id", "name"]


def stored(spark, root):
    return {n: spark.read.option("header", True).csv(f"{root}/{n}").count() for n in ("orders", "history") if os.path.exists(f"{root}/{n}")}


def test_marts_appear_together_or_not_at_all(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/marts"
    W.publish_marts({"orders": mart(spark, 3), "history": mart(spark, 0)}, root, ("orders", "history"))
    assert stored(spark, root) == {"orders": 3, "history": 0}
    broken = (spark.range(5).withColumn("name", F.raise_error(F.lit("no")).cast("string")), ["id", "name"])
    with pytest.raises(Exception, match="no"):
        W.publish_marts({"orders": mart(spark, 9), "history": broken}, root)
    with pytest.raises(W.NoSales):
        W.publish_marts({"orders": mart(spark, 0), "history": mart(spark, 0)}, root, ("orders", "history"))
    assert stored(spark, root) == {"orders": 3, "history": 0}
    # A stop between the two moves: the old marts come back, or the next publication mends it.
    move, calls = W.Files.move, []

    def stops(self, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise KeyboardInterrupt
        move(self, source, target)

    monkeypatch.setattr(W.Files, "move", stops)
    with pytest.raises(KeyboardInterrupt):
        W.publish_marts({"orders": mart(spark, 7), "history": mart(spark, 1)}, root)
    assert stored(spark, root) == {}
    W.restore_marts(spark, root)
    assert stored(spark, root) == {"orders": 3, "history": 0}
    W.publish_marts({"orders": mart(spark, 7), "history": mart(spark, 1)}, root)
    assert stored(spark, root) == {"orders": 7, "history": 1} and sorted(os.listdir(tmp_path)) == ["marts"]


def test_confirmations(spark, tmp_path):
    rows = [("warehouse_live", "", day(1)), ("warehouse_live", "", day(1)), ("warehouse_live", "", day(9)), ("warehouse_live", "ds", day(1)), ("public_anonymized_historical_csv", "ds", day(2)),
            ("public_anonymized_historical_csv", "other", day(2)), ("public_anonymized_historical_csv", "", day(2)), ("elsewhere", "", day(1)), (None, None, None)]
    asked = spark.createDataFrame(rows, "data_origin string, source_dataset string, full_date date")
    known = spark.createDataFrame([("public_anonymized_historical_csv", "ds")], "data_origin string, source_dataset string")
    today = F.lit(day(9))
    reasons = sorted(r.reason for r in marts.judged_confirmations(asked, known, today).collect())
    assert reasons == ["", "", "", "DATASET_MISSING", "DATASET_UNKNOWN", "DAY_NOT_OVER", "DAY_NOT_OVER", "ORIGIN_NOT_SUPPORTED", "ORIGIN_NOT_SUPPORTED"]
    table = W.confirmation_table(spark, f"{tmp_path}/c")
    for hour in (1, 2):
        W.confirm(table, marts.confirm_coverage(asked, known, today), F.lit(dt.datetime(2026, 2, 1, hour)))
    assert sorted((r.data_origin, r.full_date, r.confirmed_at.hour) for r in table.read().collect()) == [
        ("public_anonymized_historical_csv", day(2), 2), ("warehouse_live", day(1), 2)]


def test_for_all_coverage_and_observed_demand(spark):
    f = spark.createDataFrame([(1, "S", day(1), "warehouse_live", []), (2, "S", day(1), "public_anonymized_historical_csv", ["a", "b", "a"]), (3, "S", day(2), "public_anonymized_historical_csv", ["a"]),
                               (4, "S", day(1), "public_anonymized_historical_csv", ["a", "c"]), (5, "T", day(1), "other", ["a"]), (6, "T", day(1), "warehouse_live", []), (7, "S", day(30), "warehouse_live", [])],
                              "forecast_id int, sku string, target_date date, data_origin string, source_datasets array<string>")
    h = "public_anonymized_historical_csv"
    coverage = spark.createDataFrame([("warehouse_live", "", day(1)), ("warehouse_live", "", day(30)), (h, "a", day(1)), (h, "b", day(1)), (h, "b", day(2)), (h, "a", day(1))], "data_origin string, source_dataset string, full_date date")
    done = {r.forecast_id: r.actual_complete for r in marts.coverage_complete(f, coverage, F.lit(day(20))).collect()}
    assert done == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}
    live = spark.createDataFrame([("S", day(1), 5), ("S", day(1), 2), ("S", day(2), 1)], "sku string, order_date date, quantity int")
    past = spark.createDataFrame([("S", day(1), h, "a", 10), ("S", day(1), h, "a", 1), ("S", day(1), h, "b", 100), ("S", day(1), h, "z", 7), ("S", day(1), "else", "a", 9)],
                                 "sku string, order_date date, data_origin string, source_dataset string, quantity int")
    seen = {r.forecast_id: r.observed_demand for r in marts.observed_demand(f, live, past).collect()}
    assert seen == {1: 7.0, 2: 111.0, 3: None, 4: 11.0, 5: None, 6: None, 7: None}


# ---- history files ----------------------------------------------------------------------

HEAD = "order_sn,item_sku,item_name,create_time,quantity,order_status"


@pytest.mark.parametrize("text", [f"{HEAD}\n1,A,n,2026-01-01T00:00:00Z,2,COMPLETED\n", f"{HEAD}\r\n1,A,n,2026-01-01T00:00:00Z,2,DONE\r\n", f"﻿{HEAD}\n1,Ä,n,2026-01-01T00:00:00Z,2,X",
                                  f"{HEAD}\n\n1,A,n,2026-01-01T00:00:00Z,2,X\n\n", HEAD, "﻿" + HEAD + "\n"])
def test_digest_is_that_of_the_bytes(spark, tmp_path, text):
    (tmp_path / "f.csv").write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes(b"another\nfile")
    got = {os.path.basename(r._file): r.source_dataset for r in H.fingerprints(spark, str(tmp_path), "shopee").collect()}
    assert got == {n: f"shopee:sha256:{hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()}" for n in ("f.csv", "g.csv")}


def test_rows_of_many_slices_are_numbered(spark, tmp_path):
    for name, n in (("a.csv", 3000), ("b.csv", 500)):
        (tmp_path / name).write_text(HEAD + "\n" + "".join(f"{i},S{i % 7},n,2026-01-01T00:00:00Z,{1 + i % 5},COMPLETED\n" for i in range(n)))
    whole = hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    told = []
    try:
        for size in ("9k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = H.imported(spark, str(tmp_path), "shopee")
            told.append(sorted((r.source_dataset, int(r.source_record_id[4:]), r.source_order_id) for r in rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert told[0] == told[1] and all(str(n) == order for _, n, order in told[0]) and len(told[0]) == 3500
    assert {d for d, _, _ in told[0]} >= {f"shopee:sha256:{whole}"}
    stored = M.merge_scd1  # the loader that history uses
    assert stored is H.merge_scd1
    rows = H.imported(spark, str(tmp_path), "shopee")
    once = spark.createDataFrame(H.merge_history(rows.drop("valid").limit(0), rows).collect(), rows.drop("valid").schema)
    assert H.merge_history(once, rows).count() == once.count() == 3500


# ---- closed-form ridge ------------------------------------------------------------------

def test_sums_give_the_usual_ridge(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + r.normal(size=300)
    part = r.integers(0, 3, 300)
    rows = spark.createDataFrame([(int(p), *map(float, v), float(t)) for p, v, t in zip(part, x, y)], "g int, a double, b double, c double, d double, target_t_plus_1 double").repartition(5)
    sums = models.gram_sums(rows, list("abcd"), F.nullif(F.col("g"), F.lit(0)))
    assert set(sums) == {1, 2}
    for alpha in (0.0, 1.0, 50.0):
        keep = part > 0
        base, weights = models.ridge_weights(sums[1] + sums[2], alpha)
        xc, yc = x[keep] - x[keep].mean(0), y[keep] - y[keep].mean()
        expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
        assert np.allclose(weights, expected) and np.isclose(base, y[keep].mean() - x[keep].mean(0) @ expected)


def test_lake_rows_are_moved_as_one_text(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from marketloom.sources import lake

    rows = [(1, "a", None, ""), (2, None, None, None), (3, "", "", ""), (4, "x\u0001y", "\u0000", None), (5, "\u0001", None, "é\u0000"), (6, 'q",\\ ', "\n", "漢😀"), (6, 'q",\\ ', "\n", "漢😀")]
    df = spark.createDataFrame(rows, "n long, a string, `b.c` string, d string").withColumns(
        {"platform": F.lit("shopee"), "year": F.lit("2024"), "month": F.lit("02"), "day": F.concat(F.lit("0"), (F.col("n") % 3).cast("string"))})
    lake.write_lake(df, f"{tmp_path}/lake")
    back = lake.scan(spark, f"{tmp_path}/lake", lake.stored_schema(df.schema))
    assert sorted((tuple(r) for r in back.select("n", "a", "`b.c`", "d").collect()), key=str) == sorted(rows, key=str)
    # Only the partition columns, the numbers and one text are shuffled, besides rows that hold a mark.
    texts = [f.name for f in df.schema.fields if f.dataType == T.StringType() and f.name not in lake.PARTITIONS]
    moved = lake.packed(df, texts)
    assert moved.columns == ["n", *lake.PARTITIONS, "_packed", "_apart"] and moved.where("_apart is null").count() == 5
