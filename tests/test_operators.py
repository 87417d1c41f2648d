"""Small examples with hand-computed results, and invariants."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators import demand as D
from marketloom.operators import drift as DR
from marketloom.operators import features as X
from marketloom.operators import forecast as P
from marketloom.operators import latest as L
from marketloom.operators import merge as M
from marketloom.operators import models, rules, unify
from marketloom.operators.prefix import exact_quantiles, number_rows, running_total
from marketloom.sources import lake

BASE = {"_platform": "shopee", "order_sn": "order", "item_sku": "A", "quantity": "2", "original_price": "10", "total_order_value": "20",
        "buyer_total_amount": "20", "create_time": "2026-10-13T17:01:00Z", "order_status": "COMPLETED"}


def frame(spark, rows, base=BASE):
    full = [{**base, **r} for r in rows]
    names = sorted({k for r in full for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ", ".join(f"`{n}` string" for n in names))


def check(spark, rows):
    typed = unify.normalise(unify.unify(frame(spark, rows)))
    return rules.with_errors(typed, rules.order_line_rules(typed))


def test_replayed_lines_are_duplicates(spark):
    lines = [{"item_sku": "A"}, {"item_sku": "B"}, {"order_line_id": "first"}, {"order_line_id": "second"}]
    rows = check(spark, lines + lines)
    accepted, _ = rules.split(rows)
    kept = L.deduplicate_lines(accepted)
    assert sorted(r.source_line_id for r in kept.collect()) == ["id:first", "id:second", "sku:A", "sku:B"]
    assert {r.order_date for r in kept.collect()} == {dt.date(2026, 10, 14)}
    report = rules.accounting(rows, L.LINE_KEY).first()
    assert (report.valid_records, report.duplicate_records, report.rejected_records, report.balanced) == (4, 4, 0, True)


def test_bad_rows_are_rejected_not_deduplicated(spark):
    rows = check(spark, [{}, {"quantity": "bad"}, {"item_sku": None}, {"quantity": "0"}, {"quantity": "1.5"}])
    report = rules.accounting(rows, L.LINE_KEY).first()
    assert (report.valid_records, report.duplicate_records, report.rejected_records) == (1, 0, 4)


CODES = [
    ({"model_discounted_price": "oops"}, "INVALID_DISCOUNTED_PRICE_TYPE"), ({"voucher_from_seller": "x"}, "INVALID_VOUCHER_TOTAL_TYPE"),
    ({"update_time": "never"}, "INVALID_SOURCE_UPDATED_AT_TYPE"), ({"pay_time": "never"}, "INVALID_PAY_TIME_TYPE"),
    ({"item_weight": "heavy"}, "INVALID_WEIGHT_KG"), ({"item_name": "n" * 501}, "TOO_LONG_PRODUCT_NAME"),
    ({"original_price": "inf"}, "OUTLIER_ORIGINAL_PRICE"), ({"original_price": "oops"}, "INVALID_ORIGINAL_PRICE_TYPE"),
    ({"pay_time": "2026-10-13T16:00:00Z"}, "PAY_TIME_BEFORE_CREATE_TIME"), ({"_platform": "lazada"}, "INVALID_PLATFORM"),
]


def test_one_code_per_bad_field(spark):
    rows = check(spark, [{"order_line_id": str(i), **change} for i, (change, _) in enumerate(CODES)])
    found = {r.source_line_id: r.errors.split("; ") for r in rows.select("source_line_id", "errors").collect()}
    for i, (_, code) in enumerate(CODES):
        assert code in found[f"id:{i}"], code


def test_cash_on_delivery_may_ship_before_payment(spark):
    times = {"pay_time": "2026-10-15T00:00:00Z", "shipped_time": "2026-10-14T00:00:00Z"}
    rows = check(spark, [{**times, "order_line_id": "1"}, {**times, "order_line_id": "2", "cod": "true"}])
    assert {r.source_line_id: r.errors for r in rows.collect()} == {"id:1": "SHIP_TIME_BEFORE_PAY_TIME", "id:2": ""}


def test_latest_version_wins_in_any_order(spark):
    old, new = {"update_time": "2026-10-14T00:00:00Z", "quantity": "1"}, {"update_time": "2026-10-15T00:00:00Z", "quantity": "3"}
    for rows in ([old, new], [new, old]):
        accepted, _ = rules.split(check(spark, rows))
        assert [r.quantity for r in L.deduplicate_lines(accepted).collect()] == [3.0]


def test_line_ids(spark):
    rows = spark.createDataFrame([("17", 17.0), ("0017", 18.0)], "t string, n double")
    none = F.lit(None).cast("string")
    texts = rows.select(S.line_key(F.col("t"), none, none, none).alias("k"), S.line_key(F.col("n"), none, none, none, numeric=True).alias("m")).collect()
    assert [(r.k, r.m) for r in texts] == [("id:17", "id:17"), ("id:0017", "id:18")]


@pytest.mark.parametrize("text, day", [
    ("2026-12-31T16:59:59Z", (2026, 12, 31)), ("2026-12-31T17:00:00.000Z", (2027, 1, 1)), ("2027-01-01T00:00:00+07:00", (2027, 1, 1)),
    ("2026-12-31T12:00:00-05:00", (2027, 1, 1)), ("2026-07-02T20:30:00", (2026, 7, 3)),
])
def test_partition_day(spark, text, day):
    row = lake.with_partitions(spark.createDataFrame([("Shopee", text)], "_platform string, create_time string")).first()
    assert (row.platform, int(row.year), int(row.month), int(row.day)) == ("shopee", *day)


def test_partition_fallbacks(spark):
    rows = spark.createDataFrame([("bad/path", "invalid", "2026-07-02T20:00:00Z"), (None, None, None)], "_platform string, create_time string, created_time string")
    first, second = lake.with_partitions(rows, F.to_timestamp(F.lit("2030-01-01T20:00:00Z"))).collect()
    assert (first.platform, first.year, first.month, first.day) == ("unknown", "2026", "07", "03")
    assert (second.platform, second.year, second.month, second.day) == ("unknown", "2030", "01", "02")


def test_stale_update_is_ignored_and_lifecycle_is_kept(spark):
    schema = "order_id string, platform string, source_line_id string, quantity int, date_key int, cancel_reason string, create_time timestamp_ntz, " \
             "pay_time timestamp_ntz, shipped_time timestamp_ntz, completed_time timestamp_ntz, cancel_time timestamp_ntz, source_updated_at timestamp_ntz"
    at = lambda n: dt.datetime(2026, 1, n)
    row = lambda q, v, pay: ("o", "p", "l", q, 1, None, at(1), pay, None, None, None, v)
    stored = spark.createDataFrame([row(1, at(5), at(2))], schema)
    assert M.merge_fact(stored, spark.createDataFrame([row(9, at(4), None)], schema)).first().quantity == 1
    merged = M.merge_fact(stored, spark.createDataFrame([row(9, at(6), None)], schema)).first()
    assert (merged.quantity, merged.pay_time) == (9, at(2))


def test_running_total_equals_plain_window(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("o"), F.col("id").alias("v"))
    out = {(r.g, r.o): r.t for r in running_total(rows, ["g"], [F.col("o")], {"t": "v"}, slices=7).collect()}
    seen: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, r.o)):
        seen[r.g] = seen.get(r.g, 0) + r.v
        assert out[(r.g, r.o)] == seen[r.g]


def test_numbering_and_quantiles(spark):
    rows = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert sorted(r.k for r in number_rows(rows, [F.col("v").desc()], "k", 10).collect()) == list(range(11, 112))
    q = exact_quantiles(rows.filter("v < 10"), [], "v", {"m": 0.5, "p": 0.95}).first()
    assert (q.n, q.m, round(q.p, 6)) == (10, 4.5, 8.55)


def sales(spark, rows):
    data = [(s, dt.datetime(2026, 1, 1) + dt.timedelta(days=d), q, Decimal(r), False) for s, d, q, r in rows]
    return spark.createDataFrame(data, "sku string, create_time timestamp_ntz, quantity int, buyer_total_amount decimal(14,2), is_cancelled boolean") \
        .withColumns({"product_name": F.col("sku"), "category": F.lit("c"), "original_price": F.lit(10).cast("decimal(14,2)"), "seller_discount": F.lit(0).cast("decimal(14,2)"),
                      "order_id": F.monotonically_increasing_id().cast("string"), "platform": F.lit("shopee")})


def test_segments(spark):
    rows = [("HIGH", d, 10, "1000") for d in range(30)] + [("MID", d, 1 if d % 2 else 5, "50") for d in range(30)] + [("LOW", 3, 1, "5"), ("LOW", 20, 1, "5")]
    out = {r.sku: r for r in D.abc_xyz(D.demand_rows(sales(spark, rows))).collect()}
    assert out["HIGH"].matrix_segment == "AX" and out["LOW"].abc_class == "C" and out["LOW"].xyz_class == "Z"
    assert out["MID"].mean_demand_exact == 3 and abs(out["MID"].std_demand_exact - (30 * 4 / 29) ** 0.5) < 1e-9
    assert (out["HIGH"].safety_stock, out["HIGH"].reorder_point) == (1, 31)


def test_equal_zero_revenue_falls_back_to_units(spark):
    out = {r.sku: r.abc_class for r in D.abc_xyz(D.demand_rows(sales(spark, [("A", 0, 9, "0"), ("B", 0, 1, "0")]))).collect()}
    assert out == {"A": "A", "B": "B"}


def series(spark, values, sku="S"):
    return spark.createDataFrame([(sku, dt.date(2026, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "sku string, date date, daily_demand double")


def test_features_do_not_leak(spark):
    a = X.ema_features(X.window_features(series(spark, range(1, 41))))
    rows = {r.date: r for r in a.collect()}
    day = lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=i)
    assert rows[day(1)].lag_1 == 1 and rows[day(7)].rolling_mean_7 == 4.0
    assert rows[day(0)].rolling_mean_7 is None and rows[day(0)].rolling_std_7 == 0 and rows[day(0)].ema_7 is None
    level = 1.0
    for i in range(1, 40):
        assert abs(rows[day(i)].ema_7 - level) < 1e-9
        level = 0.75 * level + 0.25 * (i + 1)
    changed = {r.date: r for r in X.ema_features(X.window_features(series(spark, list(range(1, 40)) + [999]))).collect()}
    assert all(changed[d].ema_7 == rows[d].ema_7 and changed[d].rolling_max_28 == rows[d].rolling_max_28 for d in rows)


def test_ema_over_several_blocks(spark):
    values = [(i * 37) % 11 for i in range(1600)]
    spans = (2, 7, 14, 200, 365)
    rows = sorted(X.ema_features(series(spark, values), spans=spans).collect(), key=lambda r: r.date)
    for s in spans:
        level, a = None, 2 / (s + 1)
        for i, v in enumerate(values):
            got = rows[i][f"ema_{s}"]
            assert (got is None) if level is None else abs(got - level) < 1e-9, (s, i)
            level = v if level is None else (1 - a) * level + a * v


def test_state_features_equal_batch_features(spark):
    values = [(i * 7) % 5 for i in range(60)]
    batch = X.ema_features(X.window_features(series(spark, values))).orderBy(F.col("date").desc()).first()
    one = spark.createDataFrame([([float(v) for v in values], dt.date(2026, 3, 1))], "h array<double>, d date")
    zero = F.lit(0.0)
    online = one.select(*[c.alias(n) for n, c in models.state_features(F.col("h"), F.col("d"), zero, zero, zero, zero).items()]).first()
    for name in ("lag_1", "lag_28", "rolling_mean_7", "rolling_std_14", "rolling_max_28", "rolling_min_7", "ema_7", "ema_14", "growth_wow"):
        assert abs(online[name] - batch[name]) < 1e-9, name


def test_dense_series_fills_days_and_prices(spark):
    lines = sales(spark, [("A", 2, 5, "50"), ("A", 5, 1, "10"), ("B", 0, 1, "10"), ("B", 7, 1, "10")])
    rows = {(r.sku, r.date.day): r for r in X.daily_history(lines).collect()}
    assert len(rows) == 16 and rows[("A", 1)].avg_unit_price == 0 and rows[("A", 4)].avg_unit_price == 10 and rows[("A", 4)].daily_demand == 0
    assert rows[("A", 3)].daily_demand == 5


def test_folds_and_requirements(spark):
    assert P.Folds().history() == (63, 92) and P.Folds(2).history() == (49, 78)
    dates = series(spark, range(70)).select(F.col("date").alias("target_date"))
    rows = {(r.fold, r.role): r.n for r in P.walk_forward(dates).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows[(1, "test")] == 14 and rows[(1, "validation")] == 7 and rows[(1, "train")] == 49 and rows[(3, "train")] == 21


def test_metrics(spark):
    rows = spark.createDataFrame([("m", 10.0, 12.0), ("m", 20.0, 18.0), ("m", 30.0, 33.0), ("m", 40.0, 37.0), ("z", 0.0, 1.0), ("b", 10.0, 12.0)], "model string, actual double, prediction double")
    out = {r.model: r for r in P.metrics(rows, ["model"]).collect()}
    assert (out["m"].mae, out["m"].wape, out["m"].rmse) == (2.5, 10.0, 2.5495) and out["z"].wape == 0 and out["b"].bias == 20


def test_drift_examples(spark):
    def hist(ref, cur):
        rows = [("reference", float(v)) for v in ref] + [("current", float(v)) for v in cur]
        return DR.histogram(spark.createDataFrame(rows, "window string, x double"), ["x"])

    same = DR.ks(hist(range(8), range(8))).first()
    assert (same.ks_statistic, same.p_value) == (0, 1)
    moved = DR.ks(hist(range(7), range(100, 107))).first()
    assert moved.ks_statistic > 0.8 and moved.p_value < 0.05
    assert DR.psi(hist([1, 2, 3, 4, 5] * 10, [10, 20, 30, 40, 50] * 10)).first().psi > 0.25


@pytest.mark.parametrize("mean, sigma, stock, want", [(0.0, 0.0, 0, (1, 2, 2)), (1.0, 1.0, 8, (3, 6, 0))])
def test_policy(spark, mean, sigma, stock, want):
    row = spark.createDataFrame([(mean, sigma, stock)], "m double, s double, k int")
    row = row.withColumn("ss", S.safety_stock(F.col("s"))).withColumn("rop", S.reorder_point(F.col("m"), F.col("ss")))
    out = row.select("ss", "rop", S.recommended_quantity(F.col("k"), F.col("rop"), F.col("m")).alias("q")).first()
    assert tuple(out) == want


def test_short_series_gives_one_padded_window(spark):
    out = X.sequence_windows(series(spark, [1, 2, 3]), ["daily_demand"]).collect()
    assert len(out) == 1 and out[0].target == 3 and [s[0] for s in out[0].steps] == [1.0] * 12 + [1.0, 2.0]


def test_topic_flushes_by_rows_or_time():
    from marketloom.streaming import jobs

    options = jobs.topic_options("host:9092", "orders")
    assert options["minOffsetsPerTrigger"] == "500" and options["maxTriggerDelay"] == "60s" and "maxOffsetsPerTrigger" not in options
    assert jobs.topic_options("host:9092", "orders", most=7)["maxOffsetsPerTrigger"] == "7"


def test_every_forecast_request_is_answered(spark):
    daily = series(spark, [3] * 40, "A").unionByName(series(spark, [0] * 40, "Z"))
    last = dt.date(2026, 1, 1) + dt.timedelta(days=39)
    ask = [(1, "A", 1, 3), (2, "A", 200, 201), (3, "none", 1, 2), (4, "Z", 1, 2), (5, "A", 5, 2)]
    rows = spark.createDataFrame([(i, s, last + dt.timedelta(days=a), last + dt.timedelta(days=b)) for i, s, a, b in ask],
                                 "request_id long, sku string, from_date date, to_date date")
    got = {}
    for r in P.batch_forecast(rows, daily, F.lit(last)).collect():
        got.setdefault(r.request_id, []).append((r.model_source, r.reason, r.predicted_quantity))
    assert {i: (len(x), x[0][:2]) for i, x in got.items()} == {
        1: (3, ("spark_baseline", "")), 2: (1, ("refused", "TOO_MANY_STEPS")), 3: (2, ("heuristic_catalog", "")), 4: (2, ("heuristic_history", "")),
        5: (1, ("refused", "RANGE_REVERSED"))}


def test_dedupe_reads_its_input_once(spark, tmp_path):
    rows = [("1", "p", "id:1", 1), ("1", "p", "id:1", 2), (None, "p", "id:1", 1), (None, "p", "id:1", 1)]
    spark.createDataFrame(rows, "order_id string, platform string, source_line_id string, source_updated_at int").write.parquet(f"{tmp_path}/lines")
    out = L.deduplicate_lines(spark.read.parquet(f"{tmp_path}/lines"))
    assert sorted((r.order_id or "", r.source_updated_at) for r in out.collect()) == [("", 1), ("", 1), ("1", 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_raw_rows_are_dealt_by_the_setting_alone(spark):
    from marketloom.sources import tables

    lines = tables.order_lines(spark, "/root/testdata/sf0.001")
    key, before = "spark.marketloom.rawPartitions", spark.conf.get("spark.marketloom.rawPartitions", None)
    try:
        spark.conf.unset(key)
        assert tables.dealt(lines, ["order_key"]) is lines
        spark.conf.set(key, "3")
        plan = tables.dealt(lines, ["order_key"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("RepartitionByExpression") and plan.splitlines()[0].rstrip().endswith(", 3")
    finally:
        if before:
            spark.conf.set(key, before)
