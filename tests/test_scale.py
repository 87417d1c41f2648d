"""Work and bytes that must not grow beside the input: plans and files of small examples."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from marketloom.operators import demand as D
from marketloom.operators import features as X
from marketloom.operators import forecast as P
from marketloom.operators import latest as L
from marketloom.operators import merge as M
from marketloom.plans import cleaning_queries as C
from marketloom.plans import demand_queries as DQ
from marketloom.plans import file_queries as FL
from marketloom.plans import forecast_queries as FQ
from marketloom.session import compiled, few_listings
from marketloom.sources import history as H
from marketloom.sources import lake
from marketloom.sources import quarantine as Q
from marketloom.sources import tables as T
from marketloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requests_of_one_sku_and_day_share_one_path(spark):
    start = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("s", start + dt.timedelta(days=k), float(k % 5 + 1)) for k in range(40)], "sku string, date date, daily_demand double")
    last = start + dt.timedelta(days=39)
    asked = [(k, "s", last + dt.timedelta(days=1), last + dt.timedelta(days=1 + k)) for k in range(12)]
    rows = spark.createDataFrame(asked, "request_id long, sku string, from_date date, to_date date").coalesce(1)
    found = P.batch_forecast(rows, daily, F.lit(last))
    plan = optimized(found)
    assert "RepartitionByExpression" in plan and "Aggregate [sku" in plan
    by = {}
    for r in found.collect():
        by.setdefault(r["request_id"], []).append((r["date"], r["predicted_quantity"]))
    longest = sorted(by[11])
    assert [len(by[k]) for k in range(12)] == list(range(1, 13))
    assert all(sorted(by[k]) == longest[: k + 1] for k in range(12))


def test_wide_projections_are_compiled_under_default_settings(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        C.checked(spark, SF)
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, "4000")
        compiled(spark)
        assert spark.conf.get(name) == "4000"
    finally:
        spark.conf.set(name, before)


def test_times_are_parsed_once(spark):
    rows = C.typed(spark, SF).select("create_time", "_invalid_create_time", "order_date")
    # The instant is a column of its own, which the value and the flag read.
    assert "AS _at_create_time" in optimized(rows)


def test_rejected_positions_are_found_from_one_evaluation(spark):
    assert "lineitem" not in C.rejects_in_quarantine(spark, SF)._jdf.queryExecution().toString()


def test_dedupe_of_clean_lines_moves_only_needed_columns(spark):
    plan = optimized(C.cleaning_report(spark, SF)) + optimized(C.clean_lines(spark, SF))
    kept = [line for line in plan.splitlines() if "max_by" in line]
    assert kept and not any("raw_payload" in line or "buyer_total_amount" in line for line in kept)


def test_quarantine_files_are_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, "x" * 100)], "sku string, price double, raw_payload string").withColumn("price", F.col("price").cast("string"))
    target = Q.write(rows, str(tmp_path / "q"), "r")
    assert list((tmp_path / "q" / "run_id=r").glob("*.json.gz")) and Q.read(spark, target, rows.schema).collect() == rows.collect()


def test_bronze_moves_the_text_only_and_stores_it_well_compressed(spark, tmp_path):
    good = json.dumps({"_platform": "shopee", "order_sn": "1", "item_sku": "s" * 50, "create_time": "2024-01-01T20:00:00Z"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([good, "{broken", "[1]"]))
    schema = spark.createDataFrame([], "_platform string, order_sn string, item_sku string, create_time string").schema
    query = jobs.bronze(jobs.read_messages(spark, str(tmp_path / "in")), schema, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    plan = query._jsq.explainInternal(True)
    shuffled = [line for line in plan.splitlines() if "RebalancePartitions" in line or "Exchange" in line]
    assert shuffled and not any("item_sku" in line for line in shuffled)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["_platform", "order_sn", "item_sku", "create_time", "_raw_payload_json", "_ingest_error", "_source_platform", "platform", "year", "month", "day"]
    assert {(r["order_sn"], r["item_sku"], r["_ingest_error"]) for r in back.collect()} == {("1", "s" * 50, None), (None, None, "INVALID_JSON_OBJECT")}
    row = back.filter("order_sn = '1'").first()
    assert (row["platform"], row["_source_platform"], row["day"], row["_raw_payload_json"]) == ("shopee", "shopee", 2, good)
    assert list((tmp_path / "out").rglob("*.zstd.parquet"))


def test_merges_move_each_key_once_and_only_what_is_read(spark, tmp_path):
    """F9, F13."""
    schema = "a string, b string, name string, qty int"
    spark.createDataFrame([("1", None, "old", 1), ("2", "x", "old", 2)], schema).write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([("1", None, "new", 10), (None, None, "new", 30)], schema).write.parquet(f"{tmp_path}/new")
    old, new = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new"))
    merged = M.merge_scd1(old, new, ["a", "b"], ["qty"])
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([("1", None, "old", 10), ("2", "x", "old", 2), (None, None, "new", 30)], key=str)
    totals = merged.agg(F.sum("qty"))
    assert "name" not in totals._jdf.queryExecution().executedPlan().toString()
    assert totals.first()[0] == 42


def test_import_of_files_of_one_slice_shuffles_no_rows(spark, tmp_path):
    """F9."""
    text = "order_sn,item_sku,item_name,create_time,quantity,order_status\n" + "".join(f"{k},s,n,2024-01-01T00:00:00Z,1,COMPLETED\n" for k in range(5))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(text)
    rows = H.imported(spark, str(tmp_path / "in"), "shopee")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 3
    assert sorted(r["source_record_id"] for r in rows.collect()) == [f"row:{k}" for k in range(5)]


def test_files_of_one_and_of_several_slices_have_the_digest_of_their_bytes(spark, tmp_path):
    """F9."""
    import hashlib

    texts = {"long.csv": "\n".join(f"line {k}" for k in range(2000)), "short.csv": "a\nb\n"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        found = {r["_file"].rsplit("/", 1)[1]: r["source_dataset"] for r in H.fingerprints(spark, str(tmp_path / "in"), "p").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {n: f"p:sha256:{hashlib.sha256(t.encode()).hexdigest()}" for n, t in texts.items()}


def test_lines_are_deduplicated_once_for_both_batches(spark):
    """F13."""
    stored, incoming = C.two_batches(spark, SF)
    assert "l_partkey" not in optimized(stored) and "l_partkey" not in optimized(incoming)


def test_dedupe_sends_the_key_once(spark):
    """F13."""
    rows = spark.createDataFrame([("k", 1, 5, "a"), ("k", 2, 3, "b"), ("k", None, 9, "c"), (None, 1, 1, "d"), (None, 1, 1, "d")], "id string, v int, t int, name string")
    out = L.deduplicate_lines(rows, ["id"], "v", ["t"])
    assert out.columns == rows.columns and sorted(map(tuple, out.collect()), key=str) == sorted([("k", 2, 3, "b"), (None, 1, 1, "d"), (None, 1, 1, "d")], key=str)
    assert not any("struct(id, " in line for line in optimized(out).splitlines() if "max_by" in line)


def test_feature_store_reads_lines_for_the_series_only(spark):
    """F21."""
    assert optimized(DQ.feature_store(spark, SF)).count("lineitem") == optimized(DQ.daily(spark, SF).select("sku")).count("lineitem") and optimized(
        DQ.feature_store(spark, SF)).count("l_extendedprice") <= optimized(DQ.daily(spark, SF)).count("l_extendedprice")


def test_bounds_of_the_series_of_trained_models_are_read_from_stored_days(spark, monkeypatch):
    """F22."""
    asked = []
    monkeypatch.setattr(D, "date_bounds", lambda rows, whole=D.date_bounds: asked.append(rows.columns) or whole(rows))
    FQ.trained(spark, SF)
    assert asked and all("original_price" not in columns for columns in asked)


def test_first_names_from_days_are_those_of_the_lines(spark):
    """cancelled lines count, equal days are told apart by the order."""
    day = dt.datetime(2024, 1, 1)
    rows = [("s", day, False, 2, "b", "c1", 2), ("s", day, True, 1, "a", "c2", 1), ("s", day + dt.timedelta(days=1), False, 1, "z", "c3", 3), (None, day, False, 1, "q", None, 4)]
    lines = spark.createDataFrame([(*r, 1.0) for r in rows], "sku string, create_time timestamp, is_cancelled boolean, quantity int, product_name string, category string, n int, buyer_total_amount double")
    pick = lambda df: sorted(map(tuple, df.select("sku", "product_name", "category", "category_code").collect()), key=str)
    assert pick(X.sku_names(X.sku_days(lines, ("n",)), ("n",))) == pick(X.sku_names(lines, ("n",)))


def test_segments_hash_their_sums(spark):
    """greatest names are found among distinct ones, and a missing SKU keeps its name."""
    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([("o", "s", "a", "c", day, 1, 1), ("o", "s", "b", None, day, 2, 2), ("o", None, "x", "y", day, 3, 3)],
                                 "data_origin string, sku string, product_name string, category string, order_date date, quantity int, revenue int").select(
        "data_origin", "sku", "product_name", "category", "order_date", F.col("quantity").cast("decimal(18,0)").alias("quantity"), F.col("revenue").cast("decimal(18,2)").alias("revenue"))
    seen = []
    whole, D.materialise = D.materialise, lambda df, label: seen.append(optimized(df)) or whole(df, label)
    try:
        out = {r["sku"]: r for r in D.abc_xyz(rows).collect()}
    finally:
        D.materialise = whole
    assert not any("max(" in line and "order_date" in line and "data_origin#" in line.split("]")[0] and "order_date" in line.split("]")[0] for line in seen[0].splitlines())
    assert (out["s"]["product_name"], out["s"]["category"], out["s"]["total_units"], out[None]["product_name"]) == ("b", "c", 3, "x")


def test_lines_with_product_and_place_are_made_behind_the_joins(spark, tmp_path):
    """F4 to F8: stored columns are shuffled, orders come last, and the rows are those of the joins one by one, repeated and missing keys too."""
    day = dt.datetime(1997, 1, 1)
    frames = {
        "lineitem": ([(1, 10, 5, 1, 3.0, 10.5, 0.1, 0.02, "N", "O", day), (1, 11, 5, 2, 7.0, 99.99, 0.0, 0.0, "R", "F", day), (2, 10, 6, 1, 1.0, 1.0, 0.05, 0.08, None, "O", None),
                      (None, 10, 6, 1, 1.0, 1.0, 0.05, 0.08, "N", "O", day), (3, None, 6, 1, 1.0, 1.0, 0.05, 0.08, "N", "O", day), (2, 10, None, 9, 2.0, None, 0.05, 0.08, "A", "O", day)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": ([(1, 7, "F", 1.0, day, "1-URGENT"), (2, 8, "P", 2.0, day, None), (2, 8, "P", 2.0, day, None), (3, 7, None, 3.0, None, "5-LOW"), (4, None, "O", 3.0, day, "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "part": ([(10, "widget", "Brand#1", "SMALL"), (11, None, "Brand#2", None), (10, "twin", "Brand#1", "LARGE")], "p_partkey long, p_name string, p_brand string, p_type string"),
        "customer": ([(7, 1), (8, 2), (8, None), (9, 1)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, "PERU", 0), (2, "CHINA", 1), (2, "CHINA2", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    whole = T.order_lines(spark, str(tmp_path), product=True, place=True)
    apart = T.order_lines(spark, str(tmp_path), place=True).join(T.products(spark, str(tmp_path)), "part_key").select(*whole.columns)
    rows = sorted(map(repr, whole.collect()))
    assert rows == sorted(map(repr, apart.collect())) and len(rows) > 8 and whole.schema == apart.schema
    below = optimized(whole).split("Join", 1)
    assert "AS subtotal" in below[0] and "AS subtotal" not in below[1] and "concat" not in below[1]


def test_span_of_deliveries_is_read_from_stored_messages(spark, monkeypatch):
    """the lines and their joins are read once, for the messages."""
    seen, inboxes = [], []
    monkeypatch.setattr(FL, "materialise", lambda df, *more, whole=FL.materialise: seen.append(optimized(df)) or whole(df, *more))
    FL.raw_deliveries(spark, SF, lambda inbox, k: inboxes.append(spark.read.text(inbox).count()))
    assert len(seen) == 1 and "scalar-subquery" not in seen[0]
    total = T.table(spark, SF, "lineitem").count()
    assert inboxes == sorted(inboxes) and inboxes[-1] == total and 0 < inboxes[0] < inboxes[1] < inboxes[2] < total


def test_a_batch_that_the_fact_holds_is_not_computed_again(spark, tmp_path):
    """its rejects were stored before the merge."""
    fact = jobs.fact_table(spark, f"{tmp_path}/fact")
    fact._note("s", 4)
    fails = spark.range(1).select(F.raise_error(F.lit("read again")).cast("string").alias("order_id"), F.lit("tiktok").alias("_platform"))
    jobs.load_batch(fails, ("s", 4), fact, f"{tmp_path}/rejects")
    jobs.load_batch(fails, ("s", 3), fact, f"{tmp_path}/rejects")
    assert not (tmp_path / "rejects").exists()
    with pytest.raises(Exception, match="read again"):
        jobs.load_batch(fails, ("s", 5), fact, f"{tmp_path}/rejects")


def test_small_folders_are_listed_by_few_tasks(spark, tmp_path):
    """not a task for each path of a batch."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        query = jobs.incremental_load(spark.readStream.format("rate").load(), jobs.fact_table(spark, f"{tmp_path}/fact"), f"{tmp_path}/r", f"{tmp_path}/cp", once=True)
        query.stop()
        assert spark.conf.get(name) == "64"
        spark.conf.set(name, "8")
        few_listings(spark)
        assert spark.conf.get(name) == "8"
    finally:
        spark.conf.set(name, before)


def test_bronze_examines_a_text_once(spark):
    """behind the shuffle the mark of the first decoding tells which texts are objects."""
    texts = ['{"a":"1"}', "{broken", "[1]", " {\"a\":2}", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    schema = spark.createDataFrame([], "a string").schema
    first = lake.decode(rows, schema)
    again = lake.decode(first.select(F.col("_raw_payload_json").alias("value"), F.col("_ingest_error").alias("mark")), schema, mark="mark")
    assert again.collect() == first.collect() and [r["a"] for r in first.collect()] == ["1", None, None, "2", None, None]
    plan = optimized(lake.decode(rows.withColumn("mark", F.lit(None).cast("string")), schema, mark="mark"))
    assert "from_json" in plan and "parse_json" not in plan.replace("from_json", "") and "RLIKE" not in plan


def test_landed_messages_go_once_their_batch_is_committed(spark, tmp_path):
    """the inbox does not lie beside the lake that grows from it."""
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.txt").write_text(json.dumps({"_platform": "shopee", "create_time": f"2024-01-0{k + 1}T00:00:00Z"}) + "\n")
    schema = spark.createDataFrame([], "_platform string, create_time string").schema
    jobs.drain(jobs.bronze(jobs.read_messages(spark, str(tmp_path / "in"), 1, spent="delete"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), once=True))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    until = time.time() + 20
    while len(list((tmp_path / "in").glob("*.txt"))) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(list((tmp_path / "in").glob("*.txt"))) <= 1


def test_lake_grows_by_portions_of_days(spark, tmp_path, monkeypatch):
    """F5 to F8: rows are stored packed and the shuffles behind them let go before the lake grows, then one portion after the other goes there."""
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("a"), F.concat(F.lit("b"), F.col("id")).alias("b"), F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "shopee").when(F.col("id") % 3 == 1, "").alias("platform"),
        F.lit("2024").alias("year"), F.lit("02").alias("month"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0").alias("day"))
    held, grown = [], []
    monkeypatch.setattr(lake, "new_folder", lambda *_: held.append(f"{tmp_path}/held") or held[-1])
    monkeypatch.setattr(lake, "release", lambda _: grown.append((len(list(tmp_path.glob("held/_portion=*"))), len({p.parent for p in tmp_path.glob("lake/**/*.parquet")}))))
    monkeypatch.setattr(lake, "TOGETHER", 1)
    lake.write_lake(rows, f"{tmp_path}/lake")
    waiting, folders = zip(*grown)
    assert folders[0] == 0 and waiting[0] > 4 and waiting[-1] == 0 and list(waiting) == sorted(waiting, reverse=True)
    assert list(folders) == sorted(set(folders)) and folders[-1] == 56 and len(held) == 1 and not (tmp_path / "held").exists()
    back = lake.scan(spark, f"{tmp_path}/lake", lake.stored_schema(rows.schema))
    expected = sorted((str(i), f"b{i}", i, "shopee" if i % 3 == 0 else None, 2024, 2, i % 28 + 1) for i in range(400))
    assert sorted((r["a"], r["b"], r["n"], r["platform"], r["year"], r["month"], r["day"]) for r in back.collect()) == expected
    monkeypatch.undo()
    lake.write_lake(rows, f"{tmp_path}/small")
    assert len({p.parent for p in tmp_path.glob("small/**/*.parquet")}) == 56
    lake.write_lake(rows.limit(0), f"{tmp_path}/none")
    assert (tmp_path / "none").exists() and not list(tmp_path.glob("none/**/*.parquet"))
