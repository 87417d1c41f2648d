"""Back-testing roles, baseline and recursive forecasts, and retail error metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators.rules import forecast_request_rules

BASELINES = ("naive", "seasonal_naive", "moving_average")


# ---- walk-forward folds -----------------------------------------------------------------

@dataclass(frozen=True)
class Folds:
    """Test windows counted back from the last target day, newest first; in front of each lie its validation days, and all days before train."""

    number: int = 3
    test_days: int = 14
    validation_days: int = 7

    def __post_init__(self):
        if min(self.number, self.test_days, self.validation_days) < 1:
            raise ValueError(f"folds need days: {self}")

    def edges(self, fold: int | Column) -> tuple[int | Column, int | Column, int | Column]:
        """How many days back the test, validation and training days of a fold (from 1) begin."""
        test = (fold - 1) * self.test_days
        return test, test + self.test_days, test + self.test_days + self.validation_days

    def role(self, back: Column, fold: Column) -> Column:
        test, validation, train = self.edges(fold)
        return F.when(back >= train, "train").when(back >= validation, "validation").when(back >= test, "test")

    def history(self, train_days: int = 14, max_lag_days: int = 28) -> tuple[int, int]:
        """(target days, source days) with which even the oldest fold has ``train_days``.

        The first source days only feed the largest lag, and the last one has no next day to predict.
        """
        if train_days < 1 or max_lag_days < 0:
            raise ValueError("no days to train on")
        targets = self.edges(self.number)[2] + train_days
        return targets, max_lag_days + targets + 1


FOLDS = Folds()


def fold_dates(df: DataFrame, date_col: str = "target_date", folds: Folds = FOLDS) -> DataFrame:
    """(date, fold, role) counted back from the last distinct date; fold 1 is the latest. A fold without training days is left out.

    The ordering runs over distinct calendar days only, so it is bounded by the calendar.
    """
    dates = df.select(F.col(date_col).alias("_d")).distinct()
    back = Window.orderBy(F.col("_d").desc())
    ranked = dates.withColumns({"_back": F.row_number().over(back) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    each = ranked.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds.number)))).filter(F.col("_n") > folds.edges(F.col("fold"))[2])
    return each.select(F.col("_d").alias(date_col), "fold", folds.role(F.col("_back"), F.col("fold")).alias("role")).filter("role is not null")


def walk_forward(df: DataFrame, date_col: str = "target_date", folds: Folds = FOLDS) -> DataFrame:
    """Rows repeated per fold with their role. The joined table has at most folds x calendar days rows."""
    return df.join(F.broadcast(fold_dates(df, date_col, folds)), date_col)


def fit_set(rows: DataFrame) -> DataFrame:
    """Rows a fold may be fitted on: train and validation together."""
    return rows.filter(F.col("role").isin("train", "validation"))


# ---- baselines --------------------------------------------------------------------------

def baseline_columns(df: DataFrame) -> DataFrame:
    """One-step baseline predictions read from the feature row."""
    return df.withColumns({
        "naive": F.coalesce("lag_1", F.lit(0.0)), "seasonal_naive": F.coalesce("lag_7", F.lit(0.0)),
        "moving_average": F.coalesce("rolling_mean_7", F.lit(0.0)),
    })


def _from_end(history: Column, back: int) -> Column:
    """Demand ``back`` days before the last day of the array, zero when it is not there."""
    return F.coalesce(F.try_element_at(history, F.lit(-(back + 1))), F.lit(0.0))


def _previous(history: Column, n: int) -> Column:
    """The last ``n`` values before the final one (fewer when the array is short)."""
    before = F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0)))
    return F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), F.lit(n))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def baseline_step(name: str) -> Callable[[Column], Column]:
    """Next-day forecast from a demand array that ends at the feature day."""
    return {
        "naive": lambda h: _from_end(h, 1),
        "seasonal_naive": lambda h: _from_end(h, 7),
        "moving_average": lambda h: _mean(_previous(h, 7)),
    }[name]


def recurse(history: Column, steps: Column, step: Callable[[Column], Column], keep: int = V.HISTORY_DAYS) -> Column:
    """Array of ``steps`` forecasts; each one is appended to the history of the next."""
    start = F.struct(history.alias("h"), F.array().cast("array<double>").alias("p"))

    def advance(acc: Column, _: Column) -> Column:
        y = F.greatest(F.lit(0.0), step(acc["h"]))
        grown = F.array_append(acc["h"], y)
        return F.struct(
            F.slice(grown, F.greatest(F.size(grown) - keep + 1, F.lit(1)), F.lit(keep)).alias("h"),
            F.array_append(acc["p"], y).alias("p"),
        )

    range_ = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(range_, start, advance, lambda acc: acc["p"])


# ---- history ----------------------------------------------------------------------------

def complete_history(daily: DataFrame, last: Column) -> DataFrame:
    """Gap-free history per SKU from its first day: price carried, revenue and orders imputed."""
    from marketloom.operators.demand import dense_daily

    filled = daily.withColumns({
        "daily_demand": F.coalesce("daily_demand", F.lit(0.0)),
        "total_discount": F.coalesce("total_discount", F.lit(0.0)),
    })
    price = F.last("avg_unit_price", ignorenulls=True).over(
        Window.partitionBy("sku").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    filled = filled.withColumn("avg_unit_price", F.coalesce(price, F.lit(0.0)))
    filled = filled.withColumns({
        "daily_revenue": F.coalesce("daily_revenue", F.col("daily_demand") * F.col("avg_unit_price")),
        "order_count": F.coalesce("order_count", "daily_demand"),
    })
    return dense_daily(filled.filter(F.col("date") <= last), None, last)


def history_from_features(store: DataFrame, max_lag: int = 28) -> DataFrame:
    """Daily rows recovered from a feature store: the stored day, and the day its largest lag refers to."""
    columns = ["daily_demand", "daily_revenue", "avg_unit_price", "total_discount", "order_count"]
    own = store.select("sku", "date", *columns, F.lit(1).alias("_rank"))
    lagged = store.select(
        "sku", F.date_sub("date", max_lag).alias("date"), F.col(f"lag_{max_lag}").alias("daily_demand"),
        (F.col(f"lag_{max_lag}") * F.col("avg_unit_price")).alias("daily_revenue"), "avg_unit_price",
        F.lit(0.0).alias("total_discount"), F.col(f"lag_{max_lag}").alias("order_count"), F.lit(0).alias("_rank"),
    )
    # A day that was stored itself beats the same day read back from a lag.
    merged = own.unionByName(lagged).groupBy("sku", "date").agg(
        F.max_by(F.struct(*columns), "_rank").alias("v"))
    return merged.select("sku", "date", "v.*")


def sku_series(daily: DataFrame, columns: tuple[str, ...] = ("daily_demand",)) -> DataFrame:
    """One ordered array per SKU; its length is bounded by the calendar."""
    return daily.groupBy("sku").agg(
        F.sort_array(F.collect_list(F.struct("date", *columns))).alias("series"))


def history_as_of(requests: DataFrame, daily: DataFrame, end: str = "history_end", days: int = V.HISTORY_DAYS, columns: tuple[str, ...] = ("daily_demand",)) -> DataFrame:
    """Requests with ``history``: the last ``days`` days of their SKU up to ``end``, ordered by date; empty where there are none.

    Days are packed into arrays by SKU and stretch of ``days`` days. The days of a request lie in at most two adjoining stretches, which two
    joins on (SKU, stretch) bring, so however long the series is, a request meets at most twice ``days`` of it.
    """
    stretch = lambda c: F.floor(F.unix_date(c) / days)
    row = F.struct("date", *columns)
    packed = daily.filter(F.col("date").isNotNull()).groupBy("sku", stretch(F.col("date")).alias("_stretch")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    asked = requests.withColumn("_last", stretch(F.col(end)))
    for name, back in (("_own", 0), ("_before", 1)):
        part = packed.select(F.col("sku").alias("_sku"), (F.col("_stretch") + back).alias("_of"), F.col("_rows").alias(name))
        asked = asked.join(part, (F.col("sku") == F.col("_sku")) & (F.col("_last") == F.col("_of")), "left").drop("_sku", "_of")
    none = F.array().cast(packed.schema["_rows"].dataType)
    both = F.concat(F.coalesce("_before", none), F.coalesce("_own", none))
    inside = F.filter(both, lambda r: (r["date"] <= F.col(end)) & (r["date"] > F.date_sub(F.col(end), days)))
    return asked.withColumn("history", F.coalesce(inside, none)).drop("_last", "_own", "_before")


# ---- recursive back-test ----------------------------------------------------------------

def fold_origins(rows: DataFrame, folds: Folds = FOLDS) -> DataFrame:
    """fold, origin (last known day) and last (target) of every fold of ``rows`` (target_date)."""
    tests = fold_dates(rows, folds=folds).filter("role = 'test'")
    return tests.groupBy("fold").agg(F.date_sub(F.min("target_date"), 1).alias("origin"), F.max("target_date").alias("last"))


def histories(daily: DataFrame, origins: DataFrame, number: int, days: int = V.HISTORY_DAYS) -> DataFrame:
    """sku, fold, origin, last and history (the last ``days`` demands up to the origin) of the SKUs that could be served there: they have the
    day of the origin, and demand in the window. Only days of a window are shuffled, each once."""
    # An array of one element per fold, so the origins reach every task without a join.
    listed = origins.agg(F.array_sort(F.collect_list(F.struct("fold", "origin", "last"))).alias("o")).scalar()
    at = [F.try_element_at(listed, F.lit(k + 1)) for k in range(number)]
    inside = [(F.col("date") <= o["origin"]) & (F.col("date") > F.date_sub(o["origin"], days)) for o in at]
    needed = reduce(lambda a, b: a | b, [F.coalesce(i, F.lit(False)) for i in inside])
    packed = daily.filter(needed).groupBy("sku").agg(*[F.sort_array(F.collect_list(F.when(i, F.struct("date", "daily_demand")))).alias(f"_{k}") for k, i in enumerate(inside)])
    each = F.array(*[F.struct(o["fold"].alias("fold"), o["origin"].alias("origin"), o["last"].alias("last"), F.col(f"_{k}").alias("days")) for k, o in enumerate(at)])
    state = packed.select("sku", F.inline(each)).filter((F.size("days") > 0) & (F.try_element_at("days", F.lit(-1))["date"] == F.col("origin")))
    return state.select("sku", "fold", "origin", "last", F.transform("days", lambda r: r["daily_demand"]).alias("history")).filter(F.exists("history", lambda y: y > 0))


def recursive_backtest(store: DataFrame, daily: DataFrame, models: tuple[str, ...] = BASELINES,
                       history_days: int = V.HISTORY_DAYS, folds: Folds = FOLDS) -> DataFrame:
    """Multi-step forecasts of every test window, all SKUs and folds in one job.

    SKUs without history at the origin, or without any demand in the history window, are left out,
    as they could not be served either.
    """
    rows = store.withColumn("target_date", F.date_add("date", 1))
    usable = histories(daily, fold_origins(rows, folds), folds.number, history_days)
    steps = F.datediff("last", "origin")
    paths = usable.select(
        "sku", "fold", "origin",
        *[recurse(F.col("history"), steps, baseline_step(m), history_days).alias(m) for m in models])
    flat = paths.select("sku", "fold", "origin", F.posexplode(F.arrays_zip(*models)).alias("_p", "z"))
    predicted = flat.select("sku", "fold", F.date_add("origin", F.col("_p") + 1).alias("target_date"),
                            (F.col("_p") + 1).alias("horizon"), *[F.col(f"z.{m}").alias(m) for m in models])
    return scored_rows(rows, predicted, models)


def scored_rows(rows: DataFrame, predicted: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Predictions next to the actual target; test rows without a prediction drop out."""
    actual = rows.select("sku", "target_date", F.col("target_t_plus_1").alias("actual"),
                         *[c for c in ("abc_class", "matrix_class") if c in rows.columns])
    wide = predicted.join(actual, ["sku", "target_date"])
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in models])
    return wide.select(*[c for c in wide.columns if c not in models], F.inline(pairs))


# ---- metrics ----------------------------------------------------------------------------

def metrics(scored: DataFrame, groups: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE, MAPE, WAPE, R2 and bias with zero guards, one aggregation for all groups."""
    y, p = F.col(actual).cast("double"), F.greatest(F.lit(0.0), F.col(prediction).cast("double"))
    gap = F.abs(y - p)
    sums = scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(gap).alias("se"),
        F.sum(gap * gap).alias("see"), F.sum(gap / (y + 1.0)).alias("sr"), F.sum(p - y).alias("sb"))
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    guard = lambda c: F.when(F.col("sy") == 0, 0.0).otherwise(c)
    return sums.select(
        *groups, "n",
        F.round(F.col("se") / F.col("n"), 4).alias("mae"), F.round(F.sqrt(F.col("see") / F.col("n")), 4).alias("rmse"),
        F.round(F.col("sr") / F.col("n") * 100.0, 2).alias("mape"),
        F.round(guard(F.col("se") / F.col("sy") * 100.0), 2).alias("wape"),
        F.round(F.when(total > 0, 1.0 - F.col("see") / total).otherwise(0.0), 4).alias("r2"),
        F.round(guard(F.col("sb") / F.col("sy") * 100.0), 2).alias("bias"),
    )


def fold_mean(per_fold: DataFrame, groups: list[str]) -> DataFrame:
    return per_fold.groupBy(*groups).agg(
        *[F.round(F.avg(m), 2).alias(m) for m in ("wape", "mape", "bias")],
        *[F.round(F.avg(m), 4).alias(m) for m in ("mae", "rmse", "r2")], F.count(F.lit(1)).alias("folds"))


def segment_wape(scored: DataFrame, groups: list[str]) -> DataFrame:
    """WAPE of AX+AY, AZ+BZ and C; zero when the segment sold nothing."""
    def wape(condition: Column) -> Column:
        e = F.sum(F.when(condition, F.abs(F.col("actual") - F.col("prediction"))))
        y = F.sum(F.when(condition, F.col("actual")))
        return F.round(F.when(y > 0, e / y * 100.0).otherwise(0.0), 4)

    return scored.groupBy(*groups).agg(
        wape(F.col("matrix_class").isin("AX", "AY")).alias("wape_ax_ay"),
        wape(F.col("matrix_class").isin("AZ", "BZ")).alias("wape_az_bz"),
        wape(F.col("abc_class") == "C").alias("wape_group_c"))


def champion(runs: DataFrame, **required: str) -> DataFrame:
    """Lowest WAPE among runs that used the required strategy and data."""
    eligible = runs
    for name, value in required.items():
        eligible = eligible.filter(F.col(name) == value)
    return eligible.orderBy(F.col("wape").asc(), F.col("model").asc()).limit(1)


# ---- readiness --------------------------------------------------------------------------

def _readiness(row: DataFrame, available: Column, evaluation: Column, need: tuple[int, int]) -> DataFrame:
    evaluation_days, source_days = need
    missing = F.greatest(F.lit(0).cast("long"), F.lit(source_days) - available)
    ok = (missing == 0) & (evaluation >= evaluation_days)
    return row.withColumns({
        "available_history_days": available, "required_history_days": F.lit(source_days), "missing_history_days": missing,
        "evaluation_days_available": evaluation, "evaluation_days_required": F.lit(evaluation_days), "data_sufficient": ok,
        "status": F.when(ok, "READY").otherwise("INSUFFICIENT_DATA"),
    })


def order_readiness(lines: DataFrame, max_lag_days: int = 28, folds: Folds = FOLDS) -> DataFrame:
    """One-row report from order lines; days without any order do not count as history."""
    day = F.col("create_time").cast("date")
    row = lines.filter(~F.col("is_cancelled")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("sku").alias("sku_count"),
        F.count_distinct(day).alias("active_source_days"), F.min(day).alias("history_start"), F.max(day).alias("history_end"),
        F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(0)).alias("calendar_span_days"))
    evaluation = F.greatest(F.lit(0).cast("long"), F.col("active_source_days") - max_lag_days - 1)
    return _readiness(row, F.col("active_source_days"), evaluation, folds.history(max_lag_days=max_lag_days))


def feature_readiness(store: DataFrame, max_lag_days: int = 28, folds: Folds = FOLDS) -> DataFrame:
    """One-row report from a feature store."""
    day = F.date_add("date", 1)
    row = store.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("sku").alias("sku_count"),
        F.count_distinct(day).alias("active_source_days"), F.min(day).alias("history_start"), F.max(day).alias("history_end"))
    available = F.col("active_source_days") + max_lag_days + 1
    return _readiness(row, available, F.col("active_source_days"), folds.history(max_lag_days=max_lag_days))


def status_transitions(history: DataFrame, key: list[str], at: str) -> DataFrame:
    """Changed and recovered flags against the previous report of the same key."""
    w = Window.partitionBy(*key).orderBy(at)
    before = F.lag("status").over(w)
    changed = ~before.eqNullSafe(F.col("status")) | ~F.lag("missing_history_days").over(w).eqNullSafe(F.col("missing_history_days")) \
        | ~F.lag("available_history_days").over(w).eqNullSafe(F.col("available_history_days"))
    return history.withColumns({
        "previous_status": before, "changed": changed,
        "recovered": F.coalesce((before == "INSUFFICIENT_DATA") & (F.col("status") == "READY"), F.lit(False)),
    })


# ---- batch forecasts --------------------------------------------------------------------

def batch_forecast(requests: DataFrame, daily: DataFrame, last_known: Column, model: str = "moving_average",
                   history_days: int = V.HISTORY_DAYS, catalog_mean: float = 1.0, source: str = "spark_baseline") -> DataFrame:
    """Forecast rows for a request table (request_id, sku, from_date, to_date), all in one job; every request has at least one row.

    History ends at the day before the request or at the last known day, whichever is earlier. A request that breaks a rule of
    ``forecast_request_rules`` yields one row without a date and quantity, and the rule as its reason. A SKU without demand in its window is
    forecast by the heuristic: from the mean of its history where it has days at all (``heuristic_history``), else from ``catalog_mean``
    (``heuristic_catalog``). ``source`` labels the rows of the model.
    """
    end = F.least(F.date_sub("from_date", 1), last_known)
    judged = requests.withColumn("history_end", end)
    judged = judged.withColumn("reason", F.concat_ws("; ", *forecast_request_rules(F.col("history_end"))))
    refused = judged.filter("reason <> ''").select(
        "request_id", "sku", F.lit(None).cast("date").alias("date"), *[F.lit(None).cast("double").alias(c) for c in ("predicted_quantity", "lower_bound", "upper_bound")],
        F.lit("refused").alias("model_source"), F.lit("none").alias("history_source"), "history_end", "reason")
    # Requests for the same SKU and last known day share history, statistics and path, so these are computed once for each such pair, as far as
    # its longest request goes. The requests are dealt to tasks of their own: a table of them may be one small file and many days of answers.
    asked = judged.filter("reason = ''").withColumns({"_steps": F.datediff("to_date", "history_end")})
    asked = asked.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id", "sku", "from_date")
    pairs = asked.groupBy("sku", "history_end").agg(F.max("_steps").alias("_steps"))
    usable = history_as_of(pairs, daily, "history_end", history_days).withColumn("history", F.transform("history", lambda r: r["daily_demand"]))
    recent = F.slice(F.col("history"), F.greatest(F.size("history") - V.STATS_WINDOW_DAYS + 1, F.lit(1)), F.lit(V.STATS_WINDOW_DAYS))
    total = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x * x)
    mean, sigma = S.statistics_from_sums(F.size(recent), total, squares)
    known = F.size("history") > 0
    sold = F.exists("history", lambda y: y > 0)
    path = F.array().cast("array<double>") if model == "heuristic" else F.when(sold, recurse(F.col("history"), F.col("_steps"), baseline_step(model), history_days))
    shared = usable.select(
        F.col("sku").alias("_sku"), F.col("history_end").alias("_end"), F.when(known, mean).otherwise(F.lit(catalog_mean)).alias("hist_mean"),
        F.when(known, sigma).otherwise(F.lit(0.0)).alias("sigma"), known.alias("_known"), sold.alias("_sold"), path.alias("_path"))
    usable = asked.join(shared, F.col("sku").eqNullSafe(F.col("_sku")) & F.col("history_end").eqNullSafe(F.col("_end")))
    known, sold = F.col("_known"), F.col("_sold")
    kind = F.when(known, "heuristic_history").otherwise("heuristic_catalog")
    by_rule = usable if model == "heuristic" else usable.filter(~sold)
    items = by_rule.select("*", F.explode(F.sequence("from_date", "to_date")).alias("date")).withColumns({
        "raw": S.heuristic_demand(F.col("hist_mean"), F.col("date")), "_widen": F.sqrt(S.sale_factor(F.col("date"))), "model_source": kind})
    if model != "heuristic":
        own = F.when(F.col("_steps") >= 1, F.slice("_path", F.lit(1), F.greatest("_steps", F.lit(0))))
        modelled = usable.filter(sold).select("*", F.posexplode(own).alias("_p", "raw")).withColumns({
            "date": F.date_add("history_end", F.col("_p") + 1), "_widen": F.lit(1.0), "model_source": F.lit(source),
        }).filter(F.col("date") >= F.col("from_date")).drop("_p")
        items = items.unionByName(modelled)
    quantity = F.round(F.col("raw") + 1e-9, 1)
    lower, upper = S.interval_bounds(F.col("predicted_quantity"), F.col("sigma"), F.col("_widen"))
    return items.withColumn("predicted_quantity", quantity).withColumns({
        "lower_bound": lower, "upper_bound": upper, "history_source": F.when(known, "warehouse").otherwise("none")}).select(
        "request_id", "sku", "date", "predicted_quantity", "lower_bound", "upper_bound", "model_source", "history_source", "history_end",
        F.lit("").alias("reason")).unionByName(refused)


def forecast_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("request_id", "sku", "model_source", "history_source").agg(
        F.round(F.sum("predicted_quantity"), 1).alias("total_quantity"), F.count(F.lit(1)).alias("days"))
