"""Trained regressors in the walk-forward back-test, with recursive multi-step scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import vocab as V
from marketloom.operators import forecast as P
from marketloom.session import checkpoint_root, materialise

TARGET = "target_t_plus_1"
STATIC = ("abc_class_code", "xyz_class_code", "matrix_class_code", "category_code", "cv", "safety_stock")
CALENDAR = ("day_of_week", "is_weekend", "day_of_month", "month", "quarter", "is_mega_sale", "target_day_of_week",
            "target_is_weekend", "target_day_of_month", "target_is_mega_sale")


def regressor(name: str, **params):
    """``gbt`` or ``forest``; ridge regressions are solved from sums, see ``ridge_weights``."""
    common = dict(featuresCol="features", labelCol=TARGET, predictionCol="prediction")
    if name == "gbt":
        return GBTRegressor(maxIter=params.get("trees", 20), maxDepth=params.get("depth", 5),
                            stepSize=params.get("rate", 0.1), seed=42, **common)
    if name == "forest":
        return RandomForestRegressor(numTrees=params.get("trees", 20), maxDepth=params.get("depth", 8), seed=42, **common)
    raise ValueError(name)


def _assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


def _ema_step(a: float):
    return lambda level, x: F.coalesce(level * (1 - a) + x * a, x)


def state_features(history: Column, day: Column, price: Column, orders: Column, discount: Column, revenue: Column,
                   lags=V.DEFAULT_LAGS, windows=V.ROLLING_WINDOWS, spans=V.EMA_SPANS) -> dict[str, Column]:
    """The feature row of ``day`` from a demand array ending that day; equals the batch features."""
    present = lambda k: F.try_element_at(history, F.lit(-(k + 1)))
    out: dict[str, Column] = {
        "daily_demand": present(0), "daily_revenue": revenue, "avg_unit_price": price, "total_discount": discount, "order_count": orders,
    }
    for k in lags:
        out[f"lag_{k}"] = present(k)
    for n in windows:
        part = P._previous(history, n)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x)
        mean, std = S.statistics_from_sums(F.size(part), total, squares)
        out[f"rolling_mean_{n}"] = F.when(F.size(part) > 0, mean)
        out[f"rolling_std_{n}"] = std
        out[f"rolling_max_{n}"] = F.array_max(part)
        out[f"rolling_min_{n}"] = F.array_min(part)
    before = F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0)))
    for s in spans:
        out[f"ema_{s}"] = F.aggregate(before, F.lit(None).cast("double"), _ema_step(2.0 / (s + 1)))
    if 1 in lags and 7 in lags:
        out["growth_wow"] = (present(1) - present(7)) / (present(7) + 1.0)
    t = F.date_add(day, 1)
    out |= {
        "day_of_week": F.weekday(day), "is_weekend": (F.weekday(day) >= 5).cast("int"), "day_of_month": F.dayofmonth(day),
        "month": F.month(day), "quarter": F.quarter(day), "is_mega_sale": S.is_sale_day(day).cast("int"),
        "target_day_of_week": F.weekday(t), "target_is_weekend": (F.weekday(t) >= 5).cast("int"),
        "target_day_of_month": F.dayofmonth(t), "target_is_mega_sale": S.is_sale_day(t).cast("int"),
    }
    return out


def model_columns(store: DataFrame) -> list[str]:
    from marketloom.operators.features import feature_columns

    return feature_columns(store)


Predict = Callable[[DataFrame], DataFrame]


def forecast_paths(predict: Predict, state: DataFrame, horizon: int, cut_every: int = 5, keep: int = V.HISTORY_DAYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Advance all SKUs one day at a time; every step is one distributed scoring of the whole state.

    The steps are narrow (no shuffle). Lineage is cut every few steps with a reliable checkpoint. ``predict`` adds ``prediction`` to feature rows.
    ``state``: sku, day, history, price, per_order, orders, discount, revenue, the static columns, and those to ``carry`` along.
    """
    checkpoint_root(state.sparkSession)
    current = state.withColumn("path", F.array().cast("array<double>"))
    for i in range(1, horizon + 1):
        row = state_features(F.col("history"), F.col("day"), F.col("price"), F.col("orders"), F.col("discount"), F.col("revenue"))
        scored = predict(current.withColumns(row))
        y = F.greatest(F.lit(0.0), F.col("prediction"))
        grown = F.array_append("history", F.col("_y"))
        current = scored.withColumn("_y", y).select(
            "sku", F.date_add("day", 1).alias("day"),
            F.slice(grown, F.greatest(F.size(grown) - keep + 1, F.lit(1)), F.lit(keep)).alias("history"),
            "price", "per_order",
            F.when(F.col("per_order") != 0, F.col("_y") / F.col("per_order")).otherwise(0.0).alias("orders"),
            F.lit(0.0).alias("discount"), (F.col("_y") * F.col("price")).alias("revenue"),
            *[c for c in STATIC if c in state.columns], *carry, F.array_append("path", F.col("_y")).alias("path"))
        if i % cut_every == 0 and i < horizon:
            current = current.checkpoint()
    return current


def origin_state(store: DataFrame, daily: DataFrame, origin, history_days: int = V.HISTORY_DAYS) -> DataFrame:
    """State of every servable SKU at the forecast origin (a date literal)."""
    day = F.lit(origin).cast("date")
    recent = daily.filter((F.col("date") <= day) & (F.col("date") > F.date_sub(day, history_days)))
    packed = recent.groupBy("sku").agg(
        F.sort_array(F.collect_list(F.struct("date", "daily_demand"))).alias("s"),
        F.max_by(F.struct("avg_unit_price", "order_count", "total_discount", "daily_revenue"), "date").alias("l"),
        F.max("date").alias("_end"),
        F.sum(F.when(F.col("date") > F.date_sub(day, V.STATS_WINDOW_DAYS), F.col("daily_demand"))).alias("_q"),
        F.sum(F.when(F.col("date") > F.date_sub(day, V.STATS_WINDOW_DAYS), F.col("order_count"))).alias("_o"),
    ).filter((F.col("_end") == day) & F.exists("s", lambda r: r["daily_demand"] > 0))
    profile = store.groupBy("sku").agg(*[F.min(c).alias(c) for c in STATIC if c in store.columns])
    return packed.join(profile, "sku").select(
        "sku", day.alias("day"), F.transform("s", lambda r: r["daily_demand"]).alias("history"),
        F.col("l.avg_unit_price").alias("price"),
        F.when(F.col("_o") > 0, F.col("_q") / F.col("_o")).otherwise(1.0).alias("per_order"),
        F.col("l.order_count").alias("orders"), F.col("l.total_discount").alias("discount"),
        F.col("l.daily_revenue").alias("revenue"), *[c for c in STATIC if c in store.columns])


def _folds(rows: DataFrame, folds: P.Folds) -> list[Row]:
    """fold, start and end of the test windows: a row for each fold."""
    tests = P.fold_dates(rows, folds=folds).filter("role = 'test'")
    return tests.groupBy("fold").agg(F.min("target_date").alias("start"), F.max("target_date").alias("end")).orderBy("fold").collect()


def _targets(paths: DataFrame, name: str, *keep: str) -> DataFrame:
    """A row for each forecast day of paths that hold their fold's ``start`` and ``end``."""
    flat = paths.select("sku", "fold", *keep, "start", "end", F.posexplode("path").alias("_p", name))
    return flat.select("sku", "fold", *keep, F.date_add("start", F.col("_p")).alias("target_date"), (F.col("_p") + 1).alias("horizon"), name, "end").filter("target_date <= end").drop("end")


def backtest_model(store: DataFrame, daily: DataFrame, name: str, params: dict | None = None, folds: P.Folds = P.FOLDS) -> DataFrame:
    """Fit per fold on all labels before the test window and forecast the window recursively.

    ``store`` and ``daily`` should be written tables: every fold reads them again.
    """
    if name == "ridge":
        return backtest_ridge(store, daily, [(params or {}).get("alpha", 10.0)], folds).drop("alpha")
    rows = store.withColumn("target_date", F.date_add("date", 1))
    columns = model_columns(store)
    parts: list[DataFrame] = []
    for fold in _folds(rows, folds):
        fit = rows.filter(F.col("target_date") < F.lit(fold["start"]))
        model = regressor(name, **(params or {})).fit(_assemble(fit, columns).select("features", TARGET))
        state = origin_state(store, daily, F.date_sub(F.lit(fold["start"]), 1)).withColumns({k: F.lit(fold[k]) for k in ("fold", "start", "end")})
        paths = forecast_paths(lambda df, m=model: m.transform(_assemble(df, columns)), state, (fold["end"] - fold["start"]).days + 1, carry=("fold", "start", "end"))
        parts.append(_targets(paths, name))
    return P.scored_rows(rows, reduce(DataFrame.unionByName, parts), (name,))


# ---- ridge in closed form ---------------------------------------------------------------

def gram_sums(rows: DataFrame, columns: list[str], group: Column) -> dict[int, np.ndarray]:
    """Sums of the products of (1, features, target) over the rows of each group, from one pass.

    A task adds up its own matrices, so what is shuffled, and what comes to the driver, is a matrix of the features for each group.
    """
    size = len(columns) + 2
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    flat = rows.select(group.cast("int").alias("part"), F.array(F.lit(1.0), *values, F.col(TARGET).cast("double")).alias("x")).filter("part is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for p in np.unique(part).tolist():
                own = x[part == p]
                sums[p] = sums.get(p, 0) + own.T @ own
        for p, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part", "cells"])

    cells = flat.mapInArrow(run, "part int, cells array<double>").select("part", F.posexplode("cells").alias("place", "cell"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("part", "place").agg(F.sum("cell").alias("cell")).collect():
        out.setdefault(r["part"], np.zeros(size * size))[r["place"]] = r["cell"]
    return {p: total.reshape(size, size) for p, total in out.items()}


def ridge_weights(gram: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the squared errors plus ``alpha`` times the squared weights, from sums of products."""
    n, sums, cross, own = gram[0, 0], gram[0, 1:-1], gram[1:-1, -1], gram[1:-1, 1:-1]
    mean, target = sums / n, gram[0, -1] / n
    spread = own - n * np.outer(mean, mean)
    # Least squares also solves the case without a penalty and with columns that repeat each other.
    weights = np.linalg.lstsq(spread + alpha * np.eye(len(mean)), cross - n * mean * target, rcond=None)[0]
    return float(target - mean @ weights), weights


def backtest_ridge(store: DataFrame, daily: DataFrame, alphas: list[float], folds: P.Folds = P.FOLDS) -> DataFrame:
    """Recursive walk-forward forecasts of ridge regressions with every penalty, in ``alpha``.

    The rows are read once to fit: a row counts for every fold whose test window begins after it, so the folds' matrices are running sums.
    All folds and penalties are then forecast together, each row of the state with its own weights.
    """
    rows, columns = store.withColumn("target_date", F.date_add("date", 1)), model_columns(store)
    tests = _folds(rows, folds)
    fits = reduce(lambda a, b: a + b, [F.when(F.col("target_date") < F.lit(t["start"]), 1).otherwise(0) for t in tests])
    sums = gram_sums(rows, columns, F.nullif(fits, F.lit(0)))
    states: list[DataFrame] = []
    for k, t in enumerate(tests, 1):
        gram = sum(total for part, total in sums.items() if part >= k)
        models = [F.struct(F.lit(float(a)).alias("alpha"), F.lit(w0).alias("base"), F.array(*[F.lit(float(w)) for w in ws]).alias("weights"))
                  for a, (w0, ws) in ((a, ridge_weights(gram, a)) for a in alphas)]
        state = origin_state(store, daily, F.date_sub(F.lit(t["start"]), 1)).withColumns({c: F.lit(t[c]) for c in ("fold", "start", "end")})
        states.append(state.select("*", F.inline(F.array(*models))))
    # Ready for one chain of steps, and not described anew in each of them.
    whole = materialise(reduce(DataFrame.unionByName, states), "ridge-state")

    @F.pandas_udf("double")
    def apply(features: pd.Series, weights: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", np.stack(features.to_numpy()), np.stack(weights.to_numpy())) + base.to_numpy())

    def predict(df: DataFrame) -> DataFrame:
        features = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
        return df.withColumn("prediction", apply(features, F.col("weights"), F.col("base")))

    horizon = max((t["end"] - t["start"]).days + 1 for t in tests)
    # Cut after each step: the optimizer would write the features of a step into those of all later ones.
    paths = forecast_paths(predict, whole, horizon, 1, carry=("fold", "start", "end", "alpha", "base", "weights"))
    return P.scored_rows(rows, _targets(paths, "ridge", "alpha"), ("ridge",))


def grid_search(store: DataFrame, daily: DataFrame, name: str, grid: dict[str, list], folds: P.Folds = P.FOLDS) -> DataFrame:
    """Walk-forward errors of every parameter combination, best first. Ridge penalties share one pass and one chain of forecasts."""
    if name == "ridge":
        scored = backtest_ridge(store, daily, [float(a) for a in grid["alpha"]], folds)
        named = F.concat(F.lit("alpha="), F.col("alpha").cast("string"))
        return P.metrics(scored.withColumn("params", named), ["model", "params"]).select("model", "params", "wape", "mae", "rmse").orderBy("wape", "params")
    lines: list[DataFrame] = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        scored = backtest_model(store, daily, name, params, folds)
        lines.append(P.metrics(scored, ["model"]).select("model", F.lit(", ".join(f"{k}={v}" for k, v in params.items())).alias("params"), "wape", "mae", "rmse"))
    return reduce(DataFrame.unionByName, lines).orderBy("wape", "params")


def compare_models(scored: DataFrame) -> DataFrame:
    """Per model of ``scored`` rows: how many folds, the mean of their errors, and the errors of all rows pooled."""
    per_fold = P.metrics(scored, ["model", "fold"]).groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), F.round(F.avg("wape") + 1e-9, 2).alias("mean_fold_wape"), F.round(F.avg("mae") + 1e-9, 4).alias("mean_fold_mae"))
    pooled = P.metrics(scored, ["model"]).select("model", F.col("wape").alias("pooled_wape"), F.col("mae").alias("pooled_mae"), F.col("rmse").alias("pooled_rmse"))
    return per_fold.join(pooled, "model")
