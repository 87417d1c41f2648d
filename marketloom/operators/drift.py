"""Distribution drift: two-sample KS, PSI, flags and the retraining decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import vocab as V
from marketloom.operators.prefix import running_total
from marketloom.session import materialise


CURRENT_DAYS, REFERENCE_DAYS = 7, 28
DAYS = CURRENT_DAYS + REFERENCE_DAYS


def windows(store: DataFrame, current_days: int = CURRENT_DAYS, reference_days: int = REFERENCE_DAYS) -> DataFrame:
    """Rows of the two adjacent windows that end at the last date, labelled ``current`` or ``reference``."""
    last = store.agg(F.max("date").alias("m")).scalar()
    start = F.date_sub(last, current_days - 1)
    kept = store.filter(F.col("date") >= F.date_sub(start, reference_days))
    return kept.withColumn("window", F.when(F.col("date") >= start, "current").otherwise("reference"))


def require_windows(labelled: DataFrame) -> DataFrame:
    """Refuses windows of which one has no row: there is nothing to compare."""
    found = {r["window"] for r in labelled.select("window").distinct().collect()}
    if len(found) < 2:
        raise ValueError(f"rows in {' and '.join(sorted(found)) or 'neither'} window only, both are needed")
    return labelled


def histogram(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur): both samples reduced to counts per value, map-side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in columns])
    long = labelled.select("window", F.inline(pairs))
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("window") == "reference").alias("n_ref"), F.count_if(F.col("window") == "current").alias("n_cur"))


def _totals(hist: DataFrame) -> DataFrame:
    # One row per monitored feature, a fixed list, so it may be broadcast.
    return hist.groupBy("feature").agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        (F.sum(F.col("value") * F.col("n_ref")) / F.sum("n_ref")).alias("m_ref"),
        (F.sum(F.col("value") * F.col("n_cur")) / F.sum("n_cur")).alias("m_cur"))


def ks(hist: DataFrame) -> DataFrame:
    """KS statistic and asymptotic p-value per feature.

    One feature owns as many values as the data has, so the cumulative counts run over range
    slices and not in one window task per feature.
    """
    summed = running_total(hist, ["feature"], [F.col("value")], {"c_ref": "n_ref", "c_cur": "n_cur"})
    both = summed.join(F.broadcast(_totals(hist)), "feature")
    gaps = both.groupBy("feature").agg(
        F.max(F.abs(F.col("c_ref") / F.col("t_ref") - F.col("c_cur") / F.col("t_cur"))).alias("d"),
        F.max("t_ref").alias("t_ref"), F.max("t_cur").alias("t_cur"))
    n = F.sqrt(F.col("t_ref") * F.col("t_cur") / (F.col("t_ref") + F.col("t_cur")))
    lam = (n + 0.12 + 0.11 / n) * F.col("d")
    p = F.when(lam <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * F.exp(-2.0 * lam * lam))))
    empty = (F.col("t_ref") == 0) | (F.col("t_cur") == 0)
    return gaps.select("feature", F.when(empty, 0.0).otherwise(F.round("d", 4)).alias("ks_statistic"),
                       F.when(empty, 1.0).otherwise(F.round(p, 4)).alias("p_value"))


def psi(hist: DataFrame, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index over equal-width bins of the pooled range."""
    totals = _totals(hist)
    joined = hist.join(F.broadcast(totals), "feature")
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counted = joined.groupBy("feature", index.cast("int").alias("bin")).agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))
    dense = totals.select("feature", "t_ref", "t_cur", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = dense.join(counted, ["feature", "bin"], "left")
    p_ref = F.coalesce("r", F.lit(0)) / F.col("t_ref") + eps
    p_cur = F.coalesce("c", F.lit(0)) / F.col("t_cur") + eps
    term = (p_cur - p_ref) * F.log(p_cur / p_ref)
    flat = (F.col("lo") == F.col("hi")) | (F.col("t_ref") == 0) | (F.col("t_cur") == 0)
    return filled.groupBy("feature").agg(F.round(F.sum(F.when(flat, 0.0).otherwise(term)), 4).alias("psi"))


def feature_drift(hist: DataFrame, p_threshold: float = 0.05) -> DataFrame:
    """KS, PSI, means and the drift flag per feature."""
    hist = materialise(hist, "drift-histogram")
    means = _totals(hist).select("feature", F.round("m_ref", 2).alias("ref_mean"), F.round("m_cur", 2).alias("curr_mean"))
    return ks(hist).join(psi(hist), "feature").join(means, "feature").withColumn("drift_detected", F.col("p_value") < p_threshold)


def summary(drift: DataFrame, target: str = "daily_demand", share_threshold: float = 0.30) -> DataFrame:
    """Data drift by share of drifted features, and target drift separately; one row."""
    feature = F.col("feature") != target
    row = drift.agg(
        F.count_if(feature).alias("number_of_features"), F.count_if(feature & F.col("drift_detected")).alias("number_of_drifted_features"),
        F.array_sort(F.collect_list(F.when(feature & F.col("drift_detected"), F.col("feature")))).alias("drifted_features"),
        F.coalesce(F.bool_or(F.when(~feature, F.col("drift_detected"))), F.lit(False)).alias("target_drift_detected"))
    share = F.round(F.col("number_of_drifted_features") / F.greatest(F.col("number_of_features"), F.lit(1)), 3)
    row = row.withColumn("drift_share", share).withColumn("dataset_drift_detected", share >= share_threshold)
    return row.withColumn("drift_detected", F.col("dataset_drift_detected") | F.col("target_drift_detected"))


def summary_json(drift: DataFrame) -> DataFrame:
    """Nested form: one JSON object with the metrics of every feature."""
    return drift.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "feature", F.struct("ks_statistic", "p_value", "psi", "drift_detected", "ref_mean", "curr_mean").alias("m")))))).alias("features_evaluated"))


def retrain_decision(summaries: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """Decision per pair of drift summary and deployed model; the retraining itself is not run here."""
    s = summaries.join(manifests, "model_name")
    lists = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>")))
    same = (F.col("drift_origin").eqNullSafe(F.col("model_origin")) & (lists("drift_datasets") == lists("model_datasets"))
            & F.col("feature_data_source").eqNullSafe(F.lit("warehouse")))
    decision: Column = (
        F.when(F.lit(not force) & F.col("drift_detected") & (F.col("data_source") == "synthetic_demo"), "SKIPPED_SYNTHETIC")
        .when(F.lit(not force) & ~F.col("drift_detected"), "SKIPPED_HEALTHY")
        .when(F.col("model_origin").isNull(), "FAILED_NO_ORIGIN")
        .when(F.lit(not force) & ~same, "FAILED_PROVENANCE")
        .otherwise("RETRAIN"))
    trigger = F.when(F.lit(force) & ~F.col("drift_detected"), "manual_force").otherwise("data_drift")
    return s.withColumns({"decision": decision, "trigger": F.when(decision == "RETRAIN", trigger)})


MONITORED = list(V.DRIFT_COLUMNS)
