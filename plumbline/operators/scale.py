"""Metric scale of a reconstruction from one of five kinds of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite
from plumbline.operators.ranks import exact_percentiles, upper_middle

# The accepted modes, and whether each may see reference geometry.
SCALE_MODES = ["camera_height", "trajectory", "metric_model", "known_object", "oracle_reference"]
REGRESSION_MODES = ["trajectory", "oracle_reference"]


def _positive(c: str) -> Column:
    return F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False))


def _not_negative(c: str) -> Column:
    return F.coalesce(finite(F.col(c)) & (F.col(c) >= 0), F.lit(False))


def request_faults(observations: DataFrame) -> DataFrame:
    """First fault of each request, NULL when it may be solved.

    ``observations``: request_id, mode, observation_id, predicted, metric,
    uncertainty. Repeated ids are found by counting per id first, so one huge
    request is still aggregated in parts.
    """
    per_id = observations.groupBy("request_id", "mode", "observation_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.bool_and(_positive("predicted")).alias("_predicted"),
        F.bool_and(_positive("metric")).alias("_metric"),
        F.bool_and(_not_negative("uncertainty")).alias("_uncertainty"),
    )
    needs_metric = F.col("mode") != "metric_model"
    fault = (
        F.when(~F.col("mode").isin(*SCALE_MODES), F.lit("unsupported scale mode"))
        .when(F.max("_rows") > 1, F.lit("observation ids must be unique"))
        .when(needs_metric & ~F.bool_and("_predicted"), F.lit("predicted must be positive"))
        .when(needs_metric & ~F.bool_and("_metric"), F.lit("metric must be positive"))
        .when(~F.bool_and("_uncertainty"), F.lit("uncertainty must not be negative"))
    )
    return per_id.groupBy("request_id", "mode").agg(
        F.sum("_rows").alias("observations"), fault.alias("fault")
    )


def even_median(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Median that averages the two middle values of an even group, for groups of any size."""
    middle = exact_percentiles(
        df, keys, value, {"_lo": 50, "_hi": 50}, ranks={"_hi": upper_middle}
    )
    return middle.select(*keys, ((F.col("_lo") + F.col("_hi")) / f64(2)).alias(out))


def camera_height_scale(observations: DataFrame) -> DataFrame:
    """Known camera height over the median predicted height.

    ``metric`` is the known height and ``uncertainty`` its uncertainty, equal on
    every row of a request.
    """
    keys = ["request_id", "mode"]
    middle = even_median(observations, keys, F.col("predicted"), "_median")
    rows = observations.join(middle, keys).withColumn("factor", F.col("metric") / F.col("_median"))
    each = F.col("metric") / F.col("predicted")
    off = F.col("predicted") * F.col("factor") - F.col("metric")
    grouped = rows.groupBy(*keys).agg(
        F.first("factor").alias("factor"),
        F.count(F.lit(1)).alias("observation_count"),
        (F.coalesce(F.stddev_samp(each), f64(0)) / F.sqrt(F.count(F.lit(1)))).alias("_sem"),
        F.first(F.col("factor") * F.col("uncertainty") / F.col("metric")).alias("_cal"),
        F.sqrt(F.avg(off * off)).alias("rmse_m"),
        F.max(F.abs(off)).alias("max_abs_m"),
    )
    total = F.sqrt(F.col("_cal") * F.col("_cal") + F.col("_sem") * F.col("_sem"))
    return grouped.select(
        *keys, "factor", "observation_count", "rmse_m", "max_abs_m", total.alias("factor_uncertainty")
    )


def regression_scale(observations: DataFrame) -> DataFrame:
    """Through-origin fit of metric on predicted distances with fit and measurement uncertainty."""
    keys = ["request_id", "mode"]
    p, m, u = F.col("predicted"), F.col("metric"), F.col("uncertainty")
    sums = observations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.sum(p * p).alias("_pp"),
        (F.sum(p * m) / F.sum(p * p)).alias("factor"),
        (F.sqrt(F.sum((u / p) * (u / p))) / F.count(F.lit(1))).alias("_measured"),
    )
    off = p * F.col("factor") - m
    grouped = (
        observations.join(sums, keys)
        .groupBy(*keys, "observation_count", "factor", "_pp", "_measured")
        .agg(
            F.sum(off * off).alias("_ss"),
            F.max(F.abs(off)).alias("max_abs_m"),
        )
    )
    n = F.col("observation_count")
    fit = F.col("_ss") / F.greatest(F.lit(1), n - 1) / F.col("_pp")
    return grouped.select(
        *keys,
        "factor",
        "observation_count",
        F.sqrt(F.col("_ss") / n).alias("rmse_m"),
        "max_abs_m",
        F.sqrt(fit + F.col("_measured") * F.col("_measured")).alias("factor_uncertainty"),
    )


def declared_scale(observations: DataFrame) -> DataFrame:
    """Single-statement modes: a metric model (factor 1) or one object of known size."""
    model = F.col("mode") == "metric_model"
    factor = F.when(model, f64(1)).otherwise(F.col("metric") / F.col("predicted"))
    spread = F.when(model, F.col("uncertainty")).otherwise(F.col("uncertainty") / F.col("predicted"))
    return observations.select(
        "request_id",
        "mode",
        factor.alias("factor"),
        F.lit(1).cast("long").alias("observation_count"),
        f64(0).alias("rmse_m"),
        f64(0).alias("max_abs_m"),
        spread.alias("factor_uncertainty"),
    )


def solve_scale(observations: DataFrame) -> DataFrame:
    """Dispatch every valid request on its mode; faulty requests come back refused."""
    keys = ["request_id", "mode"]
    faults = request_faults(observations)
    good = observations.join(faults.where(F.col("fault").isNull()), keys, "left_semi")
    by = lambda *modes: good.where(F.col("mode").isin(*modes))
    solved = (
        camera_height_scale(by("camera_height"))
        .unionByName(regression_scale(by(*REGRESSION_MODES)))
        .unionByName(declared_scale(by("metric_model", "known_object")))
    )
    return faults.join(solved, keys, "left").select(
        *keys,
        F.when(F.col("fault").isNull(), F.lit("ok")).otherwise(F.lit("refused")).alias("status"),
        "fault",
        "factor",
        F.when(F.col("mode") == "metric_model", F.lit("unitless"))
        .otherwise(F.lit("metre_per_model_unit"))
        .alias("factor_unit"),
        F.coalesce("observation_count", "observations").alias("observation_count"),
        "rmse_m",
        "max_abs_m",
        "factor_uncertainty",
        F.when(F.col("mode") == "oracle_reference", F.lit("oracle_only"))
        .otherwise(F.lit("forbidden"))
        .alias("reference_policy"),
    )
