"""Grading against known lengths: error models, uncertainty budgets, scale factors.

Scale never crosses clips or settings: the caller's ``keys`` name the group a
model belongs to. Bias and uncertainty stay in separate columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite

MIN_TRIALS_FOR_SPREAD = 3


def usable(observations: DataFrame) -> DataFrame:
    return observations.where(
        finite(F.col("truth")) & finite(F.col("predicted")) & (F.col("truth") > 0)
    )


def _line(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    t, p = F.col("truth"), F.col("predicted")
    sums = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(t * p).alias("_tp"),
        F.sum(p * p).alias("_pp"),
        F.regr_sxx(p, t).alias("_sxx"),
        F.regr_slope(p, t).alias("_slope"),
        F.regr_intercept(p, t).alias("_intercept"),
    )
    line = (F.col("observations") >= 2) & (F.col("_sxx") > f64(1e-12))
    return sums.select(
        *keys,
        "observations",
        "_pp",
        F.when(line, F.col("_slope")).alias("slope"),
        F.when(line, F.col("_intercept")).alias("intercept"),
        F.when(F.col("_pp") > 0, F.col("_tp") / F.col("_pp")).alias("scale_factor"),
    )


def error_residuals(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each usable observation with its fitted value, residual and plain error."""
    data = usable(observations)
    fitted = F.col("slope") * F.col("truth") + F.col("intercept")
    return (
        data.join(_line(data, keys), list(keys))
        .withColumn("fitted", fitted)
        .withColumn("residual", F.col("predicted") - F.col("fitted"))
        .withColumn("error", F.col("predicted") - F.col("truth"))
    )


def fit_error_model(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line and through-origin factor per group with its standard error and residual sizes."""
    rows = error_residuals(observations, keys)
    off = F.col("truth") - F.col("scale_factor") * F.col("predicted")
    head = ["observations", "slope", "intercept", "scale_factor", "_pp"]
    grouped = rows.groupBy(*keys, *head).agg(
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("residual_rms"),
        F.sum(off * off).alias("_ss"),
        F.max(F.abs("error")).alias("max_abs_error"),
        F.avg(F.abs("error") / F.col("truth")).alias("mean_abs_rel"),
    )
    stderr = F.when(
        (F.col("observations") >= 2) & (F.col("_pp") > 0),
        F.sqrt(F.col("_ss") / F.nullif(F.col("observations") - 1, F.lit(0)) / F.col("_pp")),
    )
    return grouped.select(
        *keys,
        "observations",
        "slope",
        "intercept",
        "residual_rms",
        "scale_factor",
        stderr.alias("scale_factor_stderr"),
        "max_abs_error",
        "mean_abs_rel",
    )


def scale_verdict(predicted: Column, truth: Column, tolerance: Column) -> Column:
    known = finite(predicted) & finite(truth) & finite(tolerance)
    within = F.abs(predicted - truth) <= tolerance
    return (
        F.when(~known, F.lit("unknown"))
        .when(within, F.lit("within-uncertainty"))
        .otherwise(F.lit("biased"))
    )


def quadrature(*terms: Column) -> Column:
    """Root sum of squares of the positive terms; NULL when there is none."""
    counted = [F.when(finite(t) & (t > 0), t) for t in terms]
    total = reduce(lambda a, b: a + b, (F.coalesce(t * t, f64(0)) for t in counted))
    return F.when(F.coalesce(*counted).isNotNull(), F.sqrt(total))


def compose_uncertainty(rows: DataFrame) -> DataFrame:
    """Add the budget of each reading.

    Reads value_m, roughness_m, operator_range_m and a model (observations,
    scale_factor, scale_factor_stderr, residual_rms; NULL without one). Random
    and systematic parts are separate; bias is a third thing and is never added in.
    """
    keep = rows.columns
    value = F.col("value_m")
    rough = F.when(finite(F.col("roughness_m")), F.abs("roughness_m"))
    half = F.when(finite(F.col("operator_range_m")), F.abs("operator_range_m") / f64(2))
    factor = F.col("scale_factor")
    calibrated = F.coalesce(
        (F.col("observations") >= 2) & finite(factor) & (factor > 0), F.lit(False)
    )
    only = lambda c: F.when(F.col("calibrated"), c)
    stderr = F.when(
        finite(F.col("scale_factor_stderr")), F.abs(value * F.col("scale_factor_stderr"))
    )
    spread = F.when(finite(F.col("residual_rms")), F.abs("residual_rms"))
    base = (
        rows.withColumn("calibrated", calibrated)
        .withColumn("_rough", rough)
        .withColumn("_half", half)
        .withColumn("_factor_term", only(stderr))
        .withColumn("_spread_term", only(spread))
        .withColumn("random_m", quadrature(F.col("_rough"), F.col("_half")))
        .withColumn("systematic_m", quadrature(F.col("_factor_term"), F.col("_spread_term")))
        .withColumn("bias_relative", only(f64(1) / factor - f64(1)))
        .withColumn("calibrated_m", only(value * factor))
        .withColumn(
            "calibrated_uncertainty_m",
            only(quadrature(F.col("random_m") * factor, F.col("systematic_m"))),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), f64(0))
    dominant = (
        F.when(~F.col("calibrated"), F.lit("unknown"))
        .when(F.col("systematic_m") >= zero("random_m"), F.lit("systematic"))
        .when(F.col("_half") >= zero("_rough"), F.lit("operator"))
        .otherwise(F.lit("roughness"))
    )
    # The basis wording and term labels that readings are filed under.
    basis = F.concat_ws(
        " · ",
        F.when(F.col("_rough").isNotNull(), F.lit("patch roughness")).otherwise(
            F.lit("no patch roughness")
        ),
        F.when(F.col("_half").isNotNull(), F.lit("repeat trials")).otherwise(
            F.lit(f"no operator term (needs {MIN_TRIALS_FOR_SPREAD} trials)")
        ),
        F.when(
            F.col("calibrated"),
            F.format_string("scale fitted over %d graded objects", F.col("observations")),
        ).otherwise(F.lit("no calibration basis in this setting")),
    )
    term = lambda label, kind, c: F.when(
        F.col(c).isNotNull(),
        F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col(c).alias("value_m")),
    )
    terms = F.array_compact(
        F.array(
            term("patch roughness", "random", "_rough"),
            term("operator repeatability", "random", "_half"),
            term("correction factor", "systematic", "_factor_term"),
            term("calibration residual", "systematic", "_spread_term"),
        )
    )
    stated = F.when(F.col("calibrated"), F.col("calibrated_uncertainty_m")).otherwise(
        F.col("random_m")
    )
    return base.select(
        *keep,
        "calibrated",
        "random_m",
        "systematic_m",
        "bias_relative",
        "calibrated_m",
        "calibrated_uncertainty_m",
        dominant.alias("dominant"),
        basis.alias("basis"),
        terms.alias("terms"),
        stated.alias("stated_m"),
    )


def scale_check(measurements: DataFrame, truths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error, relative error, factor and verdict of single readings against a known truth."""
    joined = measurements.join(truths, list(keys))
    raw, truth = F.col("raw_m"), F.col("truth_m")
    error = raw - truth
    random = quadrature(F.abs(F.col("internal_spread_m")))
    return joined.select(
        *measurements.columns,
        "truth_m",
        error.alias("error_m"),
        (F.abs(error) / truth).alias("absolute_relative_error"),
        (truth * raw / F.nullif(raw * raw, f64(0))).alias("correction_factor"),
        random.alias("random_m"),
        scale_verdict(raw, truth, random).alias("verdict"),
    )


def calibration_targets(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest available target with a known truth, per group."""
    known = targets.where(F.col("truth_m").isNotNull() & F.col("availability_note").isNull())
    best = F.max_by(F.struct("object_id", "truth_m"), F.struct("truth_m", "object_id"))
    return known.groupBy(*keys).agg(best.alias("c")).select(
        *keys,
        F.col("c.object_id").alias("object_id"),
        F.col("c.truth_m").alias("truth_m"),
    )


def clip_scale_factors(
    means: DataFrame, calibrators: DataFrame, clip_keys: Sequence[str], run_keys: Sequence[str]
) -> DataFrame:
    """Truth over mean reading of the calibration target, per run."""
    factor = F.when(F.col("mean_m") > 0, F.col("truth_m") / F.col("mean_m"))
    return means.join(calibrators, [*clip_keys, "object_id"]).select(
        *run_keys, F.col("object_id").alias("calibrator"), factor.alias("factor")
    )


def setting_comparison(
    means: DataFrame,
    targets: DataFrame,
    clip_keys: Sequence[str],
    setting_keys: Sequence[str],
) -> DataFrame:
    """Mean absolute error of the held-out targets per setting, raw and corrected."""
    calibrators = calibration_targets(targets, clip_keys)
    factors = clip_scale_factors(means, calibrators, clip_keys, setting_keys)
    held = targets.where(
        F.col("truth_m").isNotNull() & F.col("availability_note").isNull()
    ).join(calibrators.select(*clip_keys, "object_id"), [*clip_keys, "object_id"], "left_anti")
    raw = F.abs(F.col("mean_m") - F.col("truth_m"))
    corrected = F.abs(F.col("mean_m") * F.col("factor") - F.col("truth_m"))
    return (
        means.where(finite(F.col("mean_m")))
        .join(held.select(*clip_keys, "object_id", "truth_m"), [*clip_keys, "object_id"])
        .join(factors, list(setting_keys), "left")
        .groupBy(*setting_keys, "factor")
        .agg(
            F.count(F.lit(1)).alias("views"),
            F.avg(raw).alias("raw_mae"),
            F.avg(corrected).alias("corrected_mae"),
        )
    )
