"""Error models, budgets and scale jobs over the trial and distance views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.operators import calibrate as K, scale as S
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6, r6s

TRIALS = A.cte("targets", "trials")

MODEL = """line AS (SELECT run_id, count(*) AS n, sum(truth_m * raw_m) / sum(raw_m * raw_m) AS f, sum(raw_m * raw_m) AS pp,
             regr_slope(raw_m, truth_m) AS slope, regr_intercept(raw_m, truth_m) AS intercept FROM trials GROUP BY ALL),
    model AS (SELECT run_id, any_value(n) AS observations, any_value(slope) AS slope, any_value(intercept) AS intercept,
             sqrt(avg((raw_m - slope * truth_m - intercept) ** 2)) AS residual_rms, any_value(f) AS scale_factor,
             sqrt(sum((truth_m - f * raw_m) ** 2) / (any_value(n) - 1) / any_value(pp)) AS scale_factor_stderr,
             max(abs(raw_m - truth_m)) AS max_abs_error, avg(abs(raw_m - truth_m) / truth_m) AS mean_abs_rel
           FROM trials JOIN line USING (run_id) GROUP BY run_id)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return A.trials(spark, sf).withColumnsRenamed({"truth_m": "truth", "raw_m": "predicted"})


@plan(
    "error_model",
    "K1, K2",
    TRIALS
    + f", {MODEL} SELECT run_id, observations, "
    + r6s("slope", "intercept", "residual_rms", "scale_factor", "scale_factor_stderr", "max_abs_error", "mean_abs_rel")
    + " FROM model",
)
def error_model(spark: SparkSession, sf: str) -> DataFrame:
    return publish(K.fit_error_model(observations(spark, sf), ["run_id"]))


@plan(
    "error_residuals",
    "K3, K4",
    TRIALS
    + f""", {MODEL} SELECT run_id, event_id, {r6('slope * truth_m + intercept', 'fitted')},
      {r6('raw_m - slope * truth_m - intercept', 'residual')}, {r6('raw_m - truth_m', 'error')},
      CASE WHEN abs(raw_m - truth_m) <= internal_spread_m THEN 'within-uncertainty' ELSE 'biased' END AS verdict
    FROM trials JOIN model USING (run_id)""",
)
def error_residuals(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.error_residuals(observations(spark, sf), ["run_id"])
    verdict = K.scale_verdict(F.col("predicted"), F.col("truth"), F.col("internal_spread_m"))
    return publish(
        rows.select("run_id", "event_id", "fitted", "residual", "error", verdict.alias("verdict"))
    )


@plan(
    "scale_check",
    "K5",
    TRIALS
    + f""" SELECT event_id, run_id, object_id, {r6s('raw_m', 'internal_spread_m', 'truth_m')}, {r6('raw_m - truth_m', 'error_m')},
      {r6('abs(raw_m - truth_m) / truth_m', 'absolute_relative_error')}, {r6('truth_m / raw_m', 'correction_factor')},
      {r6('CASE WHEN internal_spread_m > 0 THEN internal_spread_m END', 'random_m')},
      CASE WHEN internal_spread_m = 0 THEN 'unknown' WHEN abs(raw_m - truth_m) <= internal_spread_m THEN 'within-uncertainty' ELSE 'biased' END AS verdict
    FROM trials""",
)
def scale_check(spark: SparkSession, sf: str) -> DataFrame:
    readings = A.trials(spark, sf).select("event_id", "run_id", "object_id", "raw_m", "internal_spread_m")
    truths = A.targets(spark).select("object_id", "truth_m")
    return publish(K.scale_check(readings, truths, ["object_id"]))


BUDGET = f"""st AS (SELECT run_id, object_id, count(*) AS n, avg(raw_m) AS mean_m, max(raw_m) - min(raw_m) AS range_m,
             avg(internal_spread_m) AS rough FROM trials GROUP BY ALL),
    parts AS (SELECT s.run_id, object_id, mean_m, rough, CASE WHEN n >= 3 THEN range_m / 2e0 END AS half, m.scale_factor AS f, m.observations,
             abs(mean_m * scale_factor_stderr) AS ft, abs(residual_rms) AS sp FROM st s JOIN model m USING (run_id)),
    sums AS (SELECT *, sqrt(rough * rough + coalesce(half * half, 0e0)) AS random_m, sqrt(ft * ft + sp * sp) AS systematic_m FROM parts)"""


@plan(
    "uncertainty_budget",
    "K6, K7",
    TRIALS
    + f""", {MODEL}, {BUDGET} SELECT run_id, object_id, {r6s('random_m', 'systematic_m')}, {r6('1e0 / f - 1e0', 'bias_relative')},
      {r6('mean_m * f', 'calibrated_m')}, {r6('sqrt((random_m * f) ** 2 + systematic_m ** 2)', 'calibrated_uncertainty_m')},
      {r6('sqrt((random_m * f) ** 2 + systematic_m ** 2)', 'stated_m')}, true AS calibrated,
      CASE WHEN systematic_m >= random_m THEN 'systematic' WHEN half >= rough THEN 'operator' ELSE 'roughness' END AS dominant,
      'patch roughness · ' || CASE WHEN half IS NULL THEN 'no operator term (needs 3 trials)' ELSE 'repeat trials' END
        || ' · scale fitted over ' || observations || ' graded objects' AS basis,
      CAST(CASE WHEN half IS NULL THEN 3 ELSE 4 END AS BIGINT) AS term_count FROM sums""",
)
def uncertainty_budget(spark: SparkSession, sf: str) -> DataFrame:
    trials = A.trials(spark, sf)
    stats = trials.groupBy("run_id", "object_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("raw_m").alias("value_m"),
        F.avg("internal_spread_m").alias("roughness_m"),
        (F.max("raw_m") - F.min("raw_m")).alias("_range"),
    )
    ranged = F.when(F.col("n") >= K.MIN_TRIALS_FOR_SPREAD, F.col("_range"))
    model = K.fit_error_model(observations(spark, sf), ["run_id"]).select(
        "run_id", "observations", "scale_factor", "scale_factor_stderr", "residual_rms"
    )
    rows = stats.withColumn("operator_range_m", ranged).drop("_range").join(model, "run_id", "left")
    budget = K.compose_uncertainty(rows).withColumn("term_count", F.size("terms"))
    return publish(
        budget.select(
            "run_id", "object_id", "calibrated", "random_m", "systematic_m", "bias_relative", "calibrated_m",
            "calibrated_uncertainty_m", "dominant", "basis", "term_count", "stated_m",
        )
    )


def clip_means(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Mean reading per (clip, run, object), and targets; one target is not available."""
    trials = A.trials(spark, sf)
    means = trials.groupBy("run_id", "object_id").agg(F.avg("raw_m").alias("mean_m"))
    means = means.withColumn("clip_key", F.col("run_id") % 2)
    note = F.when(F.col("object_id") == "click", F.lit("out of view"))
    clips = means.select("clip_key").distinct()
    targets = A.targets(spark).withColumn("availability_note", note)
    every = clips.select("clip_key", F.explode(F.array(*(F.lit(o) for o, _ in A.TARGETS))).alias("object_id"))
    return means, every.join(targets, "object_id")


@plan(
    "setting_comparison",
    "K8, K9",
    TRIALS
    + f""", m AS (SELECT run_id, run_id % 2 AS clip_key, object_id, truth_m, avg(raw_m) AS mean_m FROM trials GROUP BY ALL),
    f AS (SELECT run_id, truth_m / mean_m AS factor FROM m WHERE object_id = 'purchase')
    SELECT clip_key, run_id, {r6s('factor')}, count(*) AS views, {r6('avg(abs(mean_m - truth_m))', 'raw_mae')},
      {r6('avg(abs(mean_m * factor - truth_m))', 'corrected_mae')}
    FROM m JOIN f USING (run_id) WHERE object_id NOT IN ('purchase', 'click') GROUP BY clip_key, run_id, factor""",
)
def setting_comparison(spark: SparkSession, sf: str) -> DataFrame:
    means, targets = clip_means(spark, sf)
    return publish(K.setting_comparison(means, targets, ["clip_key"], ["clip_key", "run_id"]))


OBS = A.cte("scale_obs")


@plan(
    "scale_camera_height",
    "K10",
    OBS
    + f""", h AS (SELECT request_id, predicted, max(metric) OVER (PARTITION BY request_id) AS known FROM scale_obs),
    m AS (SELECT request_id, known / median(predicted) AS factor FROM h GROUP BY request_id, known)
    SELECT request_id, 'camera_height' AS mode, {r6('any_value(factor)', 'factor')}, count(*) AS observation_count,
      {r6('sqrt(avg((predicted * factor - known) ** 2))', 'rmse_m')}, {r6('max(abs(predicted * factor - known))', 'max_abs_m')},
      {r6('sqrt((any_value(factor) * 2e-2 / any_value(known)) ** 2 + (coalesce(stddev_samp(known / predicted), 0e0) / sqrt(count(*))) ** 2)', 'factor_uncertainty')}
    FROM h JOIN m USING (request_id) GROUP BY request_id""",
)
def scale_camera_height(spark: SparkSession, sf: str) -> DataFrame:
    obs = A.scale_observations(spark, sf)
    known = obs.groupBy("request_id").agg(F.max("metric").alias("metric"))
    rows = obs.select("request_id", "predicted").join(known, "request_id").select(
        "request_id", F.lit("camera_height").alias("mode"), "predicted", "metric", f64(0.02).alias("uncertainty")
    )
    return publish(S.camera_height_scale(rows))


@plan(
    "scale_trajectory",
    "K11",
    OBS
    + f""", m AS (SELECT request_id, sum(predicted * metric) / sum(predicted * predicted) AS factor, sum(predicted * predicted) AS pp FROM scale_obs GROUP BY ALL)
    SELECT request_id, 'trajectory' AS mode, {r6('any_value(factor)', 'factor')}, count(*) AS observation_count,
      {r6('sqrt(avg((predicted * factor - metric) ** 2))', 'rmse_m')}, {r6('max(abs(predicted * factor - metric))', 'max_abs_m')},
      {r6('sqrt(sum((predicted * factor - metric) ** 2) / greatest(1, count(*) - 1) / any_value(pp) + sum((uncertainty / predicted) ** 2) / count(*) ** 2)', 'factor_uncertainty')}
    FROM scale_obs JOIN m USING (request_id) GROUP BY request_id""",
)
def scale_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.scale_observations(spark, sf).withColumn("mode", F.lit("trajectory"))
    return publish(S.regression_scale(rows))


# One request per order line group, in a mode by its key; an order line repeats its
# observation id when it appears twice, and those requests are refused.
REQUESTS = """req AS (SELECT l_orderkey AS request_id, CASE l_orderkey % 6 WHEN 0 THEN 'camera_height' WHEN 1 THEN 'trajectory'
        WHEN 2 THEN 'metric_model' WHEN 3 THEN 'known_object' WHEN 4 THEN 'oracle_reference' ELSE 'eyeball' END AS mode,
        l_linenumber AS observation_id, l_quantity AS predicted,
        CASE WHEN l_orderkey % 6 = 0 THEN 15e-1 ELSE l_quantity * (9e-1 + l_discount) END AS metric, 1e-2 + l_tax AS uncertainty FROM lineitem)"""


def scale_requests(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem")
    # The mode given to a request by its key.
    modes = ["camera_height", "trajectory", "metric_model", "known_object", "oracle_reference", "eyeball"]
    kind = F.get(F.array(*(F.lit(m) for m in modes)), (F.col("l_orderkey") % 6).cast("int"))
    metric = F.col("l_quantity") * (f64(0.9) + F.col("l_discount"))
    return li.select(
        F.col("l_orderkey").alias("request_id"),
        kind.alias("mode"),
        F.col("l_linenumber").alias("observation_id"),
        F.col("l_quantity").alias("predicted"),
        F.when(F.col("l_orderkey") % 6 == 0, f64(1.5)).otherwise(metric).alias("metric"),
        (f64(0.01) + F.col("l_tax")).alias("uncertainty"),
    )


@plan(
    "scale_requests",
    "K12, K13",
    f"""WITH {REQUESTS}, ids AS (SELECT request_id, observation_id, count(*) AS k FROM req GROUP BY ALL),
    worst AS (SELECT request_id, max(k) AS k FROM ids GROUP BY ALL),
    v AS (SELECT r.*, CASE WHEN mode = 'eyeball' THEN 'unsupported scale mode' WHEN k > 1 THEN 'observation ids must be unique' END AS fault
          FROM req r JOIN worst USING (request_id)),
    f AS (SELECT request_id, mode, CASE mode WHEN 'camera_height' THEN 15e-1 / median(predicted)
          WHEN 'metric_model' THEN 1e0 WHEN 'known_object' THEN max(metric / predicted)
          ELSE sum(predicted * metric) / sum(predicted * predicted) END AS factor FROM v WHERE fault IS NULL AND mode NOT IN ('metric_model', 'known_object') GROUP BY request_id, mode)
    SELECT v.request_id, v.mode, CASE WHEN fault IS NULL THEN 'ok' ELSE 'refused' END AS status, fault, {r6('any_value(f.factor)', 'factor')},
      CASE WHEN v.mode = 'metric_model' THEN 'unitless' ELSE 'metre_per_model_unit' END AS factor_unit, count(*) AS observation_count,
      CASE WHEN v.mode = 'oracle_reference' THEN 'oracle_only' ELSE 'forbidden' END AS reference_policy
    FROM v LEFT JOIN f ON f.request_id = v.request_id WHERE v.mode NOT IN ('metric_model', 'known_object') GROUP BY v.request_id, v.mode, fault
    UNION ALL
    SELECT request_id, mode, CASE WHEN fault IS NULL THEN 'ok' ELSE 'refused' END, fault,
      round(CASE WHEN fault IS NOT NULL THEN NULL WHEN mode = 'metric_model' THEN 1e0 ELSE metric / predicted END + 1e-9, 6) + 0e0,
      CASE WHEN mode = 'metric_model' THEN 'unitless' ELSE 'metre_per_model_unit' END, CASE WHEN fault IS NULL THEN 1 ELSE n END, 'forbidden'
    FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n,
            row_number() OVER (PARTITION BY request_id ORDER BY observation_id) AS at_ FROM v WHERE mode IN ('metric_model', 'known_object'))
    WHERE fault IS NULL OR at_ = 1""",
)
def scale_requests_plan(spark: SparkSession, sf: str) -> DataFrame:
    return publish(S.solve_scale(scale_requests(spark, sf)).drop("rmse_m", "max_abs_m", "factor_uncertainty"))
