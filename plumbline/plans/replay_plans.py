"""Frozen masks of the frame view measured again over frames of which some are lost or altered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.operators import masks as M, poses as G, replay as R, trials as T
from plumbline.plans import adapters as A
from plumbline.plans.pixel_plans import ERODED, FLOOR20
from plumbline.plans.pose_plans import GRAVITY
from plumbline.plans.registry import plan, publish, r6, r6s
from plumbline.session import cut_lineage
from plumbline.sources import sinks

#: Masks were painted on a grid twice as fine as the frames.
GRID = 2 * A.SIDE
MIN_POINTS = 8
#: Every trial's plane lies this far below the camera.
LIFT = 0.25


def stored_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The frames as they are stored now: some are gone, some were written again with other depths."""
    scale = (
        F.when(F.col("frame") % 11 == 0, f64(1.0005)).when(F.col("frame") % 7 == 0, f64(1.000001)).otherwise(f64(1))
    )
    kept = A.frames(spark, sf).where(F.col("frame") % 13 != 0).withColumn("_scale", scale)
    return kept.withColumn("depth", F.transform("depth", lambda d: d * F.col("_scale"))).drop("_scale")


def frozen_trials(spark: SparkSession, sf: str) -> DataFrame:
    """One trial per mask: its run lengths and digest, its plane, and the reading taken when it was recorded."""
    fine = M.resample(A.masks(spark, sf), A.SIDE, A.SIDE, GRID, GRID)
    frozen = M.snapshot(M.encode_runs(fine, GRID), GRID, GRID)
    up = G.estimate_gravity(A.frames(spark, sf)).select(
        "run_id", F.col("ux").alias("nx"), F.col("uy").alias("ny"), F.col("uz").alias("nz")
    )
    frame = F.col("frame")
    recorded = cut_lineage(
        frozen.join(up, "run_id").select(
            F.concat_ws("-", "run_id", "object_id", "frame").alias("trial_id"),
            "run_id",
            "object_id",
            "frame",
            F.when(frame % 2 == 0, "vertical_extent").otherwise("top_above_floor").alias("mode"),
            F.lit(GRID).alias("mask_width"),
            F.lit(GRID).alias("mask_height"),
            "runs",
            "digest",
            "nx",
            "ny",
            "nz",
            f64(LIFT).alias("d"),
            (f64(1) + F.substring("object_id", 4, 1).cast("double") / 4).alias("truth_m"),
            (frame % 4 == 0).alias("automatic"),
        )
    )
    read = R.measure_again(recorded, A.frames(spark, sf), min_points=MIN_POINTS)
    trials = recorded.join(read.select("trial_id", F.col("replay_m").alias("stored_m")), "trial_id").where(
        F.col("stored_m").isNotNull()
    )
    # Of some trials the mask was lost, of some it is no longer the one recorded.
    empty = F.array().cast(recorded.schema["runs"].dataType)
    return cut_lineage(
        trials.withColumn("runs", F.when(frame % 17 == 0, empty).otherwise(F.col("runs"))).withColumn(
            "digest", F.when(frame % 19 == 0, F.reverse("digest")).otherwise(F.col("digest"))
        )
    )


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    return R.replay(frozen_trials(spark, sf), stored_frames(spark, sf), min_points=MIN_POINTS)


# The same by windows over the pixel view: ``now`` 0 is the recording, 1 what is stored today.
REPLAYED = (
    A.cte("px", "mask", "cam")
    + f""", {ERODED}, {FLOOR20}, {GRAVITY},
    twice AS (SELECT 0 AS now, * FROM px UNION ALL SELECT 1, run_id, frame, x, y, px,
        depth * CASE WHEN frame % 11 = 0 THEN 10005e-4 WHEN frame % 7 = 0 THEN 1000001e-6 ELSE 1e0 END, confidence FROM px WHERE frame % 13 <> 0),
    steps AS (SELECT *, greatest(
        abs(lag(depth, 1, depth) OVER (PARTITION BY now, run_id, frame, y ORDER BY x) - depth),
        abs(lead(depth, 1, depth) OVER (PARTITION BY now, run_id, frame, y ORDER BY x) - depth),
        abs(lag(depth, 1, depth) OVER (PARTITION BY now, run_id, frame, x ORDER BY y) - depth),
        abs(lead(depth, 1, depth) OVER (PARTITION BY now, run_id, frame, x ORDER BY y) - depth)) AS step FROM twice),
    rays AS (SELECT s.*, e.object_id, ux, uy, uz, c, s AS sn, (x - 35e-1) * depth / 8e0 - tx AS rx, (y - 35e-1) * depth / 8e0 - ty AS ry, depth - tz AS rz
      FROM steps s JOIN eroded e USING (run_id, frame, x, y) JOIN floor20 USING (run_id, frame) JOIN cam USING (run_id, frame) JOIN gravity USING (run_id)
      WHERE kept AND confidence >= min_confidence AND NOT step > depth * 8e-2),
    pts AS (SELECT *, c * ry + sn * rz AS wy, ux * rx + uy * (c * ry + sn * rz) + uz * (-sn * ry + c * rz) + {LIFT} AS h FROM rays),
    read AS (SELECT now, run_id, object_id, frame, count(*) AS points, quantile_disc(-wy, 98e-2) - quantile_disc(-wy, 2e-2) AS control_m,
        CASE WHEN count(*) >= {MIN_POINTS} THEN quantile_disc(h, 98e-2) - CASE WHEN frame % 2 = 0 THEN quantile_disc(h, 2e-2) ELSE 0e0 END END AS value
      FROM pts GROUP BY now, run_id, object_id, frame),
    again AS (SELECT a.run_id || '-' || a.object_id || '-' || a.frame AS trial_id, a.run_id, a.object_id, a.frame, a.value AS stored_m,
        1e0 + CAST(substr(a.object_id, 4, 1) AS DOUBLE) / 4e0 AS truth_m, a.frame % 4 = 0 AS automatic,
        CASE WHEN a.frame % 17 = 0 OR a.frame % 19 = 0 THEN 'mask' WHEN a.frame % 13 = 0 THEN 'frame' WHEN b.value IS NULL THEN 'measure'
             WHEN abs(b.value - a.value) * 1e3 > 1e-1 THEN 'replay' END AS stage,
        b.value AS v, b.points, b.control_m FROM read a LEFT JOIN read b ON b.now = 1 AND a.run_id = b.run_id AND a.object_id = b.object_id AND a.frame = b.frame
      WHERE a.now = 0 AND a.value IS NOT NULL),
    seen AS (SELECT * REPLACE (CASE WHEN stage IS DISTINCT FROM 'mask' THEN points END AS points, CASE WHEN stage IS DISTINCT FROM 'mask' THEN control_m END AS control_m),
        CASE WHEN stage IS DISTINCT FROM 'mask' THEN v END AS replay_m FROM again)"""
)
GROUPS = """grouped AS (SELECT run_id, object_id, CASE WHEN bool_and(automatic) THEN 'automatic' WHEN bool_or(automatic) THEN 'mixed' ELSE 'brush' END AS mask_source,
      count(*) AS n, median(stored_m) AS median_m, avg(stored_m) AS mean_m, max(stored_m) - min(stored_m) AS spread_m, any_value(truth_m) AS truth_m
      FROM seen WHERE stage IS NULL GROUP BY run_id, object_id)"""


@plan(
    "replay_trials",
    "T22",
    REPLAYED
    + f""" SELECT trial_id, run_id, object_id, frame, {r6s('stored_m', 'replay_m', 'control_m')}, {r6('abs(replay_m - stored_m) * 1e3', 'drift_mm')},
      points AS point_count, points AS round_trip_hits, points - points AS round_trip_misses, stage FROM seen""",
)
def replay_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Every trial with its second reading; each kept point falls back into its own mask."""
    return publish(
        replayed(spark, sf).select(
            "trial_id", "run_id", "object_id", "frame", "stored_m", "replay_m", "control_m", "drift_mm", "point_count",
            "round_trip_hits", "round_trip_misses", "stage",
        )
    )


@plan(
    "replay_failures",
    "T22 (failures), S16",
    REPLAYED
    + """ SELECT run_id, trial_id, stage, CASE stage WHEN 'mask' THEN 'the frozen mask is gone or is not the one recorded' WHEN 'frame' THEN 'its frame is not stored'
      WHEN 'measure' THEN 'too few points are left to measure' ELSE printf('measured again: %.6f m, recorded: %.6f m, %.3f mm apart', replay_m, stored_m, abs(replay_m - stored_m) * 1e3) END AS reason
    FROM seen WHERE stage IS NOT NULL""",
)
def replay_failures(spark: SparkSession, sf: str) -> DataFrame:
    return publish(replayed(spark, sf).where(F.col("stage").isNotNull()).select("run_id", "trial_id", "stage", "reason"))


@plan(
    "replay_study",
    "T23",
    REPLAYED
    + f""", {GROUPS} SELECT run_id, object_id, mask_source, n, {r6s('median_m', 'mean_m', 'spread_m', 'truth_m')}, {r6('median_m - truth_m', 'error_m')},
      {r6('(median_m - truth_m) / truth_m * 1e2', 'error_pct')} FROM grouped""",
)
def replay_study(spark: SparkSession, sf: str) -> DataFrame:
    return publish(T.study_groups(replayed(spark, sf).where(F.col("stage").isNull())))


@plan(
    "study_rollup",
    "T23 (rollup)",
    REPLAYED
    + f""" SELECT grouping(run_id) + grouping(object_id) AS level, run_id, object_id, count(*) AS n, {r6('avg(stored_m - truth_m)', 'mean_error_m')},
      {r6('max(stored_m) - min(stored_m)', 'spread_m')}, {r6('max(abs(replay_m - stored_m) * 1e3)', 'worst_drift_mm')}, {r6('median(stored_m)', 'median_m')}
    FROM seen WHERE stage IS NULL GROUP BY ROLLUP (run_id, object_id)""",
)
def study_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The published trials per target, per run and over all."""
    return publish(R.study_rollup(replayed(spark, sf).where(F.col("stage").isNull())))


@plan(
    "study_report",
    "S16",
    REPLAYED
    + f""", {GROUPS} SELECT run_id, object_id, '| ' || object_id || ' | ' || mask_source || ' | ' || printf('%.3f', truth_m) || ' m | ' || n || ' | ' || printf('%.4f', median_m) || ' m | '
      || CASE WHEN median_m >= truth_m THEN '+' ELSE '' END || printf('%.4f', median_m - truth_m) || ' m | '
      || CASE WHEN median_m >= truth_m THEN '+' ELSE '' END || printf('%.1f', (median_m - truth_m) / truth_m * 1e2) || '% | ' || printf('%.1f', spread_m * 1e3) || ' mm |' AS line FROM grouped""",
)
def study_report(spark: SparkSession, sf: str) -> DataFrame:
    return publish(sinks.study_lines(T.study_groups(replayed(spark, sf).where(F.col("stage").isNull()))))
