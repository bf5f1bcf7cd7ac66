"""Recorded trials measured again: the frozen mask over the frames as they are stored now.

A trial keeps its mask as run lengths on the grid it was painted on, the digest of that mask, the plane it
was measured over and its reading. A replay goes the whole way again: decode, resample to the frame's grid,
erode, back-project, measure. A trial is published only if the new reading agrees with the recorded one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite
from plumbline.functions.vectors import plane, signed_height, vec
from plumbline.operators import audits, heights as H, masks as M, pixels as P
from plumbline.operators.scale import even_median
from plumbline.session import cut_lineage

#: Two readings of one mask differ by rounding only; more is a fault of the measurement path.
TOLERANCE_MM = 0.1


def mask_digest(width: Column, height: Column, runs: Column) -> Column:
    """The digest that ``masks.snapshot`` gives a flat list of starts and lengths."""
    text = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":"), F.array_join(runs, ","))
    return F.substring(F.sha2(text, 256), 1, 16)


def frozen_pixels(trials: DataFrame, frames: DataFrame, radius: int = 1) -> DataFrame:
    """Set pixels of intact masks on their frame's grid: run_id, object_id (the trial), frame, x, y, kept.

    Only the sizes of frames are read here, not their maps.
    """
    sizes = P.usable_frames(frames).select("run_id", "frame", "width", "height")
    grid = ["mask_width", "mask_height", "width", "height"]
    starts = F.expr("filter(sequence(0, greatest(size(runs), 0)), k -> k % 2 = 0 and k + 1 < size(runs))")
    spans = (
        trials.where(intact())
        .join(sizes, ["run_id", "frame"])
        .withColumn("_k", F.explode(starts))
        .select(
            "run_id",
            F.col("trial_id").alias("object_id"),
            "frame",
            *grid,
            F.get("runs", F.col("_k").cast("int")).cast("long").alias("start"),
            F.get("runs", F.col("_k").cast("int") + 1).cast("long").alias("len"),
        )
    )
    painted = M.decode_runs(spans, F.col("mask_width"), [*M.MASK, *grid])
    resampled = M.resample(painted, *grid)
    return M.erode(resampled.select(*M.MASK, F.col("x").cast("long"), F.col("y").cast("long")), radius)


def intact() -> Column:
    """The mask has pixels and is the one that was recorded."""
    same = mask_digest(F.col("mask_width"), F.col("mask_height"), F.col("runs")) == F.col("digest")
    return F.coalesce((F.size("runs") >= 2) & same, F.lit(False))


def frozen_points(
    masks: DataFrame, trials: DataFrame, frames: DataFrame, drop_percent: float, max_relative_step: float
) -> DataFrame:
    """Kept points of each trial over its own plane: run_id, object_id (the trial), frame, wx, wy, wz, h.

    A mask is packed to one row and meets its frame once, so a depth map is never repeated per pixel;
    the rejections are those of ``pixels.mask_points``, in the same order.
    """
    pixel = F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "kept")
    packed = masks.groupBy(*M.MASK).agg(F.collect_list(pixel).alias("mask"))
    planes = trials.select(F.col("trial_id").alias("object_id"), "nx", "ny", "nz", "d")
    floors = P.confidence_floor(frames, drop_percent)
    maps = P.usable_frames(frames).select("run_id", "frame", "width", "height", "depth", "confidence", "intrinsics", "extrinsics")
    joined = packed.join(planes, "object_id").join(floors, ["run_id", "frame"]).join(maps, ["run_id", "frame"])
    x, y, deep = F.col("m.x"), F.col("m.y"), F.col("_deep")
    index = y * F.col("width") + x
    read = joined.withColumn("m", F.explode("mask")).withColumn("_deep", F.get("depth", index.cast("int")).cast("double"))
    sure = F.get("confidence", index.cast("int")).cast("double")
    good = F.col("m.kept") & P.in_depth_range(deep) & ~F.coalesce(sure < F.col("min_confidence"), F.lit(False))
    if max_relative_step > 0:
        good = good & ~P.depth_edge(index, x, y, deep, max_relative_step)
    world = P.back_project(x, y, deep)
    placed = read.where(good).select(*M.MASK, *(p.alias(n) for p, n in zip(world, ("wx", "wy", "wz"))), "nx", "ny", "nz", "d")
    return placed.withColumn("h", signed_height(plane(), vec("wx", "wy", "wz"))).where(finite(F.col("h"))).drop("nx", "ny", "nz", "d")


def measure_again(
    trials: DataFrame,
    frames: DataFrame,
    radius: int = 1,
    drop_percent: float = 20.0,
    max_relative_step: float = 0.08,
    lower: float = 2.0,
    upper: float = 98.0,
    min_points: int = 80,
) -> DataFrame:
    """trial_id, replay_m, point_count, control_m, round_trip_hits, round_trip_misses of every trial with points.

    ``trials``: trial_id, run_id, frame, mode (vertical_extent | top_above_floor), mask_width, mask_height,
    runs, digest, nx, ny, nz, d. ``replay_m`` is NULL below ``min_points``. ``control_m`` is the extent along
    the scene's own vertical; the round trip projects the kept points back into the mask.
    """
    masks = cut_lineage(frozen_pixels(trials, frames, radius))
    points = cut_lineage(frozen_points(masks, trials, frames, drop_percent, max_relative_step).repartition(*M.MASK))
    heights = points.select(*M.MASK, "h")
    limits = dict(upper=upper, min_points=min_points)
    extent = H.vertical_extent(heights, lower=lower, **limits).select(*M.MASK, "point_count", F.col("height").alias("_extent"))
    top = H.measure_height(heights, percentile=upper, min_points=min_points).select(*M.MASK, F.col("height").alias("_top"))
    up = points.withColumn("_up", -F.col("wy"))
    control = up.groupBy(*M.MASK).agg(
        (H.grouped_percentile("_up", upper) - H.grouped_percentile("_up", lower)).alias("control_m")
    )
    back = audits.round_trip(points, frames, masks)
    value = F.when(F.col("mode") == "top_above_floor", F.col("_top")).otherwise(F.col("_extent"))
    return (
        extent.join(top, M.MASK)
        .join(control, M.MASK)
        .join(back, M.MASK, "left")
        .join(trials.select(F.col("trial_id").alias("object_id"), "mode"), "object_id")
        .select(
            F.col("object_id").alias("trial_id"),
            value.alias("replay_m"),
            "point_count",
            "control_m",
            F.col("hits").alias("round_trip_hits"),
            F.col("misses").alias("round_trip_misses"),
        )
    )


def replay(trials: DataFrame, frames: DataFrame, tolerance_mm: float = TOLERANCE_MM, **measure) -> DataFrame:
    """``trials`` with what ``measure_again`` gives, drift_mm, and the stage and reason of a failure.

    ``stage`` is mask (gone or not the recorded one), frame (absent or unusable), measure (too few points
    left) or replay (the readings disagree); NULL for a trial that may be published. Every trial comes back once.
    """
    again = measure_again(trials, frames, **measure)
    there = P.usable_frames(frames).select("run_id", "frame", F.lit(True).alias("_there"))
    joined = trials.join(there, ["run_id", "frame"], "left").join(again, "trial_id", "left")
    drift = F.abs(F.col("replay_m") - F.col("stored_m")) * f64(1000)
    stage = (
        F.when(~intact(), "mask")
        .when(F.col("_there").isNull(), "frame")
        .when(F.col("replay_m").isNull(), "measure")
        .when(~F.coalesce(F.col("drift_mm") <= f64(tolerance_mm), F.lit(False)), "replay")
    )
    disagrees = F.format_string(
        "measured again: %.6f m, recorded: %.6f m, %.3f mm apart", "replay_m", "stored_m", "drift_mm"
    )
    reason = (
        F.when(F.col("stage") == "mask", "the frozen mask is gone or is not the one recorded")
        .when(F.col("stage") == "frame", "its frame is not stored")
        .when(F.col("stage") == "measure", "too few points are left to measure")
        .when(F.col("stage") == "replay", disagrees)
    )
    return joined.withColumn("drift_mm", drift).withColumn("stage", stage).withColumn("reason", reason).drop("_there")


def study_rollup(published: DataFrame) -> DataFrame:
    """Trials, medians, mean error and spread per target of a run, per run and over all.

    One row per level: run_id and object_id are NULL where a level runs over all of them, and ``level`` is
    the number of such columns. A trial is counted under three keys; medians come from the distributed ranks,
    so the level over all is no group of one task.
    """
    keys = ["level", "run_id", "object_id"]
    levels = F.array(*[F.lit(i) for i in range(3)])
    spread = published.withColumn("level", F.explode(levels)).withColumns(
        {
            "run_id": F.when(F.col("level") < 2, F.col("run_id")),
            "object_id": F.when(F.col("level") < 1, F.col("object_id")),
        }
    )
    named = F.struct(*keys)
    spread = spread.withColumn("_key", F.to_json(named))
    stats = spread.groupBy("_key", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("stored_m") - F.col("truth_m")).alias("mean_error_m"),
        (F.max("stored_m") - F.min("stored_m")).alias("spread_m"),
        F.max("drift_mm").alias("worst_drift_mm"),
    )
    middle = even_median(spread, ["_key"], F.col("stored_m"), "median_m")
    return stats.join(middle.select("_key", "median_m"), "_key").drop("_key")
