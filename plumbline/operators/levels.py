"""Horizontal surfaces from the histogram of heights over a plane."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite
from plumbline.functions.vectors import dot, ground_axes, plane, signed_height, vec
from plumbline.operators.ranks import exact_nmad, exploded, with_ordinal
from plumbline.session import cut_lineage

LEVEL = ["run_id", "bin"]


@dataclass(frozen=True)
class LevelOptions:
    bin_size: float = 0.005
    low: float = -0.25
    high: float = 3.0
    separation: float = 0.05
    half_band: float = 0.02
    min_fraction: float = 0.002
    min_prominence: float = 2.0
    min_extent: float = 0.05
    stride: int = 1


def heights(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Signed height of every point over its run's plane. One plane row per run."""
    normals = planes.select("run_id", "nx", "ny", "nz", "d")
    return (
        points.join(normals, "run_id")
        .withColumn("h", signed_height(plane(), vec("x", "y", "z")))
        .drop("nx", "ny", "nz", "d")
    )


def height_profile(points: DataFrame, planes: DataFrame, options: LevelOptions) -> DataFrame:
    """Finite heights with ground-plane coordinates and a histogram bin (NULL outside the range)."""
    used = points
    if options.stride > 1:
        used = with_ordinal(points, ["run_id"], "frame", ["px", "x", "y", "z"]).where(
            F.col("ord") % options.stride == 0
        )
    count = max(1, math.ceil((options.high - options.low) / options.bin_size))
    p = vec("x", "y", "z")
    e1, e2 = ground_axes(vec("nx", "ny", "nz"))
    h = F.col("h")
    in_range = (h >= f64(options.low)) & (h < f64(options.high))
    bin_ = F.least(
        F.lit(count - 1), F.floor((h - f64(options.low)) / f64(options.bin_size))
    ).cast("int")
    return (
        used.select("run_id", "x", "y", "z")
        .join(planes.select("run_id", "nx", "ny", "nz", "d"), "run_id")
        .withColumn("h", signed_height(plane(), p))
        .where(finite(h))
        .select(
            "run_id", "h", dot(p, e1).alias("u"), dot(p, e2).alias("v"), F.when(in_range, bin_).alias("bin")
        )
    )


def level_peaks(profile: DataFrame, options: LevelOptions) -> DataFrame:
    """Histogram bins that stand above every bin within the separation; ties go to the lower bin."""
    reach = max(1, math.floor(options.separation / options.bin_size + 0.5))
    counts = profile.groupBy("run_id", "bin").agg(F.count(F.lit(1)).alias("population"))
    totals = counts.groupBy("run_id").agg(F.sum("population").alias("sampled"))
    order = W.partitionBy("run_id").orderBy("bin")
    below, above = order.rangeBetween(-reach, -1), order.rangeBetween(1, reach)
    n = F.col("population")
    # At most 2 x reach neighbours, so the list is a constant-size array.
    around = F.sort_array(
        F.concat(F.collect_list("population").over(below), F.collect_list("population").over(above))
    )
    ranked = (
        counts.where(F.col("bin").isNotNull())
        .withColumn("_low", F.coalesce(F.max("population").over(below), F.lit(0)))
        .withColumn("_high", F.coalesce(F.max("population").over(above), F.lit(0)))
        .withColumn("_around", around)
        .where((n > F.col("_low")) & (n >= F.col("_high")) & (F.size("_around") > 0))
        .withColumn(
            "_mid", F.get("_around", F.ceil(f64(0.5) * F.size("_around")).cast("int") - 1)
        )
        .withColumn("prominence", n / F.greatest(F.lit(1), F.col("_mid")))
        .where(F.col("prominence") >= f64(options.min_prominence))
    )
    centre = f64(options.low) + (F.col("bin") + f64(0.5)) * f64(options.bin_size)
    return ranked.join(totals, "run_id").select(
        "run_id", "bin", centre.alias("centre"), "prominence", "sampled"
    )


def horizontal_levels(
    points: DataFrame, planes: DataFrame, options: LevelOptions = LevelOptions()
) -> DataFrame:
    """levels(run_id, height, count, fraction, thickness, prominence, extent).

    A peak only meets the points of the few bins its band touches: the range
    join is an equi-join on (run, bin) followed by the exact half-open test.
    """
    profile = height_profile(points, planes, options)
    # A few rows per run; everything below refers back to them.
    peaks = cut_lineage(level_peaks(profile, options))
    side = math.ceil(options.half_band / options.bin_size) + 1
    spread = F.sequence(F.col("bin") - side, F.col("bin") + side)
    near = peaks.select(
        "run_id", F.col("bin").alias("peak"), "centre", F.explode(spread).alias("bin")
    )
    h = F.col("h")
    band = (
        profile.where(F.col("bin").isNotNull())
        .join(exploded(near), LEVEL)
        .where(
            (h >= F.col("centre") - f64(options.half_band))
            & (h < F.col("centre") + f64(options.half_band))
        )
        .select("run_id", F.col("peak").alias("bin"), "h", "u", "v")
    )
    sizes = band.groupBy(*LEVEL).agg(F.count(F.lit(1)).alias("count"))
    populated = cut_lineage(
        peaks.join(sizes, LEVEL)
        .withColumn("fraction", F.col("count") / F.col("sampled"))
        .where(F.col("fraction") >= f64(options.min_fraction))
    )
    long = band.join(populated.select(*LEVEL), LEVEL, "left_semi").select(
        *LEVEL, F.explode(F.create_map(*_axis_pairs())).alias("axis", "value")
    )
    # Median and spread of three axes read this several times.
    long = cut_lineage(long)
    keys = [*LEVEL, "axis"]
    spreads = exact_nmad(long, keys, F.col("value"), middle="middle")
    on = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    shape = spreads.groupBy(*LEVEL).agg(
        on("h", "middle").alias("height"),
        on("h", "nmad").alias("thickness"),
        F.least(on("u", "nmad"), on("v", "nmad")).alias("extent"),
    )
    return (
        populated.join(shape, LEVEL)
        .where(F.col("extent") >= f64(options.min_extent))
        .select("run_id", "height", "count", "fraction", "thickness", "prominence", "extent")
    )


def _axis_pairs() -> list[Column]:
    out: list[Column] = []
    for axis in ("h", "u", "v"):
        out += [F.lit(axis), F.col(axis)]
    return out


def level_near(levels: DataFrame, expected: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """The level nearest each expected height within the tolerance; the larger one wins a tie.

    ``expected``: run_id, label, expected. NULLs when nothing is close enough. A
    run has at most range / separation levels, so the join fans out by a constant.
    """
    gap = F.abs(F.col("height") - F.col("expected"))
    pairs = (
        expected.join(levels, "run_id")
        .withColumn("_gap", gap)
        .where(F.col("_gap") <= f64(tolerance))
    )
    best = pairs.groupBy("run_id", "label").agg(
        F.min_by(
            F.struct("height", "count"), F.struct("_gap", -F.col("count"), F.col("height"))
        ).alias("b")
    )
    error = F.col("height") - F.col("expected")
    return (
        expected.join(best, ["run_id", "label"], "left")
        .select("run_id", "label", "expected", F.col("b.height").alias("height"), F.col("b.count").alias("count"))
        .withColumn("error_m", error)
        .withColumn("error_pct", error / F.col("expected") * f64(100))
    )
