"""Audits of what a cloud shows: selections, round trips, coverage and drawn views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import all_finite, f64, half_up
from plumbline.functions.vectors import Vec, cross, dot, ground_axes, unit, vec
from plumbline.operators.pixels import project
from plumbline.operators.ranks import exact_nmad, exact_percentiles, exploded, with_ordinal

#: Marks are handed on in rows of so many; all of them are kept.
MARKS_PER_ROW = 4096
WIPED_BELOW = 0.02


def select_band(heights: DataFrame, low: float, high: float) -> DataFrame:
    """Points whose height lies in the closed band."""
    return heights.where(F.col("h").between(f64(low), f64(high)))


def select_near(points: DataFrame, centres: DataFrame, max_radius: float) -> DataFrame:
    """Points within each centre's radius; ``centres``: run_id, label, cx, cy, cz, radius.

    Both sides are bucketed in cells of ``max_radius``: a centre visits the cells
    its own radius reaches (27, or more if it is larger than a cell) and only
    points in them are tested.
    """
    cell = lambda c: F.floor(F.col(c) / f64(max_radius))
    reach = F.greatest(F.lit(1), F.ceil(F.col("radius") / f64(max_radius)))
    near = F.sequence(-reach, reach)
    spread = centres.select("*", cell("cx").alias("gx"), cell("cy").alias("gy"), cell("cz").alias("gz"))
    for g in ("gx", "gy", "gz"):
        spread = spread.withColumn(g, F.explode(F.transform(near, lambda d: d + F.col(g))))
    placed = points.withColumns({"gx": cell("x"), "gy": cell("y"), "gz": cell("z")})
    away = [F.col(p) - F.col(c) for p, c in zip("xyz", ("cx", "cy", "cz"))]
    squared = away[0] * away[0] + away[1] * away[1] + away[2] * away[2]
    return (
        placed.join(exploded(spread), ["run_id", "gx", "gy", "gz"])
        .where(squared <= F.col("radius") * F.col("radius"))
        .drop("gx", "gy", "gz", "cx", "cy", "cz", "radius")
    )


def selection_profile(selection: DataFrame, cloud_sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Count, share of the cloud, p10/p50/p90 and NMAD of height per selection."""
    counts = selection.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected"))
    marks = exact_percentiles(selection, keys, F.col("h"), {"p10": 10, "p90": 90}).drop("n")
    spread = exact_nmad(selection, keys, F.col("h"), middle="p50")
    share = F.col("selected") / F.col("cloud_points")
    return (
        counts.join(cloud_sizes.select("run_id", "cloud_points"), "run_id")
        .withColumn("share", share)
        .drop("cloud_points")
        .join(marks, keys, "left")
        .join(spread, keys, "left")
    )


def points_below(heights: DataFrame, tolerance: float = 0.05) -> DataFrame:
    return heights.where(F.col("h") < f64(-tolerance))


def overlay_marks(selection: DataFrame, order: list[str]) -> DataFrame:
    """All marks of each run in stored order, in rows of bounded arrays: run_id, block, marks."""
    numbered = with_ordinal(selection, ["run_id"], "frame", order)
    mark = F.struct(F.col("ord").alias("i"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("z").alias("wz"))
    block = F.floor(F.col("ord") / MARKS_PER_ROW).alias("block")
    return numbered.groupBy("run_id", block).agg(F.array_sort(F.collect_list(mark)).alias("marks"))


def round_trip(points: DataFrame, cameras: DataFrame, masks: DataFrame) -> DataFrame:
    """Re-project kept mask points; a hit lands within one pixel of the mask.

    ``points``: run_id, object_id, frame, wx, wy, wz; the mask grows by one pixel
    and the test is a semi-join on the rounded pixel.
    """
    seen = project(vec("wx", "wy", "wz"), F.col("intrinsics"), F.col("extrinsics"))
    placed = points.join(
        cameras.select("run_id", "frame", "width", "height", "intrinsics", "extrinsics"),
        ["run_id", "frame"],
    ).select(
        "run_id",
        "object_id",
        "frame",
        half_up(seen.x).alias("x"),
        half_up(seen.y).alias("y"),
    )
    near = F.sequence(F.lit(-1), F.lit(1))
    grown = (
        masks.select("run_id", "object_id", "frame", "x", "y")
        .withColumn("x", F.explode(F.transform(near, lambda d: (d + F.col("x")).cast("long"))))
        .withColumn("y", F.explode(F.transform(near, lambda d: (d + F.col("y")).cast("long"))))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    keys = ["run_id", "object_id", "frame"]
    return (
        placed.join(exploded(grown), [*keys, "x", "y"], "left")
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("_hit").isNotNull()).alias("hits"),
            F.count_if(F.col("_hit").isNull()).alias("misses"),
        )
    )


def frame_survival(confident: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each frame's pixels over a threshold, and whether the frame is wiped out.

    ``confident``: run_id, frame, confidence per pixel; ``thresholds`` keyed by ``keys``.
    """
    kept = F.count_if(F.col("confidence") >= F.col("threshold"))
    share = (kept / F.count(F.lit(1))).alias("survival")
    return (
        confident.join(thresholds.select(*keys, "threshold"), keys)
        .groupBy("run_id", "frame", "threshold")
        .agg(kept.alias("kept"), share)
        .withColumn("wiped", F.col("survival") < f64(WIPED_BELOW))
    )


def coverage(points: DataFrame, cloud: DataFrame, thresholds: DataFrame, keys: list[str], voxel: float) -> DataFrame:
    """Per frame: pixels below the floor, pixels whose voxel the cloud left empty, and both.

    ``points``: run_id, frame, x, y, z, confidence for every valid pixel. Occupied
    cells are deduplicated map-side before they meet the pixels.
    """
    cell = lambda c: F.floor(F.col(c) / f64(voxel)).alias(f"g{c}")
    grid = ["run_id", "gx", "gy", "gz"]
    occupied = cloud.select("run_id", *(cell(c) for c in "xyz")).distinct().withColumn("_full", F.lit(True))
    placed = (
        points.select("run_id", "frame", "confidence", *(cell(c) for c in "xyz"))
        .join(thresholds.select(*keys, "threshold"), keys)
        .join(occupied, grid, "left")
    )
    low = F.col("confidence") < F.col("threshold")
    gone = F.col("_full").isNull()
    return placed.groupBy("run_id", "frame").agg(
        F.count(F.lit(1)).alias("valid_pixels"),
        F.count_if(low).alias("predicted"),
        F.count_if(gone).alias("absent"),
        F.count_if(low & gone).alias("both"),
    )


def view_basis(ups: DataFrame, view: str) -> DataFrame:
    """Screen axes (right, screen up, forward) of a named view, one row per run."""
    axis = unit(vec("ux", "uy", "uz"))
    e1, e2 = ground_axes(vec("ux", "uy", "uz"))
    named = lambda v, n: [part.alias(f"{n}{c}") for part, c in zip(v, "xyz")]
    axes = ups.select("run_id", *named(axis, "u")).select(
        "run_id", "ux", "uy", "uz", *named(e1, "a"), *named(e2, "b")
    )
    up, a, b = vec("ux", "uy", "uz"), vec("ax", "ay", "az"), vec("bx", "by", "bz")
    neg = lambda v: Vec(-v.x, -v.y, -v.z)
    flat = {
        "top": (a, b, neg(up)),
        "front": (a, up, b),
        "floor": (a, up, b),
        "side": (b, up, neg(a)),
    }
    if view in flat:
        right, screen, forward = flat[view]
        return axes.select("run_id", *named(right, "r"), *named(screen, "s"), *named(forward, "f"))
    if view != "iso":
        raise ValueError(f"unknown view {view!r}")
    tipped = unit(Vec(*(-(p + q) * f64(0.7) - u for p, q, u in zip(a, b, up))))
    ahead = axes.select("run_id", "ux", "uy", "uz", *named(tipped, "f"))
    f, r = vec("fx", "fy", "fz"), vec("rx", "ry", "rz")
    sideways = ahead.select("*", *named(unit(cross(f, up)), "r"))
    return sideways.select("run_id", "rx", "ry", "rz", *named(unit(cross(r, f)), "s"), "fx", "fy", "fz")


def raster(points: DataFrame, basis: DataFrame, width: int, height: int, order: list[str]) -> DataFrame:
    """Front point per screen cell of an orthographic view fitted to the run.

    Nearest wins, the later stored row wins a tie, and a selected point beats any
    unselected one (the last selected row wins). Cells are found by hash aggregates
    of single numbers, as a struct would sort every point of a task. Only selected
    points of a cell's last ``order[0]`` are compared by all stored order columns.
    """
    p = vec("x", "y", "z")
    placed = (
        points.where(all_finite(F.col(c) for c in "xyz"))
        .join(basis, "run_id")
        .withColumn("_u", dot(p, vec("rx", "ry", "rz")))
        .withColumn("_v", dot(p, vec("sx", "sy", "sz")))
        .withColumn("_w", dot(p, vec("fx", "fy", "fz")))
    )
    box = placed.groupBy("run_id").agg(
        F.min("_u").alias("_u0"), F.max("_u").alias("_u1"), F.min("_v").alias("_v0"), F.max("_v").alias("_v1")
    )
    span = lambda a, b: F.greatest(f64(1e-9), F.col(b) - F.col(a))
    scale = F.least(f64(width) / span("_u0", "_u1"), f64(height) / span("_v0", "_v1"))
    left = (f64(width) - (F.col("_u1") - F.col("_u0")) * F.col("_k")) / f64(2)
    down = f64(height) - (f64(height) - (F.col("_v1") - F.col("_v0")) * F.col("_k")) / f64(2)
    framed = box.withColumn("_k", scale).select("run_id", "_u0", "_v0", "_k", left.alias("_l"), down.alias("_b"))
    cells = (
        placed.join(framed, "run_id")
        .withColumn("cell_x", half_up(F.col("_l") + (F.col("_u") - F.col("_u0")) * F.col("_k")))
        .withColumn("cell_y", half_up(F.col("_b") - (F.col("_v") - F.col("_v0")) * F.col("_k")))
        .where(
            (F.col("cell_x") >= 0)
            & (F.col("cell_y") >= 0)
            & (F.col("cell_x") < width)
            & (F.col("cell_y") < height)
        )
    )
    selected = F.coalesce(F.col("selected"), F.lit(False)) if "selected" in points.columns else F.lit(False)
    cells = cells.withColumn("_sel", selected)
    cell, lead = ["run_id", "cell_x", "cell_y"], order[0]
    tops = cells.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("points"),
        F.min(F.when(~F.col("_sel"), F.col("_w"))).alias("_near"),
        F.max("_sel").alias("selected"),
        F.max(F.when(F.col("_sel"), F.col(lead))).alias("_lead"),
    )
    wanted = tops.where("selected").select(*cell, "_lead")
    # The side of one row a cell is hashed; a sort-merge join would sort the points.
    last = cells.where("_sel").join(wanted.hint("shuffle_hash"), cell).where(F.col(lead).eqNullSafe(F.col("_lead")))
    painted = last.groupBy(*cell).agg(F.max_by("_w", F.struct(*order)).alias("_last"))
    depth = F.when(F.col("selected"), F.col("_last")).otherwise(F.col("_near")).alias("depth")
    return tops.join(painted, cell, "left").select(*cell, "points", depth, "selected")


def support_class(h: Column, band: float) -> Column:
    """below / inlier / above the plane."""
    return (
        F.when(h < f64(-band), F.lit("below"))
        .when(h <= f64(band), F.lit("inlier"))
        .otherwise(F.lit("above"))
    )
