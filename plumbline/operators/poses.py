"""Camera poses as a time series: gravity, path, fields of view and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite
from plumbline.functions.vectors import (
    Vec,
    distance,
    length,
    transform_direction,
    transform_point,
    unit,
    vec,
)
from plumbline.operators.ranks import exploded
from plumbline.session import cut_lineage

MIN_COHERENCE = 0.7


def _e(i: int):
    return F.col("extrinsics").getItem(i).cast("double")


def estimate_gravity(frames: DataFrame) -> DataFrame:
    """Up is minus the mean camera down axis; coherence is the mean's length."""
    down = unit(Vec(_e(4), _e(5), _e(6)))
    sums = (
        frames.select("run_id", *(part.alias(n) for part, n in zip(down, ("dx", "dy", "dz"))))
        .where(F.col("dx").isNotNull())
        .groupBy("run_id")
        .agg(
            F.sum("dx").alias("sx"),
            F.sum("dy").alias("sy"),
            F.sum("dz").alias("sz"),
            F.count(F.lit(1)).alias("frame_count"),
        )
    )
    total = vec("sx", "sy", "sz")
    up = unit(Vec(-total.x, -total.y, -total.z))
    return sums.select(
        "run_id",
        *(part.alias(n) for part, n in zip(up, ("ux", "uy", "uz"))),
        (length(total) / F.col("frame_count")).alias("coherence"),
        "frame_count",
    )


def gravity_gate(gravity: DataFrame) -> DataFrame:
    """Runs whose camera up may be used for a floor, with the reason for each refusal."""
    return gravity.withColumn(
        "reason",
        F.when(F.col("ux").isNull(), F.lit("camera down axes cancel out")).when(
            F.col("coherence") < f64(MIN_COHERENCE), F.lit("camera up is incoherent")
        ),
    )


def camera_centres(frames: DataFrame) -> DataFrame:
    t = Vec(_e(3), _e(7), _e(11))
    centre = [-(_e(c) * t.x + _e(c + 4) * t.y + _e(c + 8) * t.z) for c in range(3)]
    return frames.select(
        "run_id", "frame", *(part.alias(n) for part, n in zip(centre, ("cx", "cy", "cz")))
    )


def path_extent(centres: DataFrame) -> DataFrame:
    """Span per axis and travelled length, frame to frame."""
    order = W.partitionBy("run_id").orderBy("frame")
    here = vec("cx", "cy", "cz")
    before = Vec(*(F.lag(c).over(order) for c in ("cx", "cy", "cz")))
    stepped = centres.withColumn("_step", distance(here, before))
    return stepped.groupBy("run_id").agg(
        *((F.max(c) - F.min(c)).alias(f"span_{c[1]}") for c in ("cx", "cy", "cz")),
        F.coalesce(F.sum("_step"), f64(0)).alias("path_m"),
    )


def camera_track(frames: DataFrame, alignments: DataFrame) -> DataFrame:
    """Displayed pose per frame: position, forward, up, fields of view and aspect."""
    centres = camera_centres(frames)
    joined = frames.join(centres, ["run_id", "frame"]).join(
        alignments.select("run_id", "alignment"), "run_id"
    )
    m = F.col("alignment")
    position = transform_point(m, vec("cx", "cy", "cz"))
    forward = transform_direction(m, Vec(_e(8), _e(9), _e(10)))
    up = transform_direction(m, Vec(-_e(4), -_e(5), -_e(6)))
    k = lambda i: F.col("intrinsics").getItem(i).cast("double")
    fov = lambda size, focal: F.degrees(
        f64(2) * F.atan(F.col(size) / (f64(2) * F.abs(focal)))
    )
    return joined.where((F.abs(k(0)) > 0) & (F.abs(k(4)) > 0)).select(
        "run_id",
        "frame",
        *(p.alias(n) for p, n in zip(position, ("x", "y", "z"))),
        *(p.alias(n) for p, n in zip(forward, ("fwd_x", "fwd_y", "fwd_z"))),
        *(p.alias(n) for p, n in zip(up, ("up_x", "up_y", "up_z"))),
        fov("height", k(4)).alias("vfov_deg"),
        fov("width", k(0)).alias("hfov_deg"),
        (F.col("width") / F.col("height")).cast("double").alias("aspect"),
    )


def frustum_apexes(vertices: DataFrame) -> DataFrame:
    """The one vertex a camera outline repeats most; a tie names no apex.

    ``vertices``: run_id, frustum, seq, x, y, z. Vertices equal to six decimals are one.
    """
    key = [F.round(c, 6).alias(f"k{c}") for c in "xyz"]
    tally = vertices.groupBy("run_id", "frustum", *key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("x", "y", "z"), "seq").alias("p"),
    )
    best = tally.groupBy("run_id", "frustum").agg(
        F.max(F.struct("n", "p")).alias("top"),
        F.count(F.lit(1)).alias("kinds"),
        F.sum("n").alias("vertices"),
    )
    ties = (
        tally.join(best, ["run_id", "frustum"])
        .where(F.col("n") == F.col("top.n"))
        .groupBy("run_id", "frustum", "top", "kinds", "vertices")
        .agg(F.count(F.lit(1)).alias("at_top"))
    )
    return ties.where(
        (F.col("at_top") == 1) & (F.col("kinds") >= 2) & (F.col("vertices") >= 4)
    ).select("run_id", "frustum", "top.p.x", "top.p.y", "top.p.z")


#: A search that found nothing near enough goes on in cells so many times as wide.
WIDER = 4


def nearest_distances(poses: DataFrame, marks: DataFrame, size: str) -> DataFrame:
    """``poses`` (run_id, i, x, y, z, ``size``) with ``nearest``, the exact distance to the closest mark of the run.

    ``marks``: run_id, ax, ay, az. Both sides are put in cubes as wide as the pose's ``size``, the same for all
    poses of a run; a pose looks into its own cube and those around it. What it finds within one cube's width is
    the nearest there is, and only poses without such a find go on, in cubes four times as wide, so each
    round is one join of fewer poses. A run without marks, or a pose without finite coordinates, gets NULL.
    """
    at = vec("x", "y", "z")
    whole = lambda cs: reduce(lambda a, b: a & b, [finite(F.col(c)) for c in cs])
    marks = cut_lineage(marks.select("run_id", "ax", "ay", "az").where(whole(("ax", "ay", "az"))))
    sizes = poses.select("run_id", F.col(size).alias("_size")).distinct()
    open_ = cut_lineage(
        poses.where(whole("xyz")).join(marks.select("run_id").distinct(), "run_id", "left_semi")
        .select("run_id", "i", "x", "y", "z", F.col(size).alias("_size"))
    )
    done = []
    around = F.sequence(F.lit(-1), F.lit(1))
    while not open_.isEmpty():
        cell = lambda c: F.floor(F.col(c) / F.col("_size"))
        looked = open_.withColumns({f"g{c}": cell(c) for c in "xyz"})
        for c in "xyz":
            looked = looked.withColumn(f"g{c}", F.explode(F.transform(around, lambda d: d + F.col(f"g{c}"))))
        placed = marks.join(sizes, "run_id").withColumns({f"g{c}": cell(f"a{c}") for c in "xyz"}).drop("_size")
        found = (
            exploded(looked)
            .join(placed, ["run_id", "gx", "gy", "gz"])
            .groupBy("run_id", "i")
            .agg(F.min(distance(at, vec("ax", "ay", "az"))).alias("nearest"))
        )
        seen = cut_lineage(open_.join(found, ["run_id", "i"], "left"))
        sure = F.coalesce(F.col("nearest") <= F.col("_size"), F.lit(False))
        done.append(seen.where(sure).select("run_id", "i", "nearest"))
        open_ = seen.where(~sure).drop("nearest").withColumn("_size", F.col("_size") * WIDER)
        sizes = sizes.withColumn("_size", F.col("_size") * WIDER)
    if not done:
        return poses.withColumn("nearest", F.lit(None).cast("double"))
    return poses.join(reduce(DataFrame.unionByName, done), ["run_id", "i"], "left")


def verify_track(track: DataFrame, apexes: DataFrame, extents: DataFrame) -> DataFrame:
    """Do the computed camera positions match the outlines in the scene file?

    In-order error is an equi-join on the sequence number; how far a pose is from the
    nearest apex, whatever the order, is searched in cells (``nearest_distances``).
    """
    seq = W.partitionBy("run_id")
    poses = track.select(
        "run_id", "x", "y", "z", F.row_number().over(seq.orderBy("frame")).alias("i")
    )
    marks = apexes.select(
        "run_id",
        F.col("x").alias("ax"),
        F.col("y").alias("ay"),
        F.col("z").alias("az"),
        F.row_number().over(seq.orderBy("frustum")).alias("i"),
    )
    tolerance = F.greatest(f64(0.01), F.abs(F.col("extent")) * f64(0.002))
    limits = extents.select("run_id", tolerance.alias("tol"))
    ordered = (
        poses.join(marks, ["run_id", "i"], "left")
        .withColumn("_d", distance(vec("x", "y", "z"), vec("ax", "ay", "az")))
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("poses"), F.max("_d").alias("worst_in_order"))
    )
    counts = marks.groupBy("run_id").agg(F.count(F.lit(1)).alias("apexes"))
    close = nearest_distances(poses.join(limits, "run_id"), marks, "tol").groupBy("run_id").agg(
        F.max("nearest").alias("worst_nearest"), F.count_if(F.col("nearest") <= F.col("tol")).alias("near_poses")
    )
    joined = (
        ordered.join(limits, "run_id")
        .join(counts, "run_id", "left")
        .join(close, "run_id", "left")
        .fillna(0, ["apexes", "near_poses"])
    )
    kind = (
        F.when(F.col("apexes") == 0, F.lit("unverified: no outlines"))
        .when(F.col("apexes") != F.col("poses"), F.lit("unverified: counts differ"))
        .when(F.col("worst_in_order") <= F.col("tol"), F.lit("confirmed"))
        .when(F.col("near_poses") == F.col("poses"), F.lit("rejected: order"))
        .otherwise(F.lit("rejected: positions"))
    )
    return joined.select(
        "run_id", "poses", "apexes", F.col("tol").alias("tolerance_m"), "worst_in_order", "worst_nearest", kind.alias("verdict")
    )


def resolve_up(runs: DataFrame, planes: DataFrame, gravity: DataFrame) -> DataFrame:
    """Floor normal, else a coherent camera up, else scene +Y."""
    floor = planes.select("run_id", "nx", "ny", "nz")
    camera = gravity.where(F.col("coherence") >= f64(MIN_COHERENCE)).select(
        "run_id", "ux", "uy", "uz"
    )
    joined = runs.select("run_id").join(floor, "run_id", "left").join(camera, "run_id", "left")
    n, u = unit(vec("nx", "ny", "nz")), unit(vec("ux", "uy", "uz"))
    pick = lambda a, b, c: F.coalesce(a, b, f64(c))
    return joined.select(
        "run_id",
        pick(n.x, u.x, 0).alias("up_x"),
        pick(n.y, u.y, 1).alias("up_y"),
        pick(n.z, u.z, 0).alias("up_z"),
        F.when(n.x.isNotNull(), F.lit("floor"))
        .when(u.x.isNotNull(), F.lit("camera"))
        .otherwise(F.lit("scene"))
        .alias("source"),
    )
