"""Hand-made scenes with answers worked out on paper."""

import itertools
import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.operators import cloud as C, ground as P, heights as H, levels as L, masks as M, pixels as X
from plumbline.operators.components import connected_voxels
from tests.conftest import SMALL

FRAME = "run_id string, frame int, width int, height int, depth array<double>, confidence array<double>, intrinsics array<double>, extrinsics array<double>"
K = [2.0, 0.0, 1.0, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0]
E = [1.0, 0.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
NAN, INF = float("nan"), float("inf")


def frame(spark, depth, confidence=None, width=3, height=3, k=K, e=E):
    return spark.createDataFrame([("r", 0, width, height, depth, confidence, k, e)], FRAME)


def statuses(df):
    return [r.status for r in df.orderBy("px").collect()]


def test_rejections_come_in_order_and_edges_see_unfiltered_depth(spark):
    depth = [2.0, 2.0, 2.0, 2.0, 2.0, NAN, 2.0, 2.0, 3.0]
    conf = [9.0, 0.1] + [9.0] * 7
    got = statuses(X.pixel_status(frame(spark, depth, conf), 1.0, 0.05))
    assert got == ["valid", "confidence", "edge", "valid", "edge", "depth", "valid", "edge", "edge"]


def test_infinite_and_negative_depths_are_out_of_range(spark):
    assert statuses(X.pixel_status(frame(spark, [INF, -1.0, 1.0, 1e-5] + [1.0] * 5)))[:4] == [
        "depth", "depth", "valid", "depth",
    ]


def test_back_projection_undoes_the_pose(spark):
    point = X.pixel_status(frame(spark, [4.0] * 9)).where("px = 5").first()
    # x = 2, y = 1: ((2 - 1) * 4 / 2 - 0.5, 0, 4)
    assert (point.wx, point.wy, point.wz) == (1.5, 0.0, 4.0)


def test_bad_cameras_are_named_not_raised(spark):
    faulty = frame(spark, [1.0] * 8).union(frame(spark, [1.0] * 9, k=[0.0] * 9)).union(frame(spark, [1.0] * 9, e=[1.0]))
    assert len([r for r in X.camera_faults(faulty).collect() if r.fault]) == 3
    assert X.usable_frames(faulty).count() == 0


def test_erosion_treats_the_border_as_outside(spark):
    full = spark.range(25).select(
        F.lit("r").alias("run_id"), F.lit("o").alias("object_id"), F.lit(0).alias("frame"),
        (F.col("id") % 5).alias("x"), F.expr("id div 5").alias("y"),
    )
    kept = {(r.x, r.y) for r in M.erode(full, 2).where("kept").collect()}
    assert kept == {(2, 2)}
    assert M.erode(full, 0).where("kept").count() == 25


def test_per_frame_floor_keeps_the_dim_frame_that_a_pooled_one_wipes(spark):
    bright = [5.0 + i / 10 for i in range(9)]
    dim = [1.1 + i / 100 for i in range(9)]
    frames = spark.createDataFrame(
        [("r", f, 3, 3, [2.0] * 9, c, K, E) for f, c in enumerate([bright, dim, bright])], FRAME
    )
    kept = {r.frame: r.kept for r in C.frame_contributions(frames).collect()}
    assert kept[1] > 0 and kept[0] > 0
    pooled = C.pooled_floor(frames).first().threshold
    assert pooled > max(dim)


def test_voxels_average_by_weight(spark):
    rows = [("r", 0, 0, 0.01, 0.0, 0.0, 1.0, 2.0), ("r", 0, 1, 0.03, 0.0, 0.0, 3.0, 4.0), ("r", 1, 0, 9.0, 0.0, 0.0, 0.0, 1.0)]
    points = spark.createDataFrame(rows, "run_id string, frame int, px int, x double, y double, z double, weight double, confidence double")
    first, second = C.voxel_grid(points, 0.05).orderBy("ix").collect()
    assert first.x == pytest.approx(0.025) and first.weight == 2.0 and first.confidence == 3.0
    assert (first.frame, first.px) == (0, 0)
    assert second.weight == pytest.approx(1e-6)


@pytest.fixture(scope="module")
def room(spark):
    """A floor at 0, a table at 0.75, and two walls with more points than the floor."""
    floor = "id % 40 * 1e-1 as x, (id % 7 - 3) * 2e-3 as y, id div 40 * 1e-1 as z"
    table = "1 + id % 30 * 3e-2 as x, 75e-2 + (id % 5 - 2) * 1e-3 as y, 1 + id div 30 * 3e-2 as z"
    wall = "id % 60 * 65e-3 as x, id div 60 * 4e-2 as y, {} as z"
    parts = [(1600, floor), (900, table), (3600, wall.format("0e0")), (3600, wall.format("4e0"))]
    cloud = None
    for i, (n, shape) in enumerate(parts):
        part = spark.range(n).selectExpr(f"{i} as frame", "id as px", *shape.split(", "))
        part = part.select("frame", "px", *(F.col(c).cast("double").alias(c) for c in "xyz"))
        cloud = part if cloud is None else cloud.union(part)
    return cloud.withColumn("run_id", F.lit("room")).withColumn("weight", f64(1))


@pytest.fixture(scope="module")
def room_up(spark):
    return spark.createDataFrame([("room", 0.02, 1.0, -0.01)], "run_id string, ux double, uy double, uz double")


def test_floor_is_found_for_every_seed(room, room_up):
    options = replace(P.MEASUREMENT_FIT, seeds=(7, 108, 209), stride=2, iterations=400)
    fits = P.fit_ground_robust(room, room_up, options).collect()
    assert len(fits) == 3
    for fit in fits:
        assert fit.status == "ok" and abs(fit.d) < 0.01 and fit.ny > 0.999


def test_scores_match_brute_force(room, room_up):
    options = replace(P.MEASUREMENT_FIT, stride=8, iterations=60, max_tilt_deg=90.0)
    sample = P.stride_sample(room, room_up, options.stride)
    planes = P.candidate_planes(sample, room_up, options)
    scores = {(r.pool, r.iter): r for r in P.score_planes(sample, planes, 0.035).collect()}
    pts = np.array([(r.x, r.y, r.z) for r in sample.collect()])
    checked = 0
    for p in planes.collect():
        h = p.nx * pts[:, 0] + p.ny * pts[:, 1] + p.nz * pts[:, 2] + p.d
        got = scores[(p.pool, p.iter)]
        assert got["count"] == int((abs(h) <= 0.035).sum()) and got.below == int((h < -0.05).sum())
        checked += 1
    assert checked > 20


def test_a_run_without_a_floor_is_refused_not_failed(spark, room_up):
    few = spark.createDataFrame([("room", 0, i, float(i), 0.0, 0.0, 1.0) for i in range(2)], "run_id string, frame int, px int, x double, y double, z double, weight double")
    fit = P.fit_ground(few, room_up, P.MEASUREMENT_FIT).collect()
    assert all(r.status == "refused" and r.reason == "fewer than 3 points" for r in fit)


def test_table_top_is_the_level_at_its_height(spark, room):
    plane = spark.createDataFrame([("room", 0.0, 1.0, 0.0, 0.0)], "run_id string, nx double, ny double, nz double, d double")
    found = L.horizontal_levels(room, plane)
    near = L.level_near(found, spark.createDataFrame([("room", "table", 0.75), ("room", "none", 2.0)], "run_id string, label string, expected double"))
    rows = {r.label: r for r in near.collect()}
    assert rows["table"].height == pytest.approx(0.75, abs=1e-3) and rows["none"].height is None


OBJECT = "run_id string, object_id string, frame int, x double, y double, z double, depth double"


def objects(spark, ys, name="o", run="r"):
    return spark.createDataFrame([(run, name, 0, 0.0, float(y), 0.0, 1.0) for y in ys], OBJECT)


def level(spark, rmse=None):
    rows = [("r", 0.0, 1.0, 0.0, 0.0, rmse or 0.0)]
    return spark.createDataFrame(rows, "run_id string, nx double, ny double, nz double, d double, rmse double")


def test_flying_pixels_do_not_move_the_top(spark):
    slab = [i * 0.001 for i in range(1000)] + [5.0] * 15
    h = H.object_heights(objects(spark, slab), level(spark))
    top = H.measure_height(h).first()
    assert top.status == "ok" and top.height < 1.0 and top.max_height == 5.0
    extent = H.vertical_extent(h).first()
    assert extent.height == pytest.approx(0.994 - 0.020, abs=2e-3)


def test_sparse_objects_are_refused(spark):
    h = H.object_heights(objects(spark, range(50)), level(spark))
    row = H.measure_height(h).first()
    assert (row.status, row.height, row.point_count) == ("refused", None, 50)


def test_tails_are_balanced(spark):
    h = H.object_heights(objects(spark, range(1000)), level(spark))
    kept = sorted(r.h for r in H.endpoint_evidence(h).collect())
    assert kept == [float(v) for v in [*range(100), *range(900, 1000)]]
    few = H.object_heights(objects(spark, range(79)), level(spark))
    assert H.endpoint_evidence(few).count() == 0


def test_automatic_extents_use_their_ends_and_keep_a_control(spark):
    ys = [i / 1000 for i in range(1000)]
    points = objects(spark, ys, "auto").union(objects(spark, ys, "brush")).union(objects(spark, ys, "raw"))
    rules = [("r", "auto", 0, "vertical_extent", True, True, False), ("r", "brush", 0, "top_above_floor", False, False, False), ("r", "raw", 0, "vertical_extent", True, False, False)]
    provenance = spark.createDataFrame(rules, "run_id string, object_id string, frame int, mode string, automatic boolean, accepted boolean, occluded boolean")
    rows = {r.object_id: r for r in H.measure_objects(points, level(spark, 0.01), provenance).collect()}
    auto = rows["auto"]
    assert auto.status == "ok" and auto.control_m == pytest.approx(0.979 - 0.019)
    assert auto.adapter_delta_m == pytest.approx(auto.raw_m - auto.control_m) and auto.raw_m > auto.control_m
    assert rows["brush"].status == "ok" and rows["brush"].raw_m == pytest.approx(0.979)
    assert rows["raw"].status.startswith("withheld") and rows["raw"].raw_m is None


def test_components_join_across_corners_only(spark):
    rows = [("a", 0.01, 0.01, 0.01), ("a", 0.06, 0.06, 0.06), ("a", 0.5, 0.5, 0.5), ("a", 0.51, 0.5, 0.5), ("a", 0.52, 0.5, 0.5)]
    rows += [("chain", i * 0.05 + 0.01, 0.0, 0.0) for i in range(64)]
    points = spark.createDataFrame(rows, "k string, x double, y double, z double")
    got = {r.k: r for r in connected_voxels(points, ["k"], 0.05).collect()}
    assert (got["a"].components, got["a"].largest_points, got["a"].voxels) == (2, 3, 3)
    assert (got["chain"].components, got["chain"].largest_share) == (1, 1.0)


def test_components_cross_blocks(spark):
    """Chains through many blocks in any direction, two that only pass each other, and negative places."""
    at = lambda i: 0.05 * i + 0.01
    rows = [("long", at(i), at(-i), 0.0) for i in range(-90, 90)]
    rows += [("two", at(i), 0.01, 0.01) for i in range(-40, 40)] + [("two", at(i), 0.01, 0.16) for i in range(-40, 40)]
    rows += [("corner", at(15), at(15), at(15)), ("corner", at(16), at(16), at(16)), ("corner", at(14), at(17), 0.0), ("nan", float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "k string, x double, y double, z double")
    got = {r.k: (r.components, r.largest_points, r.voxels) for r in connected_voxels(points, ["k"], 0.05).collect()}
    assert got == {"long": (1, 180, 180), "two": (2, 80, 160), "corner": (2, 2, 3)}
    assert connected_voxels(points.where("FALSE"), ["k"], 0.05).count() == 0


def test_components_take_all_valid_pixels(spark):
    """Every depth counts, against a flood fill; the given frames split where near pixels are left out."""
    from plumbline.operators.pixels import pixel_status
    from plumbline.plans import adapters, catalogue

    frames = adapters.frames(spark, SMALL)
    counts, split = {}, {}
    for r in pixel_status(frames).where("status = 'valid'").select("run_id", "frame", "depth", "wx", "wy", "wz").collect():
        cell = tuple(math.floor(v / 0.25) for v in (r.wx, r.wy, r.wz))
        counts.setdefault((r.run_id, r.frame), Counter())[cell] += 1
        if r.depth > 4:
            split.setdefault((r.run_id, r.frame), Counter())[cell] += 1

    def filled(cells):
        left, sizes = set(cells), []
        while left:
            stack, size = [left.pop()], 0
            while stack:
                x, y, z = at = stack.pop()
                size += cells[at]
                for d in itertools.product((-1, 0, 1), repeat=3):
                    near = (x + d[0], y + d[1], z + d[2])
                    if near in left:
                        left.remove(near)
                        stack.append(near)
            sizes.append(size)
        return len(sizes), max(sizes), len(cells)

    wanted = {k: filled(c) for k, c in counts.items()}
    rows = catalogue.PLANS["voxel_components"].job(spark, SMALL).collect()
    assert {(r.run_id, r.frame): (r.components, r.largest_points, r.voxels) for r in rows} == wanted
    assert all(abs(r.largest_share - r.largest_points / counts[r.run_id, r.frame].total()) < 1e-6 for r in rows)
    assert wanted != {k: filled(c) for k, c in split.items()}
