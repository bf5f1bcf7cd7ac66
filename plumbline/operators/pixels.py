"""Pixel work on the frames table.

``frames`` holds one row per (run_id, frame) with the depth and confidence maps
as arrays. A pixel's neighbours are read from the same row while the array is
being unnested, so edge tests, cameras and projection need no shuffle and no
window: pixels only move once something groups them in space.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite, half_up
from plumbline.functions.vectors import Vec
from plumbline.operators.ranks import exploded

MIN_DEPTH = 1e-4
BEHIND = 1e-6
#: Frames of a run are packed into rows of about so many pixels (a larger frame is a row of its own) before they meet its marks.
PIXELS_PER_ROW = 1 << 16
#: The rows of a run are dealt out to so many keys, each of which gets the run's marks.
SLOTS = 16
STATES = ("behind", "outside", "occluded", "visible")


def camera_faults(frames: DataFrame) -> DataFrame:
    """One row per frame with the first thing wrong with it, NULL when usable."""
    k, e = F.col("intrinsics"), F.col("extrinsics")
    pixels = F.col("width") * F.col("height")
    focal_zero = (F.abs(k[0]) > 0) & (F.abs(k[4]) > 0)
    fault = (
        F.when(F.size("depth") != pixels, F.lit("depth size does not match width x height"))
        .when(F.size(k) < 9, F.lit("intrinsics must be a row-major 3x3"))
        .when(F.size(e) < 12, F.lit("extrinsics must be a row-major 3x4"))
        .when(
            F.col("confidence").isNotNull() & (F.size("confidence") != pixels),
            F.lit("confidence size does not match width x height"),
        )
        .when(~F.coalesce(focal_zero, F.lit(False)), F.lit("intrinsics have a zero focal length"))
    )
    return frames.select("run_id", "frame", fault.alias("fault"))


def usable_frames(frames: DataFrame) -> DataFrame:
    """Frames that pass ``camera_faults``; the others belong in a quarantine table."""
    k, e = F.col("intrinsics"), F.col("extrinsics")
    return frames.where(
        (F.size("depth") == F.col("width") * F.col("height"))
        & (F.size(k) >= 9)
        & (F.size(e) >= 12)
        & (F.abs(k[0]) > 0)
        & (F.abs(k[4]) > 0)
    )


def _depth_at(index: Column) -> Column:
    return F.get(F.col("depth"), index.cast("int")).cast("double")


def depth_edge(index: Column, x: Column, y: Column, d: Column, step: float) -> Column:
    """A 4-neighbour differs by more than ``step`` of this depth, or is not finite.

    A neighbour outside the image does not count (it is read as the pixel itself).
    Reads the unfiltered depth map. NaN and infinite jumps compare as larger than
    any limit, so no separate test is needed; this runs once per pixel and its
    generated code has to stay small enough to be compiled.
    """
    width, height = F.col("width"), F.col("height")
    sides = [
        F.when(x > 0, index - 1).otherwise(index),
        F.when(x < width - 1, index + 1).otherwise(index),
        F.when(y > 0, index - width).otherwise(index),
        F.when(y < height - 1, index + width).otherwise(index),
    ]
    missing = f64(float("nan"))
    jumps = [F.abs(F.coalesce(_depth_at(at), missing) - d) for at in sides]
    return F.greatest(*jumps) > F.abs(d) * f64(step)


def in_depth_range(d: Column, low: float = MIN_DEPTH, high: float = float("inf")) -> Column:
    """Finite and inside the range; NaN compares above infinity."""
    top = d < f64(high) if high == float("inf") else d <= f64(high)
    return F.coalesce((d >= f64(low)) & top, F.lit(False))


def back_project(x: Column, y: Column, d: Column) -> Vec:
    """Camera pixel and depth to world, by the transpose of the frame's rotation."""
    k, e = F.col("intrinsics"), F.col("extrinsics")
    g = lambda a, i: a.getItem(i).cast("double")
    rx = (x - g(k, 2)) * d / g(k, 0) - g(e, 3)
    ry = (y - g(k, 5)) * d / g(k, 4) - g(e, 7)
    rz = d - g(e, 11)
    return Vec(
        *(g(e, c) * rx + g(e, c + 4) * ry + g(e, c + 8) * rz for c in range(3))
    )


def pixels(frames: DataFrame) -> DataFrame:
    """The dense pixel table, one row per pixel, row-major index ``px``."""
    return (
        frames.select("run_id", "frame", "width", "confidence", F.posexplode("depth").alias("px", "depth"))
        .select(
            "run_id",
            "frame",
            "px",
            (F.col("px") % F.col("width")).alias("x"),
            F.expr("px div width").alias("y"),
            F.col("depth").cast("double").alias("depth"),
            F.get("confidence", F.col("px")).cast("double").alias("confidence"),
        )
    )


def pixel_status(
    frames: DataFrame,
    min_confidence: float = 0.0,
    max_relative_step: float = 0.0,
    min_depth: float = MIN_DEPTH,
    max_depth: float = float("inf"),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Whole frames back-projected: every pixel with its status and world point.

    ``status`` is the first failing test of depth, confidence, edge, else valid;
    the point is NULL unless valid. The edge test is off at step 0. ``carry``
    names per-frame columns to repeat on the pixels.
    """
    edge = _edge(max_relative_step)
    status = F.when(~in_depth_range(F.col("d"), min_depth, max_depth), F.lit("depth"))
    if min_confidence > 0:
        status = status.when(F.col("c") < f64(min_confidence), F.lit("confidence"))
    if edge is not None:
        status = status.when(edge, F.lit("edge"))
    flagged = _unnested(frames).withColumn("status", status.otherwise(F.lit("valid")))
    world = back_project(F.col("x"), F.col("y"), F.col("d"))
    valid = F.col("status") == "valid"
    point = [F.when(valid, part).alias(name) for part, name in zip(world, ("wx", "wy", "wz"))]
    return flagged.select(
        *PIXEL,
        F.col("d").alias("depth"),
        F.col("c").alias("confidence"),
        "status",
        *point,
        *_colours(frames),
        *carry,
    )


PIXEL = ["run_id", "frame", "px", "x", "y"]


def _unnested(frames: DataFrame) -> DataFrame:
    """Pixel rows that still reach their frame's packed arrays."""
    return (
        usable_frames(frames)
        .select("*", F.posexplode("depth").alias("px", "d0"))
        .withColumn("d", F.col("d0").cast("double"))
        .withColumn("x", F.col("px") % F.col("width"))
        .withColumn("y", F.expr("px div width"))
        .withColumn("c", F.get("confidence", F.col("px")).cast("double"))
    )


def _edge(step: float) -> Column | None:
    if step <= 0:
        return None
    return depth_edge(F.col("px"), F.col("x"), F.col("y"), F.col("d"), step)


def _colours(frames: DataFrame) -> list[Column]:
    return [F.get(c, F.col("px")).alias(c) for c in ("r", "g", "b") if c in frames.columns]


def valid_points(
    frames: DataFrame,
    max_relative_step: float = 0.0,
    min_depth: float = MIN_DEPTH,
    max_depth: float = float("inf"),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Only the valid pixels of ``pixel_status``, tested once and projected."""
    keep = in_depth_range(F.col("d"), min_depth, max_depth)
    edge = _edge(max_relative_step)
    if edge is not None:
        keep = keep & ~edge
    world = back_project(F.col("x"), F.col("y"), F.col("d"))
    point = [part.alias(name) for part, name in zip(world, ("wx", "wy", "wz"))]
    return (
        _unnested(frames)
        .where(keep)
        .select(
            *PIXEL,
            F.col("d").alias("depth"),
            F.col("c").alias("confidence"),
            *point,
            *_colours(frames),
            *carry,
        )
    )


def frame_point_counts(status: DataFrame) -> DataFrame:
    """Per frame: pixels, valid points and points lost to depth edges."""
    return status.groupBy("run_id", "frame").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(F.col("status") == "valid").alias("valid"),
        F.count_if(F.col("status") == "edge").alias("edge_rejected"),
    )


def mask_points(
    frames: DataFrame,
    masks: DataFrame,
    max_relative_step: float = 0.05,
    min_depth: float = MIN_DEPTH,
    max_depth: float = float("inf"),
) -> DataFrame:
    """Masked back-projection with ordered rejection.

    ``masks`` carries set pixels (run_id, object_id, frame, x, y, ``kept`` from
    the erosion) and an optional ``min_confidence`` per row. Only frames that
    have a mask are read past the scan; the depth map stays packed and each mask
    pixel indexes it.
    """
    columns = ["run_id", "frame", "width", "height", "depth", "confidence", "intrinsics", "extrinsics"]
    joined = masks.join(usable_frames(frames).select(*columns), ["run_id", "frame"])
    index = F.col("y") * F.col("width") + F.col("x")
    floor = F.coalesce(F.col("min_confidence"), f64(0)) if "min_confidence" in masks.columns else f64(0)
    d, x, y = F.col("d"), F.col("x"), F.col("y")
    read = joined.withColumn("d", _depth_at(index)).withColumn(
        "c", F.get("confidence", index.cast("int")).cast("double")
    )
    status = (
        F.when(~F.col("kept"), F.lit("eroded"))
        .when(~in_depth_range(d, min_depth, max_depth), F.lit("depth"))
        .when(F.col("c") < floor, F.lit("confidence"))
    )
    if max_relative_step > 0:
        status = status.when(depth_edge(index, x, y, d, max_relative_step), F.lit("discontinuity"))
    world = back_project(x, y, d)
    flagged = read.withColumn("status", status.otherwise(F.lit("kept")))
    kept = F.col("status") == "kept"
    return flagged.select(
        "run_id",
        "object_id",
        "frame",
        "x",
        "y",
        F.col("d").alias("depth"),
        "status",
        *(F.when(kept, part).alias(name) for part, name in zip(world, ("wx", "wy", "wz"))),
    )


def mask_point_counts(points: DataFrame) -> DataFrame:
    """Per (run, object, frame): masked pixels, points kept, and the count of each rejection."""
    count = lambda s: F.count_if(F.col("status") == s)
    return points.groupBy("run_id", "object_id", "frame").agg(
        F.count(F.lit(1)).alias("masked_pixels"),
        count("kept").alias("point_count"),
        count("eroded").alias("eroded"),
        count("depth").alias("depth_rejected"),
        count("confidence").alias("confidence_rejected"),
        count("discontinuity").alias("discontinuity_rejected"),
    )


def confidence_floor(frames: DataFrame, drop_percent: float) -> DataFrame:
    """Per-frame nearest-rank confidence percentile, 0 without a confidence map.

    The map is already in the row, so sorting it there costs no shuffle.
    """
    values = F.sort_array(F.filter("confidence", lambda v: finite(v.cast("double"))))
    share = f64(min(100.0, max(0.0, drop_percent)) / 100.0)
    rank = F.greatest(F.lit(1), F.ceil(share * F.size(values))).cast("int")
    picked = F.when(F.size(values) > 0, F.get(values, rank - 1).cast("double"))
    return frames.select(
        "run_id", "frame", F.coalesce(picked, f64(0)).alias("min_confidence")
    )


def depth_preview(frames: DataFrame) -> DataFrame:
    """Depth stretched per frame from its 2nd..98th (interpolated) percentile to 0..255."""
    values = F.sort_array(F.filter(F.col("depth"), lambda v: finite(v.cast("double"))))

    def interpolated(p: float) -> Column:
        n = F.size("_v")
        at = f64(p) * (n - 1)
        low = F.floor(at).cast("int")
        a = F.get("_v", low).cast("double")
        b = F.get("_v", F.least(low + 1, n - 1)).cast("double")
        return a + (b - a) * (at - low)

    ranged = (
        frames.withColumn("_v", values)
        .where(F.size("_v") > 0)
        .withColumn("_lo", interpolated(0.02))
        .withColumn("_hi", interpolated(0.98))
        .select("run_id", "frame", "width", "_lo", "_hi", F.posexplode("depth").alias("px", "d"))
    )
    share = (F.col("d").cast("double") - F.col("_lo")) / F.greatest(
        F.col("_hi") - F.col("_lo"), f64(1e-8)
    )
    level = F.floor(F.greatest(f64(0), F.least(f64(1), share)) * f64(255)).cast("int")
    return ranged.select(
        "run_id",
        "frame",
        (F.col("px") % F.col("width")).alias("x"),
        F.expr("px div width").alias("y"),
        F.when(finite(F.col("d").cast("double")), level).alias("level"),
    )


def project(p: Vec, k: Column, e: Column) -> Vec:
    """World point to (pixel x, pixel y, depth) of one camera; NULL behind it."""
    g = lambda a, i: a.getItem(i).cast("double")
    cam = [g(e, r) * p.x + g(e, r + 1) * p.y + g(e, r + 2) * p.z + g(e, r + 3) for r in (0, 4, 8)]
    ahead = cam[2] > f64(BEHIND)
    return Vec(
        F.when(ahead, g(k, 0) * cam[0] / cam[2] + g(k, 2)),
        F.when(ahead, g(k, 4) * cam[1] / cam[2] + g(k, 5)),
        F.when(ahead, cam[2]),
    )


def view_visibility(marks: DataFrame, frames: DataFrame) -> DataFrame:
    """Each mark seen from each camera of its run: pixel, depth and state.

    ``marks`` is rows of bounded arrays of world points (see
    ``audits.overlay_marks``): each block meets each frame of its run once, and
    ``mark`` is the point's place in the run. The depth map is indexed in place. A mark is occluded when it lies behind the recorded
    surface by more than max(3 cm, 2 %).
    """
    columns = ["run_id", "frame", "width", "height", "depth", "intrinsics", "extrinsics"]
    joined = (
        usable_frames(frames)
        .select(*columns)
        .join(marks, "run_id")
        .select("*", F.explode("marks").alias("_m"))
        .withColumn("mark", F.col("_m.i"))
    )
    at = Vec(F.col("_m.wx"), F.col("_m.wy"), F.col("_m.wz"))
    seen = project(at, F.col("intrinsics"), F.col("extrinsics"))
    placed = joined.withColumn("u", seen.x).withColumn("v", seen.y).withColumn("z", seen.z)
    u, v, z = F.col("u"), F.col("v"), F.col("z")
    inside = (u >= 0) & (v >= 0) & (u < F.col("width")) & (v < F.col("height"))
    surface = F.col("surface")
    index = half_up(v) * F.col("width") + half_up(u)
    behind = finite(surface) & (z > surface + F.greatest(f64(0.03), f64(0.02) * surface))
    state = (
        F.when(z.isNull(), F.lit("behind"))
        .when(~F.coalesce(inside, F.lit(False)), F.lit("outside"))
        .when(F.coalesce(behind, F.lit(False)), F.lit("occluded"))
        .otherwise(F.lit("visible"))
    )
    return (
        placed.withColumn("surface", F.when(inside, _depth_at(index)))
        .withColumn("state", state)
        .select("run_id", "frame", "mark", "u", "v", "z", "state")
    )


def _seen(x: np.ndarray, y: np.ndarray, z: np.ndarray, size: tuple[int, int], k: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """``project`` for arrays: which points lie behind the camera, and pixel index and depth of those inside the image."""
    cam = [e[r] * x + e[r + 1] * y + e[r + 2] * z + e[r + 3] for r in (0, 4, 8)]
    ahead = cam[2] > BEHIND
    with np.errstate(all="ignore"):
        u, v = k[0] * cam[0] / cam[2] + k[2], k[4] * cam[1] / cam[2] + k[5]
    inside = ahead & (u >= 0) & (v >= 0) & (u < size[0]) & (v < size[1])
    index = np.floor(v[inside] + 0.5).astype(np.int64) * size[0] + np.floor(u[inside] + 0.5).astype(np.int64)
    # Not finite is not behind: NaN stands above all numbers in the DataFrame form.
    return ~ahead & ~np.isnan(cam[2]), index, cam[2][inside]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of frames and marks, per frame how many of the marks are in each state."""

    def numbers(lists: pa.ListArray) -> list[np.ndarray]:
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        return [flat[a:b] for a, b in zip(at, at[1:])]

    for batch in batches:
        runs, found = [], []
        views, marks = batch.column("views"), batch.column("marks")
        v_at, m_at = views.offsets.to_numpy(), marks.offsets.to_numpy()
        for row in range(batch.num_rows):
            own = views.values.slice(v_at[row], v_at[row + 1] - v_at[row])
            frame, width, height = (own.field(c).to_numpy(zero_copy_only=False) for c in ("frame", "width", "height"))
            depth, k, e = (numbers(own.field(c)) for c in ("depth", "intrinsics", "extrinsics"))
            points = marks.values.slice(m_at[row], m_at[row + 1] - m_at[row])
            x, y, z = (points.field(c).to_numpy(zero_copy_only=False) for c in ("wx", "wy", "wz"))
            cameras: dict[tuple, list[int]] = {}
            for i in range(len(own)):
                cameras.setdefault((int(width[i]), int(height[i]), k[i].tobytes(), e[i].tobytes()), []).append(i)
            for (w, h, *_), same in cameras.items():
                behind, index, far = _seen(x, y, z, (w, h), k[same[0]], e[same[0]])
                for i in same:
                    # A pixel that rounds past the last one has no depth, and nothing is behind a depth that is not finite.
                    limit = np.full(w * h + w + 2, np.inf)
                    limit[: w * h] = np.where(np.isfinite(depth[i]), depth[i] + np.maximum(0.03, 0.02 * depth[i]), np.inf)
                    occluded = int((far > limit[index]).sum())
                    back = int(behind.sum())
                    found.append((frame[i], back, len(x) - back - len(index), occluded, len(index) - occluded))
                    runs.append(row)
        if found:
            first, *rest = zip(*found)
            columns = [batch.column("run_id").take(pa.array(runs)), pa.array(first, views.values.field("frame").type)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in rest)], ["run_id", "frame", *STATES])


def visibility_counts(marks: DataFrame, frames: DataFrame) -> DataFrame:
    """(run_id, frame, behind, outside, occluded, visible): how many marks ``view_visibility`` finds in each state.

    Every mark is judged from every frame of its run, but no row is made for each: frames are packed into rows of
    bounded size, and each such row meets each block of marks in one step over arrays. Frames of a row that share a
    camera share the projection. The rows of a run are dealt out to ``SLOTS`` keys, so that a run is not one task.
    """
    usable = usable_frames(frames)
    kinds = dict(frames.dtypes)
    pixels_of = (F.col("width") * F.col("height")).cast("long")
    sizes = usable.groupBy("run_id").agg(F.ceil(F.sum(pixels_of) / PIXELS_PER_ROW).alias("_rows"))
    maps = [F.col(c).cast("array<double>").alias(c) for c in ("depth", "intrinsics", "extrinsics")]
    view = F.struct("frame", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *maps)
    row = F.pmod(F.xxhash64("frame"), F.col("_rows"))
    packed = usable.join(sizes, "run_id").groupBy("run_id", row.alias("_row")).agg(F.collect_list(view).alias("views"))
    dealt = packed.withColumn("_slot", (F.col("_row") % SLOTS).cast("int"))
    spread = marks.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    met = dealt.join(exploded(spread), ["run_id", "_slot"]).select("run_id", "views", "marks")
    counts = met.mapInArrow(_counted, f"run_id {kinds['run_id']}, frame {kinds['frame']}, " + ", ".join(f"{s} long" for s in STATES))
    return counts.groupBy("run_id", "frame").agg(*(F.sum(s).alias(s) for s in STATES))


def best_view(visibility: DataFrame, keys: list[str]) -> DataFrame:
    """The frame that sees most of the marks; the earliest wins a tie."""
    counts = visibility.groupBy(*keys, "frame").agg(
        F.count_if(F.col("state") == "visible").alias("visible"),
        F.count_if(F.col("state") == "occluded").alias("occluded"),
    )
    return best_of_counts(counts, keys)


def best_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``best_view`` from the counts of each frame."""
    best = F.max_by(F.struct("frame", F.col("visible").alias("marks"), "occluded"), F.struct("visible", -F.col("frame")))
    return counts.where(F.col("visible") > 0).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
