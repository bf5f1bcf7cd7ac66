"""Pixel, mask and selection jobs over the frame view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.functions.vectors import (
    Vec,
    invert_rigid4,
    transform_direction,
    transform_point,
    usable_alignment,
    vec,
)
from plumbline.operators import audits, masks as M, pixels as P
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6, r6s

MOVED = """moved AS (
    SELECT w.*, 8e-1 * wx - 6e-1 * wy + ax AS mx, 6e-1 * wx + 8e-1 * wy AS my, wz + 5e-1 AS mz
    FROM world w JOIN align USING (run_id))"""

ERODED = """eroded AS (
    SELECT m.run_id, m.object_id, m.frame, m.x, m.y,
           count(*) FILTER (abs(n.x - m.x) <= 1 AND abs(n.y - m.y) <= 1) = 9 AS kept
    FROM mask m JOIN mask n ON m.run_id = n.run_id AND m.object_id = n.object_id AND m.frame = n.frame
    GROUP BY ALL)"""

FLOOR20 = """floor20 AS (
    SELECT run_id, frame, quantile_disc(confidence, 2e-1) AS min_confidence FROM px GROUP BY ALL)"""

SELECTED = """selected AS (
    SELECT e.run_id, e.object_id, e.frame, e.x, e.y, w.depth, w.wx, w.wy, w.wz, w.rx, w.ry, w.rz,
           CASE WHEN NOT kept THEN 'eroded' WHEN NOT (w.depth >= 1e-4) THEN 'depth'
                WHEN confidence < min_confidence THEN 'confidence'
                WHEN step > w.depth * 8e-2 THEN 'discontinuity' ELSE 'kept' END AS status
    FROM eroded e JOIN world w USING (run_id, frame, x, y) JOIN floor20 USING (run_id, frame))"""


@plan(
    "pixel_grid",
    "S4",
    A.cte("px") + f" SELECT run_id, frame, px, x, y, {r6s('depth', 'confidence')} FROM px",
)
def pixel_grid(spark: SparkSession, sf: str) -> DataFrame:
    return publish(P.pixels(A.frames(spark, sf)))


@plan(
    "camera_faults",
    "B3",
    "SELECT CAST(label AS BIGINT) AS run_id, count(*) AS frames, "
    "count(*) FILTER (len(embedding) <> 64) AS faulty FROM embeddings GROUP BY ALL",
)
def camera_faults(spark: SparkSession, sf: str) -> DataFrame:
    checked = P.camera_faults(A.frames(spark, sf))
    return publish(
        checked.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("frames"), F.count("fault").alias("faulty")
        )
    )


@plan(
    "depth_edges",
    "B4",
    A.cte("px", "edge")
    + " SELECT run_id, frame, count(*) FILTER (step > depth * 8e-2) AS edges_8, "
    "count(*) FILTER (step > depth * 5e-2) AS edges_5 FROM jump GROUP BY ALL",
)
def depth_edges(spark: SparkSession, sf: str) -> DataFrame:
    frames = P.usable_frames(A.frames(spark, sf)).select(
        "run_id", "frame", "width", "height", "depth", F.posexplode("depth").alias("px", "d")
    )
    x, y = F.col("px") % F.col("width"), F.expr("px div width")
    edge = lambda s: F.count_if(P.depth_edge(F.col("px"), x, y, F.col("d"), s))
    return publish(
        frames.groupBy("run_id", "frame").agg(edge(0.08).alias("edges_8"), edge(0.05).alias("edges_5"))
    )


@plan(
    "frame_points",
    "B6",
    A.cte("px", "edge", "cam", "world")
    + " SELECT run_id, frame, px, CASE WHEN step > depth * 8e-2 THEN 'edge' ELSE 'valid' END AS status, "
    + ", ".join(r6(f"CASE WHEN step <= depth * 8e-2 THEN {c} END", c) for c in ("wx", "wy", "wz"))
    + " FROM world",
)
def frame_points(spark: SparkSession, sf: str) -> DataFrame:
    status = P.pixel_status(A.frames(spark, sf), max_relative_step=0.08)
    return publish(status.select("run_id", "frame", "px", "status", "wx", "wy", "wz"))


@plan(
    "frame_point_counts",
    "B6, C16 (counts)",
    A.cte("px", "edge")
    + " SELECT run_id, frame, count(*) AS pixels, count(*) FILTER (depth BETWEEN 37e-1 AND 425e-2 "
    "AND confidence >= 15e-1 AND step <= depth * 8e-2) AS valid, count(*) FILTER (depth BETWEEN 37e-1 AND 425e-2 "
    "AND confidence >= 15e-1 AND step > depth * 8e-2) AS edge_rejected FROM jump GROUP BY ALL",
)
def frame_point_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = P.pixel_status(
        A.frames(spark, sf), min_confidence=1.5, max_relative_step=0.08, min_depth=3.7, max_depth=4.25
    )
    return publish(P.frame_point_counts(status))


@plan(
    "aligned_points",
    "V8, V12",
    A.cte("px", "edge", "cam", "world", "align")
    + f", {MOVED} SELECT run_id, frame, px, {r6s('mx', 'my', 'mz')} FROM moved",
)
def aligned_points(spark: SparkSession, sf: str) -> DataFrame:
    aligned = A.alignments(spark, sf).withColumn("alignment", usable_alignment(F.col("alignment")))
    status = P.pixel_status(A.frames(spark, sf)).join(aligned, "run_id")
    moved = transform_point(F.col("alignment"), vec("wx", "wy", "wz"))
    return publish(
        status.select(
            "run_id", "frame", "px", *(p.alias(n) for p, n in zip(moved, ("mx", "my", "mz")))
        )
    )


@plan(
    "inverse_alignment",
    "V9, V10",
    A.cte("align")
    + f" SELECT run_id, {r6('8e-1', 'i0')}, {r6('6e-1', 'i1')}, {r6('-8e-1 * ax', 'i3')}, "
    f"{r6('-6e-1', 'i4')}, {r6('8e-1', 'i5')}, {r6('6e-1 * ax', 'i7')}, {r6('-5e-1', 'i11')}, "
    f"{r6('-6e-1', 'up_x')}, {r6('8e-1', 'up_y')} FROM align",
)
def inverse_alignment(spark: SparkSession, sf: str) -> DataFrame:
    inverse = A.alignments(spark, sf).withColumn("inverse", invert_rigid4(F.col("alignment")))
    up = transform_direction(F.col("alignment"), Vec(f64(0), f64(1), f64(0)))
    cells = [F.col("inverse")[i].alias(f"i{i}") for i in (0, 1, 3, 4, 5, 7, 11)]
    return publish(inverse.select("run_id", *cells, up.x.alias("up_x"), up.y.alias("up_y")))


@plan(
    "depth_preview",
    "V15",
    A.cte("px")
    + """, marks AS (SELECT run_id, frame, quantile_cont(depth, 2e-2) AS lo, quantile_cont(depth, 98e-2) AS hi
         FROM px GROUP BY ALL)
    SELECT run_id, frame, x, y, CAST(floor(greatest(0e0, least(1e0,
           (depth - lo) / greatest(hi - lo, 1e-8))) * 255e0) AS BIGINT) AS level
    FROM px JOIN marks USING (run_id, frame)""",
)
def depth_preview(spark: SparkSession, sf: str) -> DataFrame:
    return publish(P.depth_preview(A.frames(spark, sf)))


@plan(
    "mask_resample",
    "B1",
    A.cte("px", "mask")
    + """, grid AS (SELECT tx, ty, least(7, (2 * tx + 1) * 8 // (2 * 20)) AS sx,
                           least(7, (2 * ty + 1) * 8 // (2 * 12)) AS sy
                    FROM (SELECT unnest(range(20)) AS tx), (SELECT unnest(range(12)) AS ty))
    SELECT run_id, object_id, frame, tx AS x, ty AS y FROM grid JOIN mask ON sx = x AND sy = y""",
)
def mask_resample(spark: SparkSession, sf: str) -> DataFrame:
    return publish(M.resample(A.masks(spark, sf), A.SIDE, A.SIDE, 20, 12))


@plan("mask_erosion", "B2", A.cte("px", "mask") + f", {ERODED} SELECT * FROM eroded")
def mask_erosion(spark: SparkSession, sf: str) -> DataFrame:
    return publish(M.erode(A.masks(spark, sf), 1))


@plan(
    "confidence_floor",
    "B8",
    A.cte("px") + f", {FLOOR20} SELECT run_id, frame, {r6s('min_confidence')} FROM floor20",
)
def confidence_floor(spark: SparkSession, sf: str) -> DataFrame:
    return publish(P.confidence_floor(A.frames(spark, sf), 20))


def selected_points(spark: SparkSession, sf: str) -> DataFrame:
    """Mask pixels with the erosion, the per-frame floor and the edge test applied."""
    frames = A.frames(spark, sf)
    eroded = M.erode(A.masks(spark, sf), 1)
    floors = P.confidence_floor(frames, 20)
    return P.mask_points(frames, eroded.join(floors, ["run_id", "frame"]), max_relative_step=0.08)


@plan(
    "brush_selection",
    "B5, B7, V8",
    A.cte("px", "mask", "edge", "cam", "world", "align")
    + f", {ERODED}, {FLOOR20}, {SELECTED} SELECT run_id, object_id, frame, x, y, status, "
    + r6("CASE WHEN status = 'kept' THEN 8e-1 * wx - 6e-1 * wy + ax END", "mx")
    + ", "
    + r6("CASE WHEN status = 'kept' THEN 6e-1 * wx + 8e-1 * wy END", "my")
    + ", "
    + r6("CASE WHEN status = 'kept' THEN wz + 5e-1 END", "mz")
    + " FROM selected JOIN align USING (run_id)",
)
def brush_selection(spark: SparkSession, sf: str) -> DataFrame:
    points = selected_points(spark, sf).join(A.alignments(spark, sf), "run_id")
    moved = transform_point(F.col("alignment"), vec("wx", "wy", "wz"))
    return publish(
        points.select(
            "run_id", "object_id", "frame", "x", "y", "status",
            *(p.alias(n) for p, n in zip(moved, ("mx", "my", "mz"))),
        )
    )


@plan(
    "selection_rejections",
    "B5",
    A.cte("px", "mask", "edge", "cam", "world")
    + f", {ERODED}, {FLOOR20}, {SELECTED}"
    + """ SELECT run_id, object_id, frame, count(*) AS masked_pixels,
        count(*) FILTER (status = 'kept') AS point_count, count(*) FILTER (status = 'eroded') AS eroded,
        count(*) FILTER (status = 'depth') AS depth_rejected,
        count(*) FILTER (status = 'confidence') AS confidence_rejected,
        count(*) FILTER (status = 'discontinuity') AS discontinuity_rejected
    FROM selected GROUP BY ALL""",
)
def selection_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return publish(P.mask_point_counts(selected_points(spark, sf)))


@plan(
    "round_trip",
    "B9, B12",
    A.cte("px", "mask", "edge", "cam", "world")
    + f", {ERODED}, {FLOOR20}, {SELECTED}"
    + """, back AS (SELECT s.run_id, object_id, frame,
           floor((8e0 * (wx + tx) / (s_ * wy + c_ * wz + tz) + 35e-1) + 5e-1) AS u,
           floor((8e0 * (c_ * wy - s_ * wz + ty) / (s_ * wy + c_ * wz + tz) + 35e-1) + 5e-1) AS v, s.x, s.y
         FROM selected s JOIN (SELECT run_id, frame, c AS c_, s AS s_, tx, ty, tz FROM cam) k USING (run_id, frame)
         WHERE status = 'kept'),
    hit AS (SELECT b.run_id, b.object_id, b.frame, b.x, b.y, bool_or(m.x IS NOT NULL) AS hit
         FROM back b LEFT JOIN mask m ON m.run_id = b.run_id AND m.object_id = b.object_id
           AND m.frame = b.frame AND abs(m.x - u) <= 1 AND abs(m.y - v) <= 1 GROUP BY ALL)
    SELECT run_id, object_id, frame, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses
    FROM hit GROUP BY ALL""",
)
def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    kept = selected_points(spark, sf).where(F.col("status") == "kept")
    return publish(audits.round_trip(kept, A.frames(spark, sf), A.masks(spark, sf)))


MARKS = """numbered AS (
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame, px) - 1 AS o
        FROM world WHERE step > depth * 8e-2),
    marks AS (SELECT run_id, o AS mark, wx, wy, wz FROM numbered),
    seen AS (
        SELECT m.run_id, k.frame, mark, wx + tx AS a, c * wy - s * wz + ty AS b, s * wy + c * wz + tz AS z
        FROM marks m JOIN cam k USING (run_id)),
    spot AS (
        SELECT run_id, frame, mark, z, CASE WHEN z > 1e-6 THEN 8e0 * a / z + 35e-1 END AS u,
               CASE WHEN z > 1e-6 THEN 8e0 * b / z + 35e-1 END AS v FROM seen),
    judged AS (
        SELECT p.run_id, p.frame, mark, CASE WHEN u IS NULL THEN 'behind'
               WHEN NOT (u >= 0 AND v >= 0 AND u < 8 AND v < 8) THEN 'outside'
               WHEN p.z > d.depth + greatest(3e-2, 2e-2 * d.depth) THEN 'occluded' ELSE 'visible' END AS state
        FROM spot p LEFT JOIN px d ON u >= 0 AND v >= 0 AND u < 8 AND v < 8 AND d.run_id = p.run_id
          AND d.frame = p.frame AND d.px = floor(v + 5e-1) * 8 + floor(u + 5e-1))"""


def edge_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks on the depth edges of each run, the selection drawn over its frames."""
    status = P.pixel_status(A.frames(spark, sf))
    step = P.pixel_status(A.frames(spark, sf), max_relative_step=0.08).where(F.col("status") == "edge")
    points = status.join(step.select("run_id", "frame", "px"), ["run_id", "frame", "px"], "left_semi")
    named = points.select("run_id", "frame", "px", *(F.col(f"w{c}").alias(c) for c in "xyz"))
    return audits.overlay_marks(named, ["px"])


@plan(
    "mark_visibility",
    "B9, B10",
    A.cte("px", "edge", "cam", "world")
    + f", {MARKS} SELECT run_id, frame, state, count(*) AS marks FROM judged GROUP BY ALL",
)
def mark_visibility(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.visibility_counts(edge_marks(spark, sf), A.frames(spark, sf))
    states = counts.unpivot(["run_id", "frame"], list(P.STATES), "state", "marks")
    return publish(states.where("marks > 0"))


@plan(
    "best_view",
    "B11",
    A.cte("px", "edge", "cam", "world")
    + f""", {MARKS}, tally AS (SELECT run_id, frame, count(*) FILTER (state = 'visible') AS marks,
             count(*) FILTER (state = 'occluded') AS occluded FROM judged GROUP BY ALL)
    SELECT run_id, frame, marks, occluded FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY marks DESC, frame) AS k FROM tally WHERE marks > 0)
    WHERE k = 1""",
)
def best_view(spark: SparkSession, sf: str) -> DataFrame:
    return publish(P.best_of_counts(P.visibility_counts(edge_marks(spark, sf), A.frames(spark, sf)), ["run_id"]))


@plan(
    "mask_runs",
    "T1",
    A.cte("px", "mask")
    + """ SELECT run_id, object_id, frame, min(i) AS start, count(*) AS len FROM (
        SELECT *, y * 8 + x AS i, y * 8 + x - row_number() OVER (PARTITION BY run_id, object_id, frame ORDER BY y, x) AS g
        FROM mask) GROUP BY run_id, object_id, frame, g""",
)
def mask_runs(spark: SparkSession, sf: str) -> DataFrame:
    return publish(M.encode_runs(A.masks(spark, sf), A.SIDE))


@plan("mask_decoded", "T2", A.cte("px", "mask") + " SELECT run_id, object_id, frame, x, y FROM mask")
def mask_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return publish(M.decode_runs(M.encode_runs(A.masks(spark, sf), A.SIDE), A.SIDE))


@plan(
    "mask_snapshot",
    "T3",
    A.cte("px", "mask")
    + """, g AS (SELECT *, y * 8 + x AS i, y * 8 + x - row_number() OVER (
             PARTITION BY run_id, object_id, frame ORDER BY y, x) AS isle FROM mask),
    rl AS (SELECT run_id, object_id, frame, min(i) AS start, count(*) AS len FROM g
           GROUP BY run_id, object_id, frame, isle)
    SELECT run_id, object_id, frame, CAST(sum(len) AS BIGINT) AS painted_pixels,
           substr(sha256('8x8:' || string_agg(start || ',' || len, ',' ORDER BY start)), 1, 16) AS digest
    FROM rl GROUP BY ALL""",
)
def mask_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    runs = M.encode_runs(A.masks(spark, sf), A.SIDE)
    return publish(M.snapshot(runs, A.SIDE, A.SIDE).drop("runs"))


@plan(
    "mask_boundary",
    "T4",
    A.cte("px")
    + f""" SELECT run_id, frame, {r6("count(*) FILTER (x IN (0, 7) OR y IN (0, 7)) / 28e0", "boundary_fraction")}
    FROM px WHERE depth > 39e-1 GROUP BY ALL""",
)
def mask_boundary(spark: SparkSession, sf: str) -> DataFrame:
    far = A.pixel_rows(spark, sf).where(F.col("depth") > f64(3.9))
    return publish(M.boundary_fraction(far, A.SIDE, A.SIDE, ["run_id", "frame"]))


@plan(
    "mask_candidates",
    "T5",
    f""" SELECT vec_id, idx, {r6s('score', 'margin')} FROM (
      SELECT vec_id, idx, score, score - lead(score) OVER w AS margin, row_number() OVER w AS k FROM (
        SELECT vec_id, i AS idx, abs(CAST(embedding[i * 20 + 1] AS DOUBLE)) * 2e0 AS score
        FROM embeddings, (SELECT unnest(range(3)) AS i) r)
      WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, idx)) WHERE k = 1""",
)
def mask_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    rows = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"), "embedding").select(
        "vec_id", "idx", (F.abs(F.get("embedding", F.col("idx") * 20).cast("double")) * f64(2)).alias("score")
    )
    return publish(M.best_candidate(rows, ["vec_id"]))


@plan(
    "mask_review",
    "T6",
    """ SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'no positive click' WHEN vec_id % 5 = 0 THEN NULL
        WHEN score < 7e-1 THEN 'low mask confidence' WHEN margin < 15e-3 THEN 'two nearly equal masks'
        WHEN boundary > 4e-2 THEN 'mask reaches too much of the boundary' END AS issue FROM (
      SELECT vec_id, 5e-1 + 2e0 * abs(CAST(embedding[1] AS DOUBLE)) AS score,
             abs(CAST(embedding[2] AS DOUBLE)) AS margin, abs(CAST(embedding[3] AS DOUBLE)) / 2e0 AS boundary
      FROM embeddings)""",
)
def mask_review(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    v = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    source = F.when(F.col("vec_id") % 5 == 0, F.lit("model+brush")).otherwise(F.lit("model"))
    issue = M.review_issue(
        F.col("vec_id") % 11 != 0, source, f64(0.5) + f64(2) * v(0), v(1), v(2) / f64(2)
    )
    return publish(e.select("vec_id", issue.alias("issue")))


@plan(
    "brush_strokes",
    "B17",
    """ WITH strokes AS (
        SELECT event_id // 25 AS frame, event_id AS seq, event_id * 7 % 40 AS x0, event_id * 11 % 30 AS y0,
               event_id * 13 % 40 AS x1, event_id * 5 % 30 AS y1, 15e-1 + event_id % 4 AS radius,
               event_type = 'error' AS erase FROM events),
    walk AS (SELECT *, greatest(1, CAST(ceil(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / greatest(1e0, radius * 45e-2)) AS BIGINT)) AS n
             FROM strokes),
    stamps AS (SELECT frame, seq, erase, radius, x0 + (x1 - x0) * (k / CAST(n AS DOUBLE)) AS cx,
                      y0 + (y1 - y0) * (k / CAST(n AS DOUBLE)) AS cy
               FROM (SELECT *, unnest(range(n + 1)) AS k FROM walk)),
    grid AS (SELECT x, y FROM (SELECT unnest(range(40)) AS x), (SELECT unnest(range(30)) AS y))
    SELECT frame, x, y FROM (
        SELECT frame, x, y, max_by(erase, seq) AS gone FROM stamps JOIN grid
          ON (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius GROUP BY ALL)
    WHERE NOT gone""",
)
def brush_strokes(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    at = lambda k, size: (F.col("event_id") * k % size).cast("double")
    strokes = e.select(
        F.expr("event_id div 25").alias("frame"),
        F.col("event_id").alias("seq"),
        at(7, 40).alias("x0"),
        at(11, 30).alias("y0"),
        at(13, 40).alias("x1"),
        at(5, 30).alias("y1"),
        (f64(1.5) + F.col("event_id") % 4).alias("radius"),
        (F.col("event_type") == "error").alias("erase"),
    )
    return publish(M.paint(strokes, 40, 30, ["frame"]))
