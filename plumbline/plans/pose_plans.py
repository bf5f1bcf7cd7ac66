"""Camera path jobs over the frame view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.operators import poses as G
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6, r6s

# The second rotation row is (0, c, -s); its length is 1 up to rounding.
GRAVITY = """down AS (
    SELECT run_id, sum(c / sqrt(c * c + s * s)) AS sy, sum(-s / sqrt(c * c + s * s)) AS sz, count(*) AS frame_count
    FROM cam GROUP BY ALL),
gravity AS (
    SELECT run_id, 0e0 AS ux, -sy / sqrt(sy * sy + sz * sz) AS uy, -sz / sqrt(sy * sy + sz * sz) AS uz,
           sqrt(sy * sy + sz * sz) / frame_count AS coherence, frame_count FROM down)"""
CENTRES = """centres AS (
    SELECT run_id, frame, -tx AS cx, -(c * ty + s * tz) AS cy, -(-s * ty + c * tz) AS cz FROM cam)"""


@plan(
    "gravity",
    "G1, G9",
    A.cte("cam")
    + f", {GRAVITY} SELECT run_id, {r6s('ux', 'uy', 'uz', 'coherence')}, frame_count, "
    "CASE WHEN coherence < 7e-1 THEN 'camera up is incoherent' END AS reason FROM gravity",
)
def gravity(spark: SparkSession, sf: str) -> DataFrame:
    return publish(G.gravity_gate(G.estimate_gravity(A.frames(spark, sf))))


@plan(
    "camera_centres",
    "G2",
    A.cte("cam") + f", {CENTRES} SELECT run_id, frame, {r6s('cx', 'cy', 'cz')} FROM centres",
)
def camera_centres(spark: SparkSession, sf: str) -> DataFrame:
    return publish(G.camera_centres(A.frames(spark, sf)))


@plan(
    "path_extent",
    "G3, G4",
    A.cte("cam")
    + f""", {CENTRES}, hop AS (SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2
         + (cz - lag(cz) OVER w) ** 2) AS d FROM centres WINDOW w AS (PARTITION BY run_id ORDER BY frame))
    SELECT run_id, {r6('max(cx) - min(cx)', 'span_x')}, {r6('max(cy) - min(cy)', 'span_y')},
           {r6('max(cz) - min(cz)', 'span_z')}, {r6('coalesce(sum(d), 0e0)', 'path_m')} FROM hop GROUP BY ALL""",
)
def path_extent(spark: SparkSession, sf: str) -> DataFrame:
    return publish(G.path_extent(G.camera_centres(A.frames(spark, sf))))


TRACK = """track AS (
    SELECT run_id, frame, 8e-1 * cx - 6e-1 * cy + ax AS x, 6e-1 * cx + 8e-1 * cy AS y, cz + 5e-1 AS z,
           -6e-1 * s AS fwd_x, 8e-1 * s AS fwd_y, c AS fwd_z, 6e-1 * c AS up_x, -8e-1 * c AS up_y, s AS up_z
    FROM centres JOIN cam USING (run_id, frame) JOIN align USING (run_id))"""


@plan(
    "camera_track",
    "G5, V9",
    A.cte("cam", "align")
    + f", {CENTRES}, {TRACK} SELECT run_id, frame, {r6s('x', 'y', 'z')}, "
    + ", ".join(
        r6(f"{p}_{c} / sqrt({p}_x * {p}_x + {p}_y * {p}_y + {p}_z * {p}_z)", f"{p}_{c}")
        for p in ("fwd", "up")
        for c in "xyz"
    )
    + f", {r6('degrees(2e0 * atan(5e-1))', 'vfov_deg')}, {r6('degrees(2e0 * atan(5e-1))', 'hfov_deg')}, "
    + f"{r6('1e0', 'aspect')} FROM track",
)
def camera_track(spark: SparkSession, sf: str) -> DataFrame:
    return publish(G.camera_track(A.frames(spark, sf), A.alignments(spark, sf)))


OUTLINES = """outline AS (
    SELECT run_id, CASE WHEN run_id = 5 THEN -frame ELSE frame END AS frustum, k AS seq,
           CASE WHEN k % 2 = 0 THEN x + 4e-3 * ((run_id + 1) % 4) ELSE x + 1e-1 * k END AS x,
           CASE WHEN k % 2 = 0 THEN y ELSE y + 2e-1 * k END AS y, z
    FROM track, (SELECT unnest(range(8)) AS k) r)"""


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """A camera outline per frame: the apex on every other vertex.

    Some runs are shifted by more than the tolerance, and one is listed backwards.
    """
    k = F.col("seq")
    even = k % 2 == 0
    track = G.camera_track(A.frames(spark, sf), A.alignments(spark, sf))
    return track.select(
        "run_id",
        F.when(F.col("run_id") == 5, -F.col("frame")).otherwise(F.col("frame")).alias("frustum"),
        "x",
        "y",
        "z",
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq")
    ).select(
        "run_id",
        "frustum",
        "seq",
        F.when(even, F.col("x") + f64(0.004) * ((F.col("run_id") + 1) % 4)).otherwise(F.col("x") + f64(0.1) * k).alias("x"),
        F.when(even, F.col("y")).otherwise(F.col("y") + f64(0.2) * k).alias("y"),
        "z",
    )


@plan(
    "frustum_apexes",
    "G6",
    A.cte("cam", "align")
    + f""", {CENTRES}, {TRACK}, {OUTLINES}, tally AS (SELECT run_id, frustum, round(x, 6) AS kx, round(y, 6) AS ky,
         round(z, 6) AS kz, count(*) AS n, arg_min(x, seq) AS x, arg_min(y, seq) AS y, arg_min(z, seq) AS z
         FROM outline GROUP BY run_id, frustum, round(x, 6), round(y, 6), round(z, 6))
    SELECT run_id, frustum, {r6s('x', 'y', 'z')} FROM (
      SELECT *, rank() OVER (PARTITION BY run_id, frustum ORDER BY n DESC) AS k,
             count(*) OVER (PARTITION BY run_id, frustum, n) AS same FROM tally) WHERE k = 1 AND same = 1""",
)
def frustum_apexes(spark: SparkSession, sf: str) -> DataFrame:
    return publish(G.frustum_apexes(outlines(spark, sf)))


@plan(
    "track_check",
    "G7",
    A.cte("cam", "align")
    + f""", {CENTRES}, {TRACK}, {OUTLINES},
    p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS i FROM track),
    q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frustum) AS i FROM outline WHERE seq = 0),
    d AS (SELECT p.run_id, p.i AS pi, q.i AS qi, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS dist
          FROM p JOIN q USING (run_id)),
    m AS (SELECT run_id, pi, min(dist) FILTER (pi = qi) AS own, min(dist) AS near FROM d GROUP BY ALL),
    t AS (SELECT run_id, greatest(1e-2, 2e-3 * (max(x) - min(x))) AS tol FROM track GROUP BY ALL)
    SELECT run_id, count(*) AS poses, count(*) AS apexes, {r6('tol', 'tolerance_m')},
           {r6('max(own)', 'worst_in_order')}, {r6('max(near)', 'worst_nearest')},
           CASE WHEN max(own) <= tol THEN 'confirmed' WHEN max(near) <= tol THEN 'rejected: order'
                ELSE 'rejected: positions' END AS verdict FROM m JOIN t USING (run_id) GROUP BY run_id, tol""",
)
def track_check(spark: SparkSession, sf: str) -> DataFrame:
    track = G.camera_track(A.frames(spark, sf), A.alignments(spark, sf))
    extents = track.groupBy("run_id").agg((F.max("x") - F.min("x")).alias("extent"))
    checked = G.verify_track(track, G.frustum_apexes(outlines(spark, sf)), extents)
    return publish(checked)


@plan(
    "up_axis",
    "G8",
    A.cte("cam")
    + f""", {GRAVITY} SELECT run_id, {r6('CASE WHEN coherence >= 7e-1 THEN ux ELSE 0e0 END', 'up_x')},
      {r6('CASE WHEN run_id % 2 = 0 THEN 1e0 WHEN coherence >= 7e-1 THEN uy ELSE 1e0 END', 'up_y')},
      {r6('CASE WHEN run_id % 2 = 0 THEN 0e0 WHEN coherence >= 7e-1 THEN uz ELSE 0e0 END', 'up_z')},
      CASE WHEN run_id % 2 = 0 THEN 'floor' WHEN coherence >= 7e-1 THEN 'camera' ELSE 'scene' END AS source
    FROM gravity""",
)
def up_axis(spark: SparkSession, sf: str) -> DataFrame:
    gravity_ = G.estimate_gravity(A.frames(spark, sf))
    floors = gravity_.where(F.col("run_id") % 2 == 0).select(
        "run_id", f64(0).alias("nx"), f64(1).alias("ny"), f64(0).alias("nz")
    )
    return publish(G.resolve_up(gravity_.select("run_id"), floors, gravity_))
