"""Levels and object heights, over the point view and the masked frame view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.functions.vectors import angle_deg, plane, plane_elevation_at, vec
from plumbline.operators.components import connected_voxels
from plumbline.operators import ground, heights as H, levels as L, masks as M, pixels as P, poses as G
from plumbline.operators.ranks import exact_nmad
from plumbline.plans import adapters as A
from plumbline.plans.pixel_plans import ERODED, FLOOR20, SELECTED, selected_points
from plumbline.plans.pose_plans import GRAVITY
from plumbline.plans.registry import plan, publish, r6, r6s
from plumbline.session import cut_lineage

LEVELS = """b AS (SELECT run_id, CAST(floor((y + 25e-2) / 5e-3) AS BIGINT) AS bin, count(*) AS n FROM pts
          WHERE y >= -25e-2 AND y < 3e0 GROUP BY ALL),
    tot AS (SELECT run_id, count(*) AS sampled FROM pts GROUP BY ALL),
    nb AS (SELECT a.run_id, a.bin, a.n, max(k.n) FILTER (k.bin < a.bin) AS lo, max(k.n) FILTER (k.bin > a.bin) AS hi,
             quantile_disc(k.n, 5e-1) AS mid FROM b a JOIN b k ON a.run_id = k.run_id AND k.bin <> a.bin AND abs(k.bin - a.bin) <= 10 GROUP BY ALL),
    peak AS (SELECT run_id, bin, n / CAST(greatest(1, mid) AS DOUBLE) AS prominence, -25e-2 + (bin + 5e-1) * 5e-3 AS centre FROM nb
             WHERE n > coalesce(lo, 0) AND n >= coalesce(hi, 0) AND n / CAST(greatest(1, mid) AS DOUBLE) >= 2e0),
    band AS (SELECT p.run_id, bin, prominence, y AS h, z AS u, x AS v FROM peak p JOIN pts USING (run_id)
             WHERE y >= centre - 2e-2 AND y < centre + 2e-2 AND y >= -25e-2 AND y < 3e0),
    mids AS (SELECT run_id, bin, prominence, count(*) AS count, quantile_disc(h, 5e-1) AS mh, quantile_disc(u, 5e-1) AS mu,
             quantile_disc(v, 5e-1) AS mv FROM band GROUP BY ALL),
    levels AS (SELECT run_id, mh AS height, count, count / CAST(sampled AS DOUBLE) AS fraction,
             14826e-4 * quantile_disc(abs(h - mh), 5e-1) AS thickness, m.prominence,
             least(14826e-4 * quantile_disc(abs(u - mu), 5e-1), 14826e-4 * quantile_disc(abs(v - mv), 5e-1)) AS extent
           FROM band JOIN mids m USING (run_id, bin) JOIN tot USING (run_id)
           GROUP BY run_id, bin, mh, count, sampled, m.prominence
           HAVING count / CAST(sampled AS DOUBLE) >= 2e-3 AND
             least(14826e-4 * quantile_disc(abs(u - mu), 5e-1), 14826e-4 * quantile_disc(abs(v - mv), 5e-1)) >= 5e-2)"""


@plan(
    "heights_over_plane",
    "V3, V4",
    A.cte("pts")
    + f""" SELECT run_id, frame, {r6('min(28e-2 * x + 96e-2 * y - 1e-1)', 'low')}, {r6('max(28e-2 * x + 96e-2 * y - 1e-1)', 'high')},
      {r6('avg(28e-2 * x + 96e-2 * y - 1e-1)', 'mean')} FROM pts GROUP BY ALL""",
)
def heights_over_plane(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    tilted = A.level_planes(points).withColumns(
        {"nx": f64(0.28), "ny": f64(0.96), "d": f64(-0.1)}
    )
    placed = L.heights(points, tilted)
    return publish(
        placed.groupBy("run_id", "frame").agg(
            F.min("h").alias("low"), F.max("h").alias("high"), F.avg("h").alias("mean")
        )
    )


@plan(
    "plane_elevations",
    "V5, V6, V7",
    A.cte("pts")
    + f""", m AS (SELECT run_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY ALL)
    SELECT run_id, {r6('y - (28e-2 * x + 96e-2 * y - 1e-1) / 96e-2', 'elevation')}, {r6('degrees(acos(96e-2))', 'tilt_deg')} FROM m""",
)
def plane_elevations(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    centres = points.groupBy("run_id").agg(*(F.avg(c).alias(c) for c in "xyz"))
    tilted = centres.withColumns({"nx": f64(0.28), "ny": f64(0.96), "nz": f64(0), "d": f64(-0.1)})
    up = A.ups(points)
    joined = tilted.join(up, "run_id")
    axis = vec("ux", "uy", "uz")
    return publish(
        joined.select(
            "run_id",
            plane_elevation_at(plane(), vec("x", "y", "z"), axis).alias("elevation"),
            angle_deg(vec("nx", "ny", "nz"), axis).alias("tilt_deg"),
        )
    )


@plan(
    "robust_spread",
    "M1, M2, M3",
    A.cte("pts")
    + f""", m AS (SELECT run_id, quantile_disc(confidence, 5e-1) AS mid FROM pts GROUP BY ALL)
    SELECT run_id, {r6('14826e-4 * quantile_disc(abs(confidence - mid), 5e-1)', 'nmad')} FROM pts JOIN m USING (run_id) GROUP BY run_id""",
)
def robust_spread(spark: SparkSession, sf: str) -> DataFrame:
    return publish(exact_nmad(A.points(spark, sf), ["run_id"], F.col("confidence")))


@plan(
    "horizontal_levels",
    "M11",
    A.cte("pts")
    + f", {LEVELS} SELECT run_id, count, {r6s('height', 'fraction', 'thickness', 'prominence', 'extent')} FROM levels",
)
def horizontal_levels(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    return publish(L.horizontal_levels(points, A.level_planes(points)))


@plan(
    "graded_levels",
    "J4, M12, M13",
    A.cte("pts", "targets")
    + f""", {LEVELS}, near AS (SELECT r.run_id, object_id AS label, truth_m AS expected, height, count,
        row_number() OVER (PARTITION BY r.run_id, object_id ORDER BY abs(height - truth_m), count DESC, height) AS k
      FROM (SELECT DISTINCT run_id FROM pts) r JOIN targets ON true LEFT JOIN levels l ON l.run_id = r.run_id AND abs(height - truth_m) <= 25e-2)
    SELECT run_id, label, count, {r6s('expected', 'height')}, {r6('height - expected', 'error_m')},
           {r6('(height - expected) / expected * 1e2', 'error_pct')} FROM near WHERE k = 1""",
)
def graded_levels(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    found = L.horizontal_levels(points, A.level_planes(points))
    truths = F.array(
        *(F.struct(F.lit(o).alias("label"), f64(t).alias("expected")) for o, t in A.TARGETS)
    )
    expected = points.select("run_id").distinct().select("run_id", F.explode(truths).alias("t")).select("run_id", "t.*")
    return publish(L.level_near(found, expected, 0.25))


# Object points of the masked frames, over the plane found from the camera path:
# up by gravity, offset by the low quantile of the run's kept points.
OBJECT = (
    A.cte("px", "mask", "edge", "cam", "world")
    + f""", {ERODED}, {FLOOR20}, {SELECTED}, {GRAVITY},
    kept AS (SELECT s.run_id, object_id, frame, s.x AS px_x, s.y AS px_y, depth, wx AS x, wy AS y, wz AS z, ux, uy, uz,
                    ux * wx + uy * wy + uz * wz AS along FROM selected s JOIN gravity USING (run_id) WHERE status = 'kept'),
    low AS (SELECT run_id, quantile_disc(along, 2e-2) AS elevation FROM kept GROUP BY ALL),
    obj AS (SELECT k.*, along - elevation AS h FROM kept k JOIN low USING (run_id))"""
)

def extent_sql(of: str = "obj", p: str = "") -> str:
    """CTEs up to ``{p}extent``: both ends of each object over the points of ``of``, with their roughness."""
    key = "(run_id, object_id, frame)"
    low, high = "h BETWEEN bottom - 5e-2 AND bottom + 5e-2", "h BETWEEN top - 5e-2 AND top + 5e-2"
    mids = lambda name, band: f"""{p}{name}m AS (SELECT run_id, object_id, frame, quantile_disc(h, 5e-1) AS mid, count(*) AS n
           FROM {of} JOIN {p}ends USING {key} WHERE {band} GROUP BY ALL),
    {p}{name}r AS (SELECT run_id, object_id, frame, any_value({p}{name}m.n) AS n, 14826e-4 * quantile_disc(abs(h - mid), 5e-1) AS r
           FROM {of} JOIN {p}ends USING {key} JOIN {p}{name}m USING {key} WHERE {band} GROUP BY run_id, object_id, frame)"""  # noqa: E731
    return f"""{p}ends AS (SELECT run_id, object_id, frame, count(*) AS point_count, quantile_disc(h, 2e-2) AS bottom, quantile_disc(h, 98e-2) AS top,
               min(h) AS min_height, max(h) AS max_height FROM {of} GROUP BY run_id, object_id, frame),
    {mids("b", low)},
    {mids("t", high)},
    {p}extent AS (SELECT e.*, top - bottom AS height, CASE WHEN b.n >= 3 THEN b.r ELSE 0e0 END AS bottom_roughness,
             CASE WHEN t.n >= 3 THEN t.r ELSE 0e0 END AS top_roughness, t.n AS top_band_count, t.r AS tr_raw
           FROM {p}ends e JOIN {p}br b USING {key} JOIN {p}tr t USING {key})"""


EXTENT = extent_sql()

MIN_POINTS = 8


def object_cloud(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(kept mask points, planes): gravity from the poses, offset from the low quantile."""
    kept = cut_lineage(
        selected_points(spark, sf)
        .where(F.col("status") == "kept")
        .select("run_id", "object_id", "frame", "x", "y", "depth", "wx", "wy", "wz")
        .withColumnsRenamed({"x": "px_x", "y": "px_y"})
        .withColumnsRenamed({"wx": "x", "wy": "y", "wz": "z"})
    )
    # Sums of doubles depend on the order of their parts; points are placed several times along one up.
    up = cut_lineage(G.estimate_gravity(A.frames(spark, sf)))
    normals = up.select(
        "run_id", F.col("ux").alias("nx"), F.col("uy").alias("ny"), F.col("uz").alias("nz")
    )
    cloud = kept.withColumn("weight", f64(1)).withColumn("px", F.col("px_y") * 8 + F.col("px_x"))
    return kept, cut_lineage(ground.anchor_to_low_quantile(cloud, normals))


@plan(
    "object_heights",
    "M6, P16, B5, G1 (flagship)",
    OBJECT
    + f", {EXTENT} SELECT run_id, object_id, frame, CASE WHEN point_count >= {MIN_POINTS} THEN 'ok' ELSE 'refused' END AS status, point_count, "
    + ", ".join(
        r6(f"CASE WHEN point_count >= {MIN_POINTS} THEN {e} END", n)
        for e, n in [
            ("height", "height"),
            ("sqrt(bottom_roughness * bottom_roughness + top_roughness * top_roughness)", "uncertainty"),
            ("bottom", "bottom"),
            ("top", "top"),
            ("bottom_roughness", "bottom_roughness"),
            ("top_roughness", "top_roughness"),
            ("min_height", "min_height"),
            ("max_height", "max_height"),
        ]
    )
    + " FROM extent",
)
def object_heights(spark: SparkSession, sf: str) -> DataFrame:
    kept, planes = object_cloud(spark, sf)
    return publish(H.vertical_extent(H.object_heights(kept, planes), min_points=MIN_POINTS))


@plan(
    "heights_above_floor",
    "M5",
    OBJECT
    + f""", {EXTENT}, res AS (SELECT run_id, sqrt(avg(h * h) FILTER (abs(h) <= 35e-3)) AS rmse FROM obj GROUP BY ALL)
    SELECT run_id, object_id, frame, CASE WHEN point_count >= {MIN_POINTS} THEN 'ok' ELSE 'refused' END AS status, point_count,
      {r6(f'CASE WHEN point_count >= {MIN_POINTS} THEN top END', 'height')},
      {r6(f'CASE WHEN point_count >= {MIN_POINTS} THEN sqrt(top_roughness * top_roughness + rmse * rmse) END', 'uncertainty')},
      {r6(f'CASE WHEN point_count >= {MIN_POINTS} AND top_band_count >= 3 THEN tr_raw END', 'top_roughness')},
      CASE WHEN point_count >= {MIN_POINTS} THEN top_band_count END AS top_band_count,
      {r6(f'CASE WHEN point_count >= {MIN_POINTS} THEN max_height END', 'max_height')} FROM extent JOIN res USING (run_id)""",
)
def heights_above_floor(spark: SparkSession, sf: str) -> DataFrame:
    kept, planes = object_cloud(spark, sf)
    placed = H.object_heights(kept, planes)
    return publish(H.measure_height(placed, min_points=MIN_POINTS, plane_rmse=planes))


TAILS = """tails AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, object_id, frame ORDER BY h, y, x, z) AS k,
               count(*) OVER (PARTITION BY run_id, object_id, frame) AS n FROM obj)
      WHERE n >= 8 AND (k <= least(n // 2, greatest(4, CAST(floor(n * 1e-1) AS BIGINT)))
                     OR k > n - least(n // 2, greatest(4, CAST(floor(n * 1e-1) AS BIGINT)))))"""


@plan(
    "endpoint_evidence",
    "M4",
    OBJECT
    + f""", {TAILS} SELECT run_id, object_id, frame, any_value(least(n // 2, greatest(4, CAST(floor(n * 1e-1) AS BIGINT)))) AS points_per_end,
      count(*) AS points, {r6('sum(h)', 'height_sum')} FROM tails GROUP BY run_id, object_id, frame""",
)
def endpoint_evidence(spark: SparkSession, sf: str) -> DataFrame:
    kept, planes = object_cloud(spark, sf)
    tails = H.endpoint_evidence(H.object_heights(kept, planes), min_per_end=4)
    return publish(
        tails.groupBy(*H.OBJECT, "points_per_end").agg(
            F.count(F.lit(1)).alias("points"), F.sum("h").alias("height_sum")
        )
    )


def geometry_sql(of: str = "obj", p: str = "") -> str:
    """CTEs up to ``{p}ruler``: centroids of the ends of ``{p}extent`` and the ruler between them."""
    return f"""{p}g AS (SELECT o.run_id, object_id, frame, any_value(bottom) AS bottom, any_value(top) AS top,
        any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz, any_value(elevation) AS elevation,
        avg(x) FILTER (abs(h - bottom) <= 5e-2) AS bx, avg(y) FILTER (abs(h - bottom) <= 5e-2) AS by_, avg(z) FILTER (abs(h - bottom) <= 5e-2) AS bz,
        avg(x) FILTER (abs(h - top) <= 5e-2) AS tx, avg(y) FILTER (abs(h - top) <= 5e-2) AS ty, avg(z) FILTER (abs(h - top) <= 5e-2) AS tz
      FROM {of} o JOIN {p}extent USING (run_id, object_id, frame) JOIN low USING (run_id) WHERE point_count >= {MIN_POINTS}
      GROUP BY o.run_id, object_id, frame),
    {p}k AS (SELECT *, sqrt((tx - bx) ** 2 + (ty - by_) ** 2 + (tz - bz) ** 2) AS apart,
            ux * (tx - bx) + uy * (ty - by_) + uz * (tz - bz) AS rise,
            ux * (bx + tx) / 2e0 + uy * (by_ + ty) / 2e0 + uz * (bz + tz) / 2e0 - elevation AS lift FROM {p}g),
    {p}ruler AS (SELECT *, (bx + tx) / 2e0 + ux * (bottom - lift) AS rbx, (by_ + ty) / 2e0 + uy * (bottom - lift) AS rby, (bz + tz) / 2e0 + uz * (bottom - lift) AS rbz,
            (bx + tx) / 2e0 + ux * (top - lift) AS rtx, (by_ + ty) / 2e0 + uy * (top - lift) AS rty, (bz + tz) / 2e0 + uz * (top - lift) AS rtz FROM {p}k)"""


GEOMETRY = geometry_sql()


@plan(
    "endpoint_geometry",
    "J5, M7, M8, M9, V11",
    OBJECT
    + f", {EXTENT}, {GEOMETRY} SELECT run_id, object_id, frame, "
    + ", ".join(
        r6(e, n)
        for e, n in [
            ("bx", "bottom_x"), ("by_", "bottom_y"), ("bz", "bottom_z"), ("tx", "top_x"), ("ty", "top_y"), ("tz", "top_z"),
            ("apart", "centroid_distance"), ("sqrt(greatest(0e0, apart * apart - rise * rise))", "lateral_offset"),
            ("rbx", "ruler_bottom_x"), ("rby", "ruler_bottom_y"), ("rbz", "ruler_bottom_z"),
            ("rtx", "ruler_top_x"), ("rty", "ruler_top_y"), ("rtz", "ruler_top_z"),
            ("sqrt((bx - rbx) ** 2 + (by_ - rby) ** 2 + (bz - rbz) ** 2)", "bottom_ruler_offset"),
            ("sqrt((tx - rtx) ** 2 + (ty - rty) ** 2 + (tz - rtz) ** 2)", "top_ruler_offset"),
        ]
    )
    + " FROM ruler",
)
def endpoint_geometry(spark: SparkSession, sf: str) -> DataFrame:
    kept, planes = object_cloud(spark, sf)
    placed = H.object_heights(kept, planes)
    extents = H.vertical_extent(placed, min_points=MIN_POINTS)
    return publish(H.endpoint_geometry(placed, extents, planes))


@plan(
    "endpoint_depths",
    "M15",
    OBJECT
    + f""", {EXTENT}, e AS (SELECT o.run_id, o.object_id, o.frame, depth, abs(h - bottom) <= 5e-2 AS low_, abs(h - top) <= 5e-2 AS high_
       FROM obj o JOIN extent USING (run_id, object_id, frame) WHERE point_count >= {MIN_POINTS})
    SELECT run_id, object_id, frame, {r6('quantile_disc(depth, 5e-1) FILTER (low_)', 'bottom_depth')},
      {r6('quantile_disc(depth, 9e-1) FILTER (low_) - quantile_disc(depth, 1e-1) FILTER (low_)', 'bottom_depth_spread')},
      {r6('quantile_disc(depth, 5e-1) FILTER (high_)', 'top_depth')},
      {r6('quantile_disc(depth, 9e-1) FILTER (high_) - quantile_disc(depth, 1e-1) FILTER (high_)', 'top_depth_spread')}
    FROM e GROUP BY ALL""",
)
def endpoint_depths(spark: SparkSession, sf: str) -> DataFrame:
    kept, planes = object_cloud(spark, sf)
    placed = H.object_heights(kept, planes)
    extents = H.vertical_extent(placed, min_points=MIN_POINTS)
    return publish(H.end_depths(placed, extents))


@plan(
    "gravity_control",
    "M14",
    OBJECT
    + f""", {EXTENT}, y_up AS (SELECT run_id, object_id, frame, quantile_disc(-y, 98e-2) - quantile_disc(-y, 2e-2) AS control FROM obj GROUP BY ALL)
    SELECT run_id, object_id, frame, {r6('height', 'height')}, {r6('control', 'control')}, {r6('height - control', 'difference')}
    FROM extent JOIN y_up USING (run_id, object_id, frame) WHERE point_count >= {MIN_POINTS}""",
)
def gravity_control(spark: SparkSession, sf: str) -> DataFrame:
    """The same extent along the scene's own vertical, as a check on the fitted one."""
    kept, planes = object_cloud(spark, sf)
    scene = planes.select(
        "run_id", f64(0).alias("nx"), f64(-1).alias("ny"), f64(0).alias("nz"), f64(0).alias("d")
    )
    limits = dict(min_points=MIN_POINTS)
    fitted = H.vertical_extent(H.object_heights(kept, planes), **limits).where(F.col("status") == "ok")
    control = H.vertical_extent(H.object_heights(kept, scene), **limits).select(
        *H.OBJECT, F.col("height").alias("control")
    )
    return publish(
        fitted.join(control, H.OBJECT).select(
            *H.OBJECT, "height", "control", (F.col("height") - F.col("control")).alias("difference")
        )
    )


#: Points an end of an automatic mask needs here, as frames are small.
PER_END = 4
_EACH = f"least(n // 2, greatest({PER_END}, CAST(floor(n * 1e-1) AS BIGINT)))"
_RULER = [f"ruler_{end}_{c}" for end in ("bottom", "top") for c in "xyz"]


@plan(
    "measurement_job",
    "M10",
    OBJECT
    + f""", {EXTENT}, prov AS (SELECT run_id, object_id, frame,
        CASE WHEN frame % 2 = 0 THEN 'vertical_extent' ELSE 'top_above_floor' END AS mode, frame % 3 = 1 AS automatic,
        frame % 5 <> 0 AS accepted, frame % 7 = 0 AS occluded FROM mask GROUP BY ALL),
    judged AS (SELECT *, CASE WHEN automatic AND NOT accepted THEN 'withheld: mask not accepted'
          WHEN automatic AND occluded THEN 'withheld: base is occluded' END AS held, automatic AND frame % 2 = 0 AS balanced FROM prov),
    res AS (SELECT run_id, sqrt(avg(h * h) FILTER (abs(h) <= 35e-3)) AS rmse FROM obj GROUP BY ALL),
    placed AS (SELECT o.*, balanced, row_number() OVER w AS at_, count(*) OVER (PARTITION BY run_id, object_id, frame) AS n
        FROM obj o JOIN judged USING (run_id, object_id, frame) WHERE held IS NULL WINDOW w AS (PARTITION BY run_id, object_id, frame ORDER BY h, y, x, z)),
    chosen AS (SELECT *, {_EACH} AS each FROM placed WHERE NOT balanced OR (n >= {2 * PER_END} AND (at_ <= {_EACH} OR at_ > n - {_EACH}))),
    tails AS (SELECT run_id, object_id, frame, count(*) AS endpoint_points, max(each) AS points_per_end FROM chosen WHERE balanced GROUP BY ALL),
    {extent_sql("chosen", "c")}, {geometry_sql("chosen", "c")},
    topped AS (SELECT o.run_id, object_id, frame, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz, any_value(elevation) AS elevation, any_value(top) AS top,
        avg(x) AS x, avg(y) AS y, avg(z) AS z FROM chosen o JOIN cextent USING (run_id, object_id, frame) JOIN low USING (run_id)
        WHERE abs(h - top) <= 5e-2 GROUP BY o.run_id, object_id, frame),
    based AS (SELECT *, ux * x + uy * y + uz * z - elevation AS up FROM topped),
    final AS (SELECT j.run_id, j.object_id, j.frame, mode, held, mode = 'top_above_floor' AS floor_, c.point_count, c.point_count >= {MIN_POINTS} AS ok, c.bottom, c.top, c.height,
          c.bottom_roughness, c.top_roughness, CASE WHEN c.top_band_count >= 3 THEN c.tr_raw END AS top_raw, c.max_height, rmse, endpoint_points, points_per_end,
          CASE WHEN balanced AND held IS NULL AND e.point_count >= {MIN_POINTS} THEN e.height END AS control_m,
          rbx, rby, rbz, rtx, rty, rtz, b.x - ux * up AS fbx, b.y - uy * up AS fby, b.z - uz * up AS fbz,
          b.x + ux * (b.top - up) AS ftx, b.y + uy * (b.top - up) AS fty, b.z + uz * (b.top - up) AS ftz
        FROM judged j LEFT JOIN cextent c USING (run_id, object_id, frame) LEFT JOIN extent e USING (run_id, object_id, frame) LEFT JOIN tails USING (run_id, object_id, frame)
        LEFT JOIN (SELECT run_id, object_id, frame, rbx, rby, rbz, rtx, rty, rtz FROM cruler) r USING (run_id, object_id, frame)
        LEFT JOIN (SELECT run_id, object_id, frame, ux, uy, uz, up, top, x, y, z FROM based) b USING (run_id, object_id, frame) LEFT JOIN res USING (run_id))
    SELECT run_id, object_id, frame, mode, CASE WHEN held IS NOT NULL THEN held WHEN ok THEN 'ok' ELSE 'refused' END AS status,
      {r6("CASE WHEN ok THEN CASE WHEN floor_ THEN top ELSE height END END", "raw_m")},
      {r6("CASE WHEN ok THEN CASE WHEN floor_ THEN sqrt(coalesce(top_raw, 0e0) ** 2 + coalesce(rmse, 0e0) ** 2) ELSE sqrt(bottom_roughness ** 2 + top_roughness ** 2) END END", "internal_spread_m")},
      point_count, {r6("CASE WHEN ok THEN CASE WHEN floor_ THEN 0e0 ELSE bottom END END", "bottom_m")}, {r6("CASE WHEN ok THEN top END", "top_m")},
      {r6("CASE WHEN ok AND NOT floor_ THEN bottom_roughness END", "bottom_roughness_m")}, {r6("CASE WHEN ok THEN CASE WHEN floor_ THEN top_raw ELSE top_roughness END END", "top_roughness_m")},
      {r6("CASE WHEN ok AND floor_ THEN rmse END", "floor_rmse_m")}, {r6("CASE WHEN ok AND floor_ THEN max_height END", "max_height_m")},
      CASE WHEN ok THEN CASE WHEN floor_ THEN 'floor_height' ELSE 'extent' END END AS ruler_kind,
      """
    + ", ".join(
        r6(f"CASE WHEN ok THEN CASE WHEN floor_ THEN f{end}{c} ELSE r{end}{c} END END", n)
        for n, (end, c) in zip(_RULER, [(e, c) for e in "bt" for c in "xyz"])
    )
    + f""", endpoint_points, points_per_end, {r6s('control_m')}, {r6("CASE WHEN ok AND NOT floor_ THEN height - control_m END", 'adapter_delta_m')} FROM final""",
)
def measurement_job(spark: SparkSession, sf: str) -> DataFrame:
    kept, planes = object_cloud(spark, sf)
    frame = F.col("frame")
    provenance = A.masks(spark, sf).select(*H.OBJECT).distinct().select(
        *H.OBJECT,
        F.when(frame % 2 == 0, F.lit("vertical_extent")).otherwise(F.lit("top_above_floor")).alias("mode"),
        (frame % 3 == 1).alias("automatic"),
        (frame % 5 != 0).alias("accepted"),
        (frame % 7 == 0).alias("occluded"),
    )
    return publish(H.measure_objects(kept, planes, provenance, min_points=MIN_POINTS, min_per_end=PER_END))


@plan(
    "support_matched_cloud",
    "M16",
    f"""SELECT run_id, CASE WHEN abs(a - want) <= abs(b - want) THEN 'export' ELSE 'rebuilt' END AS cloud FROM (
      SELECT CAST(label AS BIGINT) AS run_id, avg(abs(CAST(embedding[1] AS DOUBLE))) AS a, avg(abs(CAST(embedding[2] AS DOUBLE))) AS b,
             avg(abs(CAST(embedding[3] AS DOUBLE))) AS want FROM embeddings GROUP BY ALL)""",
)
def support_matched_cloud(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    mean = lambda i: F.avg(F.abs(F.get("embedding", F.lit(i)).cast("double")))
    per_run = e.groupBy(F.col("label").cast("long").alias("run_id")).agg(
        mean(0).alias("a"), mean(1).alias("b"), mean(2).alias("recorded")
    )
    clouds = F.array(
        F.struct(F.lit("export").alias("cloud"), F.lit(0).alias("ord"), F.col("a").alias("support")),
        F.struct(F.lit("rebuilt").alias("cloud"), F.lit(1).alias("ord"), F.col("b").alias("support")),
    )
    options = per_run.select("run_id", "recorded", F.explode(clouds).alias("c")).select("run_id", "recorded", "c.*")
    return publish(H.nearest_level_cloud(options, ["run_id"]))


@plan(
    "endpoint_components",
    "C22, M15 (components)",
    OBJECT.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {EXTENT}, t AS (SELECT o.run_id, o.object_id, o.frame, o.x, o.y, o.z FROM obj o JOIN extent USING (run_id, object_id, frame)
       WHERE point_count >= {MIN_POINTS} AND abs(h - top) <= 5e-2),
    v AS (SELECT run_id, object_id, frame, CAST(floor(x / 5e-2) AS BIGINT) AS ix, CAST(floor(y / 5e-2) AS BIGINT) AS iy,
           CAST(floor(z / 5e-2) AS BIGINT) AS iz, count(*) AS points FROM t GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id, object_id, frame ORDER BY ix, iy, iz) AS id FROM v),
    e AS (SELECT a.run_id, a.object_id, a.frame, a.id AS src, b.id AS dst FROM n a JOIN n b ON a.run_id = b.run_id AND a.object_id = b.object_id
          AND a.frame = b.frame AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1),
    reach AS (SELECT * FROM e UNION SELECT r.run_id, r.object_id, r.frame, r.src, e.dst FROM reach r
              JOIN e ON e.run_id = r.run_id AND e.object_id = r.object_id AND e.frame = r.frame AND e.src = r.dst),
    lab AS (SELECT run_id, object_id, frame, src AS id, min(dst) AS label FROM reach GROUP BY ALL),
    comp AS (SELECT run_id, object_id, frame, label, sum(points) AS pts, count(*) AS vox FROM n JOIN lab USING (run_id, object_id, frame, id) GROUP BY ALL)
    SELECT run_id, object_id, frame, count(*) AS components, CAST(max(pts) AS BIGINT) AS largest_points,
           {r6('max(pts) / CAST(sum(pts) AS DOUBLE)', 'largest_share')}, CAST(sum(vox) AS BIGINT) AS voxels FROM comp GROUP BY ALL""",
)
def endpoint_components(spark: SparkSession, sf: str) -> DataFrame:
    kept, planes = object_cloud(spark, sf)
    placed = H.object_heights(kept, planes)
    extents = H.vertical_extent(placed, min_points=MIN_POINTS).where(F.col("status") == "ok")
    top = placed.join(extents.select(*H.OBJECT, "top"), H.OBJECT).where(
        F.abs(F.col("h") - F.col("top")) <= f64(0.05)
    )
    return publish(connected_voxels(top.select(*H.OBJECT, "x", "y", "z"), H.OBJECT, 0.05))
