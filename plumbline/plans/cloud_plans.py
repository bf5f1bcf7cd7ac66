"""Cloud building, voxel, sampling and audit jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.functions.vectors import vec
from plumbline.operators import audits, cloud as C, pixels as P
from plumbline.operators.components import connected_voxels
from plumbline.operators.levels import heights
from plumbline.operators.ranks import exact_percentiles, uniform_sample
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6, r6s
from plumbline.sources import sinks

# Histogram floor per frame over valid pixels, built from the bins themselves.
HIST = """valid AS (SELECT * FROM jump WHERE step <= depth * 8e-2),
    ends AS (SELECT run_id, frame, min(confidence) AS lo,
                    CASE WHEN max(confidence) > min(confidence) THEN max(confidence) - min(confidence) ELSE 1e0 END AS span
             FROM valid GROUP BY ALL),
    hist AS (SELECT run_id, frame, lo, span, CAST(floor((confidence - lo) / span * 4095e0) AS BIGINT) AS bin, count(*) AS n
             FROM valid JOIN ends USING (run_id, frame) GROUP BY ALL),
    cum AS (SELECT *, CAST(sum(n) OVER (PARTITION BY run_id, frame ORDER BY bin) AS BIGINT) AS cum,
                   CAST(sum(n) OVER (PARTITION BY run_id, frame) AS BIGINT) AS total FROM hist),
    marks AS (SELECT run_id, frame, lo + min(bin) FILTER (cum >= 4e-1 * total) / 4095e0 * span AS p40,
                     lo + min(bin) FILTER (cum >= 9e-1 * total) / 4095e0 * span AS p90,
                     lo + min(bin) FILTER (cum >= 2e-1 * total) / 4095e0 * span AS p20 FROM cum GROUP BY run_id, frame, lo, span),
    floors AS (SELECT run_id, frame, least(greatest(105e-2, p40), p90) AS threshold, p20 FROM marks)"""

WORLD = A.cte("px", "edge", "cam", "world") + ", " + HIST


@plan(
    "confidence_histogram",
    "C2",
    A.cte("px", "edge") + f", {HIST} SELECT run_id, frame, bin, n, cum, total, {r6s('lo', 'span')} FROM cum",
)
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    status = P.pixel_status(A.frames(spark, sf), max_relative_step=0.08)
    return publish(C.confidence_histogram(status))


@plan(
    "histogram_percentiles",
    "C3",
    A.cte("px", "edge") + f", {HIST} SELECT run_id, frame, {r6s('p20', 'p40', 'p90')} FROM marks",
)
def histogram_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    status = P.pixel_status(A.frames(spark, sf), max_relative_step=0.08)
    marks = {"p20": 20, "p40": 40, "p90": 90}
    return publish(C.histogram_percentile(C.confidence_histogram(status), marks))


@plan(
    "cloud_per_frame_floor",
    "C1, C5, C8, C9, C14",
    WORLD
    + f""" SELECT run_id, frame, px, {r6('wx', 'x')}, {r6('wy', 'y')}, {r6('wz', 'z')}, {r6('1e0', 'weight')},
      {r6('confidence', 'confidence')} FROM world JOIN floors USING (run_id, frame)
      WHERE step <= depth * 8e-2 AND confidence >= threshold""",
)
def cloud_per_frame_floor(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.build_cloud(A.frames(spark, sf)))


@plan(
    "cloud_rank_weights",
    "C1, C4, C5 (percentile), C8, C10, C14, C15",
    A.cte("px", "edge", "cam", "world", "align")
    + f""", {HIST}, moved AS (
      SELECT w.run_id, w.frame, w.px, 8e-1 * wx - 6e-1 * wy + ax AS x, 6e-1 * wx + 8e-1 * wy AS y, wz + 5e-1 AS z,
             cum / CAST(total AS DOUBLE) AS weight, confidence
      FROM world w JOIN floors USING (run_id, frame) JOIN align USING (run_id)
      JOIN cum c ON c.run_id = w.run_id AND c.frame = w.frame AND c.bin = CAST(floor((confidence - c.lo) / c.span * 4095e0) AS BIGINT)
      WHERE step <= depth * 8e-2 AND confidence >= p20 AND w.x % 2 = 0 AND w.y % 2 = 0)
    SELECT run_id, frame, px, {r6s('x', 'y', 'z')},
           {r6('weight / avg(weight) OVER (PARTITION BY run_id)', 'weight')}, {r6s('confidence')} FROM moved""",
)
def cloud_rank_weights(spark: SparkSession, sf: str) -> DataFrame:
    options = C.CloudOptions(
        confidence="percentile", confidence_value=20, weight="rank", pixel_stride=2
    )
    return publish(C.build_cloud(A.frames(spark, sf), options, A.alignments(spark, sf)))


VOXELS = """cell AS (
        SELECT run_id, floor(x / {e}) AS ix, floor(y / {e}) AS iy, floor(z / {e}) AS iz,
               CASE WHEN weight > 0 THEN weight ELSE 1e-6 END AS w, * EXCLUDE (run_id) FROM {source}),
    vox AS (
        SELECT run_id, ix, iy, iz, sum(x * w) / sum(w) AS x, sum(y * w) / sum(w) AS y, sum(z * w) / sum(w) AS z,
               avg(w) AS weight, avg(confidence) AS confidence, count(*) AS points{colour}
        FROM cell GROUP BY run_id, ix, iy, iz)"""


@plan(
    "cloud_voxels",
    "C1, C5 (absolute), C8 (linear), C11, C14",
    A.cte("px", "edge", "cam", "world")
    + """, kept AS (SELECT run_id, wx AS x, wy AS y, wz AS z, confidence AS weight, confidence FROM world
         WHERE step <= depth * 8e-2 AND confidence >= 15e-1), """
    + VOXELS.format(e="1e-1", source="kept", colour="")
    + f" SELECT run_id, {r6s('x', 'y', 'z')}, {r6('weight / avg(weight) OVER (PARTITION BY run_id)', 'weight')}, "
    f"{r6s('confidence')} FROM vox",
)
def cloud_voxels(spark: SparkSession, sf: str) -> DataFrame:
    options = C.CloudOptions(
        confidence="absolute", confidence_value=1.5, weight="linear", voxel_m=0.1
    )
    built = C.build_cloud(A.frames(spark, sf), options)
    return publish(built.drop("frame", "px"))


@plan(
    "voxel_grid",
    "C11",
    A.cte("pts")
    + ", "
    + VOXELS.format(
        e="5e-2",
        source="pts",
        colour=", floor(avg(r)) AS r, floor(avg(g)) AS g, floor(avg(b)) AS b",
    )
    + f""" SELECT run_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, CAST(iz AS BIGINT) AS iz, points,
      {r6s('x', 'y', 'z', 'weight', 'confidence')}, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM vox""",
)
def voxel_grid(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.voxel_grid(A.points(spark, sf), 0.05).drop("frame", "px"))


@plan(
    "voxel_refusals",
    "C11 (range)",
    A.cte("pts")
    + """ SELECT run_id, count(*) FILTER (far) AS out_of_range, count(*) FILTER (NOT far) AS in_range FROM (
        SELECT run_id, abs(floor(x / 2e-5) + 5e-1) > 65536 OR abs(floor(y / 2e-5) + 5e-1) > 65536
               OR abs(floor(z / 2e-5) + 5e-1) > 65536 AS far FROM pts) GROUP BY ALL""",
)
def voxel_refusals(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.voxel_refusals(A.points(spark, sf), 2e-5))


@plan(
    "pooled_floor",
    "C6",
    A.cte("px")
    + f""", q AS (SELECT run_id, quantile_disc(confidence, 4e-1) AS p40, quantile_disc(confidence, 9e-1) AS p90 FROM px GROUP BY ALL)
    SELECT run_id, {r6s('p40', 'p90')}, {r6('least(greatest(105e-2, p40), p90)', 'threshold')} FROM q""",
)
def pooled_floor(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.pooled_floor(A.frames(spark, sf)))


@plan(
    "interpolated_floor",
    "C7",
    A.cte("px")
    + f" SELECT run_id, frame, {r6('quantile_cont(confidence, 4e-1)', 'threshold')} FROM px WHERE depth > 0 GROUP BY ALL",
)
def interpolated_floor(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.interpolated_floor(A.frames(spark, sf)))


@plan(
    "frame_contributions",
    "C16",
    A.cte("px", "edge")
    + f""", {HIST} SELECT run_id, frame, count(*) AS pixels, count(*) AS usable,
      count(*) FILTER (step > depth * 8e-2) AS edges, {r6('threshold', 'threshold')},
      count(*) FILTER (step <= depth * 8e-2 AND confidence >= threshold) AS kept
    FROM jump JOIN floors USING (run_id, frame) GROUP BY run_id, frame, threshold""",
)
def frame_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.frame_contributions(A.frames(spark, sf)))


@plan(
    "run_shares",
    "C17",
    A.cte("px", "edge")
    + f""", {HIST}, f AS (SELECT run_id, frame, count(*) AS usable,
      count(*) FILTER (step <= depth * 8e-2 AND confidence >= threshold) AS kept
      FROM jump JOIN floors USING (run_id, frame) GROUP BY run_id, frame)
    SELECT run_id, {r6('min(kept / CAST(usable AS DOUBLE))', 'leanest_share')},
           {r6('sum(kept) / CAST(sum(usable) AS DOUBLE)', 'kept_share')}, CAST(sum(kept) AS BIGINT) AS kept FROM f GROUP BY ALL""",
)
def run_shares(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.run_shares(C.frame_contributions(A.frames(spark, sf))))


@plan(
    "coloured_cloud",
    "C15",
    A.cte("px", "edge")
    + f""", {HIST}, k AS (SELECT run_id, j.* EXCLUDE (run_id), CAST(floor(depth * 1e2) AS BIGINT) AS q FROM jump j JOIN floors USING (run_id, frame)
         WHERE step <= depth * 8e-2 AND confidence >= threshold),
    ok AS (SELECT CAST(label AS BIGINT) AS run_id, NOT bool_or(label >= 8 AND vec_id % 2 = 1) AS coloured FROM embeddings GROUP BY ALL)
    SELECT run_id, frame, px, CASE WHEN coloured THEN q * 3 % 256 END AS r, CASE WHEN coloured THEN q * 5 % 256 END AS g,
           CASE WHEN coloured THEN q * 7 % 256 END AS b FROM k JOIN ok USING (run_id)""",
)
def coloured_cloud(spark: SparkSession, sf: str) -> DataFrame:
    frames = A.coloured_frames(spark, sf)
    whole = C.coloured_runs(frames)
    cloud = C.build_cloud(frames).join(whole, "run_id")
    return publish(
        cloud.select("run_id", "frame", "px", *(F.when(F.col("coloured"), F.col(c)).alias(c) for c in "rgb"))
    )


@plan(
    "cloud_sample",
    "C12, C13",
)
def cloud_sample(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    return publish(uniform_sample(points, ["run_id"], ["frame", *A.POINT_ORDER], 1000, 7))


@plan(
    "cloud_sample_sizes",
    "C12, C13 (size and uniqueness)",
    A.cte("pts") + " SELECT run_id, least(count(*), 1000) AS kept FROM pts GROUP BY ALL",
)
def cloud_sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    kept = uniform_sample(A.points(spark, sf), ["run_id"], ["frame", *A.POINT_ORDER], 1000, 7)
    return publish(kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept")))


@plan(
    "cloud_decimated",
    "C18, P2",
    A.cte("pts", "ord") + f" SELECT run_id, ord, {r6s('x', 'y', 'z')} FROM ord WHERE ord % 16 = 0",
)
def cloud_decimated(spark: SparkSession, sf: str) -> DataFrame:
    kept = C.decimate(A.points(spark, sf), 16, A.POINT_ORDER)
    return publish(kept.select("run_id", "ord", "x", "y", "z"))


@plan(
    "cloud_export_lines",
    "C19, S11",
    A.cte("pts", "ord")
    + """ SELECT run_id, ord, printf('%.7g %.7g %.7g %d %d %d', x, y, z, r, g, b) AS line FROM ord
    WHERE ord % CAST(greatest(1, ceil(n / 25e2)) AS BIGINT) = 0""",
)
def cloud_export_lines(spark: SparkSession, sf: str) -> DataFrame:
    return publish(sinks.cloud_lines(A.points(spark, sf), 2500, A.POINT_ORDER))


@plan(
    "cloud_stats",
    "C20",
    A.cte("pts")
    + " SELECT run_id, "
    + ", ".join(r6(f"min({c})", f"min_{c}") + ", " + r6(f"max({c})", f"max_{c}") + ", " + r6(f"avg({c})", f"centroid_{c}") for c in "xyz")
    + ", count(*) AS finite, CAST(0 AS BIGINT) AS non_finite, "
    + r6("sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2)", "diagonal")
    + " FROM pts GROUP BY ALL",
)
def cloud_stats(spark: SparkSession, sf: str) -> DataFrame:
    return publish(C.cloud_stats(A.points(spark, sf)))


@plan(
    "quantiles_along_up",
    "C21, M1",
    A.cte("pts")
    + f""", a AS (SELECT run_id, (28e-2 * x + 96e-2 * y) / sqrt(28e-2 * 28e-2 + 96e-2 * 96e-2) AS v FROM pts)
    SELECT run_id, count(*) AS n, {r6('quantile_disc(v, 1e-2)', 'p1')}, {r6('quantile_disc(v, 5e-1)', 'p50')},
           {r6('quantile_disc(v, 99e-2)', 'p99')} FROM a GROUP BY ALL""",
)
def quantiles_along_up(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    up = points.select("run_id").distinct().select(
        "run_id", f64(0.28).alias("ux"), f64(0.96).alias("uy"), f64(0).alias("uz")
    )
    return publish(C.quantiles_along(points, up))


def components_sql(edge: str) -> str:
    """Components of each frame's occupied voxels over all its valid pixels, by the closure over pairs of voxels."""
    return (
        A.cte("px", "edge", "cam", "world", recursive=True)
        + f""", v AS (SELECT run_id, frame, CAST(floor(wx / {edge}) AS BIGINT) AS ix, CAST(floor(wy / {edge}) AS BIGINT) AS iy,
                 CAST(floor(wz / {edge}) AS BIGINT) AS iz, count(*) AS points FROM world WHERE depth >= 1e-4 GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY ix, iy, iz) AS id FROM v),
    e AS (SELECT a.run_id, a.frame, a.id AS src, b.id AS dst FROM n a JOIN n b ON a.run_id = b.run_id AND a.frame = b.frame
          AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1),
    reach AS (SELECT run_id, frame, src, dst FROM e
              UNION SELECT r.run_id, r.frame, r.src, e.dst FROM reach r JOIN e ON e.run_id = r.run_id AND e.frame = r.frame AND e.src = r.dst),
    lab AS (SELECT run_id, frame, src AS id, min(dst) AS label FROM reach GROUP BY ALL),
    comp AS (SELECT run_id, frame, label, sum(points) AS pts, count(*) AS vox FROM n JOIN lab USING (run_id, frame, id) GROUP BY ALL)
    SELECT run_id, frame, count(*) AS components, CAST(max(pts) AS BIGINT) AS largest_points,
           round(max(pts) / CAST(sum(pts) AS DOUBLE) + 1e-9, 6) + 0e0 AS largest_share, CAST(sum(vox) AS BIGINT) AS voxels
    FROM comp GROUP BY ALL"""
    )


def valid_points(spark: SparkSession, sf: str) -> DataFrame:
    status = P.pixel_status(A.frames(spark, sf)).where("status = 'valid'")
    return status.select("run_id", "frame", *(F.col(f"w{c}").alias(c) for c in "xyz"))


@plan("voxel_components", "C22", components_sql("25e-2"))
def voxel_components(spark: SparkSession, sf: str) -> DataFrame:
    return publish(connected_voxels(valid_points(spark, sf), ["run_id", "frame"], 0.25))


@plan("frame_components", "C22", components_sql("5e-1"))
def frame_components(spark: SparkSession, sf: str) -> DataFrame:
    """The same in voxels of half a metre, which connect most of a frame."""
    return publish(connected_voxels(valid_points(spark, sf), ["run_id", "frame"], 0.5))


@plan(
    "points_below",
    "C23, B20",
    A.cte("pts")
    + """ SELECT run_id, frame, count(*) FILTER (y - 5e-1 < -5e-2) AS below_5cm,
      count(*) FILTER (y - 5e-1 < -35e-3) AS below, count(*) FILTER (abs(y - 5e-1) <= 35e-3) AS inlier,
      count(*) FILTER (y - 5e-1 > 35e-3) AS above FROM pts GROUP BY ALL""",
)
def points_below(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    raised = A.level_planes(points).withColumn("d", f64(-0.5))
    placed = heights(points, raised).withColumn("class", audits.support_class(F.col("h"), 0.035))
    sunk = audits.points_below(placed).groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("below_5cm"))
    count = lambda c: F.count_if(F.col("class") == c).alias(c)
    classes = placed.groupBy("run_id", "frame").agg(count("below"), count("inlier"), count("above"))
    return publish(classes.join(sunk, ["run_id", "frame"], "left").fillna(0, ["below_5cm"]))


@plan(
    "display_and_measurement_clouds",
    "C24",
    A.cte("px", "edge")
    + f""", {HIST} SELECT run_id, count(*) FILTER (confidence >= 2e0) AS display_points,
      count(*) FILTER (confidence >= threshold) AS measurement_points
    FROM valid JOIN floors USING (run_id, frame) GROUP BY ALL""",
)
def display_and_measurement_clouds(spark: SparkSession, sf: str) -> DataFrame:
    """Two clouds of one source: display settings never touch the measured one."""
    frames = A.frames(spark, sf)
    shown = C.build_cloud(frames, C.CloudOptions(confidence="absolute", confidence_value=2.0))
    measured = C.build_cloud(frames, C.CloudOptions())
    size = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    return publish(size(shown, "display_points").join(size(measured, "measurement_points"), "run_id"))


@plan(
    "band_selection",
    "B14, B16",
    A.cte("pts")
    + f""", s AS (SELECT * FROM pts WHERE y BETWEEN 7e-1 AND 8e-1), c AS (SELECT run_id, count(*) AS n FROM pts GROUP BY ALL),
    m AS (SELECT run_id, quantile_disc(y, 5e-1) AS mid FROM s GROUP BY ALL)
    SELECT run_id, count(*) AS selected, {r6('count(*) / CAST(any_value(n) AS DOUBLE)', 'share')},
           {r6('quantile_disc(y, 1e-1)', 'p10')}, {r6('quantile_disc(y, 5e-1)', 'p50')}, {r6('quantile_disc(y, 9e-1)', 'p90')},
           {r6('14826e-4 * quantile_disc(abs(y - mid), 5e-1)', 'nmad')},
           {r6('max(z) - min(z)', 'width')}, {r6('max(x) - min(x)', 'depth')}
    FROM s JOIN c USING (run_id) JOIN m USING (run_id) GROUP BY run_id""",
)
def band_selection(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    picked = audits.select_band(heights(points, A.level_planes(points)), 0.7, 0.8)
    sizes = points.groupBy("run_id").agg(F.count(F.lit(1)).alias("cloud_points"))
    profile = audits.selection_profile(picked, sizes, ["run_id"])
    return publish(profile.join(C.footprint(picked, A.ups(points), ["run_id"]), "run_id"))


@plan(
    "sphere_selection",
    "B15, B16",
    A.cte("pts")
    + f""", c AS (SELECT run_id, CAST(s_suppkey AS BIGINT) AS label, (s_suppkey % 7) * 5e-1 - 15e-1 AS cx, 75e-2 AS cy,
                  (s_suppkey % 5) * 5e-1 - 1e0 AS cz, 2e-1 + s_suppkey % 3 * 1e-1 AS radius
           FROM supplier, (SELECT DISTINCT run_id FROM pts) WHERE s_suppkey % 10 = run_id)
    SELECT run_id, label, count(*) AS selected, {r6('min(y)', 'low')}, {r6('max(y)', 'high')} FROM pts JOIN c USING (run_id)
    WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= radius * radius GROUP BY ALL""",
)
def sphere_selection(spark: SparkSession, sf: str) -> DataFrame:
    s = A.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    centres = s.select(
        (k % 10).alias("run_id"),
        k.alias("label"),
        ((k % 7) * f64(0.5) - f64(1.5)).alias("cx"),
        f64(0.75).alias("cy"),
        ((k % 5) * f64(0.5) - f64(1)).alias("cz"),
        (f64(0.2) + k % 3 * f64(0.1)).alias("radius"),
    )
    near = audits.select_near(A.points(spark, sf), centres, 0.4)
    return publish(
        near.groupBy("run_id", "label").agg(
            F.count(F.lit(1)).alias("selected"), F.min("y").alias("low"), F.max("y").alias("high")
        )
    )


@plan(
    "coverage_audit",
    "B13",
    A.cte("px", "edge", "cam", "world")
    + f""", q AS (SELECT run_id, least(greatest(105e-2, quantile_disc(confidence, 4e-1)), quantile_disc(confidence, 9e-1)) AS threshold
           FROM px GROUP BY ALL),
    g AS (SELECT run_id, frame, confidence, threshold, floor(wx / 8e-2) AS gx, floor(wy / 8e-2) AS gy, floor(wz / 8e-2) AS gz,
                 step <= depth * 8e-2 AS smooth FROM world JOIN q USING (run_id)),
    occ AS (SELECT DISTINCT run_id, gx, gy, gz FROM g WHERE confidence >= threshold AND smooth)
    SELECT run_id, frame, count(*) AS valid_pixels, count(*) FILTER (confidence < threshold) AS predicted,
           count(*) FILTER (o.gx IS NULL) AS absent, count(*) FILTER (confidence < threshold AND o.gx IS NULL) AS both,
           {r6('count(*) FILTER (confidence >= threshold) / CAST(count(*) AS DOUBLE)', 'survival')},
           count(*) FILTER (confidence >= threshold) / CAST(count(*) AS DOUBLE) < 2e-2 AS wiped
    FROM g LEFT JOIN occ o USING (run_id, gx, gy, gz) GROUP BY ALL""",
)
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    frames = A.frames(spark, sf)
    floors = C.pooled_floor(frames)
    valid = P.pixel_status(frames).select(
        "run_id", "frame", "confidence", *(F.col(f"w{c}").alias(c) for c in "xyz")
    )
    kept = P.pixel_status(frames, max_relative_step=0.08).where(F.col("status") == "valid")
    cloud = kept.join(floors.select("run_id", "threshold"), "run_id").where(
        F.col("confidence") >= F.col("threshold")
    ).select("run_id", *(F.col(f"w{c}").alias(c) for c in "xyz"))
    seen = audits.coverage(valid, cloud, floors, ["run_id"], 0.08)
    survival = audits.frame_survival(valid, floors, ["run_id"]).drop("threshold", "kept")
    return publish(seen.join(survival, ["run_id", "frame"]))


@plan(
    "view_raster",
    "B18, B19",
    A.cte("pts")
    + """, p AS (SELECT *, z AS u, x AS v, -y AS w, y BETWEEN 7e-1 AND 8e-1 AS sel FROM pts),
    box AS (SELECT run_id, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM p GROUP BY ALL),
    k AS (SELECT *, least(2e2 / greatest(1e-9, u1 - u0), 15e1 / greatest(1e-9, v1 - v0)) AS k FROM box),
    cells AS (SELECT p.*, CAST(floor((2e2 - (u1 - u0) * k) / 2e0 + (u - u0) * k + 5e-1) AS BIGINT) AS cx,
              CAST(floor(15e1 - (15e1 - (v1 - v0) * k) / 2e0 - (v - v0) * k + 5e-1) AS BIGINT) AS cy FROM p JOIN k USING (run_id)),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY run_id, cx, cy) AS points,
               row_number() OVER (PARTITION BY run_id, cx, cy ORDER BY sel DESC, CASE WHEN sel THEN 0e0 ELSE w END,
                 frame DESC, px DESC, x DESC, y DESC, z DESC, weight DESC, confidence DESC, r DESC, g DESC, b DESC) AS place
               FROM cells WHERE cx BETWEEN 0 AND 199 AND cy BETWEEN 0 AND 149)
    SELECT run_id, cx AS cell_x, cy AS cell_y, points, round(w + 1e-9, 6) + 0e0 AS depth, sel AS selected FROM ranked WHERE place = 1""",
)
def view_raster(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    marked = points.withColumn("selected", F.col("y").between(f64(0.7), f64(0.8)))
    basis = audits.view_basis(A.ups(points), "top")
    return publish(audits.raster(marked, basis, 200, 150, ["frame", *A.POINT_ORDER]))
