"""Ground plane jobs over the point view (+Y up)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, with_uniform_draw
from plumbline.operators import ground as P
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6, r6s

# The recorded settings; only the support floor is lower, for the thin point view.
OPTIONS = replace(P.MEASUREMENT_FIT, min_inliers=30)

# One term of the seeded generator in SQL, from a seed and a 1-based position.
DRAW = """(SELECT ((u ^ (u >> 14)) & 4294967295) / 4294967296e0 FROM (
      SELECT xor(t, (t + CAST((CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296 AS BIGINT)) & 4294967295) AS u FROM (
      SELECT CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) AS t FROM (
      SELECT CAST(({seed} + CAST({nth} AS HUGEINT) * 1831565813) % 4294967296 AS BIGINT) AS a))))""".replace(
    "(u ^ (u >> 14)) & 4294967295", "xor(u, u >> 14)"
)


def draw(seed: str, nth: str) -> str:
    return DRAW.format(seed=seed, nth=nth)


@plan(
    "seeded_draws",
    "P1",
    f"""SELECT run_id, nth, {r6('r', 'draw')} FROM (
      SELECT o_orderkey AS run_id, n AS nth, {draw('o_orderkey', 'n')} AS r
      FROM orders, (SELECT unnest(range(1, 4)) AS n))""",
)
def seeded_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Three draws per order, seeded by its key."""
    o = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("nth")
    )
    return publish(with_uniform_draw(o, F.col("run_id"), F.col("nth"), "draw"))


FIT_SQL = """samp AS (
        SELECT run_id, ord // {stride} AS pos, x, y, z, weight, 0e0 * x + 1e0 * y + 0e0 * z AS along FROM ord WHERE ord % {stride} = 0),
    low AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY along, pos) - 1 AS lowpos,
                   count(*) OVER (PARTITION BY run_id) AS n FROM samp),
    pool AS (SELECT run_id, 1e0 AS pool, pos AS place, x, y, z FROM low
             UNION ALL SELECT run_id, 35e-2, lowpos, x, y, z FROM low WHERE lowpos < greatest(3, ceil(n * 35e-2))),
    size AS (SELECT run_id, pool, count(*) AS m FROM pool GROUP BY ALL),
    tri AS (SELECT run_id, seed, pool, iter,
              least(m - 1, CAST(floor(r0 * m) AS BIGINT)) AS a0, least(m - 1, CAST(floor(r1 * m) AS BIGINT)) AS a1,
              least(m - 1, CAST(floor(r2 * m) AS BIGINT)) AS a2
            FROM size, (SELECT seed, iter, {d0} AS r0, {d1} AS r1, {d2} AS r2
                        FROM (SELECT CAST(unnest([{seeds}]) AS BIGINT) AS seed), (SELECT unnest(range({iterations})) AS iter))),
    corner AS (SELECT t.run_id, t.seed, t.pool, iter, a.x AS x0, a.y AS y0, a.z AS z0, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz,
                 c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz
               FROM tri t JOIN pool a ON a.run_id = t.run_id AND a.pool = t.pool AND a.place = a0
               JOIN pool b ON b.run_id = t.run_id AND b.pool = t.pool AND b.place = a1
               JOIN pool c ON c.run_id = t.run_id AND c.pool = t.pool AND c.place = a2
               WHERE a0 <> a1 AND a1 <> a2 AND a0 <> a2),
    crossed AS (SELECT *, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM corner),
    sized AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS size, CASE WHEN cy < 0 THEN -1e0 ELSE 1e0 END AS face FROM crossed),
    planes AS (SELECT run_id, seed, pool, iter, face * cx / size AS nx, face * cy / size AS ny, face * cz / size AS nz, x0, y0, z0
               FROM sized WHERE size > 1e-12),
    cand AS (SELECT run_id, seed, pool, iter, nx, ny, nz, -(nx * x0 + ny * y0 + nz * z0) AS d,
                    degrees(acos(greatest(-1e0, least(1e0, ny)))) AS tilt FROM planes
             WHERE degrees(acos(greatest(-1e0, least(1e0, ny)))) <= {tilt}),
    high AS (SELECT c.run_id, seed, pool, iter, c.nx, c.ny, c.nz, c.d, tilt, weight, nx * x + ny * y + nz * z + d AS h
             FROM cand c JOIN samp USING (run_id)),
    score AS (SELECT run_id, seed, pool, iter, nx, ny, nz, d, tilt, count(*) AS n,
                sum(weight) AS tw, sum(weight) FILTER (abs(h) <= {band}) AS w, count(*) FILTER (abs(h) <= {band}) AS cnt,
                count(*) FILTER (h < -5e-2) AS below, sum(h * h) FILTER (abs(h) <= {band}) AS sq FROM high GROUP BY ALL),
    qual AS (SELECT *, ln(greatest(1e-6, w / tw)) - 2e0 * (tilt / {tilt}) ** 2 - 2e0 * (below / CAST(n AS DOUBLE) / 5e-2) ** 2
                - sqrt(sq / cnt) / {band} AS q FROM score WHERE cnt > 0),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seed, pool ORDER BY q DESC, iter) AS k
                            FROM qual WHERE cnt >= {support}) WHERE k = 1),
    considered AS (SELECT run_id, seed, pool, count(*) AS considered FROM qual GROUP BY ALL)"""


def refine_sql(source: str, out: str, band: str, tilt: str) -> str:
    """Weighted height field y = a*z + b*x + c over the inliers of a plane, by its normal equations.

    For up = +Y the ground axes are e1 = +Z and e2 = +X.
    """
    return f"""{out}_in AS (SELECT p.run_id, p.seed, p.pool, s.z AS u, s.x AS v, s.y AS h, s.weight AS w
        FROM {source} p JOIN samp s USING (run_id) WHERE abs(nx * x + ny * y + nz * z + d) <= {band} AND s.weight > 0),
    {out}_sum AS (SELECT run_id, seed, pool, sum(w*u*u) uu, sum(w*v*v) vv, sum(w*u*v) uv, sum(w*u) su, sum(w*v) sv, sum(w*h) sh,
        sum(w*u*h) uh, sum(w*v*h) vh, sum(w) s1 FROM {out}_in GROUP BY ALL),
    {out}_det AS (SELECT *, uu*(vv*s1 - sv*sv) - uv*(uv*s1 - sv*su) + su*(uv*sv - vv*su) AS det FROM {out}_sum),
    {out}_fit AS (SELECT run_id, seed, pool,
        (uh*(vv*s1 - sv*sv) - uv*(vh*s1 - sv*sh) + su*(vh*sv - vv*sh)) / det AS a,
        (uu*(vh*s1 - sv*sh) - uh*(uv*s1 - sv*su) + su*(uv*sh - vh*su)) / det AS b,
        (uu*(vv*sh - vh*sv) - uv*(uv*sh - vh*su) + uh*(uv*sv - vv*su)) / det AS c FROM {out}_det WHERE abs(det) >= 1e-12),
    {out}_n AS (SELECT run_id, seed, pool, -b / sqrt(a*a + b*b + 1e0) AS rx, 1e0 / sqrt(a*a + b*b + 1e0) AS ry,
        -a / sqrt(a*a + b*b + 1e0) AS rz, -c / sqrt(a*a + b*b + 1e0) AS rd FROM {out}_fit),
    {out} AS (SELECT p.run_id, p.seed, p.pool,
        CASE WHEN degrees(acos(ry)) <= {tilt} THEN rx ELSE nx END AS nx, CASE WHEN degrees(acos(ry)) <= {tilt} THEN ry ELSE ny END AS ny,
        CASE WHEN degrees(acos(ry)) <= {tilt} THEN rz ELSE nz END AS nz, CASE WHEN degrees(acos(ry)) <= {tilt} THEN rd ELSE d END AS d
        FROM {source} p LEFT JOIN {out}_n USING (run_id, seed, pool))"""


def fit_sql(options: P.GroundOptions) -> str:
    """Sample, draws, scoring, two refinements and support, as CTEs ending in ``fit``."""
    band, tilt = f"{options.inlier_distance!r}e0", f"{options.max_tilt_deg!r}e0"
    head = FIT_SQL.format(
        stride=options.stride,
        seeds=", ".join(map(str, options.seeds)),
        iterations=options.iterations,
        d0=draw("seed", "(iter * 3 + 1)"),
        d1=draw("seed", "(iter * 3 + 2)"),
        d2=draw("seed", "(iter * 3 + 3)"),
        tilt=tilt,
        band=band,
        support=options.min_inliers,
    )
    below = f"{options.max_below_fraction!r}e0"
    return f"""{head}, {refine_sql('best', 'once', band, tilt)}, {refine_sql('once', 'twice', band, tilt)},
    held AS (SELECT p.run_id, seed, pool, nx, ny, nz, d, nx * x + ny * y + nz * z + d AS h FROM twice p JOIN samp USING (run_id)),
    fit0 AS (SELECT run_id, seed, pool, nx, ny, nz, d, count(*) FILTER (abs(h) <= {band}) AS inlier_count,
        count(*) FILTER (abs(h) <= {band}) / CAST(count(*) AS DOUBLE) AS inlier_fraction,
        sqrt(avg(h * h) FILTER (abs(h) <= {band})) AS rmse,
        count(*) FILTER (h < -5e-2) / CAST(count(*) AS DOUBLE) AS below_fraction,
        degrees(acos(least(1e0, ny))) AS tilt_deg FROM held GROUP BY ALL),
    asked AS (SELECT run_id, seed, pool FROM size, (SELECT CAST(unnest([{", ".join(map(str, options.seeds))}]) AS BIGINT) AS seed)),
    fit AS (SELECT a.run_id, a.seed, a.pool, nx, ny, nz, d, inlier_count, inlier_fraction, rmse, below_fraction, tilt_deg, coalesce(considered, 0) AS considered,
        ln(greatest(1e-6, inlier_fraction)) - 2e0 * (tilt_deg / {tilt}) ** 2 - 2e0 * (below_fraction / 5e-2) ** 2 - rmse / {band} AS quality,
        CASE WHEN considered IS NULL THEN 'no horizontal plane in the tilt gate' WHEN nx IS NULL THEN 'no candidate with enough support'
             WHEN inlier_count < {options.min_inliers} THEN 'too few inliers'
             WHEN below_fraction > {below} THEN 'too much below the plane' END AS reason
      FROM asked a LEFT JOIN considered c USING (run_id, seed, pool) LEFT JOIN fit0 f USING (run_id, seed, pool))"""


@plan(
    "pool_positions",
    "P2, P3",
    A.cte("pts", "ord")
    + ", "
    + fit_sql(OPTIONS)
    + f" SELECT run_id, {r6s('pool')}, place, {r6s('x', 'y', 'z')} FROM pool",
)
def pool_positions(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    sample = P.stride_sample(points, A.ups(points), OPTIONS.stride)
    return publish(P._pool_positions(sample, OPTIONS.pools))


@plan(
    "candidate_planes",
    "P4, P5, P6, V1, V2, V6",
    A.cte("pts", "ord")
    + ", "
    + fit_sql(OPTIONS)
    + f" SELECT run_id, seed, {r6s('pool')}, iter, {r6s('nx', 'ny', 'nz', 'd')}, {r6('tilt', 'tilt_deg')} FROM cand",
)
def candidate_planes(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    ups = A.ups(points)
    sample = P.stride_sample(points, ups, OPTIONS.stride)
    return publish(P.candidate_planes(sample, ups, OPTIONS))


@plan(
    "plane_scores",
    "P7, P8",
    A.cte("pts", "ord")
    + ", "
    + fit_sql(OPTIONS)
    + f""" SELECT run_id, seed, {r6s('pool')}, iter, {r6('coalesce(w, 0e0)', 'weight')}, cnt AS count, below,
      {r6('coalesce(sq, 0e0)', 'squared')} FROM score""",
)
def plane_scores(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    ups = A.ups(points)
    sample = P.stride_sample(points, ups, OPTIONS.stride)
    candidates = P.candidate_planes(sample, ups, OPTIONS)
    return publish(P.score_planes(sample, candidates, OPTIONS.inlier_distance))


FIT_COLUMNS = r6s("nx", "ny", "nz", "d", "inlier_fraction", "rmse", "tilt_deg", "below_fraction", "quality")


def _unclamped(fits: DataFrame) -> DataFrame:
    return fits.drop("tilt_clamped", "elevation")


@plan(
    "ground_fit",
    "P9, P10, P11, P12, P13, G9",
    A.cte("pts", "ord")
    + ", "
    + fit_sql(OPTIONS)
    + f""" SELECT run_id, seed, {r6s('pool')}, CASE WHEN reason IS NULL THEN 'ok' ELSE 'refused' END AS status, reason,
      {FIT_COLUMNS}, inlier_count, considered AS candidates_considered FROM fit""",
)
def ground_fit(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    return publish(_unclamped(P.fit_ground(points, A.ups(points), OPTIONS)))


ROBUST_SQL = """ranked AS (SELECT *, lead(CASE WHEN reason IS NULL THEN quality END) OVER w AS runner, row_number() OVER w AS k FROM fit
        WINDOW w AS (PARTITION BY run_id, seed ORDER BY CASE WHEN reason IS NULL THEN quality END DESC NULLS LAST, pool DESC)),
    robust AS (SELECT * FROM ranked WHERE k = 1)"""


@plan(
    "ground_plane",
    "P14, P20, P21",
    A.cte("pts", "ord")
    + ", "
    + fit_sql(OPTIONS)
    + f""", {ROBUST_SQL} SELECT run_id, seed, {r6s('pool')}, CASE WHEN reason IS NULL THEN 'ok' ELSE 'refused' END AS status, reason,
      {FIT_COLUMNS}, inlier_count, considered AS candidates_considered, {r6('quality - runner', 'margin')},
      {r6('(quality - runner) / greatest(1e-9, abs(quality) + abs(runner))', 'separation')}
    FROM robust""",
)
def ground_plane(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    return publish(_unclamped(P.fit_ground_robust(points, A.ups(points), OPTIONS)))


@plan("ground_two_pass", "P15")
def ground_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    options = replace(OPTIONS, pools=(0.35,), max_below_fraction=0.5)
    return publish(P.fit_two_pass(points, A.ups(points), options))


@plan(
    "anchored_plane",
    "P16",
    A.cte("pts")
    + f""", a AS (SELECT run_id, quantile_disc(y, 2e-2) AS elevation FROM pts GROUP BY ALL)
    SELECT run_id, {r6('0e0', 'nx')}, {r6('1e0', 'ny')}, {r6('0e0', 'nz')}, {r6s('elevation')}, {r6('-elevation', 'd')},
      count(*) FILTER (abs(y - elevation) <= 35e-3) AS inlier_count,
      {r6('count(*) FILTER (abs(y - elevation) <= 35e-3) / CAST(count(*) AS DOUBLE)', 'inlier_fraction')},
      {r6('sqrt(avg((y - elevation) ** 2) FILTER (abs(y - elevation) <= 35e-3))', 'rmse')},
      {r6('count(*) FILTER (y - elevation < -5e-2) / CAST(count(*) AS DOUBLE)', 'below_fraction')}
    FROM pts JOIN a USING (run_id) GROUP BY run_id, elevation""",
)
def anchored_plane(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    return publish(P.anchor_to_low_quantile(points, A.level_planes(points)))


@plan(
    "seeded_plane",
    "P17, P10",
    A.cte("pts", "ord")
    + f""", samp AS (SELECT run_id, x, y, z, weight FROM pts),
    pick AS (SELECT run_id, CAST(0 AS BIGINT) AS seed, 1e0 AS pool, regr_slope(y, z) AS one FROM pts WHERE y < 2e-3 AND z > 1e0 GROUP BY ALL),
    seedp AS (SELECT run_id, z AS u, x AS v, y AS h FROM pts WHERE y < 2e-3 AND z > 1e0),
    ss AS (SELECT run_id, sum(u*u) uu, sum(v*v) vv, sum(u*v) uv, sum(u) su, sum(v) sv, sum(h) sh, sum(u*h) uh, sum(v*h) vh,
           CAST(count(*) AS DOUBLE) s1 FROM seedp GROUP BY ALL),
    sd AS (SELECT *, uu*(vv*s1 - sv*sv) - uv*(uv*s1 - sv*su) + su*(uv*sv - vv*su) AS det FROM ss),
    sf AS (SELECT run_id, (uh*(vv*s1 - sv*sv) - uv*(vh*s1 - sv*sh) + su*(vh*sv - vv*sh)) / det AS a,
        (uu*(vh*s1 - sv*sh) - uh*(uv*s1 - sv*su) + su*(uv*sh - vh*su)) / det AS b,
        (uu*(vv*sh - vh*sv) - uv*(uv*sh - vh*su) + uh*(uv*sv - vv*su)) / det AS c FROM sd),
    first AS (SELECT run_id, CAST(0 AS BIGINT) AS seed, 1e0 AS pool, -b / sqrt(a*a + b*b + 1e0) AS nx, 1e0 / sqrt(a*a + b*b + 1e0) AS ny,
        -a / sqrt(a*a + b*b + 1e0) AS nz, -c / sqrt(a*a + b*b + 1e0) AS d FROM sf),
    {refine_sql('first', 'final', '2e-2', '9e1')}
    SELECT run_id, {r6s('nx', 'ny', 'nz', 'd')}, {r6('degrees(acos(least(1e0, ny)))', 'tilt_deg')},
      count(*) FILTER (abs(nx*x + ny*y + nz*z + d) <= 2e-2) AS inlier_count,
      {r6('count(*) FILTER (abs(nx*x + ny*y + nz*z + d) <= 2e-2) / CAST(count(*) AS DOUBLE)', 'inlier_fraction')},
      {r6('sqrt(avg((nx*x + ny*y + nz*z + d) ** 2) FILTER (abs(nx*x + ny*y + nz*z + d) <= 2e-2))', 'rmse')},
      {r6('count(*) FILTER (nx*x + ny*y + nz*z + d < -5e-2) / CAST(count(*) AS DOUBLE)', 'below_fraction')}
    FROM final JOIN pts USING (run_id) GROUP BY run_id, nx, ny, nz, d""",
)
def seeded_plane(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    seeds = points.where((F.col("y") < f64(0.002)) & (F.col("z") > f64(1)))
    return publish(P.fit_from_seeds(points, seeds, A.ups(points), 0.02))


@plan(
    "plane_evidence",
    "P18",
    A.cte("pts")
    + f""", i AS (SELECT * FROM pts WHERE abs(y) <= 35e-3), m AS (SELECT run_id, count(*) AS inliers, avg(x) AS cx, avg(z) AS cz FROM i GROUP BY ALL)
    SELECT run_id, inliers, {r6s('cx')}, {r6('0e0', 'cy')}, {r6s('cz')},
      {r6('greatest(2e-1, quantile_disc(sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)), 9e-1))', 'radius')}
    FROM i JOIN m USING (run_id) GROUP BY run_id, inliers, cx, cz""",
)
def plane_evidence(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    return publish(P.plane_evidence(points, A.level_planes(points), 0.035))


STUDY = replace(OPTIONS, seeds=tuple(P.RESEED_START + P.RESEED_STEP * i for i in range(3)))


@plan(
    "reseed_study",
    "P19, V5",
    A.cte("pts", "ord")
    + ", "
    + fit_sql(STUDY)
    + f""", {ROBUST_SQL}, mid AS (SELECT run_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pts GROUP BY ALL),
    lifted AS (SELECT run_id, seed, tilt_deg, my - (nx * mx + ny * my + nz * mz + d) / ny AS height FROM robust JOIN mid USING (run_id) WHERE reason IS NULL)
    SELECT run_id, count(*) AS fits, {r6('min(height)', 'height_min')}, {r6('max(height)', 'height_max')},
      {r6('max(height) - min(height)', 'height_spread')}, {r6('max(tilt_deg) - min(tilt_deg)', 'tilt_spread')} FROM lifted GROUP BY ALL""",
)
def reseed_study(spark: SparkSession, sf: str) -> DataFrame:
    points = A.points(spark, sf)
    return publish(P.reseed_study(points, A.ups(points), 3, OPTIONS)[1])
