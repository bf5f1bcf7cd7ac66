"""Ground planes: seeded consensus fits for every run, pool and seed at once.

The candidate planes of a run are few (iterations x pools x seeds, all fixed by
the caller); the points are many. Points are cut into fixed-size blocks by their
stored position, each block meets its run's candidates once and returns one
partial score per candidate, so no point x candidate row ever exists and a run
with a third of all points is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import all_finite, f64, with_uniform_draw
from plumbline.functions.vectors import (
    Vec,
    cross,
    dot,
    ground_axes,
    length,
    minus,
    plane,
    plane_elevation_at,
    scaled,
    signed_height,
    tilt_deg,
    unit,
    vec,
)
from plumbline.operators.ranks import exact_percentiles, exploded, with_ordinal, with_rank
from plumbline.session import cut_lineage

BELOW_M = 0.05
BLOCK = 16384
FIT = ["run_id", "seed", "pool"]


@dataclass(frozen=True)
class GroundOptions:
    max_tilt_deg: float = 30.0
    inlier_distance: float = 0.02
    iterations: int = 2000
    seeds: tuple[int, ...] = (1,)
    min_inliers: int = 100
    stride: int = 1
    pools: tuple[float, ...] = (1.0,)
    max_below_fraction: float = 0.15
    below_scale: float = 0.05
    min_inlier_fraction: float = 0.01


# The settings of the recorded measurement chain.
MEASUREMENT_FIT = GroundOptions(
    inlier_distance=0.035,
    iterations=1200,
    seeds=(7,),
    stride=16,
    pools=(1.0, 0.35),
    max_below_fraction=0.2,
)

RESEED_START = 7
RESEED_STEP = 101


def ground_quality(
    inlier_fraction: Column, tilt_deg: Column, below: Column, rmse: Column, options: GroundOptions
) -> Column:
    """ln support minus penalties for tilt, for points below, and for residual."""
    tilt = tilt_deg / f64(max(1.0, options.max_tilt_deg))
    sunk = below / f64(max(1e-6, options.below_scale))
    return (
        F.ln(F.greatest(f64(1e-6), inlier_fraction))
        - f64(2) * tilt * tilt
        - f64(2) * sunk * sunk
        - rmse / f64(max(1e-6, options.inlier_distance))
    )


def strided(points: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th stored point with its sample position and run size."""
    columns = ["run_id", "frame", "px", "x", "y", "z", "weight"]
    finite = points.select(*columns).where(all_finite(F.col(c) for c in "xyz"))
    numbered = with_ordinal(finite, ["run_id"], "frame", ["px", "x", "y", "z", "weight"])
    return numbered.where(F.col("ord") % stride == 0).select(
        "run_id",
        F.expr(f"ord div {stride}").alias("pos"),
        F.ceil(F.col("group_rows") / f64(stride)).cast("long").alias("n"),
        "x",
        "y",
        "z",
        "weight",
    )


def _along_up(sample: DataFrame, ups: DataFrame) -> DataFrame:
    """Sample points with their run's unit up and their height along it."""
    return sample.join(_unit_ups(ups), "run_id").withColumn(
        "along", dot(vec("x", "y", "z"), vec("ux", "uy", "uz"))
    )


def stride_sample(points: DataFrame, ups: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th stored point with its sample position, run size and height along up."""
    return _along_up(strided(points, stride), ups)


def _pool_size(n: Column, pool: float) -> Column:
    if pool >= 1:
        return n
    return F.least(n, F.greatest(F.lit(3), F.ceil(n * f64(pool))))


def _pool_positions(sample: DataFrame, pools: Sequence[float]) -> DataFrame:
    """Every proposal point with its position in each pool (stored order, or lowest first)."""
    keep = ["run_id", "pool", "place", "x", "y", "z"]
    parts: list[DataFrame] = []
    if any(p >= 1 for p in pools):
        parts.append(sample.withColumn("pool", f64(1)).withColumn("place", F.col("pos")).select(*keep))
    low = [p for p in pools if p < 1]
    if low:
        ranked = with_rank(sample, ["run_id"], F.col("along"), ["pos"])
        wanted = F.array(*(F.struct(f64(p).alias("p"), _pool_size(F.col("n"), p).alias("m")) for p in low))
        parts.append(
            ranked.withColumn("_p", F.explode(wanted))
            .where(F.col("rank") <= F.col("_p.m"))
            .withColumn("pool", F.col("_p.p"))
            .withColumn("place", F.col("rank") - 1)
            .select(*keep)
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def draw_positions(sizes: DataFrame, options: GroundOptions) -> DataFrame:
    """Three pool positions per iteration, one row per draw, per (run, seed, pool)."""
    pools = F.array(*(F.struct(f64(p).alias("p"), _pool_size(F.col("n"), p).alias("m")) for p in options.pools))
    base = (
        sizes.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in options.seeds))))
        .withColumn("_p", F.explode(pools))
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(3 * options.iterations))))
    )
    drawn = with_uniform_draw(base, F.col("seed"), F.col("nth"), "_r")
    place = F.least(F.col("_p.m") - 1, F.floor(F.col("_r") * F.col("_p.m"))).cast("long")
    # Never NULL; said so, the join adds no null test that would compute it twice.
    place = F.coalesce(place, F.lit(0).cast("long"))
    return drawn.select(
        "run_id",
        "seed",
        F.col("_p.p").alias("pool"),
        F.expr("(nth - 1) div 3").cast("int").alias("iter"),
        ((F.col("nth") - 1) % 3).alias("slot"),
        place.alias("place"),
    )


def candidate_planes(sample: DataFrame, ups: DataFrame, options: GroundOptions) -> DataFrame:
    """One row per usable draw: an up-facing plane inside the tilt gate."""
    sizes = sample.groupBy("run_id").agg(F.max("n").alias("n")).where(F.col("n") >= 3)
    located = exploded(draw_positions(sizes, options)).join(
        _pool_positions(sample, options.pools), ["run_id", "pool", "place"]
    )
    corner = lambda s, c: F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{c}{s}")
    corners = located.groupBy(*FIT, "iter").agg(
        F.min("place").alias("_p0"),
        F.max("place").alias("_p2"),
        F.sum("place").alias("_ps"),
        *(corner(s, c) for s in range(3) for c in "xyz"),
    )
    # A draw that repeats a point is dropped: three places are distinct when the
    # middle one equals neither end.
    middle = F.col("_ps") - F.col("_p0") - F.col("_p2")
    corners = corners.where((middle > F.col("_p0")) & (middle < F.col("_p2")))
    a, b, c = (vec(f"x{s}", f"y{s}", f"z{s}") for s in range(3))
    up, n = vec("ux", "uy", "uz"), vec("nx", "ny", "nz")
    names = ("_cx", "_cy", "_cz")
    across = cross(minus(b, a), minus(c, a))
    raw = corners.join(_unit_ups(ups), "run_id").select(
        *FIT, "iter", "ux", "uy", "uz", "x0", "y0", "z0", *(p.alias(k) for p, k in zip(across, names))
    )
    # Three points give a plane unless they are collinear; its normal faces up.
    product = vec(*names)
    size = length(product)
    faced = F.when(dot(product, up) < f64(0), f64(-1)).otherwise(f64(1))
    planes = raw.withColumn("_size", size).where(F.col("_size") > f64(1e-12)).withColumn("_face", faced)
    normal = planes.select(
        *FIT,
        "iter",
        "x0",
        "y0",
        "z0",
        "ux",
        "uy",
        "uz",
        *((F.col("_face") * F.col(k) / F.col("_size")).alias(m) for k, m in zip(names, ("nx", "ny", "nz"))),
    )
    return (
        normal.withColumn("d", -dot(n, a))
        .withColumn("tilt_deg", tilt_deg(n, up))
        .where(F.col("tilt_deg") <= f64(options.max_tilt_deg))
        .select(*FIT, "iter", "nx", "ny", "nz", "d", "tilt_deg")
    )


def _unit_ups(ups: DataFrame) -> DataFrame:
    axis = unit(vec("ux", "uy", "uz"))
    return ups.select("run_id", *(a.alias(c) for a, c in zip(axis, ("ux", "uy", "uz"))))


def score_planes(sample: DataFrame, candidates: DataFrame, band: float) -> DataFrame:
    """Weight, count, below-count and squared residual of every candidate, in one pass.

    Blocks of points and the run's candidates meet in a cogroup; the partial
    scores (one row per block and candidate) are then summed.
    """
    blocks = sample.select(
        "run_id", F.expr(f"pos div {BLOCK}").alias("block"), "x", "y", "z", "weight"
    )
    spans = sample.groupBy("run_id").agg(F.max("pos").alias("_last"))
    per_block = candidates.join(spans, "run_id").select(
        F.col("run_id").alias("fit_run"),
        "seed",
        "pool",
        "iter",
        "nx",
        "ny",
        "nz",
        "d",
        F.explode(F.expr(f"sequence(0L, _last div {BLOCK})")).alias("fit_block"),
    )

    def score(points: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
        x, y, z, w = (np.ascontiguousarray(points[c].to_numpy()) for c in ("x", "y", "z", "weight"))
        h, part = np.empty(len(x)), np.empty(len(x))
        out = np.zeros((4, len(planes)))
        # One plane at a time over columns that stay in the processor's cache, without new arrays of points x planes.
        for i, (nx, ny, nz, d) in enumerate(planes[["nx", "ny", "nz", "d"]].to_numpy()):
            np.multiply(x, nx, out=h)
            h += np.multiply(y, ny, out=part)
            h += np.multiply(z, nz, out=part)
            h += d
            inside = np.abs(h, out=part) <= band
            near = h[inside]
            out[:, i] = w[inside].sum(), len(near), np.count_nonzero(h < -BELOW_M), near @ near
        named = planes[["fit_run", "seed", "pool", "iter"]].rename(columns={"fit_run": "run_id"})
        return named.assign(
            weight=out[0], count=out[1].astype("int64"), below=out[2].astype("int64"), squared=out[3]
        )

    run_type = sample.schema["run_id"].dataType.simpleString()
    schema = (
        f"run_id {run_type}, seed int, pool double, iter int, "
        "weight double, count long, below long, squared double"
    )
    partial = (
        blocks.groupBy("run_id", "block")
        .cogroup(per_block.groupBy("fit_run", "fit_block"))
        .applyInPandas(score, schema)
    )
    return partial.groupBy(*FIT, "iter").agg(
        *(F.sum(c).alias(c) for c in ("weight", "count", "below", "squared"))
    )


def best_candidates(
    candidates: DataFrame, scores: DataFrame, totals: DataFrame, options: GroundOptions
) -> DataFrame:
    """Highest quality per (run, seed, pool); the first iteration wins a tie."""
    scored = candidates.join(scores, [*FIT, "iter"]).join(totals, "run_id")
    quality = ground_quality(
        F.col("weight") / F.greatest(f64(1e-9), F.col("total_weight")),
        F.col("tilt_deg"),
        F.col("below") / F.col("n"),
        F.sqrt(F.col("squared") / F.col("count")),
        options,
    )
    supported = F.col("count") >= options.min_inliers
    ranked = scored.where(F.col("count") > 0).withColumn("quality", quality)
    chosen = F.max_by(
        F.struct("iter", "nx", "ny", "nz", "d", "quality"),
        F.when(supported, F.struct("quality", -F.col("iter"))),
    )
    return (
        ranked.groupBy(*FIT)
        .agg(F.count(F.lit(1)).alias("candidates_considered"), chosen.alias("b"))
        .select(*FIT, "candidates_considered", "b.*")
    )


def refine(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted least-squares height field over the rows of each group.

    ``members`` carries x, y, z, weight and the unit up (ux, uy, uz). One
    aggregate of nine sums, then a 3x3 solve in plain expressions; NULL plane
    when the points do not span the ground.
    """
    up = vec("ux", "uy", "uz")
    e1, e2 = ground_axes(up)
    p = vec("x", "y", "z")
    flat = (
        members.where(F.col("weight") > 0)
        .withColumn("_u", dot(p, e1))
        .withColumn("_v", dot(p, e2))
        .withColumn("_h", dot(p, up))
    )
    u, v, h, w = (F.col(c) for c in ("_u", "_v", "_h", "weight"))
    terms = {
        "uu": w * u * u,
        "vv": w * v * v,
        "uv": w * u * v,
        "u": w * u,
        "v": w * v,
        "h": w * h,
        "uh": w * u * h,
        "vh": w * v * h,
        "s": w,
    }
    sums = flat.groupBy(*keys).agg(
        *(F.sum(t).alias(f"_s{n}") for n, t in terms.items()),
        *(F.first(c).alias(c) for c in ("ux", "uy", "uz")),
    )
    s = {n: F.col(f"_s{n}") for n in terms}
    rows = [[s["uu"], s["uv"], s["u"]], [s["uv"], s["vv"], s["v"]], [s["u"], s["v"], s["s"]]]
    right = [s["uh"], s["vh"], s["h"]]

    def det(m: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, i, j) = m
        return a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)

    def swapped(column: int) -> list[list[Column]]:
        return [[right[r] if c == column else rows[r][c] for c in range(3)] for r in range(3)]

    solved = sums.withColumn("_det", det(rows))
    for i in range(3):
        solved = solved.withColumn(
            f"_k{i}", F.when(F.abs(F.col("_det")) >= f64(1e-12), det(swapped(i)) / F.col("_det"))
        )
    b1, b2 = ground_axes(up)
    tilt = [F.col("_k0"), F.col("_k1")]
    raw = [w_ - tilt[0] * a - tilt[1] * b for w_, a, b in zip(up, b1, b2)]
    leaning = solved.select(
        *keys, "ux", "uy", "uz", "_k2", *(r.alias(c) for r, c in zip(raw, ("_rx", "_ry", "_rz")))
    )
    normal = unit(vec("_rx", "_ry", "_rz"))
    named = leaning.select(
        *keys, "ux", "uy", "uz", "_k2", *(n.alias(c) for n, c in zip(normal, ("nx", "ny", "nz")))
    )
    return named.select(
        *keys,
        "nx",
        "ny",
        "nz",
        (-F.col("_k2") * dot(vec("nx", "ny", "nz"), up)).alias("d"),
    )


def _refine_once(sample: DataFrame, fits: DataFrame, options: GroundOptions) -> DataFrame:
    """Refine each fit on its own inliers; keep the old plane when the new one leaves the gate."""
    joined = sample.join(fits.select(*FIT, "nx", "ny", "nz", "d"), "run_id")
    inliers = joined.where(
        F.abs(signed_height(plane(), vec("x", "y", "z"))) <= f64(options.inlier_distance)
    ).drop("nx", "ny", "nz", "d")
    better = refine(inliers, FIT).select(
        *FIT, *(F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz", "d"))
    )
    ups = sample.groupBy("run_id").agg(*(F.first(c).alias(c) for c in ("ux", "uy", "uz")))
    tilt = tilt_deg(vec("_nx", "_ny", "_nz"), vec("ux", "uy", "uz"))
    inside = F.coalesce(tilt <= f64(options.max_tilt_deg), F.lit(False))
    outside = F.coalesce(tilt > f64(options.max_tilt_deg), F.lit(False))
    # A handful of rows per run, read three times by the next step.
    return cut_lineage(
        fits.join(better, FIT, "left")
        .join(ups, "run_id")
        .withColumn("_ok", inside)
        .withColumn("tilt_clamped", F.col("tilt_clamped") | outside)
        .select(
            *(c for c in fits.columns if c not in ("nx", "ny", "nz", "d", "tilt_clamped")),
            *(
                F.when(F.col("_ok"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
                for c in ("nx", "ny", "nz", "d")
            ),
            "tilt_clamped",
        )
    )


def plane_support(sample: DataFrame, fits: DataFrame, keys: Sequence[str], band: float) -> DataFrame:
    """Inlier count and share, rmse and share below each plane over the sample."""
    joined = sample.join(fits.select(*keys, "nx", "ny", "nz", "d"), "run_id")
    h = F.col("_h")
    inside = F.abs(h) <= f64(band)
    return (
        joined.withColumn("_h", signed_height(plane(), vec("x", "y", "z")))
        .groupBy(*keys)
        .agg(
            F.count_if(inside).alias("inlier_count"),
            (F.count_if(inside) / F.count(F.lit(1))).alias("inlier_fraction"),
            F.sqrt(F.avg(F.when(inside, h * h))).alias("rmse"),
            (F.count_if(h < f64(-BELOW_M)) / F.count(F.lit(1))).alias("below_fraction"),
        )
    )


def fit_ground(
    points: DataFrame, ups: DataFrame, options: GroundOptions, runs: DataFrame | None = None
) -> DataFrame:
    """One row per (run, seed, pool): a plane, or the reason there is none.

    A refusal is a row with ``status = 'refused'``, so one bad run never fails
    the job: a run with an up direction and no finite point is refused, and so is
    one of ``runs`` (run_id: all that are asked for) without an up direction. The
    strided sample is written once to the checkpoint folder since scoring and two
    refinements all read it.
    """
    return _fit_strided(strided(points, options.stride), ups, options, runs)


def _fit_strided(
    taken: DataFrame, ups: DataFrame, options: GroundOptions, runs: DataFrame | None = None
) -> DataFrame:
    sample = cut_lineage(_along_up(taken, ups))
    known = ups.select("run_id", F.lit("no finite points").alias("reason"))
    if runs is not None:
        nameless = runs.select("run_id").distinct().join(ups.select("run_id"), "run_id", "left_anti")
        known = known.unionByName(nameless.withColumn("reason", F.lit("no up direction")))
    missing = known.join(sample.select("run_id").distinct(), "run_id", "left_anti")
    return _with_refused(fit_sample(sample, ups, options), missing, options)


def _with_refused(fits: DataFrame, missing: DataFrame, options: GroundOptions) -> DataFrame:
    """``fits`` and a refused row per seed and pool of each of ``missing`` (run_id, reason)."""
    asked = missing.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in options.seeds)))).withColumn(
        "pool", F.explode(F.array(*(f64(p) for p in options.pools)))
    )
    given = {
        "status": F.lit("refused"),
        "tilt_clamped": F.lit(False),
        "candidates_considered": F.lit(0),
    }
    kinds = {f.name: f.dataType for f in fits.schema.fields}
    rows = asked.select(
        *(
            (F.col(c) if c in asked.columns else given.get(c, F.lit(None))).cast(kinds[c]).alias(c)
            for c in fits.columns
        )
    )
    return fits.unionByName(rows)


def fit_sample(sample: DataFrame, ups: DataFrame, options: GroundOptions) -> DataFrame:
    # Scored and then joined with its scores: written once rather than drawn twice.
    candidates = cut_lineage(candidate_planes(sample, ups, options))
    scores = score_planes(sample, candidates, options.inlier_distance)
    totals = sample.groupBy("run_id").agg(
        F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("n")
    )
    best = cut_lineage(best_candidates(candidates, scores, totals, options))
    fits = best.where(F.col("nx").isNotNull()).withColumn("tilt_clamped", F.lit(False))
    for _ in range(2):
        fits = _refine_once(sample, fits, options)
    support = plane_support(sample, fits, FIT, options.inlier_distance)
    axes = totals.select("run_id", "n").join(_unit_ups(ups), "run_id")
    asked = axes.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in options.seeds)))).withColumn(
        "pool", F.explode(F.array(*(f64(p) for p in options.pools)))
    )
    joined = (
        asked.join(best.select(*FIT, "candidates_considered"), FIT, "left")
        .join(fits.drop("candidates_considered", "iter", "quality"), FIT, "left")
        .join(support, FIT, "left")
        .withColumn("candidates_considered", F.coalesce(F.col("candidates_considered"), F.lit(0)))
    )
    reason = (
        F.when(F.col("n") < 3, F.lit("fewer than 3 points"))
        .when(F.col("candidates_considered") == 0, F.lit("no horizontal plane in the tilt gate"))
        .when(F.col("nx").isNull(), F.lit("no candidate with enough support"))
        .when(F.col("inlier_count") < options.min_inliers, F.lit("too few inliers"))
        .when(F.col("below_fraction") > f64(options.max_below_fraction), F.lit("too much below the plane"))
    )
    tilt = tilt_deg(vec("nx", "ny", "nz"), vec("ux", "uy", "uz"))
    graded = joined.withColumn("tilt_deg", tilt)
    quality = ground_quality(
        F.col("inlier_fraction"), F.col("tilt_deg"), F.col("below_fraction"), F.col("rmse"), options
    )
    return graded.select(
        *FIT,
        F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("refused")).alias("status"),
        reason.alias("reason"),
        "nx",
        "ny",
        "nz",
        "d",
        "inlier_count",
        "inlier_fraction",
        "rmse",
        "tilt_deg",
        (-F.col("d")).alias("elevation"),
        "below_fraction",
        F.coalesce(F.col("tilt_clamped"), F.lit(False)).alias("tilt_clamped"),
        "candidates_considered",
        quality.alias("quality"),
    )


def choose_robust(fits: DataFrame, options: GroundOptions) -> DataFrame:
    """Best surviving pool per (run, seed) with its margin over the runner-up.

    A thin winner is refused, and so is a run whose every pool was.
    """
    # Pools are tried in the order given; the earlier one wins a tie.
    order = F.array_position(F.array(*(f64(p) for p in options.pools)), F.col("pool"))
    ok = F.col("status") == "ok"
    ranked = W.partitionBy("run_id", "seed").orderBy(F.desc(F.when(ok, F.col("quality"))), order)
    best = (
        fits.withColumn("_at", F.row_number().over(ranked))
        .withColumn("_next", F.lead(F.when(ok, F.col("quality"))).over(ranked))
        .where(F.col("_at") == 1)
    )
    gap = F.col("quality") - F.col("_next")
    separation = gap / F.greatest(f64(1e-9), F.abs(F.col("quality")) + F.abs(F.col("_next")))
    thin = ok & (F.col("inlier_fraction") < f64(options.min_inlier_fraction))
    return best.select(
        *(c for c in fits.columns if c not in ("status", "reason")),
        F.when(ok & ~thin, F.lit("ok")).otherwise(F.lit("refused")).alias("status"),
        F.when(thin, F.lit("support too thin")).otherwise(F.col("reason")).alias("reason"),
        gap.alias("margin"),
        separation.alias("separation"),
    )


def fit_ground_robust(
    points: DataFrame, ups: DataFrame, options: GroundOptions = MEASUREMENT_FIT, runs: DataFrame | None = None
) -> DataFrame:
    """The best pool of each run and seed; of ``runs`` (run_id) those without an up direction are refused rows."""
    return choose_robust(fit_ground(points, ups, options, runs), options)


def fit_two_pass(points: DataFrame, ups: DataFrame, options: GroundOptions, runs: DataFrame | None = None) -> DataFrame:
    """A second fit along the first one's normal, with a tighter gate and the next seed.

    Both rows come back, ``pass`` 1 and 2, the second refused if the first is.
    Takes one seed and one pool. ``runs`` as in ``fit_ground``. Both passes take
    the same points, so the cloud is put in order once.
    """
    taken = cut_lineage(strided(points, options.stride))
    first = cut_lineage(_fit_strided(taken, ups, options, runs))
    normals = first.where(F.col("status") == "ok").select(
        "run_id", F.col("nx").alias("ux"), F.col("ny").alias("uy"), F.col("nz").alias("uz")
    )
    tighter = replace(
        options,
        max_tilt_deg=min(options.max_tilt_deg, 10.0),
        seeds=tuple(s + 1 for s in options.seeds),
    )
    failed = first.where(F.col("status") != "ok").select("run_id", F.lit("first pass refused").alias("reason"))
    second = _with_refused(_fit_strided(taken, normals, tighter), failed, tighter)
    return first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))


def anchor_to_low_quantile(
    points: DataFrame,
    fits: DataFrame,
    quantile: float = 2.0,
    stride: int = 1,
    band: float = 0.035,
) -> DataFrame:
    """Slide each plane along its normal to a low nearest-rank quantile and score it again."""
    normals = fits.select("run_id", "nx", "ny", "nz")
    used = points
    if stride > 1:
        used = with_ordinal(points, ["run_id"], "frame", ["px", "x", "y", "z"]).where(
            F.col("ord") % stride == 0
        )
    placed = used.join(normals, "run_id").withColumn("_a", dot(vec("nx", "ny", "nz"), vec("x", "y", "z")))
    levels = exact_percentiles(
        placed, ["run_id"], F.col("_a"), {"elevation": max(0.0, min(100.0, quantile))}
    ).where(F.col("n") >= 3)
    planes = normals.join(levels.select("run_id", "elevation"), "run_id").withColumn(
        "d", -F.col("elevation")
    )
    support = plane_support(used, planes, ["run_id"], band)
    return planes.join(support, "run_id")


def fit_from_seeds(
    points: DataFrame, seeds: DataFrame, ups: DataFrame, band: float = 0.02
) -> DataFrame:
    """Plane through operator-picked points, refined once on its own inliers."""
    axes = _unit_ups(ups)
    picked = seeds.select("run_id", "x", "y", "z", f64(1).alias("weight")).join(axes, "run_id")
    seeded = cut_lineage(refine(picked, ["run_id"]))
    seeded = seeded.where(F.col("nx").isNotNull())
    cloud = points.select("run_id", "x", "y", "z", "weight").join(axes, "run_id")
    inliers = cloud.join(seeded, "run_id").where(
        F.abs(signed_height(plane(), vec("x", "y", "z"))) <= f64(band)
    )
    enough = inliers.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3)
    better = refine(inliers.drop("nx", "ny", "nz", "d"), ["run_id"]).join(enough, "run_id", "left_semi")
    renamed = better.select("run_id", *(F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz", "d")))
    planes = cut_lineage(
        seeded.join(renamed, "run_id", "left").select(
            "run_id",
            *(
                F.when(F.col("_nx").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
                for c in ("nx", "ny", "nz", "d")
            ),
        )
    )
    support = plane_support(cloud, planes, ["run_id"], band)
    tilt = tilt_deg(vec("nx", "ny", "nz"), vec("ux", "uy", "uz"))
    return (
        planes.join(axes, "run_id")
        .withColumn("tilt_deg", tilt)
        .drop("ux", "uy", "uz")
        .join(support, "run_id", "left")
    )


def plane_evidence(points: DataFrame, planes: DataFrame, band: float) -> DataFrame:
    """Centre of the supporting points dropped onto the plane, and their p90 radius (at least 0.2 m)."""
    p = vec("x", "y", "z")
    inliers = points.join(planes.select("run_id", "nx", "ny", "nz", "d"), "run_id").where(
        F.abs(signed_height(plane(), p)) <= f64(band)
    )
    raw = inliers.groupBy("run_id", "nx", "ny", "nz", "d").agg(
        F.count(F.lit(1)).alias("inliers"), *(F.avg(c).alias(f"_m{c}") for c in "xyz")
    )
    mean = vec("_mx", "_my", "_mz")
    drop = signed_height(plane(), mean)
    centre = minus(mean, scaled(vec("nx", "ny", "nz"), drop))
    # Sums of doubles depend on the order of their parts; distances are measured several times from one centre.
    centres = cut_lineage(
        raw.select("run_id", "inliers", *(part.alias(n) for part, n in zip(centre, ("cx", "cy", "cz"))))
    )
    away = minus(p, vec("cx", "cy", "cz"))
    normal = dot(away, vec("nx", "ny", "nz"))
    radius = F.sqrt(F.greatest(f64(0), dot(away, away) - normal * normal))
    radii = exact_percentiles(inliers.join(centres, "run_id"), ["run_id"], radius, {"p90": 90})
    return centres.join(radii.select("run_id", "p90"), "run_id").select(
        "run_id", "inliers", "cx", "cy", "cz", F.greatest(f64(0.2), F.col("p90")).alias("radius")
    )


def reseed_study(
    points: DataFrame, ups: DataFrame, times: int, options: GroundOptions = MEASUREMENT_FIT
) -> tuple[DataFrame, DataFrame]:
    """Fit with many seeds; heights are compared under the cloud's own centroid.

    Returns (one row per seed, spread per run).
    """
    seeds = tuple(RESEED_START + RESEED_STEP * i for i in range(times))
    fits = cut_lineage(fit_ground_robust(points, ups, replace(options, seeds=seeds)))
    centres = points.groupBy("run_id").agg(*(F.avg(c).alias(f"_m{c}") for c in "xyz"))
    ok = F.col("status") == "ok"
    height = plane_elevation_at(plane(), vec("_mx", "_my", "_mz"), vec("ux", "uy", "uz"))
    rows = (
        fits.join(centres, "run_id")
        .join(_unit_ups(ups), "run_id")
        .withColumn("height", F.when(ok, height))
        .select("run_id", "seed", "status", "height", "elevation", "tilt_deg", "inlier_fraction", "separation")
    )
    spread = rows.where(ok).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("fits"),
        F.min("height").alias("height_min"),
        F.max("height").alias("height_max"),
        (F.max("height") - F.min("height")).alias("height_spread"),
        (F.max("tilt_deg") - F.min("tilt_deg")).alias("tilt_spread"),
    )
    return rows, spread
