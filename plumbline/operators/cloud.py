"""Point clouds from frames: confidence floors, weights, voxels, samples and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import all_finite, f64, finite
from plumbline.functions.vectors import Vec, dot, ground_axes, length, transform_point, unit, vec
from plumbline.operators.pixels import pixel_status, usable_frames, valid_points
from plumbline.operators.ranks import exact_percentiles, uniform_sample, with_ordinal

# Histogram resolution, floor constants and the addressable voxel span.
HISTOGRAM_TOP = 4095
FLOOR_MIN = 1.05
FLOOR_LOW = 40
FLOOR_HIGH = 90
VOXEL_SPAN = 65536

FRAME = ["run_id", "frame"]


@dataclass(frozen=True)
class CloudOptions:
    """``confidence``: none | per_frame | percentile | absolute; ``weight``: none | rank | linear."""

    confidence: str = "per_frame"
    confidence_value: float = 0.0
    weight: str = "none"
    voxel_m: float = 0.0
    pixel_stride: int = 1
    max_points: int | None = None
    seed: int = 7
    min_depth: float = 1e-4
    max_depth: float = float("inf")
    max_relative_step: float = 0.08


def confidence_histogram(status: DataFrame) -> DataFrame:
    """4096-bin histogram of confidence per frame over valid pixels, with running counts."""
    valid = status.where((F.col("status") == "valid") & finite(F.col("confidence")))
    ends = valid.groupBy(*FRAME).agg(
        F.min("confidence").alias("lo"), F.max("confidence").alias("hi")
    )
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(f64(1))
    bin_ = F.floor((F.col("confidence") - F.col("lo")) / F.col("span") * f64(HISTOGRAM_TOP))
    counts = (
        valid.join(ends.withColumn("span", span), FRAME)
        .groupBy(*FRAME, "lo", "span", bin_.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = W.partitionBy(*FRAME).orderBy("bin")
    return counts.withColumn("cum", F.sum("n").over(running)).withColumn(
        "total", F.sum("n").over(W.partitionBy(*FRAME))
    )


def histogram_percentile(histogram: DataFrame, probs: dict[str, float]) -> DataFrame:
    """First bin whose running count reaches p: its lower edge as a confidence."""
    picks = [
        F.min(F.when(F.col("cum") >= f64(p / 100.0) * F.col("total"), F.col("bin"))).alias(name)
        for name, p in probs.items()
    ]
    edge = lambda name: F.col("lo") + F.col(name) / f64(HISTOGRAM_TOP) * F.col("span")
    return (
        histogram.groupBy(*FRAME, "lo", "span")
        .agg(*picks)
        .select(*FRAME, *(edge(name).alias(name) for name in probs))
    )


def frame_floors(status: DataFrame, options: CloudOptions) -> DataFrame:
    """Per-frame threshold of the chosen rule plus the counts that explain the frame.

    A histogram percentile is the bin edge of the nearest-rank value, so one
    frame-bounded aggregate gives it without keeping the histogram.
    """
    valid = (F.col("status") == "valid") & finite(F.col("confidence"))
    conf = F.when(valid, F.col("confidence"))
    p = lambda v: F.expr(
        f"percentile_disc({v}d / 100d) within group (order by case when status = 'valid' and "
        "confidence is not null and not isnan(confidence) then confidence end)"
    )
    wanted = {
        "per_frame": [FLOOR_LOW, FLOOR_HIGH],
        "percentile": [options.confidence_value],
    }.get(options.confidence, [])
    # The first bin counts as reached at p = 0.
    asked = [max(1e-9, float(v)) for v in wanted]
    stats = status.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(F.col("status").isin("valid", "edge")).alias("usable"),
        F.count_if(F.col("status") == "edge").alias("edges"),
        F.count_if(F.col("confidence").isNotNull()).alias("_mapped"),
        F.min(conf).alias("_lo"),
        F.max(conf).alias("_hi"),
        *(p(v).alias(f"_q{i}") for i, v in enumerate(asked)),
    )
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(f64(1))

    def edge(name: str) -> Column:
        bin_ = F.floor((F.col(name) - F.col("_lo")) / span * f64(HISTOGRAM_TOP))
        return F.coalesce(F.col("_lo") + bin_ / f64(HISTOGRAM_TOP) * span, f64(0))

    if options.confidence == "per_frame":
        floor = F.least(F.greatest(f64(FLOOR_MIN), edge("_q0")), edge("_q1"))
    elif options.confidence == "percentile":
        floor = edge("_q0")
    elif options.confidence == "absolute":
        floor = f64(options.confidence_value)
    elif options.confidence == "none":
        floor = f64(0)
    else:
        raise ValueError(f"unknown confidence rule {options.confidence!r}")
    threshold = F.when(F.col("_mapped") > 0, floor).otherwise(f64(0))
    return stats.select(
        *FRAME,
        "pixels",
        "usable",
        "edges",
        threshold.alias("threshold"),
        F.col("_lo").alias("conf_low"),
        span.alias("conf_span"),
    )


def _status_args(options: CloudOptions) -> dict[str, float]:
    return dict(
        max_relative_step=options.max_relative_step,
        min_depth=options.min_depth,
        max_depth=options.max_depth,
    )


def _candidates(frames: DataFrame, options: CloudOptions) -> DataFrame:
    """Valid pixels over their frame's floor, on the stride grid, with their weight.

    Frames are spread by (run, frame) while still packed. The floor aggregate runs
    where the frame is and its one row joins the packed frame, not the pixels, so
    no pixel row is shuffled, and only rank weights sort (inside a frame).
    """
    spread = usable_frames(frames)
    args = _status_args(options)
    marks = ["threshold", "conf_low", "conf_span"]
    if options.confidence != "none" or options.weight == "rank":
        spread = spread.repartition(*FRAME)
        floors = frame_floors(pixel_status(spread, **args), options).select(*FRAME, *marks)
        spread = spread.join(floors.hint("shuffle_hash"), FRAME)
    else:
        spread = spread.withColumns({m: f64(0) for m in marks})
    pixels = valid_points(spread, **args, carry=marks)
    confidence = F.col("confidence")
    if options.weight == "none":
        weight = f64(1)
    elif options.weight == "linear":
        weight = F.coalesce(confidence, f64(1))
    elif options.weight == "rank":
        bin_ = F.floor((confidence - F.col("conf_low")) / F.col("conf_span") * f64(HISTOGRAM_TOP))
        rank = F.cume_dist().over(W.partitionBy(*FRAME).orderBy(bin_))
        weight = F.when(confidence.isNull(), f64(1)).otherwise(rank)
    else:
        raise ValueError(f"unknown weight rule {options.weight!r}")
    kept = pixels.withColumn("weight", weight).where(
        confidence.isNull() | (confidence >= F.col("threshold"))
    )
    if options.pixel_stride > 1:
        s = options.pixel_stride
        kept = kept.where((F.col("x") % s == 0) & (F.col("y") % s == 0))
    colours = [c for c in ("r", "g", "b") if c in frames.columns]
    return kept.select(*FRAME, "px", "wx", "wy", "wz", "confidence", "weight", *colours)


def build_cloud(
    frames: DataFrame, options: CloudOptions = CloudOptions(), alignments: DataFrame | None = None
) -> DataFrame:
    """frames -> points(run_id, frame, px, x, y, z, weight, confidence[, r, g, b]).

    With ``voxel_m`` a row is an occupied cell, ``frame`` and ``px`` are its
    lowest contributor. Weights have mean 1 per run.
    """
    points = _candidates(frames, options)
    at = Vec(F.col("wx"), F.col("wy"), F.col("wz"))
    if alignments is not None:
        points = points.join(alignments.select("run_id", "alignment"), "run_id", "left")
        moved = transform_point(F.col("alignment"), at)
        at = Vec(*(F.when(F.col("alignment").isNull(), a).otherwise(m) for a, m in zip(at, moved)))
    colours = [c for c in ("r", "g", "b") if c in points.columns]
    points = points.select(
        *FRAME,
        "px",
        *(part.alias(name) for part, name in zip(at, "xyz")),
        "weight",
        F.coalesce(F.col("confidence"), f64(0)).alias("confidence"),
        *colours,
    )
    if options.voxel_m > 0:
        points = voxel_grid(points, options.voxel_m).drop("ix", "iy", "iz", "points")
    if options.max_points is not None:
        points = uniform_sample(points, ["run_id"], ["frame", "px"], options.max_points, options.seed)
    # Unweighted points already have mean weight 1.
    return points if options.weight == "none" else mean_one_weights(points)


def mean_one_weights(points: DataFrame) -> DataFrame:
    """Scale weights to mean 1 per run: a small aggregate joined back, not a run-wide window."""
    means = points.groupBy("run_id").agg(F.avg("weight").alias("_mean"))
    scaled = F.when(F.col("_mean") > 0, F.col("weight") / F.col("_mean")).otherwise(F.col("weight"))
    return points.join(means, "run_id").withColumn("weight", scaled).drop("_mean")


def frame_contributions(frames: DataFrame, options: CloudOptions = CloudOptions()) -> DataFrame:
    """Per frame: threshold, pixels, usable, edges and points kept on the stride grid."""
    spread = usable_frames(frames).repartition(*FRAME)
    floors = frame_floors(pixel_status(spread, **_status_args(options)), options)
    kept = _candidates(frames, options).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("kept"))
    counts = floors.drop("conf_low", "conf_span")
    return counts.join(kept, FRAME, "left").fillna(0, ["kept"])


def run_shares(contributions: DataFrame) -> DataFrame:
    """Leanest frame and the share of all candidates kept, per run."""
    lean = F.when(F.col("usable") > 0, F.col("kept") / F.col("usable")).otherwise(f64(1))
    return contributions.groupBy("run_id").agg(
        F.min(lean).alias("leanest_share"),
        (F.sum("kept") / F.nullif(F.sum("usable"), F.lit(0))).alias("kept_share"),
        F.sum("kept").alias("kept"),
    )


def voxel_index(points: DataFrame, edge: float) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / f64(edge))
    return points.withColumns({"ix": cell("x"), "iy": cell("y"), "iz": cell("z")})


def _in_span() -> Column:
    out = F.lit(True)
    for c in ("ix", "iy", "iz"):
        out = out & (F.col(c) >= -VOXEL_SPAN) & (F.col(c) < VOXEL_SPAN)
    return out


def voxel_grid(points: DataFrame, edge: float) -> DataFrame:
    """One row per occupied cell: weighted centroid, mean weight, confidence and colour.

    Partial aggregation shrinks each task to its occupied cells before the
    shuffle, so a dense cell is never gathered row by row.
    """
    colours = [c for c in ("r", "g", "b") if c in points.columns]
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(f64(1e-6))
    # One number per contributor keeps this a hash aggregate; a struct would sort.
    first = F.min(F.shiftleft(F.col("frame").cast("long"), 32) + F.col("px"))
    cells = (
        voxel_index(points, edge)
        .where(all_finite(F.col(c) for c in "xyz"))
        .withColumn("_w", w)
        .groupBy("run_id", "ix", "iy", "iz")
        .agg(
            first.alias("_first"),
            *(F.sum(F.col(c) * F.col("_w")).alias(f"_{c}") for c in "xyz"),
            F.sum("_w").alias("_sw"),
            F.avg("_w").alias("weight"),
            F.avg("confidence").alias("confidence"),
            *(F.floor(F.avg(c)).cast("int").alias(c) for c in colours),
            F.count(F.lit(1)).alias("points"),
        )
    )
    return cells.select(
        "run_id",
        F.shiftright("_first", 32).alias("frame"),
        F.col("_first").bitwiseAND(F.lit(0xFFFFFFFF)).alias("px"),
        *((F.col(f"_{c}") / F.col("_sw")).alias(c) for c in "xyz"),
        "weight",
        "confidence",
        *colours,
        "ix",
        "iy",
        "iz",
        "points",
    )


def voxel_refusals(points: DataFrame, edge: float) -> DataFrame:
    """Points beyond the span of a packed 51-bit cell number, per run; ``voxel_grid`` keeps them."""
    return (
        voxel_index(points, edge)
        .groupBy("run_id")
        .agg(F.count_if(~_in_span()).alias("out_of_range"), F.count_if(_in_span()).alias("in_range"))
    )


def pooled_floor(frames: DataFrame) -> DataFrame:
    """The per-frame formula over the whole run at once (what the audit compares with)."""
    values = frames.select("run_id", F.explode("confidence").alias("c"))
    q = exact_percentiles(values, ["run_id"], F.col("c"), {"p40": FLOOR_LOW, "p90": FLOOR_HIGH})
    return q.select(
        "run_id",
        "p40",
        "p90",
        F.least(F.greatest(f64(FLOOR_MIN), F.col("p40")), F.col("p90")).alias("threshold"),
    )


def interpolated_floor(frames: DataFrame, share: float = 0.4) -> DataFrame:
    """Linearly interpolated confidence percentile per frame over finite pixels with depth > 0."""
    pairs = F.arrays_zip(F.col("depth"), F.col("confidence"))
    usable = F.filter(
        pairs,
        lambda p: finite(p["depth"].cast("double"))
        & finite(p["confidence"].cast("double"))
        & (p["depth"] > 0),
    )
    values = F.sort_array(F.transform(usable, lambda p: p["confidence"].cast("double")))
    n = F.size("_v")
    at = f64(share) * (n - 1)
    low = F.floor(at).cast("int")
    a, b = F.get("_v", low), F.get("_v", F.least(low + 1, n - 1))
    return frames.withColumn("_v", values).select(
        *FRAME, F.when(n > 0, a + (b - a) * (at - low)).otherwise(f64(1)).alias("threshold")
    )


def decimate(points: DataFrame, every: int, order: list[str]) -> DataFrame:
    """Every Nth stored point of each run, starting with the first."""
    return with_ordinal(points, ["run_id"], "frame", order).where(F.col("ord") % every == 0)


def thin_to(points: DataFrame, max_points: int, order: list[str]) -> DataFrame:
    """Even thinning by the smallest stride that leaves at most ``max_points`` per run."""
    stride = F.greatest(F.lit(1), F.ceil(F.col("group_rows") / f64(max_points)))
    numbered = with_ordinal(points, ["run_id"], "frame", order)
    return numbered.where(F.col("ord") % stride == 0)


def cloud_stats(points: DataFrame) -> DataFrame:
    """Box, diagonal, centroid and finite counts per run, one pass."""
    good = all_finite(F.col(c) for c in "xyz")
    use = lambda c: F.when(good, F.col(c))
    stats = points.groupBy("run_id").agg(
        *(F.min(use(c)).alias(f"min_{c}") for c in "xyz"),
        *(F.max(use(c)).alias(f"max_{c}") for c in "xyz"),
        *(F.avg(use(c)).alias(f"centroid_{c}") for c in "xyz"),
        F.count_if(good).alias("finite"),
        F.count_if(~good).alias("non_finite"),
    )
    size = Vec(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"))
    return stats.withColumn("diagonal", length(size))


def quantiles_along(points: DataFrame, ups: DataFrame) -> DataFrame:
    """p1, p50, p99 of position along each run's up axis."""
    placed = points.join(ups.select("run_id", "ux", "uy", "uz"), "run_id")
    along = dot(Vec(F.col("x"), F.col("y"), F.col("z")), Vec(F.col("ux"), F.col("uy"), F.col("uz")))
    return exact_percentiles(placed, ["run_id"], along, {"p1": 1, "p50": 50, "p99": 99})


def coloured_runs(frames: DataFrame) -> DataFrame:
    """Whether every frame of the run carries a full colour map; one gap drops colour for the run."""
    full = (
        (F.size("r") == F.size("depth"))
        & (F.size("g") == F.size("depth"))
        & (F.size("b") == F.size("depth"))
    )
    return frames.groupBy("run_id").agg(
        F.bool_and(F.coalesce(full, F.lit(False))).alias("coloured")
    )


def footprint(selection: DataFrame, ups: DataFrame, keys: list[str]) -> DataFrame:
    """Width and depth across the ground of a selection."""
    axis = unit(vec("ux", "uy", "uz"))
    axes = ups.select("run_id", *(a.alias(n) for a, n in zip(axis, ("ux", "uy", "uz"))))
    e1, e2 = ground_axes(vec("ux", "uy", "uz"))
    p = vec("x", "y", "z")
    placed = (
        selection.join(axes, "run_id")
        .withColumn("_a", dot(p, e1))
        .withColumn("_b", dot(p, e2))
    )
    return placed.groupBy(*keys).agg(
        (F.max("_a") - F.min("_a")).alias("width"), (F.max("_b") - F.min("_b")).alias("depth")
    )
