"""Masks as set-pixel rows: resampling, erosion, run lengths, strokes, review rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64

MASK = ["run_id", "object_id", "frame"]

# Review limits for an automatic mask.
MIN_SCORE = 0.7
MIN_MARGIN = 0.015
MAX_BOUNDARY = 0.04

# Strokes one task paints; each touches at most a few hundred pixels.
STROKES = 20_000


def resample(
    mask: DataFrame, source_width: int | str, source_height: int | str, width: int | str, height: int | str
) -> DataFrame:
    """Nearest-neighbour resize of set pixels from one grid to another; sizes may be named columns of ``mask``.

    Each target pixel samples one source pixel. Inverted, a source pixel feeds a
    short run of targets, found by unnesting the only candidates and testing the
    forward rule, so no dense grid is built or joined.
    """
    sx = f"least({source_width} - 1, floor((tx + 5e-1) * {source_width} / {width}))"
    sy = f"least({source_height} - 1, floor((ty + 5e-1) * {source_height} / {height}))"

    def candidates(axis: str, source: int | str, target: int | str) -> Column:
        return F.expr(
            f"sequence(greatest(0, cast(floor({axis} * {target} / {source}) as int) - 1), "
            f"least({target} - 1, cast(ceil(({axis} + 1) * {target} / {source}) as int)))"
        )

    columns = [c for c in mask.columns if c not in ("x", "y")]
    return (
        mask.withColumn("tx", F.explode(candidates("x", source_width, width)))
        .where(F.expr(f"{sx} = x"))
        .withColumn("ty", F.explode(candidates("y", source_height, height)))
        .where(F.expr(f"{sy} = y"))
        .select(*columns, F.col("tx").alias("x"), F.col("ty").alias("y"))
    )


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """Add ``kept``: the (2r+1)-square around the pixel is all set. Outside the image counts as unset.

    Separable: along each row, then the survivors along each column. One
    exchange on the mask serves both windows.
    """
    if radius <= 0:
        return mask.withColumn("kept", F.lit(True))
    side = 2 * radius + 1
    spread = mask.repartition(*MASK)
    row = W.partitionBy(*MASK, "y").orderBy("x").rangeBetween(-radius, radius)
    across = spread.withColumn("_row", (F.count(F.lit(1)).over(row) == side).cast("int"))
    column = W.partitionBy(*MASK, "x").orderBy("y").rangeBetween(-radius, radius)
    return across.withColumn("kept", F.sum("_row").over(column) == side).drop("_row")


def encode_runs(mask: DataFrame, width: Column | int, keys: list[str] = MASK) -> DataFrame:
    """Row-major runs of set pixels: keys, start, len."""
    w = F.lit(width) if isinstance(width, int) else width
    indexed = mask.select(*keys, (F.col("y") * w + F.col("x")).cast("long").alias("i")).distinct()
    island = F.col("i") - F.row_number().over(W.partitionBy(*keys).orderBy("i"))
    return (
        indexed.withColumn("_g", island)
        .groupBy(*keys, "_g")
        .agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("len"))
        .drop("_g")
    )


def decode_runs(runs: DataFrame, width: Column | int, keys: list[str] = MASK) -> DataFrame:
    """Set pixels again: keys, x, y."""
    w = F.lit(width) if isinstance(width, int) else width
    return runs.withColumn(
        "_i", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
    ).select(*keys, (F.col("_i") % w).alias("x"), F.floor(F.col("_i") / w).alias("y"))


def snapshot(runs: DataFrame, width: int, height: int, keys: list[str] = MASK) -> DataFrame:
    """Painted count, flat run list and a 16-hex digest. A mask is bounded by its image."""
    packed = F.array_sort(F.collect_list(F.struct("start", "len")))
    flat = F.flatten(F.transform("_p", lambda p: F.array(p["start"], p["len"])))
    text = F.concat(F.lit(f"{width}x{height}:"), F.array_join(flat, ","))
    return (
        runs.groupBy(*keys)
        .agg(packed.alias("_p"), F.sum("len").alias("painted_pixels"))
        .select(
            *keys,
            "painted_pixels",
            flat.alias("runs"),
            F.substring(F.sha2(text, 256), 1, 16).alias("digest"),
        )
    )


def boundary_fraction(mask: DataFrame, width: int, height: int, keys: list[str] = MASK) -> DataFrame:
    """Share of the image's border pixels that the mask covers."""
    on_edge = F.col("x").isin(0, width - 1) | F.col("y").isin(0, height - 1)
    border = 2 * width + 2 * height - 4
    share = F.count_if(on_edge) / f64(border) if min(width, height) >= 2 else f64(1)
    return mask.groupBy(*keys).agg(share.alias("boundary_fraction"))


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Highest ``score`` (lowest ``idx`` on a tie) and its margin over the next best."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "idx")
    return (
        candidates.withColumn("_next", F.lead("score").over(order))
        .withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") == 1)
        .select(*keys, "idx", "score", (F.col("score") - F.col("_next")).alias("margin"))
    )


def review_issue(
    has_positive: Column, source: Column, score: Column, margin: Column, boundary: Column
) -> Column:
    """Why an automatic mask may not be accepted yet; NULL when it may."""
    return (
        F.when(~has_positive, F.lit("no positive click"))
        .when(source == "model+brush", F.lit(None))
        .when(score < f64(MIN_SCORE), F.lit("low mask confidence"))
        .when(margin < f64(MIN_MARGIN), F.lit("two nearly equal masks"))
        .when(boundary > f64(MAX_BOUNDARY), F.lit("mask reaches too much of the boundary"))
    )


def paint(strokes: DataFrame, width: int, height: int, keys: list[str] = MASK) -> DataFrame:
    """Rasterise brush strokes in order; the last stroke over a pixel decides it.

    ``strokes``: keys, seq, x0, y0, x1, y1, radius, erase. Discs are stamped along
    the segment at most max(1, 0.45 r) apart. Each disc is cut into rows, so a
    candidate list is one row span per step, tested against the disc. Strokes are
    dealt by image before they grow, ``STROKES`` a task whatever the input's size,
    as a task holds every pixel that its strokes touch.
    """
    strokes = strokes.repartition(max(1, -(-strokes.count() // STROKES)), *keys)
    length = F.sqrt(
        (F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0"))
        + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))
    )
    steps = F.greatest(
        F.lit(1), F.ceil(length / F.greatest(f64(1), F.col("radius") * f64(0.45))).cast("int")
    )
    stamped = (
        strokes.withColumn("_steps", steps)
        .withColumn("_t", F.explode(F.expr("sequence(0, _steps)")))
        .withColumn("_t", F.col("_t").cast("double") / F.col("_steps"))
        .withColumn("_cx", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("_t"))
        .withColumn("_cy", F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("_t"))
    )
    span = lambda c, size: F.expr(
        f"sequence(greatest(0, cast(floor({c} - radius) as int)), "
        f"least({size} - 1, cast(ceil({c} + radius) as int)))"
    )
    in_image = (
        (F.col("_cx") + F.col("radius") >= 0)
        & (F.col("_cx") - F.col("radius") <= width - 1)
        & (F.col("_cy") + F.col("radius") >= 0)
        & (F.col("_cy") - F.col("radius") <= height - 1)
    )
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    touched = (
        stamped.where(in_image)
        .withColumn("y", F.explode(span("_cy", height)))
        .where(dy * dy <= F.col("radius") * F.col("radius"))
        .withColumn("x", F.explode(span("_cx", width)))
        .where(dx * dx + dy * dy <= F.col("radius") * F.col("radius"))
    )
    return (
        touched.groupBy(*keys, "x", "y")
        .agg(F.max_by("erase", "seq").alias("_erase"))
        .where(~F.col("_erase"))
        .drop("_erase")
    )
