"""Object heights from masked points: robust percentiles, end bands, rulers.

A measurement group is one mask on one frame, so it is bounded by the image and
plain grouped percentiles fit. Points are exchanged once on the group key and
every aggregate and join below reuses that placement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite
from plumbline.functions.vectors import (
    Plane,
    Vec,
    distance,
    dot,
    minus,
    plane,
    plus,
    scaled,
    signed_height,
    vec,
)
from plumbline.operators.ranks import NMAD_SCALE, nearest_rank
from plumbline.session import cut_lineage

OBJECT = ["run_id", "object_id", "frame"]
END_BAND = 0.05


def grouped_percentile(column: str, p: float) -> Column:
    """Nearest-rank percentile as a grouped aggregate; NULLs are skipped."""
    return F.expr(f"percentile_disc({float(p)}d / 100d) within group (order by {column})")


def object_heights(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Finite heights of masked points over their run's plane, placed by object.

    Written once: every measurement below reads these few points several times,
    and the frames, masks and plane behind them are costly to derive again.
    """
    normals = planes.select("run_id", "nx", "ny", "nz", "d")
    return cut_lineage(
        points.join(normals, "run_id")
        .withColumn("h", signed_height(plane(), vec("x", "y", "z")))
        .where(finite(F.col("h")))
        .drop("nx", "ny", "nz", "d")
        .repartition(*OBJECT)
    )


def at_rank(ordered: Column, p: float) -> Column:
    """Nearest-rank percentile of an ordered array; NULL when it is empty."""
    return F.get(ordered, nearest_rank(F.size(ordered), p).cast("int") - 1)


def _packed(heights: DataFrame) -> DataFrame:
    """One row per object with its heights in order.

    A mask on one frame is bounded by the image, so the steps below read one array instead of
    joining the points to themselves: each such join would pin two sort buffers in the same task.
    """
    return heights.groupBy(*OBJECT).agg(
        F.count(F.lit(1)).alias("point_count"), F.sort_array(F.collect_list("h")).alias("_h")
    )


def _with_roughness(rows: DataFrame, column: str, out: str, band: float) -> DataFrame:
    """NMAD of the heights within ``band`` of one end, and their count; NULL below three points."""
    end = F.col(column)
    near = F.filter("_h", lambda h: (h >= end - f64(band)) & (h <= end + f64(band)))
    apart = F.sort_array(F.transform("_near", lambda h: F.abs(h - F.col("_mid"))))
    return (
        rows.withColumn("_near", near)
        .withColumn("_mid", at_rank(F.col("_near"), 50))
        .withColumn("_dev", apart)
        .withColumn(f"{out}_count", F.size("_near").cast("long"))
        .withColumn(out, F.when(F.col(f"{out}_count") >= 3, f64(NMAD_SCALE) * at_rank(F.col("_dev"), 50)))
        .drop("_near", "_mid", "_dev")
    )


def measure_height(
    heights: DataFrame,
    percentile: float = 98.0,
    min_points: int = 200,
    top_band: float = END_BAND,
    plane_rmse: DataFrame | None = None,
) -> DataFrame:
    """Top above the floor per object, or ``status = 'refused'`` when too sparse."""
    tops = _packed(heights).select(
        "*", at_rank(F.col("_h"), percentile).alias("top"), F.array_max("_h").alias("max_height")
    )
    joined = _with_roughness(tops, "top", "top_roughness", top_band)
    if plane_rmse is not None:
        joined = joined.join(plane_rmse.select("run_id", F.col("rmse").alias("_rmse")), "run_id", "left")
    else:
        joined = joined.withColumn("_rmse", f64(0))
    r, e = F.coalesce(F.col("top_roughness"), f64(0)), F.coalesce(F.col("_rmse"), f64(0))
    ok = F.col("point_count") >= min_points
    only = lambda c: F.when(ok, c)
    return joined.select(
        *OBJECT,
        F.when(ok, F.lit("ok")).otherwise(F.lit("refused")).alias("status"),
        "point_count",
        only(F.col("top")).alias("height"),
        only(F.sqrt(r * r + e * e)).alias("uncertainty"),
        only(F.col("top_roughness")).alias("top_roughness"),
        only(F.col("top_roughness_count")).alias("top_band_count"),
        only(F.col("max_height")).alias("max_height"),
    )


def vertical_extent(
    heights: DataFrame,
    lower: float = 2.0,
    upper: float = 98.0,
    min_points: int = 200,
    end_band: float = END_BAND,
) -> DataFrame:
    """p98 minus p2 of height per object with the roughness of both ends."""
    if not lower < upper:
        raise ValueError("lower percentile must be below upper percentile")
    ends = _packed(heights).select(
        "*",
        at_rank(F.col("_h"), lower).alias("bottom"),
        at_rank(F.col("_h"), upper).alias("top"),
        F.array_min("_h").alias("min_height"),
        F.array_max("_h").alias("max_height"),
    )
    joined = _with_roughness(ends, "bottom", "bottom_roughness", end_band)
    joined = _with_roughness(joined, "top", "top_roughness", end_band)
    b, t = (F.coalesce(F.col(f"{end}_roughness"), f64(0)) for end in ("bottom", "top"))
    ok = F.col("point_count") >= min_points
    only = lambda c: F.when(ok, c)
    return joined.select(
        *OBJECT,
        F.when(ok, F.lit("ok")).otherwise(F.lit("refused")).alias("status"),
        "point_count",
        only(F.col("top") - F.col("bottom")).alias("height"),
        only(F.sqrt(b * b + t * t)).alias("uncertainty"),
        only(F.col("bottom")).alias("bottom"),
        only(F.col("top")).alias("top"),
        only(b).alias("bottom_roughness"),
        only(t).alias("top_roughness"),
        only(F.col("min_height")).alias("min_height"),
        only(F.col("max_height")).alias("max_height"),
    )


def endpoint_evidence(
    heights: DataFrame, tail_fraction: float = 0.1, min_per_end: int = 40
) -> DataFrame:
    """Equal numbers of lowest and highest points per object; objects too thin give none."""
    if not 0 < tail_fraction <= 0.25:
        raise ValueError("tail_fraction must be in (0, 0.25]")
    order = W.partitionBy(*OBJECT).orderBy("h", "y", "x", "z")
    n = F.col("_n")
    each = F.least(
        F.floor(n / f64(2)), F.greatest(F.lit(min_per_end), F.floor(n * f64(tail_fraction)))
    )
    return (
        heights.withColumn("_at", F.row_number().over(order))
        .withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*OBJECT)))
        .where(n >= 2 * min_per_end)
        .withColumn("points_per_end", each.cast("long"))
        .where(
            (F.col("_at") <= F.col("points_per_end")) | (F.col("_at") > n - F.col("points_per_end"))
        )
        .drop("_at", "_n")
    )


def band_centroids(
    heights: DataFrame, wanted: DataFrame, columns: Sequence[str], band: float = END_BAND
) -> DataFrame:
    """Per wanted height: the mean of the points within ``band`` of it, else the single nearest point."""
    joined = heights.join(wanted.select(*OBJECT, *columns), OBJECT)
    found, named = [], []
    for column in columns:
        gap = F.abs(F.col("h") - F.col(column))
        near = gap <= f64(band)
        found += [F.avg(F.when(near, F.col(c))).alias(f"_{column}_{c}") for c in "xyz"]
        found += [F.min_by(F.struct("x", "y", "z"), F.struct(gap, "x", "y", "z")).alias(f"_{column}")]
        found += [F.first(column).alias(column)]
        named += [column, *(F.coalesce(f"_{column}_{c}", F.col(f"_{column}.{c}")).alias(f"{column}_{c}") for c in "xyz")]
    return joined.groupBy(*OBJECT).agg(*found).select(*OBJECT, *named)


def ruler_points(anchor: Vec, p: Plane, bottom: Column, top: Column) -> tuple[Vec, Vec]:
    """A vertical ruler through the anchor, from one height to the other."""
    base = minus(anchor, scaled(p.normal, signed_height(p, anchor)))
    return plus(base, scaled(p.normal, bottom)), plus(base, scaled(p.normal, top))


def endpoint_geometry(heights: DataFrame, extents: DataFrame, planes: DataFrame) -> DataFrame:
    """End centroids, their distance and sideways offset, and the ruler between them."""
    ends = extents.where(F.col("status") == "ok")
    joined = band_centroids(heights, ends, ("bottom", "top")).join(
        planes.select("run_id", "nx", "ny", "nz", "d"), "run_id"
    )
    b = vec("bottom_x", "bottom_y", "bottom_z")
    t = vec("top_x", "top_y", "top_z")
    delta = minus(t, b)
    along = dot(delta, vec("nx", "ny", "nz"))
    apart = distance(t, b)
    anchor = scaled(plus(b, t), f64(0.5))
    low, high = ruler_points(anchor, plane(), F.col("bottom"), F.col("top"))
    return joined.select(
        *OBJECT,
        *(F.col(f"{end}_{c}") for end in ("bottom", "top") for c in "xyz"),
        apart.alias("centroid_distance"),
        F.sqrt(F.greatest(f64(0), dot(delta, delta) - along * along)).alias("lateral_offset"),
        *(part.alias(f"ruler_bottom_{c}") for part, c in zip(low, "xyz")),
        *(part.alias(f"ruler_top_{c}") for part, c in zip(high, "xyz")),
        distance(b, low).alias("bottom_ruler_offset"),
        distance(t, high).alias("top_ruler_offset"),
    )


def end_depths(heights: DataFrame, extents: DataFrame, band: float = END_BAND) -> DataFrame:
    """Camera depth of the points near each end: median and p90 minus p10."""
    joined = heights.join(extents.where(F.col("status") == "ok").select(*OBJECT, "bottom", "top"), OBJECT)
    for end in ("bottom", "top"):
        joined = joined.withColumn(
            f"_{end}", F.when(F.abs(F.col("h") - F.col(end)) <= f64(band), F.col("depth"))
        )
    spread = lambda c: grouped_percentile(c, 90) - grouped_percentile(c, 10)
    return joined.groupBy(*OBJECT).agg(
        grouped_percentile("_bottom", 50).alias("bottom_depth"),
        spread("_bottom").alias("bottom_depth_spread"),
        grouped_percentile("_top", 50).alias("top_depth"),
        spread("_top").alias("top_depth_spread"),
    )


def measure_objects(
    points: DataFrame,
    planes: DataFrame,
    provenance: DataFrame,
    lower: float = 2.0,
    upper: float = 98.0,
    min_points: int = 80,
    min_per_end: int = 40,
) -> DataFrame:
    """The measurement job: both definitions with ruler and details, and the rules for automatic masks.

    ``provenance``: run_id, object_id, frame, mode, automatic, accepted, occluded.
    An automatic mask that was not accepted, or whose base is hidden, is withheld.
    An automatic extent is taken from its balanced ends, and the full mask rides
    along as a control. The ruler of an extent stands between the centroids of its
    ends; that of a height stands on the floor below the centroid of the top.
    Columns that a mode does not have are NULL.
    """
    withheld = (
        F.when(F.col("automatic") & ~F.col("accepted"), F.lit("withheld: mask not accepted"))
        .when(F.col("automatic") & F.col("occluded"), F.lit("withheld: base is occluded"))
    )
    extent = F.col("mode") == "vertical_extent"
    balanced = extent & F.col("automatic")
    point = F.struct("h", "y", "x", "z")
    masks = object_heights(points, planes).groupBy(*OBJECT).agg(F.sort_array(F.collect_list(point)).alias("_all"))
    n = F.size("_all")
    each = F.least(
        F.floor(n / f64(2)), F.greatest(F.lit(min_per_end), F.floor(n * f64(0.1)))
    ).cast("int")
    tails = F.concat(F.slice("_all", 1, F.col("_each")), F.slice("_all", n - F.col("_each") + 1, F.col("_each")))
    used = F.when(balanced, F.when(n >= 2 * min_per_end, tails)).when(
        extent | (F.col("mode") == "top_above_floor"), F.col("_all")
    )
    # A mask is bounded by the image, so a row holds its points and nothing is joined to itself.
    rows = (
        provenance.withColumn("_withheld", withheld)
        .join(masks, OBJECT, "left")
        .withColumn("_each", each)
        .withColumn("_used", F.when(F.col("_withheld").isNull(), used))
        .withColumn("_h", F.transform("_used", lambda p: p["h"]))
        .withColumn("point_count", F.when(F.col("_used").isNotNull(), F.size("_used").cast("long")))
        .withColumn("_ok", F.coalesce(F.col("point_count") >= min_points, F.lit(False)))
        .withColumn("bottom", at_rank(F.col("_h"), lower))
        .withColumn("top", at_rank(F.col("_h"), upper))
    )
    for end in ("bottom", "top"):
        rows = _with_roughness(rows, end, f"{end}_roughness", END_BAND)
        rows = _with_centre(rows, end, END_BAND)
    floor_rmse = F.col("rmse") if "rmse" in planes.columns else F.lit(None).cast("double")
    placed = rows.join(planes.select("run_id", "nx", "ny", "nz", "d", floor_rmse.alias("_rmse")), "run_id", "left")
    b, t = (vec(*(f"{end}_{c}" for c in "xyz")) for end in ("bottom", "top"))
    stands = Vec(*(F.when(extent, f64(0.5) * (lo + hi)).otherwise(hi) for lo, hi in zip(b, t)))
    height = F.when(extent, F.col("top") - F.col("bottom")).otherwise(F.col("top"))
    low, high = ruler_points(stands, plane(), F.when(extent, F.col("bottom")).otherwise(f64(0)), F.col("top"))
    zero = lambda c: F.coalesce(F.col(c), f64(0))
    under = F.when(extent, zero("bottom_roughness")).otherwise(zero("_rmse"))
    heights = F.transform("_all", lambda p: p["h"])
    control = F.when(
        balanced & F.col("_withheld").isNull() & (n >= min_points), at_rank(heights, upper) - at_rank(heights, lower)
    )
    only = lambda c: F.when(F.col("_ok"), c)
    status = F.coalesce("_withheld", F.when(F.col("_ok"), F.lit("ok")), F.lit("refused"))
    thin = balanced & F.col("_used").isNotNull()
    return placed.select(
        *OBJECT,
        "mode",
        status.alias("status"),
        only(height).alias("raw_m"),
        only(F.sqrt(under * under + zero("top_roughness") * zero("top_roughness"))).alias("internal_spread_m"),
        "point_count",
        only(F.when(extent, F.col("bottom")).otherwise(f64(0))).alias("bottom_m"),
        only(F.col("top")).alias("top_m"),
        only(F.when(extent, zero("bottom_roughness"))).alias("bottom_roughness_m"),
        only(F.when(extent, zero("top_roughness")).otherwise(F.col("top_roughness"))).alias("top_roughness_m"),
        only(F.when(~extent, F.col("_rmse"))).alias("floor_rmse_m"),
        only(F.when(~extent, F.array_max("_h"))).alias("max_height_m"),
        only(F.when(extent, F.lit("extent")).otherwise(F.lit("floor_height"))).alias("ruler_kind"),
        *(only(part).alias(n) for part, n in zip((*low, *high), RULER)),
        F.when(thin, F.col("point_count")).alias("endpoint_points"),
        F.when(thin, F.col("_each").cast("long")).alias("points_per_end"),
        control.alias("control_m"),
        (only(height) - control).alias("adapter_delta_m"),
    )


RULER = [f"ruler_{end}_{c}" for end in ("bottom", "top") for c in "xyz"]


def _with_centre(rows: DataFrame, column: str, band: float) -> DataFrame:
    """Mean of the packed points within ``band`` of a height, else the single nearest point."""
    gap = lambda p: F.abs(p["h"] - F.col(column))
    nearest = F.array_min(
        F.transform("_used", lambda p: F.struct(gap(p).alias("g"), *(p[c].alias(c) for c in "xyz")))
    )
    rows = rows.withColumn("_near", F.filter("_used", lambda p: gap(p) <= f64(band))).withColumn("_one", nearest)
    for c in "xyz":
        total = F.aggregate(F.col("_near")[c], f64(0), lambda so_far, v: so_far + v)
        mean = F.when(F.size("_near") > 0, total / F.size("_near"))
        rows = rows.withColumn(f"{column}_{c}", F.coalesce(mean, F.col("_one")[c]))
    return rows.drop("_near", "_one")


def nearest_level_cloud(options: DataFrame, keys: list[str]) -> DataFrame:
    """The cloud whose floor support is nearest the recorded one; the first listed wins a tie.

    ``options``: keys, cloud, ord, support, recorded.
    """
    gap = F.coalesce(F.abs(F.col("support") - F.col("recorded")), f64(float("inf")))
    return options.groupBy(*keys).agg(F.min_by("cloud", F.struct(gap, F.col("ord"))).alias("cloud"))
