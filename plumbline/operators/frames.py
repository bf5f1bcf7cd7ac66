"""Frame numbering: even picks, canonical maps, descriptors and nearest frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, half_up

CANONICAL_FRAMES = 256


def even_pick(i: Column, have: Column, want: Column) -> Column:
    """0-based source index of pick ``i`` when ``want`` are spread evenly over ``have``."""
    spread = half_up(i * (have - 1) / F.nullif(want - 1, F.lit(0)).cast("double"))
    return F.when(want <= 1, F.lit(0)).otherwise(spread).cast("long")


def canonical_frames(runs: DataFrame, canonical: int = CANONICAL_FRAMES) -> DataFrame:
    """npz_index -> canonical_index per run: identity once the run is at least as long."""
    i, n = F.col("npz_index"), F.col("frame_count")
    spread = even_pick(i, F.lit(canonical), n) + 1
    return (
        runs.where(F.col("frame_count") > 0)
        .withColumn("npz_index", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
        .withColumn("canonical_index", F.when(n >= canonical, i + 1).otherwise(spread).cast("long"))
    )


def frame_file(index: Column) -> Column:
    """``frame-0001.jpg``: at least four digits. Padding costs a fraction of a formatter call on every frame."""
    digits = index.cast("string")
    return F.concat(F.lit("frame-"), F.when(index < 10000, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(".jpg"))


def last_file(index: Column) -> Column:
    """The last of a group's file names, as text sorts: that of the largest index of each length, in numbers a hash aggregate holds."""
    lengths = [(0 if n == 4 else 10 ** (n - 1), 10**n) for n in range(4, 20 - 1)]
    return F.greatest(*(frame_file(F.max(F.when((index >= low) & (index < high), index))) for low, high in lengths))


def recorded_descriptors(runs: DataFrame, canonical: int = CANONICAL_FRAMES, *keep: str) -> DataFrame:
    """Frame file and timestamp of every stored frame, with the columns of ``keep`` of its run.

    Runs with ``canonical_frames`` share one numbered extraction; the others
    number their own files 1..N.
    """
    numbered = canonical_frames(runs, canonical)
    index = F.when(F.col("canonical_frames"), F.col("canonical_index")).otherwise(F.col("npz_index") + 1)
    fps = F.coalesce(F.col("effective_fps"), F.col("fps"))
    return numbered.select(
        "run_id",
        "npz_index",
        index.cast("long").alias("canonical_index"),
        frame_file(index.cast("long")).alias("file"),
        (F.col("npz_index") / fps).alias("timestamp_s"),
        *keep,
    )


def closest_frames(descriptors: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The stored frame nearest each wanted canonical index; the earlier one wins a tie.

    ``wanted``: run_id, wanted. Without it the descriptors hold ``wanted`` themselves: joined to runs
    before these are unnested, it moves one row a run, not one a frame.
    """
    gap = F.abs(F.col("canonical_index") - F.col("wanted"))
    pick = F.min_by(F.struct("npz_index", "canonical_index"), F.struct(gap, F.col("npz_index")))
    asked = descriptors if wanted is None else descriptors.join(wanted, "run_id")
    return (
        asked.groupBy("run_id", "wanted")
        .agg(pick.alias("b"))
        .select("run_id", "wanted", "b.*")
    )


def ladder(clips: DataFrame) -> DataFrame:
    """Nested even subsets of one extraction. ``clips``: clip_key, extracted, counts array."""
    want, have = F.col("rung"), F.col("extracted")
    return (
        clips.withColumn("rung", F.explode("counts"))
        .where((want <= have) & (want > 0))
        .withColumn("i", F.explode(F.sequence(F.lit(0), (want - 1).cast("int"))))
        .select("clip_key", "rung", "i", even_pick(F.col("i"), have, want).alias("source_index"))
    )


def sample_plan(fps: Column, duration: Column, max_frames: Column) -> tuple[Column, Column, Column]:
    """Frame count, effective rate and whether the cap lowered it."""
    asked = F.greatest(F.lit(1), F.floor(fps * duration)).cast("long")
    capped = asked > max_frames
    count = F.when(capped, max_frames).otherwise(asked).cast("long")
    lowered = F.when(duration > 0, max_frames / F.nullif(duration, f64(0))).otherwise(fps)
    return count, F.when(capped, lowered).otherwise(fps).cast("double"), capped


def scale_plan(width: Column, height: Column, long_edge: int = 1024) -> tuple[Column, Column, Column]:
    """Upload size: long edge limited, even numbers, never enlarged."""
    longest = F.greatest(width, height)
    scaled = (longest > long_edge) & F.lit(long_edge > 0)
    even = lambda n: F.greatest(
        F.lit(2), half_up(n * (f64(long_edge) / longest) / f64(2)) * 2
    )
    fit = lambda n: F.when(scaled, even(n)).otherwise(n).cast("long")
    return fit(width), fit(height), scaled


def display_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column, Column]:
    """Rotation in 0..359 and the size as shown."""
    turned = F.pmod(rotation, F.lit(360))
    sideways = turned % 180 == 90
    return turned, F.when(sideways, height).otherwise(width), F.when(sideways, width).otherwise(height)
