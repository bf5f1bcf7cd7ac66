"""Memory telemetry: windowed high-water marks and the run phase machine over stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def peak_windows(telemetry: DataFrame, every: str = "1 hour") -> DataFrame:
    """High-water mark per run and window; the same plan in batch and in a stream."""
    return (
        telemetry.groupBy("run_id", F.window("ts", every).alias("w"))
        .agg(F.max("used_bytes").alias("peak_bytes"), F.count(F.lit(1)).alias("samples"))
        .select("run_id", F.col("w.start").alias("window_start"), "peak_bytes", "samples")
    )


def peak_windows_stream(telemetry: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """As ``peak_windows`` with a watermark, so state of closed windows is dropped.

    Event time must be an instant, so a zone-less ``ts`` is read in the session's zone.
    """
    instants = telemetry.withColumn("ts", F.col("ts").cast("timestamp"))
    peaks = peak_windows(instants.withWatermark("ts", late), every)
    return peaks.withColumn("window_start", F.col("window_start").cast(telemetry.schema["ts"].dataType))


def phase(available: Column, model_loaded: Column) -> Column:
    return (
        F.when(~F.coalesce(available, F.lit(False)), F.lit("waking"))
        .when(~F.coalesce(model_loaded, F.lit(False)), F.lit("loadingModel"))
        .otherwise(F.lit("inferring"))
    )


def phases(telemetry: DataFrame) -> DataFrame:
    """Phase of every snapshot and the memory floor captured on entering inference.

    Snapshots are ordered by ts then event_id. Each hour of a run is sorted on its
    own; what it needs from before (the last phase, the last floor) is carried over
    as one row per hour.
    """
    order = ["ts", "event_id"]
    rows = telemetry.withColumn("_hour", F.date_trunc("hour", F.col("ts"))).withColumn(
        "phase", phase(F.col("available"), F.col("model_loaded"))
    )
    inside = W.partitionBy("run_id", "_hour").orderBy(*order)
    hours = W.partitionBy("run_id").orderBy("_hour")
    ends = rows.groupBy("run_id", "_hour").agg(F.max_by("phase", F.struct(*order)).alias("_end"))
    before = ends.select("run_id", "_hour", F.lag("_end").over(hours).alias("_before"))
    previous = F.coalesce(F.lag("phase").over(inside), F.col("_before"), F.lit("waking"))
    marked = (
        rows.join(before, ["run_id", "_hour"])
        .withColumn("_previous", previous)
        .withColumn("entered", (F.col("phase") == "inferring") & (F.col("_previous") != "inferring"))
        .withColumn("_floor", F.when(F.col("entered"), F.col("used_bytes")))
    )
    floors = marked.groupBy("run_id", "_hour").agg(
        F.max_by("_floor", F.when(F.col("entered"), F.struct(*order))).alias("_last_floor")
    )
    earlier = hours.rowsBetween(W.unboundedPreceding, -1)
    carried = floors.select(
        "run_id", "_hour", F.last("_last_floor", ignorenulls=True).over(earlier).alias("_carried")
    )
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.last("_floor", ignorenulls=True).over(upto)
    return (
        marked.withColumn("_here", here)
        .join(carried, ["run_id", "_hour"])
        .select(
            "run_id",
            "event_id",
            "ts",
            "phase",
            "entered",
            F.coalesce("_here", "_carried").alias("floor_bytes"),
        )
    )
