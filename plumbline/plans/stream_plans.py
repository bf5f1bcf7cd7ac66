"""Streaming jobs over the event table, drained with AvailableNow, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6
from plumbline.streaming import evidence as SE, phases as SP, runs as SR, telemetry as ST

PEAKS = A.cte("telemetry") + """ SELECT run_id, date_trunc('hour', ts) AS window_start, max(used_bytes) AS peak_bytes, count(*) AS samples
    FROM telemetry GROUP BY ALL"""


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = A.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@plan("telemetry_peaks", "X1 (batch)", PEAKS)
def telemetry_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return publish(ST.peak_windows(A.telemetry(A.table(spark, sf, "events"))))


@plan("telemetry_peaks_stream", "X1", PEAKS)
def telemetry_peaks_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = SR.fresh_folder(spark, "peaks")
    SR.run_available(ST.peak_windows_stream(A.telemetry(event_stream(spark, sf))), folder, "update")
    return publish(SR.latest(spark, folder, ["run_id", "window_start"]))


PHASED = A.cte("telemetry") + """, p AS (SELECT *, CASE WHEN NOT available THEN 'waking' WHEN NOT model_loaded THEN 'loadingModel' ELSE 'inferring' END AS phase FROM telemetry),
    q AS (SELECT *, phase = 'inferring' AND lag(phase, 1, 'waking') OVER (PARTITION BY run_id ORDER BY ts, event_id) <> 'inferring' AS entered FROM p)
    SELECT run_id, event_id, phase, entered, last_value(CASE WHEN entered THEN used_bytes END IGNORE NULLS) OVER (
      PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS floor_bytes"""


@plan("run_phases", "X2 (batch)", f"{PHASED} FROM q")
def run_phases(spark: SparkSession, sf: str) -> DataFrame:
    return publish(ST.phases(A.telemetry(A.table(spark, sf, "events"))).drop("ts"))


#: The month of events arrives in so many parts.
PARTS = 4


def arriving(
    rows: DataFrame, name: str, part: Column, take: Callable[[DataFrame, str], None], parts: int = PARTS
) -> str:
    """Let ``rows`` arrive part by part as new files; ``take`` drains what is there after each. The folder of results."""
    spark = rows.sparkSession
    files, folder = SR.fresh_folder(spark, f"{name}-files"), SR.fresh_folder(spark, name)
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(files)
        take(spark.readStream.schema(rows.schema).parquet(files), folder)
    return folder


@plan("run_phases_stream", "X2", f"{PHASED}, FALSE AS late FROM q")
def run_phases_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same phases as snapshots arrive week by week: each week is a micro-batch that meets the state of the last."""
    week = F.least(F.expr("(day(ts) - 1) div 8"), F.lit(PARTS - 1))
    telemetry = A.telemetry(A.table(spark, sf, "events"))
    with SR.state_store(spark):
        folder = arriving(telemetry, "phases", week, lambda s, f: SR.run_available(SP.phases_stream(s), f, "append"))
    return publish(spark.read.parquet(f"{folder}/rows").drop("epoch"))


@plan(
    "evidence_stream",
    "X3, S12 (stream)",
    """ SELECT event_type || '@' || user_id || '@' || CAST(date_trunc('hour', ts) AS VARCHAR) AS evidence_id, max(event_id) AS event_id,
      round(arg_max(value, event_id) + 1e-9, 6) + 0e0 AS value FROM events GROUP BY ALL""",
)
def evidence_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Packets arriving in several micro-batches with repeats of the same id: the last one sent stays."""
    ident = F.concat_ws("@", "event_type", F.col("user_id").cast("string"), F.date_trunc("hour", F.col("ts")).cast("string"))
    events = A.table(spark, sf, "events").select("event_type", "user_id", "ts", "event_id", "value")
    packets = SR.fresh_folder(spark, "packets")

    def take(stream: DataFrame, folder: str) -> None:
        rows = stream.select(ident.alias("evidence_id"), "event_id", "value")
        SR.drain(rows, folder, "append", SE.table_writer(packets, ["event_id"]))

    # The last part is sent first, so that older packets of an id come late.
    arriving(events, "evidence", F.lit(PARTS - 1) - F.col("event_id") % PARTS, take)
    return publish(SE.kept_packets(spark, packets, ["event_id"]))


SITTINGS = (
    A.cte("targets", "trials")
    + f""", g AS (SELECT *, CASE WHEN captured_at >= lag(captured_at) OVER w + INTERVAL 30 MINUTE OR lag(captured_at) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
         FROM trials WINDOW w AS (PARTITION BY run_id, object_id ORDER BY captured_at, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, object_id ORDER BY captured_at, event_id) AS sid FROM g)
    SELECT run_id, object_id, min(captured_at) AS sitting_start, count(*) AS trials, {r6('min(raw_m)', 'min_m')}, {r6('max(raw_m)', 'max_m')}
    FROM s GROUP BY run_id, object_id, sid"""
)


@plan("sittings", "X4 (batch)", SITTINGS)
def sittings(spark: SparkSession, sf: str) -> DataFrame:
    return publish(SE.sittings(A.trials(spark, sf), ["run_id", "object_id"]))


@plan("sittings_stream", "X4", SITTINGS)
def sittings_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Sittings of trials that arrive week by week; one that runs on over a week's end is merged, not cut.

    After the last week a row later than all sittings moves the watermark on, so that the last ones close.
    """
    trials = A.trials(spark, sf).select("run_id", "object_id", F.col("captured_at").cast("timestamp").alias("captured_at"), "raw_m")
    end = trials.agg(F.max("captured_at").alias("last")).select(
        F.lit(-1).cast("long").alias("run_id"), F.lit("end").alias("object_id"), F.expr("last + INTERVAL 7 DAYS").alias("captured_at"), f64(0).alias("raw_m")
    )
    week = F.when(F.col("run_id") < 0, PARTS).otherwise(F.least(F.expr("(day(captured_at) - 1) div 8"), F.lit(PARTS - 1)))

    def take(stream: DataFrame, folder: str) -> None:
        timed = stream.withWatermark("captured_at", "1 hour")
        SR.run_available(SE.sittings(timed, ["run_id", "object_id"]), folder, "append")

    folder = arriving(trials.unionByName(end), "sittings", week, take, PARTS + 1)
    closed = spark.read.parquet(f"{folder}/rows").drop("epoch").where(F.col("run_id") >= 0)
    return publish(closed.withColumn("sitting_start", F.col("sitting_start").cast("timestamp_ntz")))


@plan(
    "stream_reservoir",
    "X5, C13",
    """ SELECT event_type, least(count(*), 500) AS kept FROM events GROUP BY ALL""",
)
def stream_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """A bounded uniform sample of a stream, carried from epoch to epoch."""
    folder = SR.fresh_folder(spark, "reservoir")
    stream = event_stream(spark, sf).select("event_type", "event_id", "value")
    query = (
        stream.writeStream.option("checkpointLocation", f"{folder}/_progress")
        .trigger(availableNow=True)
        .foreachBatch(SE.reservoir_writer(f"{folder}/rows", ["event_type"], ["event_id"], 500, 7))
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    last = rows.agg(F.max("epoch").alias("epoch"))
    kept = rows.join(last, "epoch", "left_semi")
    return publish(kept.groupBy("event_type").agg(F.count_distinct("event_id").alias("kept")))
