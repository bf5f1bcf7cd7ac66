"""Evidence arriving in micro-batches, live sittings, and a bounded sample of a point stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ranks import uniform_sample
from plumbline.sources import versions


def table_writer(path: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that adds each micro-batch to a versioned table; a retried batch is added once.

    The stream itself keeps no state, however many ids pass: which packet of an id counts is decided when
    the table is read, so a repeat replaces the one before however late it comes. From time to time the
    table is written again without the packets that were replaced.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            versions.append(batch, path, token=f"epoch-{epoch}")
        spark = batch.sparkSession
        if len(versions.current(spark, path)[1]) >= versions.MANY:
            rows = versions.read(spark, path)
            versions.compact(spark, path, versions.newest(rows, ["evidence_id"], [F.col(c) for c in order]))

    return write


def kept_packets(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """The packet each evidence id has now: the last by ``order`` of all that came."""
    rows = versions.read(spark, path)
    return versions.newest(rows, ["evidence_id"], [F.col(c) for c in order]).drop("_version")


def sittings(trials: DataFrame, keys: Sequence[str], gap: str = "30 minutes") -> DataFrame:
    """Sessions of repeat trials where no sitting id was recorded; batch or stream.

    On a stream give ``captured_at`` a watermark: a sitting that micro-batches have cut is merged in the state
    and comes out once, when the watermark has passed its end.
    """
    return (
        trials.groupBy(*keys, F.session_window("captured_at", gap).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("trials"),
            F.min("raw_m").alias("min_m"),
            F.max("raw_m").alias("max_m"),
        )
        .select(*keys, F.col("w.start").alias("sitting_start"), "trials", "min_m", "max_m")
    )


def reservoir_writer(
    path: str, keys: Sequence[str], identity: Sequence[str], keep: int, seed: int
) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that keeps a uniform sample of everything seen so far.

    The sample is the lowest seeded hashes, so merging the last kept rows with a
    new batch gives the sample of the whole. Each epoch is its own folder: a
    retried batch rewrites itself from the epoch before.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch
        if epoch > 0:
            rows = batch.sparkSession.read.parquet(f"{path}/epoch={epoch - 1}").unionByName(batch)
        uniform_sample(rows, keys, identity, keep, seed).write.mode("overwrite").parquet(
            f"{path}/epoch={epoch}"
        )

    return write
