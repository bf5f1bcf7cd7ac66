"""Shared plumbing of the streaming jobs: epoch tables that survive retries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.session import checkpoint_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def epoch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch as its own ``epoch=N`` folder; a retried batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within: the state store that jobs with state of their own need."""
    # The setting's name and the store's class.
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def drain(stream: DataFrame, path: str, output_mode: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give what is there now to ``write``, micro-batch by micro-batch."""
    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def run_available(stream: DataFrame, path: str, output_mode: str) -> StreamingQuery:
    """Drain what is there now into an epoch table."""
    return drain(stream, path, output_mode, epoch_writer(f"{path}/rows"))


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written row per key of an epoch table: later epochs overwrite earlier ones."""
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c not in keys and c != "epoch"]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), "epoch").alias("r"))
        .select(*keys, "r.*")
    )
