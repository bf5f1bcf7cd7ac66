"""A table kept as versions: rows go to files of new names, then one small commit file makes them visible.

A reader takes the newest commit and reads exactly the batches it lists, so it sees a whole version whatever
is being written beside it. A job that is lost before its commit leaves files that nothing lists. Batches
are merged when they are read; ``compact`` writes them again as one. One writer at a time: a version that is
there already is never written again, so a second writer fails instead of hiding the first one's rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, token string, batches array<string>"
#: From so many batches on a version is worth writing again as one.
MANY = 32


def commits(spark: SparkSession, path: str) -> DataFrame:
    """version, token and batches of every commit; no rows where nothing was ever committed."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str]]:
    """Number and batches of the newest version, or of the one asked for; 0 and none before the first."""
    known = commits(spark, path)
    if version is not None:
        known = known.where(F.col("version") == version)
    newest = known.orderBy(F.desc("version")).limit(1).collect()
    return (newest[0].version, list(newest[0].batches)) if newest else (0, [])


def write_batch(rows: DataFrame, path: str, version: int, by: str | None = None) -> str:
    """The rows under a new name, with their version as ``_version``; nobody sees them before ``commit``."""
    name = f"{version:08d}-{uuid.uuid4().hex}"
    writer = rows.withColumn("_version", F.lit(version).cast("long")).write
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/data/{name}")
    return name


def commit(spark: SparkSession, path: str, version: int, token: str, batches: list[str]) -> None:
    """One file, moved into place when it is whole. Fails if the version is there already."""
    row = spark.createDataFrame([(version, token, batches)], COMMIT)
    row.coalesce(1).write.mode("error").json(f"{path}/commits/{version:08d}")


def append(rows: DataFrame, path: str, token: str | None = None, by: str | None = None) -> int:
    """Add a batch; the version that holds it. A batch whose ``token`` was committed before is not written again."""
    spark = rows.sparkSession
    if token is not None:
        done = commits(spark, path).where(F.col("token") == token).limit(1).collect()
        if done:
            return done[0].version
    version, batches = current(spark, path)
    name = write_batch(rows, path, version + 1, by)
    commit(spark, path, version + 1, token or uuid.uuid4().hex, [*batches, name])
    return version + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All rows of a version's batches with ``_version``, in any order; None if it has no batch."""
    _, batches = current(spark, path, version)
    found = None
    for name in batches:
        rows = spark.read.parquet(f"{path}/data/{name}")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def newest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last by ``order``, then by version, then by all columns. A mergeable aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.struct(*order, F.col("_version"), F.to_json(F.struct(*[c for c in rest if c != "_version"])))
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def compact(spark: SparkSession, path: str, kept: DataFrame, by: str | None = None) -> int:
    """A version of one batch, ``kept``: what is to stay of the newest version, keeping each row's ``_version``."""
    version, _ = current(spark, path)
    name = f"{version + 1:08d}-{uuid.uuid4().hex}"
    (kept.write.partitionBy(by) if by else kept.write).parquet(f"{path}/data/{name}")
    commit(spark, path, version + 1, uuid.uuid4().hex, [name])
    return version + 1
