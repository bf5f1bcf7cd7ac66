"""Evidence packets: scan, validate, store once, archive instead of deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.session import cut_lineage
from plumbline.sources import versions


def packet_id(observation: str = "observation") -> Column:
    """Stable id of a recorded trial; a missing part prints as nothing."""
    part = lambda name: F.coalesce(F.col(f"{observation}.{name}"), F.lit(""))
    return F.concat_ws(
        "@",
        part("id"),
        part("sittingId"),
        part("capturedAt"),
        F.coalesce(F.col(f"{observation}.mask.digest"), F.lit("no-mask")),
    )


def parse_packets(texts: DataFrame, text: str, *carry: str) -> DataFrame:
    """Packets held as text: parsed once (see ``manifests.parse_manifests``), broken ones dropped, each with its computed id."""
    parsed = texts.select(*carry, F.inline(F.array(F.from_json(text, schemas.PACKET))))
    return parsed.where(F.col("observation.id").isNotNull()).withColumn("evidenceId", packet_id())


def read_packets(spark: SparkSession, *directories: str) -> DataFrame:
    """Every readable packet of the directories, first directory first, one row per id.

    The directory order and then the file name decide which copy of a repeated id
    stays. A broken file is skipped and hides nothing else.
    """
    schema = f"{schemas.PACKET}, _bad string"
    tables = []
    for rank, directory in enumerate(directories):
        rows = (
            spark.read.schema(schema)
            .option("multiLine", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad")
            .json(directory)
            .withColumn("_rank", F.struct(F.lit(rank).alias("d"), F.col("_metadata.file_name").alias("f")))
        )
        tables.append(rows.where(F.col("_bad").isNull()).drop("_bad"))
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    named = every.where(F.col("observation.id").isNotNull()).withColumn("evidenceId", packet_id())
    return first_per_id(named, "_rank")


def first_per_id(packets: DataFrame, order: str) -> DataFrame:
    """One packet per id, the lowest by ``order``: a mergeable aggregate, not a window."""
    columns = [c for c in packets.columns if c not in ("evidenceId", order)]
    return (
        packets.groupBy("evidenceId")
        .agg(F.min_by(F.struct(*columns), order).alias("p"))
        .select("evidenceId", "p.*")
    )


def packet_fault(run: Column) -> Column:
    """Why a packet may not be stored under ``run``; NULL when it may."""
    o = "observation"
    return (
        F.when(
            ~(F.col("runId").eqNullSafe(run) & F.col(f"{o}.runId").eqNullSafe(run)),
            F.lit("run id does not match"),
        )
        .when(F.coalesce(F.col(f"{o}.id"), F.lit("")) == "", F.lit("no observation id"))
        .when(F.col(f"{o}.mask.runs").isNull(), F.lit("no frozen mask"))
        .when(
            F.col("evidenceId").isNotNull() & (F.col("evidenceId") != packet_id()),
            F.lit("identity does not match the recorded trial"),
        )
    )


def recovered_ruler(packets: DataFrame) -> DataFrame:
    """Lift the ruler from where older packets kept it; never recompute one."""
    held = F.col("observation.ruler").isNull() & F.col("live.measurement.ruler").isNotNull()
    lifted = (
        F.col("observation")
        .withField("ruler", F.col("live.measurement.ruler"))
        .withField("rulerKind", F.col("live.measurement.rulerKind"))
    )
    return packets.withColumn("observation", F.when(held, lifted).otherwise(F.col("observation")))


#: Order of the packets of one id: by the time they were stored; without a time before all with one.
_BY_TIME = [F.try_to_timestamp, lambda c: c]


def store_packets(
    packets: DataFrame,
    path: str,
    runs: DataFrame | None = None,
    stamp: Column | None = None,
    token: str | None = None,
) -> DataFrame:
    """Add valid packets to the store as one version; returns the refused ones (evidenceId, runId, fault).

    ``runs`` (run_id, clip_name, clip_sha256, builtin) is the registry: packets of other runs are refused and
    the others carry their run's record as ``storage``. ``stamp`` is the ``storedAt`` they get; without it they
    keep their own. Readers see the version when all of it is written. A packet that was sent again replaces
    the stored one unless it is older. Storing a batch again changes nothing that is read; with a ``token``
    that was stored before it is not even written.
    """
    spark = packets.sparkSession
    fault = packet_fault(F.col("runId"))
    rows = packets
    if runs is not None:
        record = F.struct(F.col("run_id").alias("runId"), *[F.col(c) for c in RECORD]).alias("storage")
        rows = rows.join(runs.select(F.col("run_id").alias("runId"), record), "runId", "left")
        fault = F.coalesce(fault, F.when(F.col("storage").isNull(), F.lit("no such run")))
    else:
        rows = rows.withColumn("storage", F.lit(None).cast(STORAGE))
    faulted = cut_lineage(rows.withColumn("fault", fault))
    good = faulted.where(F.col("fault").isNull()).drop("fault").withColumn("evidenceId", packet_id())
    if stamp is not None:
        good = good.withColumn("storedAt", stamp)
    versions.append(good.withColumn("archive", F.lit(None).cast(ARCHIVE)), path, token)
    return faulted.where(F.col("fault").isNotNull()).select("evidenceId", "runId", "fault")


#: What of a run is kept beside its packets, and what an archived packet says of its going.
RECORD = ("clip_name", "clip_sha256", "builtin")
STORAGE = "struct<runId:string,clip_name:string,clip_sha256:string,builtin:boolean>"
ARCHIVE = "struct<seq:bigint,reason:string,at:string>"


def _states(spark: SparkSession, path: str, version: int | None) -> DataFrame | None:
    """For each id the version it was archived in last (0: never) beside all its rows."""
    rows = versions.read(spark, path, version)
    if rows is None:
        return None
    gone = rows.where(F.col("archive").isNotNull()).groupBy("evidenceId").agg(F.max("_version").alias("_gone"))
    return rows.join(gone, "evidenceId", "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))


def live_packets(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The packets a store holds: of each id the latest that came after its last archiving."""
    rows = _states(spark, path, version)
    if rows is None:
        return spark.createDataFrame([], f"{schemas.PACKET}, storage {STORAGE}, archive {ARCHIVE}")
    after = rows.where(F.col("archive").isNull() & (F.col("_version") > F.col("_gone"))).drop("_gone")
    times = [f(F.col("storedAt")) for f in _BY_TIME]
    return versions.newest(after, ["runId", "evidenceId"], times).drop("_version")


def archived_packets(spark: SparkSession, path: str) -> DataFrame:
    """Every archiving of a packet, as it was then; nothing there is ever overwritten."""
    rows = versions.read(spark, path)
    return rows.where(F.col("archive").isNotNull()).drop("_version")


def archive_packets(spark: SparkSession, path: str, reason: str, at: Column, **filters: DataFrame) -> DataFrame:
    """Take packets out of what is read, as one version; returns their ids. ``filters`` as in ``archive_split``.

    The packet and the note of its archiving become visible in one commit, so it is never in neither place.
    """
    before = versions.read(spark, path)
    taken = before.where(F.col("archive").isNotNull()).select("evidenceId")
    moved, _ = archive_split(live_packets(spark, path), taken, reason, at, **filters)
    note = F.struct(F.col("archive_seq").alias("seq"), F.col("archived_reason").alias("reason"), F.col("archived_at").cast("string").alias("at"))
    moved = cut_lineage(moved.withColumn("archive", note).drop("archive_seq", "archived_reason", "archived_at"))
    versions.append(moved, path)
    return moved.select("evidenceId")


def compact_packets(spark: SparkSession, path: str) -> int:
    """Write the newest version again as one batch: live packets and every archiving. The version's number."""
    rows = _states(spark, path, None)
    after = rows.where(F.col("archive").isNull() & (F.col("_version") > F.col("_gone")))
    kept = versions.newest(after, ["runId", "evidenceId"], [f(F.col("storedAt")) for f in _BY_TIME])
    both = kept.unionByName(rows.where(F.col("archive").isNotNull())).drop("_gone")
    return versions.compact(spark, path, both)


def archive_split(
    packets: DataFrame,
    archived: DataFrame,
    reason: str,
    at: Column,
    evidence_ids: DataFrame | None = None,
    object_ids: DataFrame | None = None,
    runs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(newly archived, still live). With several filters a packet must match each.

    Two archives of one id are two events: the new one is numbered after those
    already there, nothing is overwritten.
    """
    chosen = packets
    if runs is not None:
        chosen = chosen.join(runs.select(F.col("run_id").alias("runId")), "runId", "left_semi")
    if evidence_ids is not None:
        chosen = chosen.join(evidence_ids.select("evidenceId"), "evidenceId", "left_semi")
    if object_ids is not None:
        wanted = object_ids.select(F.col("object_id").alias("_object"))
        chosen = chosen.join(wanted, F.col("observation.objectId") == F.col("_object"), "left_semi")
    taken = archived.groupBy("evidenceId").agg(F.count(F.lit(1)).alias("_taken"))
    moved = (
        chosen.join(taken, "evidenceId", "left")
        .withColumn("archive_seq", F.coalesce("_taken", F.lit(0)) + 1)
        .drop("_taken")
        .withColumn("archived_reason", F.lit(reason))
        .withColumn("archived_at", at)
    )
    return moved, packets.join(moved.select("evidenceId"), "evidenceId", "left_anti")
