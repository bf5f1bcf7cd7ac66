"""Files as tables: run catalogue, frame folders, artifact audits, clip identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How each artifact kind must begin (hex), and the smallest sound cloud.
MAGIC_HEX = {"glb": "676C5446", "npz": "504B0304", "png": "89504E47", "ply": "706C790A"}
MIN_VERTICES = 1000


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, folder, name, length and time of every file; the content column is pruned."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            "path",
            F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
            F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
            "length",
            F.col("modificationTime").alias("modified_at"),
        )
    )


def frame_files(files: DataFrame) -> DataFrame:
    """JPEG frames with the number in their name; ordered by it, not by the text."""
    number = F.regexp_extract("name", r"(\d+)", 1)
    return (
        files.where(F.lower("name").rlike(r"\.jpe?g$") & (number != ""))
        .withColumn("index", number.cast("long"))
        .orderBy("folder", "index")
    )


def choose_frame_folder(folders: DataFrame, manifests: DataFrame) -> DataFrame:
    """The first candidate folder of each run that holds as many frames as its manifest says.

    ``folders``: run_id, folder, priority, files; ``manifests``: run_id, frame_count
    (NULL accepts any non-empty folder).
    """
    fits = F.col("frame_count").isNull() | (F.col("files") == F.col("frame_count"))
    return (
        folders.join(manifests.select("run_id", "frame_count"), "run_id")
        .where((F.col("files") > 0) & fits)
        .groupBy("run_id")
        .agg(F.min_by("folder", F.struct("priority", "folder")).alias("folder"))
    )


def run_catalogue(builtin: DataFrame, stored: DataFrame, sizes: DataFrame) -> DataFrame:
    """Built-ins first, then the newest; saved runs are available only when they have bytes.

    ``builtin`` / ``stored``: run_id, created_at, persisted; ``sizes``: run_id, size_bytes.
    """
    listed = builtin.withColumn("builtin", F.lit(True)).unionByName(
        stored.withColumn("builtin", F.lit(False))
    )
    available = F.col("builtin") | ~F.col("persisted") | F.col("size_bytes").isNotNull()
    held = F.when(F.col("persisted"), F.coalesce("size_bytes", F.lit(0))).otherwise(F.lit(0))
    return (
        listed.join(sizes, "run_id", "left")
        .withColumn("available", available)
        .withColumn("size_bytes", held.cast("long"))
        .orderBy(F.desc("builtin"), F.desc("created_at"), "run_id")
    )


def saved_total(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(
        F.count_if("persisted").alias("saved_runs"),
        F.sum(F.when(F.col("persisted"), F.col("size_bytes"))).alias("saved_bytes"),
    )


def artifact_status(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected artifacts against stored files, by (run, name).

    ``expected``: run_id, name, size_bytes, sha256; ``found``: run_id, name,
    length, digest, head (first bytes as hex), declared (length in the header or
    NULL), vertices (NULL unless a cloud).
    """
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    wanted = F.when(suffix.isin(*MAGIC_HEX), F.create_map(*_pairs())[suffix])
    status = (
        F.when(F.col("length").isNull(), F.lit("missing"))
        .when(F.col("size_bytes").isNull(), F.lit("unexpected"))
        .when(F.col("length") != F.col("size_bytes"), F.lit("size differs"))
        .when(F.col("digest") != F.col("sha256"), F.lit("checksum differs"))
        .when(wanted.isNotNull() & ~F.startswith(F.col("head"), wanted), F.lit("wrong signature"))
        .when(F.col("declared").isNotNull() & (F.col("declared") != F.col("length")), F.lit("truncated"))
        .when((suffix == "ply") & F.col("vertices").isNull(), F.lit("no vertex count"))
        .when(F.col("vertices") <= MIN_VERTICES, F.lit("too few vertices"))
        .otherwise(F.lit("ok"))
    )
    return (
        expected.join(found, ["run_id", "name"], "full_outer")
        .withColumn("status", status)
        .select("run_id", "name", "size_bytes", "length", "status")
    )


def _pairs() -> list[Column]:
    return [F.lit(v) for pair in MAGIC_HEX.items() for v in pair]


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """The ``found`` side of the audit, from the files themselves."""
    content = F.col("content")
    head = F.hex(F.substring(content, 1, 12))
    swapped = F.concat(*(F.substring(head, at, 2) for at in (23, 21, 19, 17)))
    declared = F.when(F.substring(head, 1, 8) == MAGIC_HEX["glb"], F.conv(swapped, 16, 10).cast("long"))
    # The text header of a cloud ends at its own mark, however long it is.
    whole = F.when(F.startswith(head, F.lit(MAGIC_HEX["ply"])), F.decode(content, "ISO-8859-1"))
    header = F.substring_index(whole, "end_header", 1)
    vertices = F.regexp_extract(header, r"element vertex (\d+)", 1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"),
            F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
            "length",
            F.sha2(content, 256).alias("digest"),
            head.alias("head"),
            declared.alias("declared"),
            F.when(vertices != "", vertices.cast("long")).alias("vertices"),
        )
    )


def clip_identity(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Digest of a clip from its frame digests in order, with its descriptive fields.

    ``frames``: keys, seq, digest, source_url, start_s, clip_s. A clip is at most
    a few hundred frames, which bounds the list.
    """
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda e: e["digest"]
    )
    grouped = frames.groupBy(*keys, "source_url", "start_s", "clip_s").agg(
        F.count(F.lit(1)).alias("frames"), ordered.alias("_digests")
    )
    identity = F.struct(
        F.col("clip_s").alias("clip_seconds"),
        F.col("_digests").alias("frame_sha256"),
        F.col("source_url"),
        F.col("start_s").alias("window_start_seconds"),
    )
    return grouped.select(*keys, "frames", F.sha2(F.to_json(identity), 256).alias("identity"))
