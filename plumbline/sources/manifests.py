"""Run manifests and memory sweeps: JSON in, typed tables out, and back again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas


def read_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    return with_defaults(spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(list(paths)))


def parse_manifests(texts: DataFrame, column: str, *keep: str) -> DataFrame:
    """Manifests held as text in a table, with the columns of ``keep`` beside them; unreadable ones are left out.

    The text is unnested, not selected: a projection would be merged into those above it,
    which parse the text again for every field they use.
    """
    parsed = texts.select(*keep, F.inline(F.array(F.from_json(column, schemas.MANIFEST))))
    return with_defaults(parsed.where(F.col("run_id").isNotNull()))


def with_defaults(wire: DataFrame) -> DataFrame:
    """Fill what older files lack: allocator peak and baseline 0, no artifacts, not a mock."""
    vram = F.col("vram")
    vram = vram.withField("torch_peak_bytes", F.coalesce("vram.torch_peak_bytes", F.lit(0).cast("long")))
    vram = vram.withField("baseline_bytes", F.coalesce("vram.baseline_bytes", F.lit(0).cast("long")))
    diagnostics = F.when(
        F.col("diagnostics").isNotNull(),
        F.col("diagnostics")
        .withField(
            "native_npz",
            F.coalesce("diagnostics.native_npz", F.create_map().cast("map<string,array<string>>")),
        )
        .withField(
            "export_dir_listing",
            F.coalesce("diagnostics.export_dir_listing", F.array().cast("array<string>")),
        ),
    )
    return wire.withColumns(
        {
            "vram": vram,
            "artifacts": F.coalesce("artifacts", F.array().cast(f"array<{schemas.ARTIFACT}>")),
            "diagnostics": diagnostics,
            "mock": F.coalesce("mock", F.lit(False)),
        }
    )


def flat_runs(manifests: DataFrame) -> DataFrame:
    """The ``runs`` table: one flat row per manifest."""
    return manifests.select(
        "run_id",
        F.col("frames.count").alias("frame_count"),
        F.col("frames.requested_count").alias("requested_count"),
        "frames.width",
        "frames.height",
        "frames.capped",
        "frames.effective_fps",
        "params.fps",
        "params.process_res",
        "params.max_frames",
        "timing.gpu_seconds",
        "timing.wall_seconds",
        "timing.model_load_seconds",
        "vram.peak_bytes",
        "vram.torch_peak_bytes",
        "vram.baseline_bytes",
        "vram.total_bytes",
        "vram.device_name",
        "artifacts",
        "transient",
        "mock",
    )


def to_wire(manifests: DataFrame, *keep: str) -> DataFrame:
    """One JSON text per manifest, the complete inverse of reading it, with the columns of ``keep`` beside it."""
    fields = [c for c in manifests.columns if c not in keep]
    return manifests.select("run_id", *keep, F.to_json(F.struct(*fields)).alias("manifest"))


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.mode("append").json(path)


def read_sweeps(spark: SparkSession, *paths: str) -> DataFrame:
    """label, date, batch (when the file was written, in microseconds) and the nested runs of every sweep."""
    files = spark.read.schema(schemas.SWEEPS).option("multiLine", True).json(list(paths))
    written = F.unix_micros("_metadata.file_modification_time").alias("batch")
    return files.select(F.explode("sweeps").alias("s"), written).select("s.label", "s.date", "batch", "s.runs")


def memory_columns(prefix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("peak_bytes", "baseline_bytes", "total_bytes"))
