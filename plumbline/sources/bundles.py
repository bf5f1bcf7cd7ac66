"""Depth bundles (NPZ) to the frames table, one row per frame; bad files to quarantine."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEEDED = ("depth", "intrinsics", "extrinsics")
ROW_SCHEMA = (
    "run_id string, path string, frame int, width int, height int, depth array<float>, "
    "confidence array<float>, intrinsics array<double>, extrinsics array<double>, error string"
)


def _array(bundle: np.lib.npyio.NpzFile, name: str) -> np.ndarray:
    with bundle.zip.open(f"{name}.npy") as member:
        version = np.lib.format.read_magic(member)
        reader = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        _, fortran, dtype = reader(member)
    if dtype != np.dtype("<f4"):
        raise ValueError(f"{name} is {dtype.str}, expected little-endian float32")
    if fortran:
        raise ValueError(f"{name} is in Fortran order")
    return bundle[name]


def _frames(content: bytes) -> Iterator[dict]:
    with np.load(io.BytesIO(content), allow_pickle=False) as bundle:
        missing = [n for n in NEEDED if n not in bundle.files]
        if missing:
            raise ValueError(f"bundle has no {', '.join(missing)}")
        depth = _array(bundle, "depth")
        if depth.ndim != 3:
            raise ValueError(f"depth has shape {list(depth.shape)}, expected [frames, height, width]")
        count, height, width = depth.shape
        confidence = _array(bundle, "confidence") if "confidence" in bundle.files else None
        intrinsics = _array(bundle, "intrinsics").reshape(count, -1).astype("f8")
        extrinsics = _array(bundle, "extrinsics").reshape(count, -1).astype("f8")
        for f in range(count):
            yield {
                "frame": f,
                "width": width,
                "height": height,
                "depth": depth[f].ravel(),
                "confidence": None if confidence is None else confidence[f].ravel(),
                "intrinsics": intrinsics[f],
                "extrinsics": extrinsics[f],
                "error": None,
            }


def _ingest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
    for batch in batches:
        for row in batch.itertuples(index=False):
            head = {**dict.fromkeys(columns), "run_id": row.run_id, "path": row.path}
            try:
                for record in _frames(row.content):
                    yield pd.DataFrame([{**head, **record}])
            except Exception as broken:  # noqa: BLE001 - a bad file is a row, not a failed job
                yield pd.DataFrame([{**head, "error": str(broken)}])


def read_bundles(spark: SparkSession, path: str, pattern: str = "*.npz") -> tuple[DataFrame, DataFrame]:
    """(frames, quarantine). The run is the name of the folder that holds the bundle.

    A file is decoded where it is read and leaves as one row per frame, so memory
    is one bundle per task.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), "path", "content")
    )
    rows = files.mapInPandas(_ingest, ROW_SCHEMA)
    frames = rows.where(F.col("error").isNull()).drop("error", "path")
    quarantine = rows.where(F.col("error").isNotNull()).select("run_id", "path", "error")
    return frames, quarantine


def write_frames(frames: DataFrame, path: str) -> None:
    """The frames table on disk, one folder per run, so a run filter prunes files."""
    frames.write.mode("append").partitionBy("run_id").parquet(path)
