"""Exported clouds (binary glTF) to points, outline vertices and alignments."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the container format.
MAGIC = b"glTF"
COMPONENTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
DTYPES = {5126: "<f4", 5121: "u1", 5123: "<u2"}

ROW_SCHEMA = (
    "run_id string, path string, kind string, frustum int, seq long, x double, y double, z double, "
    "r int, g int, b int, alignment array<double>, error string"
)
CHUNK = 65536


def _accessor(gltf: dict, body: bytes, index: int) -> np.ndarray:
    accessor = gltf["accessors"][index]
    view = gltf["bufferViews"][accessor["bufferView"]]
    if accessor["componentType"] not in DTYPES:
        raise ValueError(f"unsupported component type {accessor['componentType']}")
    dtype = np.dtype(DTYPES[accessor["componentType"]])
    width = COMPONENTS[accessor["type"]]
    if view.get("byteStride") not in (None, 0, width * dtype.itemsize):
        raise ValueError("interleaved attributes are not supported")
    start = view.get("byteOffset", 0) + accessor.get("byteOffset", 0)
    flat = np.frombuffer(body, dtype, accessor["count"] * width, start)
    return flat.reshape(-1, width)


def _tables(content: bytes) -> Iterator[pd.DataFrame]:
    if content[:4] != MAGIC:
        raise ValueError("not a binary glTF file")
    if struct.unpack_from("<I", content, 8)[0] != len(content):
        raise ValueError("file is truncated")
    size = struct.unpack_from("<I", content, 12)[0]
    gltf = json.loads(content[20 : 20 + size])
    body = content[20 + size + 8 :]
    best, colours, outlines = None, None, []
    for mesh in gltf.get("meshes", []):
        for primitive in mesh.get("primitives", []):
            attributes = primitive.get("attributes", {})
            if "POSITION" not in attributes:
                continue
            positions = _accessor(gltf, body, attributes["POSITION"])
            if primitive.get("mode") != 0:
                outlines.append(positions)
            elif best is None or len(positions) > len(best):
                best = positions
                colour = attributes.get("COLOR_0")
                colours = None if colour is None else _accessor(gltf, body, colour)
    if best is None:
        raise ValueError("no POINTS primitive")
    scenes = gltf.get("scenes") or [{}]
    matrix = scenes[gltf.get("scene", 0)].get("extras", {}).get("hf_alignment")
    flat = None if matrix is None else np.asarray(matrix, "f8").ravel()
    yield pd.DataFrame({"kind": ["alignment"], "alignment": [flat]})
    for start in range(0, len(best), CHUNK):
        part = best[start : start + CHUNK].astype("f8")
        table = pd.DataFrame(part, columns=["x", "y", "z"]).assign(
            kind="point", seq=np.arange(start, start + len(part))
        )
        if colours is not None:
            for i, c in enumerate("rgb"):
                table[c] = colours[start : start + CHUNK, i].astype("i4")
        yield table
    for i, vertices in enumerate(outlines):
        yield pd.DataFrame(vertices.astype("f8"), columns=["x", "y", "z"]).assign(
            kind="outline", frustum=i, seq=np.arange(len(vertices))
        )


def _ingest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
    whole = ["frustum", "seq", "r", "g", "b"]
    kinds = {c: "Int64" for c in whole} | {c: object for c in ("run_id", "path", "kind", "error")}
    for batch in batches:
        for row in batch.itertuples(index=False):
            try:
                parts = list(_tables(row.content))
            except Exception as broken:  # noqa: BLE001 - a bad file is a row, not a failed job
                parts = [pd.DataFrame({"kind": ["error"], "error": [str(broken)]})]
            for part in parts:
                absent = {c: None for c in columns if c not in part}
                table = part.assign(**{**absent, "run_id": row.run_id, "path": row.path})[columns]
                yield table.astype(kinds)


def read_clouds(
    spark: SparkSession, path: str, pattern: str = "*.glb"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, outline vertices, alignments, quarantine); a file is decoded once per table read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), "path", "content")
    )
    rows = files.mapInPandas(_ingest, ROW_SCHEMA)
    kind = lambda k: rows.where(F.col("kind") == k)
    points = kind("point").select("run_id", F.col("seq").alias("px"), "x", "y", "z", "r", "g", "b")
    outlines = kind("outline").select("run_id", "frustum", "seq", "x", "y", "z")
    alignments = kind("alignment").select("run_id", "alignment")
    return points, outlines, alignments, kind("error").select("run_id", "path", "error")
