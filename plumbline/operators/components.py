"""Connected occupied voxels: components inside blocks first, then rounds over what crosses blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numbers import finite
from plumbline.operators.ranks import exploded
from plumbline.session import cut_lineage

#: A block is a cube of so many voxels a side, so a task holds at most SIDE ** 3 of them at once.
SIDE = 16
_STEPS = [s for s in product((-1, 0, 1), repeat=3) if any(s)]


def filled(cells: np.ndarray) -> np.ndarray:
    """For each cell of a block, numbered row by row, the lowest cell it is connected to over faces, edges or corners."""
    left = set(cells.tolist())
    label: dict[int, int] = {}
    for start in sorted(left):
        if start in label:
            continue
        label[start], stack = start, [start]
        while stack:
            x, rest = divmod(stack.pop(), SIDE * SIDE)
            y, z = divmod(rest, SIDE)
            for dx, dy, dz in _STEPS:
                a, b, c = x + dx, y + dy, z + dz
                if 0 <= a < SIDE and 0 <= b < SIDE and 0 <= c < SIDE:
                    cell = (a * SIDE + b) * SIDE + c
                    if cell in left and cell not in label:
                        label[cell] = start
                        stack.append(cell)
    return np.array([label[c] for c in cells.tolist()], "int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _labels(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for cells in blocks:
        yield cells.map(filled)


def connected_voxels(points: DataFrame, keys: list[str], edge: float = 0.05) -> DataFrame:
    """26-neighbour components of occupied voxels, summarised per group: components, largest_points, voxels, largest_share.

    Voxels of a block are connected in the task that holds it, and a block's component goes on as one node.
    Only cells on a block's faces look for neighbours, in other blocks; the edges they give are settled in
    rounds in which every node takes the lowest label around it and then that label's own, so long chains of
    blocks halve. Most groups lie in a few blocks, so few nodes reach the rounds at all. Points without
    finite coordinates are in no voxel but count for the share.
    """
    voxel = lambda c: F.floor(F.col(c) / F.lit(edge))
    at = ("x", "y", "z")
    whole = points.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    voxels = whole.groupBy(*keys, *(voxel(c).alias(f"v{c}") for c in at)).agg(F.count(F.lit(1)).alias("points"))
    block = F.struct(*(F.floor(F.col(f"v{c}") / SIDE).alias(f"b{c}") for c in at))
    local = [F.pmod(F.col(f"v{c}"), F.lit(SIDE)) for c in at]
    cell = ((local[0] * SIDE + local[1]) * SIDE + local[2]).cast("int")
    packed = voxels.groupBy(*keys, block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(cell.alias("cell"), "points"))).alias("cells")
    )
    labelled = packed.withColumn("labels", _labels(F.col("cells.cell")))
    rows = cut_lineage(
        labelled.select(*keys, "block", F.explode(F.arrays_zip("cells", "labels")).alias("r")).select(
            *keys,
            F.struct("block.bx", "block.by", "block.bz", F.col("r.labels").alias("label")).alias("node"),
            "block",
            F.col("r.cells.cell").alias("cell"),
            F.col("r.cells.points").alias("points"),
        )
    )
    nodes = rows.groupBy(*keys, "node").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("voxels"))
    labels = _joined_labels(_crossings(rows, keys), keys)
    named = nodes.join(labels, [*keys, "node"], "left").withColumn("label", F.coalesce("label", "node"))
    sized = named.groupBy(*keys, "label").agg(F.sum("points").alias("_points"), F.sum("voxels").alias("_voxels"))
    components = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("components"),
        F.max("_points").alias("largest_points"),
        F.sum("_voxels").alias("voxels"),
    )
    given = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_given"))
    return (
        components.join(given, keys)
        .withColumn("largest_share", F.col("largest_points") / F.col("_given"))
        .drop("_given")
    )


def _crossings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (src, dst) both ways between components of different blocks that touch."""
    spots = {"x": F.expr(f"cell div {SIDE * SIDE}"), "y": F.expr(f"cell div {SIDE} % {SIDE}"), "z": F.expr(f"cell % {SIDE}")}
    faces = rows.withColumns(spots).where(" OR ".join(f"{c} IN (0, {SIDE - 1})" for c in "xyz"))
    placed = faces.select(*keys, "node", "block", *((F.col(f"block.b{c}") * SIDE + F.col(c)).alias(c) for c in "xyz"))
    moved = placed.withColumnRenamed("node", "src")
    for c in "xyz":
        moved = moved.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    there = F.struct(*(F.floor(F.col(c) / SIDE).alias(f"b{c}") for c in "xyz"))
    found = exploded(moved.where(there > F.col("block")).drop("block")).join(
        placed.drop("block").withColumnRenamed("node", "dst"), [*keys, "x", "y", "z"]
    )
    one_way = found.select(*keys, "src", "dst").distinct()
    back = one_way.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return cut_lineage(one_way.unionByName(back))


def _joined_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, label): the lowest node reachable, for nodes with an edge."""
    labels = cut_lineage(
        edges.groupBy(*keys, F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("label"))
    )
    while True:
        around = (
            edges.join(labels.select(*keys, F.col("node").alias("dst"), "label"), [*keys, "dst"])
            .groupBy(*keys, F.col("src").alias("node"))
            .agg(F.min("label").alias("_low"))
        )
        lowered = labels.join(around, [*keys, "node"]).select(
            *keys, "node", F.col("label").alias("_old"), F.least("label", "_low").alias("_new")
        )
        hops = labels.select(*keys, F.col("node").alias("_new"), F.col("label").alias("_hop"))
        step = cut_lineage(
            lowered.join(hops, [*keys, "_new"], "left").select(*keys, "node", "_old", F.least("_new", "_hop").alias("label"))
        )
        labels = step.drop("_old")
        if step.where(F.col("_old") != F.col("label")).isEmpty():
            return labels
