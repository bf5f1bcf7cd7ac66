"""Near duplicates of embeddings by spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, components, slices, stored, table

LEAST = 0.98
#: Independent codes (each a random rotation), blocks of coordinates per code, code words per block.
CODES, BLOCKS, WORDS = 3, 2, 48
#: A vector falls into the filters whose direction it exceeds by so much: the expected share of
#: filters is that of a cap of this height in 64 dimensions (it shrinks as 1 / sqrt(dim)). Lower finds
#: more pairs and costs more.
HEIGHT = 0.44
SEED = 11
#: Vectors of one filter are compared in tiles of so many by so many.
TILE = 512


class Code:
    """A random rotation and for each block of coordinates a list of unit code words.

    A filter is one code word per block; its direction is their concatenation over sqrt(blocks).
    """

    def __init__(self, dim: int, seed: int, blocks: int = BLOCKS, words: int = WORDS) -> None:
        rng = np.random.Generator(np.random.PCG64([SEED, seed, dim]))
        blocks = max(1, min(blocks, dim))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [c for c in np.array_split(np.arange(dim), blocks)]
        self.words = []
        for cut in self.cuts:
            w = rng.standard_normal((words, len(cut)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))

    def filters(self, unit: np.ndarray, height: float = HEIGHT) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose direction each row exceeds, decoded block by block.

        Partial sums are kept only while the best words of the blocks to come can still lift them over
        the height; a row that exceeds no filter gets the one it comes nearest to.
        """
        turned = unit @ self.turn
        parts = [turned[:, c] @ w.T / np.sqrt(len(self.cuts)) for c, w in zip(self.cuts, self.words)]
        best = np.stack([p.max(axis=1) for p in parts], 1)
        ahead = np.hstack([np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(unit), 1))])
        height = min(0.9, height * (64 / unit.shape[1]) ** 0.5)
        need = np.minimum(height, best.sum(axis=1) - 1e-12)
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, p in enumerate(parts):
            lifted = total[:, None] + p[row]
            at, word = np.nonzero(lifted + ahead[row, k][:, None] >= need[row][:, None])
            row, code, total = row[at], code[at] * p.shape[1] + word, lifted[at, word]
        return row, code


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label and ``unit`` (double precision, length 1), for vectors that can be linked."""
    rows = vectors.where(F.col("label").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0))
    rows = rows.where(~F.exists(column, lambda x: x.isNull())).select(
        "vec_id", "label", F.col(column).cast("array<double>").alias("unit")
    )

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            sizes = np.diff(batch.column("unit").offsets.to_numpy())
            for dim in np.unique(sizes):
                some = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                v = some.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                large = np.abs(v).max(axis=1)
                fine = np.isfinite(large) & (large > 0)
                # By the largest component first, so that squares neither vanish nor overflow.
                v = v[fine] / large[fine, None]
                v /= np.sqrt((v * v).sum(axis=1))[:, None]
                kept = some.take(pa.array(np.flatnonzero(fine)))
                offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays(
                    [kept.column("vec_id"), kept.column("label"), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))],
                    ["vec_id", "label", "unit"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(scale, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit array<double>")


def classes(rows: DataFrame) -> DataFrame:
    """Vectors that are equal, label included, as one: first (smallest vec_id), n, label, unit."""
    return rows.groupBy("label", "unit").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))


def in_filters(found: DataFrame) -> DataFrame:
    """(label, code, filter, first, unit): each class in every filter of every code."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for batch in slices(batches, 1024):
            lists = batch.column("unit")
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                some = batch.take(pa.array(rows))
                unit = some.column("unit").flatten().to_numpy().reshape(-1, dim)
                if dim not in codes:
                    codes[dim] = [Code(int(dim), k) for k in range(CODES)]
                for k, code in enumerate(codes[dim]):
                    row, name = code.filters(unit)
                    taken = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [
                            taken.column("label"), pa.array(np.full(len(row), int(dim) * CODES + k, np.int32)),
                            pa.array(name), taken.column("first"), taken.column("unit"),
                        ],
                        ["label", "code", "filter", "first", "unit"],
                    )

    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return found.select("label", "first", "unit").mapInArrow(
        decode, f"label {kinds['label']}, code int, filter long, first {kinds['first']}, unit array<double>"
    )


def near_pairs(found: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b), a < b: classes of one label that share a filter and whose cosine is ``least`` or more.

    A filter's vectors are cut into tiles by a hash of their id; each pair of tiles is one small group,
    so a filter that holds a third of all vectors is many groups, and none is compared in one task. The
    number of tiles follows the filter's own count. Only pairs that pass leave a group.
    """
    placed = stored(in_filters(found), "filters")
    keys = ["label", "code", "filter"]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    tiled = placed.join(counts, keys).withColumn("tiles", tiles)
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("first"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread = tiled.withColumn("other", other).select(
        *keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "first", "unit"
    )
    spread = spread.withColumn("group", F.xxhash64(*keys, "low", "high"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def pairs() -> pa.RecordBatch:
            key, low, high = group[:3], group[3], group[4]
            first = np.array([h[0] for h in held])
            own = np.array([h[1] for h in held])
            unit = np.stack([h[2] for h in held])
            cosine = unit @ unit.T
            i, j = np.nonzero(cosine >= least - 1e-9)
            keep = (first[i] < first[j]) & ((low == high) | (own[i] != own[j]))
            i, j = i[keep], j[keep]
            # The last digit is that of a plain sum, not of the blocked product.
            exact = np.array([float(np.dot(unit[a], unit[b])) for a, b in zip(i, j)])
            fine = exact >= least if len(exact) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(first[i[fine]]), pa.array(first[j[fine]])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "low", "high", "own", "first")]
            units = batch.column("unit")
            for row, unit in zip(zip(*columns), units):
                if group is not None and row[:5] != group:
                    if len(held) > 1:
                        yield pairs()
                    held = []
                group = row[:5]
                held.append((row[6], row[5], unit.values.to_numpy()))
        if len(held) > 1:
            yield pairs()

    dealt = spread.repartition("group").sortWithinPartitions("group", *keys, "low", "high")
    kind = found.schema["first"].dataType.simpleString()
    return dealt.select(*keys, "low", "high", "own", "first", "unit").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of the label with a cosine of ``least`` or
    more that share a filter), component_id, kept (the smallest of its component).

    Equal vectors are one class with a count, so copies are linked without being paired. A vector
    without label, or NULL, empty, zero or with a NULL or non-finite component is linked with nothing.
    NULL vec_ids do not name a component: such a row is no copy's or neighbour's, has 0 links and is not
    kept. Rows that share a vec_id count as vectors of their own and share the component. No vectors
    give no rows; other columns do not pass.
    """
    rows = vectors.where("vec_id IS NOT NULL")
    found = stored(classes(usable(rows)), "classes")
    pairs = stored(near_pairs(found, least), "pairs")
    both = pairs.union(pairs.select(F.col("b"), F.col("a")))
    sizes = found.select("first", "n")
    near = both.join(sizes.withColumnRenamed("first", "b"), "b").groupBy("a").agg(F.sum("n").alias("near"))
    labelled = components(pairs)
    told = (
        found.join(near.withColumnRenamed("a", "first"), "first", "left")
        .join(labelled.withColumnRenamed("node", "first"), "first", "left")
        .select(
            "label", "unit", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "first").alias("component_id"),
        )
    )
    named = usable(rows).select("vec_id", "label", "unit").join(told, ["label", "unit"]).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    joined = vectors.select("vec_id").join(named, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_cap_filters": Query(op4)}
