"""Exact order statistics, ordinals and uniform samples for groups of any size.

A run may hold a third of all points, so no operator here sorts, collects or
hashes a whole group in one task. Each one cuts the group's value range into
bins (a monotone function of the value, so bin order is value order), counts
the bins with partial aggregation, and then sorts only inside a bin.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite
from plumbline.session import cut_lineage

BINS = 2048
SKETCH_ACCURACY = 1000
# Three times the sketch's rank error on each side.
BRACKET = 3.0 / SKETCH_ACCURACY
NMAD_SCALE = 1.4826


def exploded(df: DataFrame) -> DataFrame:
    """Mark a join side that was unnested: its size estimate is that of the rows before, so never broadcast it."""
    return df.hint("merge")


def nearest_rank(n: Column, p: float | Column) -> Column:
    """1-based nearest rank of percentile ``p`` (0..100) among ``n`` values."""
    share = f64(p / 100.0) if isinstance(p, (int, float)) else p / f64(100)
    return F.least(n, F.greatest(F.lit(1), F.ceil(share * n))).cast("long")


def _binned(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every ``_v`` a ``_bin``: linear between the 0.1 % and 99.9 % sketch marks, open-ended outside.

    The marks are worked out once: a sketch depends on the order in which its parts arrive, and bins
    that are read twice must be the same bins.
    """
    marks = cut_lineage(
        values.groupBy(*keys).agg(F.percentile_approx("_v", [0.001, 0.999], F.lit(2000)).alias("_marks"))
    )
    lo, hi = F.col("_marks")[0], F.col("_marks")[1]
    inner = F.floor((F.col("_v") - lo) / F.nullif(hi - lo, f64(0)) * f64(BINS)).cast("int")
    bin_ = (
        F.when(F.col("_v") < lo, F.lit(-1))
        .when(F.col("_v") > hi, F.lit(BINS + 1))
        .otherwise(F.coalesce(inner, F.lit(0)))
    )
    return values.join(marks, list(keys)).withColumn("_bin", bin_).drop("_marks")


def _bin_offsets(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ``_bin``, ``_before`` (values in lower bins), ``_through``, ``_n``."""
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*keys)
    running = group.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select(
        *keys,
        "_bin",
        F.sum("_c").over(running).alias("_through"),
        (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.sum("_c").over(group).alias("_n"),
    )


def upper_middle(n: Column) -> Column:
    """Rank of the upper of the two middle values (the middle one of an odd group)."""
    return (F.floor(n / f64(2)) + 1).cast("long")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    ranks: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Nearest-rank percentiles per group: ``keys``, one column per name, and ``n``.

    Exact for any group size, in two passes. A mergeable sketch with a guaranteed
    rank error brackets each wanted rank; then everything under a bracket is
    counted, what is inside it (under 1 % of the group) is counted by bins of the
    bracket, and only the values of the one bin that holds the rank are put in order.
    The counts (under 1 % of a large group, distinct values once) are stored, as they are read twice
    and a sketch made again from parts in another order gives another bracket and other bins.
    ``ranks`` replaces the nearest-rank rule of a name, within the bracket of its p.
    """
    values = df.select(*keys, value.cast("double").alias("_v")).where(finite(F.col("_v")))
    names = list(probs)
    ends = [max(0.0, probs[k] / 100.0 - BRACKET) for k in names]
    ends += [min(1.0, probs[k] / 100.0 + BRACKET) for k in names]
    marks = values.groupBy(*keys).agg(
        F.percentile_approx("_v", ends, F.lit(SKETCH_ACCURACY)).alias("_m"),
        F.count(F.lit(1)).alias("_n"),
    )

    def rank(i: int, name: str) -> Column:
        if ranks and name in ranks:
            return ranks[name](F.col("_n"))
        return nearest_rank(F.col("_n"), probs[name])

    wanted = F.array(
        *(
            F.struct(
                F.lit(i).alias("i"),
                F.col("_m")[i].alias("lo"),
                F.col("_m")[len(names) + i].alias("hi"),
                rank(i, name).alias("rank"),
            )
            for i, name in enumerate(names)
        )
    )
    brackets = marks.select(*keys, "_n", wanted.alias("_w"))
    inside = F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v"))
    width = F.nullif(F.col("_b.hi") - F.col("_b.lo"), f64(0))
    bin_ = F.when(
        F.col("_v") >= F.col("_b.lo"),
        F.coalesce(F.floor((F.col("_v") - F.col("_b.lo")) / width * f64(BINS)).cast("int"), F.lit(0)),
    ).otherwise(F.lit(-1))
    counted = cut_lineage(
        values.join(brackets, list(keys))
        .select(*keys, "_n", "_v", F.explode("_w").alias("_b"))
        .where(F.col("_v") <= F.col("_b.hi"))
        .groupBy(*keys, "_n", F.col("_b.i").alias("_i"), F.col("_b.rank").alias("_rank"), bin_.alias("_bin"), inside.alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    slot = [*keys, "_i"]
    bins = counted.groupBy(*slot, "_rank", "_bin").agg(F.sum("_c").alias("_in"))
    upto = W.partitionBy(*slot).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("_through", F.sum("_in").over(upto)).withColumn("_before", F.col("_through") - F.col("_in"))
    holding = bins.where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_through")))
    chosen = counted.join(holding.select(*slot, "_bin", "_before"), [*slot, "_bin"])
    running = (
        W.partitionBy(*slot).orderBy(F.asc_nulls_first("_x")).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    reached = chosen.withColumn("_cum", F.col("_before") + F.sum("_c").over(running)).where(
        F.col("_cum") >= F.col("_rank")
    )
    # The first value to reach the rank. Nothing there would mean the bracket
    # missed it, which the sketch rules out; fail rather than answer wrongly.
    first = lambda i: F.min_by(
        F.coalesce("_x", F.raise_error(F.lit("percentile bracket missed its rank")).cast("double")),
        F.when(F.col("_i") == i, F.col("_cum")),
    )
    return reached.groupBy(*keys).agg(
        *(first(i).alias(name) for i, name in enumerate(names)), F.max("_n").alias("n")
    )


def exact_nmad(
    df: DataFrame, keys: Sequence[str], value: Column, out: str = "nmad", middle: str | None = None
) -> DataFrame:
    """1.4826 x the lower median of absolute deviations from the lower median.

    ``middle`` names a column for that median, which is computed on the way.
    """
    values = df.select(*keys, value.cast("double").alias("_x")).where(finite(F.col("_x")))
    centre = exact_percentiles(values, keys, F.col("_x"), {"_mid": 50}).drop("n")
    spread = values.join(centre, list(keys))
    mad = exact_percentiles(spread, keys, F.abs(F.col("_x") - F.col("_mid")), {"_mad": 50})
    scaled = mad.select(*keys, (f64(NMAD_SCALE) * F.col("_mad")).alias(out))
    if middle is None:
        return scaled
    return scaled.join(centre.withColumnRenamed("_mid", middle), list(keys))


def with_rank(
    df: DataFrame, keys: Sequence[str], value: Column, ties: Sequence[str], out: str = "rank"
) -> DataFrame:
    """1-based position of each row by ``value`` then ``ties`` within its group."""
    binned = _binned(df.withColumn("_v", value.cast("double")), keys)
    offsets = _bin_offsets(binned, keys).select(*keys, "_bin", "_before", "_n")
    inside = W.partitionBy(*keys, "_bin").orderBy("_v", *ties)
    return (
        binned.join(offsets, [*keys, "_bin"])
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .withColumn("group_rows", F.col("_n"))
        .drop("_v", "_bin", "_before", "_n")
    )


def with_ordinal(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], out: str = "ord"
) -> DataFrame:
    """0-based stored position inside the group, by ``block`` (the frame) then ``order``.

    Frames are bounded by the image size, so the sort stays inside one frame; a
    run total is a prefix sum over one row per frame.
    """
    sizes = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_rows"))
    blocks = W.partitionBy(*keys).orderBy(block)
    starts = sizes.select(
        *keys,
        block,
        F.coalesce(
            F.sum("_rows").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("group_rows"),
    )
    inside = W.partitionBy(*keys, block).orderBy(*order)
    return (
        df.withColumn("_in_block", F.row_number().over(inside) - 1)
        .join(starts, [*keys, block])
        .withColumn(out, (F.col("_start") + F.col("_in_block")).cast("long"))
        .drop("_in_block", "_start")
    )


def uniform_sample(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], keep: int, seed: int
) -> DataFrame:
    """Exactly ``keep`` rows per group (or all of a smaller one), without replacement.

    Keeps the rows with the smallest seeded hash. The hash is uniform, so its top
    bits are even bins: whole bins below the cut are kept as they stand and only
    the one bin at the cut is sorted.
    """
    hashed = df.withColumn("_h", F.xxhash64(*identity, F.lit(seed))).withColumn(
        "_bin", F.shiftrightunsigned(F.col("_h"), 52).bitwiseXOR(F.lit(2048))
    )
    offsets = _bin_offsets(hashed, keys).where(F.col("_before") < keep)
    within = hashed.join(offsets.drop("_n"), [*keys, "_bin"])
    whole = within.where(F.col("_through") <= keep).drop("_through", "_before")
    edge = within.where(F.col("_through") > keep)
    cut = W.partitionBy(*keys, "_bin").orderBy("_h", *identity)
    partial = (
        edge.withColumn("_at", F.row_number().over(cut))
        .where(F.col("_at") <= F.lit(keep) - F.col("_before"))
        .drop("_at", "_through", "_before")
    )
    return whole.unionByName(partial).drop("_h", "_bin")
