"""Scalar column helpers: finiteness, rounding and the seeded 32-bit generator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF

# The generator's additive step and its two odd multiplier masks.
DRAW_STEP = 0x6D2B79F5
DRAW_ODD = 1
DRAW_MIX = 61


def f64(value: float) -> Column:
    return F.lit(float(value))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(finite(value), value)


def half_up(value: Column) -> Column:
    """Round halves towards +infinity, unlike ``round`` which goes away from zero."""
    return F.floor(value + f64(0.5))


def all_finite(columns: Iterable[Column]) -> Column:
    out = F.lit(True)
    for column in columns:
        out = out & finite(column)
    return out


def _multiply32(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(WORD))


def with_uniform_draw(df: DataFrame, seed: Column, nth: Column, out: str) -> DataFrame:
    """Add the ``nth`` (1-based) value in [0, 1) of the generator started at ``seed``.

    The state is a plain counter, so any draw is computed on its own: no row
    depends on the row before it. 32-bit products are split in two so that the
    64-bit arithmetic never overflows under ANSI mode.
    """
    state = (seed.cast("long") + nth.cast("long") * F.lit(DRAW_STEP)).bitwiseAND(F.lit(WORD))
    step = df.withColumn("_a", state)
    a = F.col("_a")
    step = step.withColumn(
        "_t", _multiply32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(DRAW_ODD)))
    )
    t = F.col("_t")
    mixed = _multiply32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(DRAW_MIX)))
    step = step.withColumn("_u", t.bitwiseXOR((t + mixed).bitwiseAND(F.lit(WORD))))
    u = F.col("_u")
    value = u.bitwiseXOR(F.shiftright(u, 14)).cast("double") / f64(4294967296.0)
    return step.withColumn(out, value).drop("_a", "_t", "_u")
