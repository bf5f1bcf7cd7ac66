import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.ranks import (
    exact_nmad,
    exact_percentiles,
    uniform_sample,
    with_ordinal,
    with_rank,
)
from plumbline.operators.scale import even_median


@pytest.fixture(scope="module")
def groups():
    """A hot group, a tiny one, one of equal values and one with far outliers."""
    r = np.random.default_rng(5)
    return {
        "hot": r.normal(size=40000),
        "tiny": np.array([3.0, 1.0, 2.0]),
        "same": np.full(500, 0.25),
        "far": np.concatenate([r.normal(size=3000) * 1e-6, [1e12, -1e12]]),
        "steps": r.integers(0, 7, 5000).astype(float),
    }


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(k, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("hot", -1, float("nan")), ("hot", -2, None), ("hot", -3, float("inf"))]
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(8)


def nearest(values, p):
    ordered = np.sort(values)
    return ordered[min(len(ordered) - 1, max(0, math.ceil(p / 100 * len(ordered)) - 1))]


def test_percentiles_are_exact_for_every_shape_of_group(table, groups):
    probs = {f"p{i}": p for i, p in enumerate([0, 0.05, 2, 10, 50, 77.7, 98, 99.99, 100])}
    for row in exact_percentiles(table, ["k"], F.col("v"), probs).collect():
        assert row.n == len(groups[row.k])
        for name, p in probs.items():
            assert row[name] == nearest(groups[row.k], p), (row.k, p)


def test_nmad_and_averaged_median(table, groups):
    finite = table.where(F.col("i") >= 0)
    nmads = {r.k: r.nmad for r in exact_nmad(finite, ["k"], F.col("v")).collect()}
    medians = {r.k: r.m for r in even_median(finite, ["k"], F.col("v"), "m").collect()}
    for k, values in groups.items():
        mid = nearest(values, 50)
        assert nmads[k] == pytest.approx(1.4826 * nearest(np.abs(values - mid), 50), abs=1e-15)
        assert medians[k] == pytest.approx(np.median(values), abs=1e-15)


def test_rank_and_ordinal_are_total_orders(table, groups):
    finite = table.where(F.col("i") >= 0).withColumn("block", F.expr("i div 1000"))
    ranked = with_rank(finite, ["k"], F.col("v"), ["i"]).collect()
    for k, values in groups.items():
        order = np.lexsort((np.arange(len(values)), values))
        got = {r.rank: r.i for r in ranked if r.k == k}
        assert [got[j + 1] for j in range(len(values))] == list(order)
    for r in with_ordinal(finite, ["k"], "block", ["i"]).collect():
        assert r.ord == r.i and r.group_rows == len(groups[r.k])


def test_sample_is_exact_in_size_stable_and_even(table, groups):
    finite = table.where(F.col("i") >= 0)
    first = uniform_sample(finite, ["k"], ["i"], 1000, 7).collect()
    again = uniform_sample(finite.repartition(3), ["k"], ["i"], 1000, 7).collect()
    assert sorted(first) == sorted(again)
    for k, values in groups.items():
        kept = [r.i for r in first if r.k == k]
        assert len(kept) == len(set(kept)) == min(1000, len(values))
    kept = [r.i for r in first if r.k == "hot"]
    assert abs(np.mean(kept) - 20000) < 1500


def test_percentiles_of_one_value_on_most_rows_and_of_a_huge_key(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(7.0)).alias("v"),
        F.when(F.col("id") % 1000 == 0, F.lit("small")).otherwise(F.lit("huge")).alias("k"),
    )
    found = {r.k: r for r in exact_percentiles(rows, ["k"], F.col("v"), {"p5": 5, "p50": 50, "p95": 95, "p99": 99}).collect()}
    for key in ("small", "huge"):
        values = sorted(r.v for r in rows.where(F.col("k") == key).collect())
        n = len(values)
        for p in (5, 50, 95, 99):
            assert found[key][f"p{p}"] == values[min(n, max(1, -(-p * n // 100))) - 1]
