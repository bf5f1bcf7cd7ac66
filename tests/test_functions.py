import math

from pyspark.sql import functions as F

from plumbline.functions.numbers import DRAW_STEP, f64, half_up, with_uniform_draw
from plumbline.functions.vectors import (
    Vec,
    angle_deg,
    fixed,
    ground_axes,
    invert_rigid4,
    transform_direction,
    transform_point,
    unit,
    usable_alignment,
    vec,
)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def uniform(seed, nth):
    word = 0xFFFFFFFF
    t = (seed + nth * DRAW_STEP) & word
    t = ((t ^ (t >> 15)) * (t | 1)) & word
    t ^= (t + ((t ^ (t >> 7)) * (t | 61) & word)) & word
    return ((t ^ (t >> 14)) & word) / 4294967296


def test_draws_follow_the_seeded_sequence(spark):
    rows = with_uniform_draw(
        spark.range(1, 200).withColumn("seed", F.lit(7)), F.col("seed"), F.col("id"), "u"
    ).collect()
    assert [r.u for r in rows] == [uniform(7, r.id) for r in rows]


def test_half_up_goes_towards_plus_infinity(spark):
    assert tuple(one(spark, half_up(f64(2.5)).alias("a"), half_up(f64(-2.5)).alias("b"))) == (3, -2)


def test_degenerate_vectors_have_no_direction(spark):
    row = one(
        spark,
        unit(fixed(0, 0, 0)).x.alias("u"),
        angle_deg(fixed(0, 0, 0), fixed(0, 1, 0)).alias("a"),
        angle_deg(fixed(1, 0, 0), fixed(0, 2, 0)).alias("b"),
    )
    assert row.u is None and row.a is None and abs(row.b - 90) < 1e-9


def test_ground_axes_are_orthonormal(spark):
    ups = [(0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.48, 0.64, 0.6), (-0.6, 0.64, 0.48)]
    df = spark.createDataFrame(ups, "ux double, uy double, uz double")
    e1, e2 = ground_axes(vec("ux", "uy", "uz"))
    for r in df.select("*", *(p.alias(n) for p, n in zip([*e1, *e2], "abcdef"))).collect():
        u, a, b = (r.ux, r.uy, r.uz), (r.a, r.b, r.c), (r.d, r.e, r.f)
        dot = lambda p, q: sum(x * y for x, y in zip(p, q))
        for p, q, want in [(a, a, 1), (b, b, 1), (a, b, 0), (a, u, 0), (b, u, 0)]:
            assert math.isclose(dot(p, q), want, abs_tol=1e-12)


def test_alignment_inverts_and_falls_back_to_identity(spark):
    m = F.array(*(f64(v) for v in [0, -2, 0, 3, 2, 0, 0, 4, 0, 0, 2, 5, 0, 0, 0, 1]))
    p = transform_point(invert_rigid4(m), transform_point(m, fixed(1.5, -2, 7)))
    flat = F.array(*(f64(0) for _ in range(16)))
    row = one(
        spark,
        *(c.alias(n) for c, n in zip(p, "xyz")),
        invert_rigid4(flat).alias("none"),
        usable_alignment(F.array(f64(1), f64(2)))[5].alias("identity"),
        transform_direction(m, Vec(f64(1), f64(0), f64(0))).y.alias("turned"),
    )
    assert (row.x, row.y, row.z) == (1.5, -2.0, 7.0)
    assert row.none is None and row.identity == 1.0 and row.turned == 1.0
