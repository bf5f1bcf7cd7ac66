"""Calibration, trials and streams with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibrate as K, fleet as R, scale as S, trials as T

DOOR = [("d", 2.1, 2.0184), ("d", 0.75, 0.6971), ("d", 0.45, 0.4276)]


def test_error_model_of_three_known_lengths(spark):
    rows = spark.createDataFrame([*DOOR, ("one", 1.0, 0.9), ("none", 0.0, 1.0)], "k string, truth double, predicted double")
    models = {r.k: r for r in K.fit_error_model(rows, ["k"]).collect()}
    door = models["d"]
    assert door.slope == pytest.approx(0.968592, abs=1e-6)
    assert door.intercept == pytest.approx(-0.017751, abs=1e-6)
    assert door.scale_factor == pytest.approx(1.044522, abs=1e-6)
    assert models["one"].slope is None and models["one"].scale_factor_stderr is None
    assert models["one"].scale_factor == pytest.approx(1 / 0.9)
    assert "none" not in models


BUDGET = "value_m double, roughness_m double, operator_range_m double, observations long, scale_factor double, scale_factor_stderr double, residual_rms double"


def test_bias_is_kept_apart_from_uncertainty(spark):
    rows = spark.createDataFrame([(2.0, 0.03, 0.08, 3, 1.05, 0.01, 0.02), (2.0, 0.03, None, None, None, None, None)], BUDGET)
    full, bare = K.compose_uncertainty(rows).orderBy(F.desc("calibrated")).collect()
    assert full.random_m == pytest.approx(0.05) and full.systematic_m == pytest.approx((0.02**2 + 0.02**2) ** 0.5)
    assert full.bias_relative == pytest.approx(1 / 1.05 - 1) and full.calibrated_m == pytest.approx(2.1)
    assert full.dominant == "operator" and len(full.terms) == 4
    assert bare.random_m == pytest.approx(0.03) and bare.systematic_m is None and bare.calibrated_m is None
    assert bare.dominant == "unknown" and bare.stated_m == pytest.approx(0.03) and "needs 3 trials" in bare.basis


def test_scale_modes(spark):
    rows = [
        ("a", "camera_height", "1", 1.0, 1.5, 0.0), ("a", "camera_height", "2", 2.0, 1.5, 0.0),
        ("b", "known_object", "1", 4.0, 2.0, 0.4), ("c", "metric_model", "m@1", None, None, 0.1),
        ("d", "trajectory", "1", 1.0, -2.0, 0.0), ("e", "guess", "1", 1.0, 1.0, 0.0),
        ("f", "trajectory", "1", 1.0, 2.0, 0.0), ("f", "trajectory", "1", 1.0, 2.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "request_id string, mode string, observation_id string, predicted double, metric double, uncertainty double")
    got = {r.request_id: r for r in S.solve_scale(df).collect()}
    assert got["a"].factor == pytest.approx(1.0) and got["b"].factor == 0.5 and got["b"].factor_uncertainty == pytest.approx(0.1)
    assert got["c"].factor == 1.0 and got["c"].factor_unit == "unitless"
    assert [got[k].fault for k in "def"] == ["metric must be positive", "unsupported scale mode", "observation ids must be unique"]


TRIAL = "object_id string, run_id string, trial_index int, raw_m double, sitting_id string, paint_ms long"


def test_spread_needs_repeats(spark):
    rows = [("o", "r", 1, 2.0, "s1", 10), ("o", "r", 2, 2.2, "s1", 30), ("o", "q", 1, 1.0, None, None)]
    stats = {r.run_id: r for r in T.trial_stats(spark.createDataFrame(rows, TRIAL)).collect()}
    two, one = stats["r"], stats["q"]
    assert (two.n, two.median_m, two.nmad_m, two.median_paint_ms) == (2, 2.0, None, 10.0)
    assert two.within_sitting_range_m == pytest.approx(0.2) and two.between_sitting_range_m is None
    assert (one.n, one.within_sitting_range_m, one.median_paint_ms) == (1, None, None)


def test_representative_trial_takes_the_lower_index_on_a_tie(spark):
    rows = [("o", "r", 3, 1.0, "s", 0), ("o", "r", 2, 2.0, "s", 0)]
    chosen = T.representative_trials(spark.createDataFrame(rows, TRIAL)).first()
    assert (chosen.trial_index, chosen.candidates) == (2, 2)


def test_small_errors_read_as_zero(spark):
    row = spark.range(1).select(T.signed_text(F.lit(-0.04), 1).alias("a"), T.signed_text(F.lit(0.06), 1).alias("b"), T.signed_text(F.lit(-3.0), 1).alias("c")).first()
    assert tuple(row) == ("0.0", "+0.1", "-3.0")


def test_memory_prediction_flags_what_was_measured(spark):
    df = spark.createDataFrame([(112, 504), (112, 252), (120, 504), (8, 504)], "f int, r int")
    value, measured = R.predict_memory(F.col("f"), F.col("r"), 7_000_000_000)
    rows = {(r.f, r.r): r for r in df.select("f", "r", value.alias("b"), measured.alias("m")).collect()}
    assert rows[(112, 504)].b == 22848471040 and rows[(112, 504)].m
    assert rows[(112, 252)].b == 22848471040 / 4 and not rows[(112, 252)].m
    assert rows[(120, 504)].b == pytest.approx((22848471040 + 23561502720) / 2)
    assert rows[(8, 504)].b == 7_000_000_000
