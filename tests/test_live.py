"""Replay, live phases and sittings, the versioned store, and the distance to the nearest outline."""

import json
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline.operators import poses, replay
from plumbline.sources import evidence, versions
from plumbline.streaming import evidence as live, phases, runs


# ---- phases


def walked(snapshots, last=0, floor=None):
    out = []
    for phase, used in snapshots:
        entered = phase == phases.INFERRING and last != phases.INFERRING
        floor, last = used if entered else floor, phase
        out.append((entered, floor))
    return out


def test_folding_is_walking():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(rng.randrange(3), rng.randrange(1, 99)) for _ in range(rng.randrange(1, 12))]
        last, floor = rng.randrange(3), rng.choice([None, 7])
        phase, used = (np.array(v) for v in zip(*rows))
        entered, floors, known = phases.folded(phase, used, last, floor)
        got = [(bool(e), int(f) if k else None) for e, f, k in zip(entered, floors, known)]
        assert got == walked(rows, last, floor)


TELEMETRY = "run_id long, event_id long, ts timestamp, used_bytes long, available boolean, model_loaded boolean"


def test_late_snapshots_change_nothing(spark, tmp_path):
    parts = [
        [(1, 1, "2024-01-01 00:00:01", 5, True, True), (1, 3, "2024-01-01 00:00:03", 7, True, None), (2, 1, "2024-01-01 00:00:01", 9, None, True)],
        [(1, 2, "2024-01-01 00:00:02", 6, True, True), (1, 4, "2024-01-01 00:00:04", 8, True, True), (1, 9, None, 8, True, True)],
        [(1, 5, "2024-01-01 00:00:05", 1, True, True)],
    ]
    folder, files = str(tmp_path / "out"), str(tmp_path / "in")
    with runs.state_store(spark):
        for part in parts:
            rows = spark.createDataFrame([], TELEMETRY).union(
                spark.createDataFrame(part, TELEMETRY.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
            )
            rows.write.mode("append").parquet(files)
            runs.run_available(phases.phases_stream(spark.readStream.schema(TELEMETRY).parquet(files)), folder, "append")
    got = {(r.run_id, r.event_id): (r.phase, r.entered, r.floor_bytes, r.late) for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {
        (1, 1): ("inferring", True, 5, False),
        (1, 3): ("loadingModel", False, 5, False),
        (2, 1): ("waking", False, None, False),
        (1, 2): ("inferring", False, None, True),
        (1, 9): ("inferring", False, None, True),
        (1, 4): ("inferring", True, 8, False),
        (1, 5): ("inferring", False, 8, False),
    }


def test_a_sitting_cut_by_micro_batches_is_one(spark, tmp_path):
    folder, files = str(tmp_path / "out"), str(tmp_path / "in")
    schema = "run_id long, captured_at timestamp, raw_m double"
    for minutes in ([0, 10], [35, 50], [95], [5000]):
        rows = spark.createDataFrame([(1, m, m / 10) for m in minutes], "run_id long, m int, raw_m double")
        at = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)")
        rows.select("run_id", at.alias("captured_at"), "raw_m").write.mode("append").parquet(files)
        stream = spark.readStream.schema(schema).parquet(files).withWatermark("captured_at", "1 hour")
        runs.run_available(live.sittings(stream, ["run_id"]), folder, "append")
    got = sorted((r.trials, r.min_m, r.max_m) for r in spark.read.parquet(f"{folder}/rows").collect())
    assert got == [(1, 9.5, 9.5), (4, 0.0, 5.0)]


# ---- the store


def packets(spark, *rows):
    """(id, raw reading, time) as packets of run r."""
    texts = [
        json.dumps(
            {
                "runId": "r",
                "storedAt": at,
                "observation": {"id": i, "objectId": i[0], "runId": "r", "rawM": raw, "mask": {"digest": "d", "runs": [1, 2]}},
            }
        )
        for i, raw, at in rows
    ]
    return evidence.parse_packets(spark.createDataFrame([(t,) for t in texts], "text string"), "text")


def held(spark, path, version=None):
    return {r.observation.id: r.observation.rawM for r in evidence.live_packets(spark, path, version).collect()}


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert held(spark, path) == {} and versions.current(spark, path) == (0, [])
    evidence.store_packets(packets(spark, ("a1", 1.0, "2024-01-01T00:00:00Z"), ("b1", 2.0, None)), path)
    # A job that stops between its data and its commit leaves files nobody reads.
    lost = packets(spark, ("a1", 9.0, "2024-01-05T00:00:00Z")).withColumn("archive", F.lit(None).cast(evidence.ARCHIVE))
    versions.write_batch(lost, path, 2)
    assert held(spark, path) == {"a1": 1.0, "b1": 2.0}
    evidence.store_packets(packets(spark, ("a1", 3.0, "2024-01-02T00:00:00Z"), ("c1", 4.0, None)), path)
    assert held(spark, path) == {"a1": 3.0, "b1": 2.0, "c1": 4.0}
    assert held(spark, path, 1) == {"a1": 1.0, "b1": 2.0}
    with pytest.raises(AnalysisException):  # a version that is there is never written again
        versions.commit(spark, path, 2, "again", [])
    assert held(spark, path) == {"a1": 3.0, "b1": 2.0, "c1": 4.0}


def test_archiving_keeps_every_event(spark, tmp_path):
    path = str(tmp_path / "store")
    first = packets(spark, ("a1", 1.0, "2024-01-01T00:00:00Z"), ("b1", 2.0, "2024-01-01T00:00:00Z"))
    registry = spark.createDataFrame([("r", "clip", "sha", True)], "run_id string, clip_name string, clip_sha256 string, builtin boolean")
    assert evidence.store_packets(first, path, registry).count() == 0
    assert evidence.store_packets(first, path, registry.where("FALSE")).head().fault == "no such run"
    only = spark.createDataFrame([("a",)], "object_id string")
    at = F.lit("2024-02-01T00:00:00Z")
    assert evidence.archive_packets(spark, path, "removed", at, object_ids=only).count() == 1
    assert held(spark, path) == {"b1": 2.0}
    evidence.store_packets(packets(spark, ("a1", 5.0, "2023-01-01T00:00:00Z")), path)
    assert held(spark, path) == {"a1": 5.0, "b1": 2.0}
    evidence.archive_packets(spark, path, "again", at, object_ids=only)
    gone = sorted((r.archive.seq, r.archive.reason, r.observation.rawM) for r in evidence.archived_packets(spark, path).collect())
    assert gone == [(1, "removed", 1.0), (2, "again", 5.0)] and held(spark, path) == {"b1": 2.0}
    evidence.compact_packets(spark, path)
    assert len(versions.current(spark, path)[1]) == 1
    assert held(spark, path) == {"b1": 2.0} and evidence.archived_packets(spark, path).count() == 2
    assert evidence.live_packets(spark, path).head().storage.clip_name == "clip"


def test_a_retried_batch_is_added_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, 2)], "k int, v int")
    assert [versions.append(rows, path, "t1"), versions.append(rows, path, "t1"), versions.append(rows, path)] == [1, 1, 2]
    assert versions.read(spark, path).count() == 2


# ---- nearest outline


def test_nearest_distances_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    near = [(1, i, *(rng.uniform(-3, 3) for _ in range(3))) for i in range(40)]
    far = [(2, i, 500.0 + i, rng.uniform(-1, 1), -700.0) for i in range(10)]
    marks = [(1, *(rng.uniform(-3, 3) for _ in range(3))) for _ in range(30)] + [(2, 0.0, 0.0, float(i)) for i in range(10)]
    odd = [(1, 99, float("nan"), 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame([(*p, 0.01 * p[0]) for p in near + far + odd], "run_id int, i int, x double, y double, z double, tol double")
    given = spark.createDataFrame(marks, "run_id int, ax double, ay double, az double")
    got = {(r.run_id, r.i): r.nearest for r in poses.nearest_distances(points, given, "tol").collect()}
    assert got.pop((1, 99)) is None and got.pop((3, 0)) is None
    for run, i, *at in near + far:
        best = min(sum((a - b) ** 2 for a, b in zip(at, m[1:])) ** 0.5 for m in marks if m[0] == run)
        assert got[run, i] == pytest.approx(best, abs=1e-12)
    assert poses.nearest_distances(points.where("run_id = 3"), given, "tol").head().nearest is None


# ---- replay


def replayable(spark, side=6):
    """One trial over a slope of depths: a 12 x 12 mask on a 6 x 6 frame."""
    depth = [2.0 + 0.1 * (k // side) for k in range(side * side)]
    frame = (1, 5, side, side, depth, [1.0] * side * side, [6.0, 0.0, 2.5, 0.0, 6.0, 2.5, 0.0, 0.0, 1.0], [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0])
    frames = spark.createDataFrame(
        [tuple([float(v) for v in c] if isinstance(c, list) else c for c in frame)],
        "run_id long, frame long, width int, height int, depth array<double>, confidence array<double>, intrinsics array<double>, extrinsics array<double>",
    )
    runs_ = [0, 144]
    trial = ("t", 1, "o", 5, "vertical_extent", 12, 12, runs_, None, 0.0, -1.0, 0.0, 0.0)
    schema = "trial_id string, run_id long, object_id string, frame long, mode string, mask_width int, mask_height int, runs array<int>, digest string, nx double, ny double, nz double, d double"
    trials = spark.createDataFrame([trial], schema)
    digest = replay.mask_digest(F.col("mask_width"), F.col("mask_height"), F.col("runs"))
    return trials.withColumn("digest", digest), frames


def test_replay_tells_the_stages_apart(spark):
    trials, frames = replayable(spark)
    read = replay.measure_again(trials, frames, min_points=4).collect()[0]
    # Rows 1..4 survive the erosion: y = (row - 2.5) * depth / 6, up is -y, nearest ranks 2 and 98 are the ends.
    ys = [(r - 2.5) * (2.0 + 0.1 * r) / 6 for r in range(1, 5)]
    assert read.replay_m == pytest.approx(max(ys) - min(ys)) and read.point_count == 16
    assert read.control_m == pytest.approx(read.replay_m) and (read.round_trip_hits, read.round_trip_misses) == (16, 0)
    stored = trials.withColumn("stored_m", F.lit(read.replay_m))

    def stage(rows, now, **limits):
        return replay.replay(rows, now, **({"min_points": 4} | limits)).head().stage

    assert stage(stored, frames) is None
    assert stage(stored.withColumn("digest", F.lit("x")), frames) == "mask"
    assert stage(stored.withColumn("runs", F.array().cast("array<int>")), frames) == "mask"
    assert stage(stored, frames.where("FALSE")) == "frame"
    assert stage(stored, frames, min_points=17) == "measure"
    moved = frames.withColumn("depth", F.transform("depth", lambda d: d * 1.001))
    assert stage(stored, moved) == "replay"
    assert replay.replay(stored.where("FALSE"), frames).count() == 0


def test_the_mask_of_round_trip_grows_by_one_pixel(spark):
    from plumbline.operators import audits

    _, frames = replayable(spark)
    points = [(1, "o", 5, (x - 2.5) * 2.0 / 6, -2.5 * 2.0 / 6, 2.0) for x in (0.0, 1.0, 2.0, 3.0)]
    points = spark.createDataFrame(points, "run_id long, object_id string, frame long, wx double, wy double, wz double")
    mask = spark.createDataFrame([(1, "o", 5, 0, 0)], "run_id long, object_id string, frame long, x long, y long")
    got = audits.round_trip(points, frames, mask).head()
    assert (got.hits, got.misses) == (2, 2)
