"""Cases that once lost rows, kept an arbitrary one or gave a wrong answer."""

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import audits, cloud, fleet, ledger, trials
from plumbline.sources import catalog


def test_no_mark_is_lost(spark):
    points = spark.range(9000).select(
        F.lit(1).alias("run_id"), (F.col("id") % 3).cast("int").alias("frame"), F.col("id").alias("px"),
        *(F.col("id").cast("double").alias(c) for c in "xyz"),
    )
    rows = audits.overlay_marks(points, ["px"]).collect()
    assert sorted(m.i for r in rows for m in r.marks) == list(range(9000))
    assert max(len(r.marks) for r in rows) <= audits.MARKS_PER_ROW


def test_far_voxels_stay(spark):
    rows = [(1, 0, 0, 1e9, 0.0, 0.0, 1.0, 1.0), (1, 0, 1, 0.0, 0.0, 0.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "run_id int, frame int, px int, x double, y double, z double, weight double, confidence double")
    assert cloud.voxel_grid(points, 0.01).count() == 2
    assert cloud.voxel_refusals(points, 0.01).collect()[0].out_of_range == 1


def test_a_sphere_wider_than_a_cell(spark):
    points = spark.createDataFrame([(1, 3.0, 0.0, 0.0), (1, 6.0, 0.0, 0.0)], "run_id int, x double, y double, z double")
    centres = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 5.0)], "run_id int, label string, cx double, cy double, cz double, radius double")
    assert [r.x for r in audits.select_near(points, centres, 1.0).collect()] == [3.0]


def test_a_save_after_a_delete_does_not_revive(spark):
    events = [(1, 1, "register"), (1, 2, "delete"), (1, 3, "save"), (2, 1, "register"), (2, 2, "save"), (2, 3, "delete"), (2, 4, "register"), (3, 1, "register"), (3, 2, "save")]
    df = spark.createDataFrame([(*e, False, 1.0) for e in events], "run_id int, seq int, action string, builtin boolean, value double")
    assert {r.run_id: r.persisted for r in fleet.current_registry(df).collect()} == {2: False, 3: True}


def test_two_edges_into_one_port(spark):
    steps = spark.createDataFrame([(n, "p", "1", "{}") for n in "abcd"], "node string, producer string, version string, params string")
    edges = spark.createDataFrame([("a", "o", "c", "i"), ("b", "o", "c", "i"), ("a", "o", "d", "i")], "src string, src_port string, dst string, dst_port string")
    keyed = {r.node for r in ledger.desired_keys(steps, edges, "v").collect()}
    assert keyed == {"a", "b", "d"}
    fault = ledger.port_faults(edges).collect()
    assert [(r.node, r.dst_port, r.sources) for r in fault] == [("c", "i", 2)]


def test_merged_trials_do_not_follow_row_order(spark):
    schema = "trial_id string, captured_at timestamp_ntz, raw_m double, stored_seq int"
    local = spark.createDataFrame([], schema)
    rows = [("t", None, 2.0, 1), ("t", None, 1.0, 2)]
    for order in (rows, rows[::-1]):
        kept = trials.merge_trials(local, spark.createDataFrame(order, schema)).collect()
        assert [r.raw_m for r in kept] == [2.0]


def test_removal_takes_trials_of_its_clips_only(spark):
    targets = spark.createDataFrame([(1, "a", False), (2, "a", False), (1, "b", True)], "clip_key int, object_id string, builtin boolean")
    tried = spark.createDataFrame([("a", 10), ("a", 20), ("b", 10), ("a", 30)], "object_id string, run_id int")
    runs = spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "clip_key int, run_id int")
    gone = spark.createDataFrame([(1, "a"), (1, "b")], "clip_key int, object_id string")
    kept_targets, kept = trials.remove_target(targets, tried, gone, runs)
    assert sorted((r.object_id, r.run_id) for r in kept.collect()) == [("a", 20), ("a", 30), ("b", 10)]
    assert kept_targets.count() == 2


def test_small_scales_invert_and_projective_ones_do_not(spark):
    small = [5e-5, 0, 0, 1, 0, 5e-5, 0, 2, 0, 0, 5e-5, 3, 0, 0, 0, 1]
    projective = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0.5, 1]
    df = spark.createDataFrame([(1, [float(v) for v in small]), (2, [float(v) for v in projective]), (3, [0.0] * 15 + [1.0])], "i int, m array<double>")
    found = {r.i: r.inv for r in df.select("i", V.invert_rigid4(F.col("m")).alias("inv")).collect()}
    assert abs(found[1][0] - 2e4) < 1e-6 and found[2] is None and found[3] is None


def test_a_repeated_batch_has_one_winner(spark):
    schema = "label string, frames int, process_res int, batch long, peak double"
    one, two = [("a", 1, 2, 5, 1.0)], [("a", 1, 2, 5, 3.0)]
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    assert fleet.upsert_rungs(a, b).collect() == fleet.upsert_rungs(b, a).collect()


def test_a_long_header_still_gives_its_vertices(spark, tmp_path):
    folder = tmp_path / "run1"
    folder.mkdir()
    header = "ply\nformat ascii 1.0\n" + "comment x\n" * 400 + "element vertex 5\nend_header\n"
    (folder / "long.ply").write_text(header)
    (folder / "none.ply").write_text("ply\nformat ascii 1.0\nend_header\nelement vertex 9\n")
    facts = catalog.file_facts(spark, str(tmp_path))
    assert {r["name"]: r.vertices for r in facts.collect()} == {"long.ply": 5, "none.ply": None}
    expected = facts.select("run_id", "name", F.col("length").alias("size_bytes"), F.col("digest").alias("sha256"))
    status = {r["name"]: r.status for r in catalog.artifact_status(expected, facts).collect()}
    assert status["none.ply"] == "no vertex count"


def test_runs_without_points_or_up_are_refused(spark):
    from plumbline.operators import ground

    schema = "run_id int, frame int, px int, x double, y double, z double, weight double"
    rows = [(1, 0, i, float(i % 7), 0.001 * (i % 3), float(i // 7), 1.0) for i in range(60)] + [(2, 0, 0, float("nan"), 0.0, 0.0, 1.0), (3, 0, 0, 1.0, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, schema)
    ups = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (2, 0.0, 1.0, 0.0)], "run_id int, ux double, uy double, uz double")
    found = ground.fit_ground(points, ups, ground.MEASUREMENT_FIT, points.select("run_id")).collect()
    reason = {r.run_id: r.reason for r in found if r.run_id != 1}
    assert reason == {2: "no finite points", 3: "no up direction"} and any(r.run_id == 1 for r in found)
    best = ground.fit_ground_robust(points, ups, ground.MEASUREMENT_FIT, points.select("run_id")).collect()
    assert {r.run_id: r.reason for r in best if r.run_id != 1} == reason
    one = ground.replace(ground.MEASUREMENT_FIT, seeds=ground.MEASUREMENT_FIT.seeds[:1], pools=ground.MEASUREMENT_FIT.pools[:1])
    twice = ground.fit_two_pass(points, ups, one, points.select("run_id")).collect()
    assert {r.run_id for r in twice if r["pass"] == 1} == {r.run_id for r in twice if r["pass"] == 2} >= {2, 3}


def test_a_packet_sent_again_replaces(spark, tmp_path):
    from plumbline.streaming import evidence

    path = str(tmp_path / "packets")
    rows = [[("a", 2, 6.0), ("b", 1, 7.0)], [("a", 1, 5.0), ("c", 3, 1.0)]]
    write = evidence.table_writer(path, ["event_id"])
    for epoch, batch in enumerate(rows + rows[1:]):
        write(spark.createDataFrame(batch, "evidence_id string, event_id int, value double"), min(epoch, 1))
    kept = evidence.kept_packets(spark, path, ["event_id"]).collect()
    assert {r.evidence_id: r.value for r in kept} == {"a": 6.0, "b": 7.0, "c": 1.0}
