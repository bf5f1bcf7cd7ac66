import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ledger as D
from plumbline.operators.poses import frustum_apexes
from plumbline.sources import bundles, catalog, clouds, evidence, manifests, sinks


def write_npz(path, **arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    path.write_bytes(buffer.getvalue())


def arrays(dtype="f4", order="C"):
    depth = np.asarray(np.arange(24).reshape(2, 3, 4), dtype, order=order)
    return dict(
        depth=depth,
        confidence=depth + 1,
        intrinsics=np.tile(np.eye(3, dtype="f4"), (2, 1, 1)),
        extrinsics=np.tile(np.eye(4, dtype="f4")[:3], (2, 1, 1)),
    )


def test_bundles_become_frames_and_bad_ones_are_set_aside(spark, tmp_path):
    write_npz(tmp_path / "good" / "bundle.npz", **arrays())
    write_npz(tmp_path / "wide" / "bundle.npz", **{**arrays(), "depth": arrays("f8")["depth"]})
    write_npz(tmp_path / "fortran" / "bundle.npz", **{**arrays(), "depth": np.asfortranarray(arrays()["depth"])})
    write_npz(tmp_path / "bare" / "bundle.npz", depth=arrays()["depth"])
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "bundle.npz").write_bytes((tmp_path / "good" / "bundle.npz").read_bytes()[:80])
    frames, quarantine = bundles.read_bundles(spark, str(tmp_path))
    rows = frames.orderBy("frame").collect()
    assert [(r.run_id, r.frame, r.width, r.height) for r in rows] == [("good", 0, 4, 3), ("good", 1, 4, 3)]
    assert rows[1].depth[0] == 12.0 and rows[1].confidence[0] == 13.0 and len(rows[0].extrinsics) == 12
    reasons = {r.run_id: r.error for r in quarantine.collect()}
    assert set(reasons) == {"wide", "fortran", "bare", "cut"}
    assert "float32" in reasons["wide"] and "Fortran" in reasons["fortran"] and "intrinsics" in reasons["bare"]
    bundles.write_frames(frames, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("run_id = 'good'").count() == 2


def glb(points, colours, lines, alignment):
    blobs = [np.asarray(points, "<f4").tobytes(), np.asarray(colours, "u1").tobytes()]
    blobs += [np.asarray(line, "<f4").tobytes() for line in lines]
    views, at = [], 0
    for blob in blobs:
        views.append({"byteOffset": at, "byteLength": len(blob)})
        at += len(blob)
    kinds = [(5126, "VEC3", len(points)), (5121, "VEC4", len(points))] + [(5126, "VEC3", len(line)) for line in lines]
    doc = {
        "accessors": [{"bufferView": i, "componentType": c, "type": t, "count": n} for i, (c, t, n) in enumerate(kinds)],
        "bufferViews": views,
        "meshes": [{"primitives": [{"mode": 0, "attributes": {"POSITION": 0, "COLOR_0": 1}}]}]
        + [{"primitives": [{"mode": 1, "attributes": {"POSITION": 2 + i}}]} for i in range(len(lines))],
        "scenes": [{"extras": {"hf_alignment": alignment}}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = b"".join(blobs)
    whole = 12 + 8 + len(text) + 8 + len(body)
    return struct.pack("<4sII", b"glTF", 2, whole) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def test_exported_clouds_become_points_outlines_and_alignment(spark, tmp_path):
    apex = [[0, 0, 0], [1, 1, 1], [0, 0, 0], [1, -1, 1]]
    tie = [[0, 0, 0], [1, 1, 1], [0, 0, 0], [1, 1, 1]]
    good = glb([[i, 0, 0] for i in range(5)], [[i, 2, 3, 255] for i in range(5)], [apex, tie], np.eye(4).tolist())
    for run, content in {"a": good, "cut": good[:-4], "junk": b"nope" * 10}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "scene.glb").write_bytes(content)
    points, outlines, alignments, bad = clouds.read_clouds(spark, str(tmp_path))
    rows = points.orderBy("px").collect()
    assert [(r.x, r.r, r.g) for r in rows] == [(float(i), i, 2) for i in range(5)]
    assert alignments.first().alignment[5] == 1.0
    assert {r.run_id for r in bad.collect()} == {"cut", "junk"}
    found = frustum_apexes(outlines).collect()
    assert [(r.frustum, r.x, r.y, r.z) for r in found] == [(0, 0.0, 0.0, 0.0)]


def packet(run="r", trial="o:r#1", at="2026-01-01T00:00:00Z", digest="d1", ruler=None, live=None):
    mask = {"digest": digest, "runs": [1, 2], "width": 4, "height": 4} if digest else None
    return {
        "runId": run,
        "target": {"id": "o", "code": "T1", "name": "n", "truthM": 2.0},
        "observation": {"id": trial, "objectId": "o", "runId": "r", "rawM": 2.1, "capturedAt": at, "sittingId": "s", "mask": mask, "ruler": ruler},
        "live": live,
    }


def test_packets_are_read_once_each_and_broken_ones_hide_nothing(spark, tmp_path):
    first, second = tmp_path / "a", tmp_path / "b"
    first.mkdir(), second.mkdir()
    ruler = {"bottom": [0.0, 0.0, 0.0], "top": [0.0, 2.0, 0.0]}
    (first / "1.json").write_text(json.dumps(packet(live={"measurement": {"ruler": ruler, "rulerKind": "extent"}})))
    (first / "2.json").write_text("{ not json")
    (second / "1.json").write_text(json.dumps({**packet(), "schemaVersion": "copy"}))
    (second / "3.json").write_text(json.dumps(packet(trial="o:r#2", digest=None)))
    found = evidence.read_packets(spark, str(first), str(second))
    rows = {r.evidenceId: r for r in evidence.recovered_ruler(found).collect()}
    assert set(rows) == {"o:r#1@s@2026-01-01T00:00:00Z@d1", "o:r#2@s@2026-01-01T00:00:00Z@no-mask"}
    kept = rows["o:r#1@s@2026-01-01T00:00:00Z@d1"]
    assert kept.schemaVersion is None and kept.observation.ruler.top == [0.0, 2.0, 0.0]


def test_storing_refuses_faults_and_is_repeatable(spark, tmp_path):
    texts = [json.dumps(p) for p in (packet(), packet(run="other"), packet(trial="o:r#2", digest=None))]
    rows = evidence.parse_packets(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    path = str(tmp_path / "store")
    refused = evidence.store_packets(rows, path)
    assert sorted(r.fault for r in refused.collect()) == ["no frozen mask", "run id does not match"]
    assert evidence.live_packets(spark, path).count() == 1
    evidence.store_packets(rows, path)
    assert evidence.live_packets(spark, path).count() == 1


def test_a_packet_stored_again_replaces_the_stored_one(spark, tmp_path):
    def sent(*rows):
        texts = [json.dumps({**packet(trial=t), "schemaVersion": v, "storedAt": at}) for t, v, at in rows]
        return evidence.parse_packets(spark.createDataFrame([(t,) for t in texts], "text string"), "text")

    def held():
        return {r.observation.id: r.schemaVersion for r in evidence.live_packets(spark, path).collect()}

    path = str(tmp_path / "store")
    first, later = "2026-01-01T00:00:00Z", "2026-01-01T00:00:00.500Z"
    evidence.store_packets(sent(("o:r#1", "b", later), ("o:r#1", "a", first), ("o:r#2", "a", first), ("o:r#3", "a", later)), path)
    assert held() == {"o:r#1": "b", "o:r#2": "a", "o:r#3": "a"}
    again = sent(("o:r#2", "c", later), ("o:r#3", "old", first), ("o:r#4", "a", None))
    for _ in range(2):
        evidence.store_packets(again, path)
        assert held() == {"o:r#1": "b", "o:r#2": "c", "o:r#3": "a", "o:r#4": "a"}
        assert evidence.live_packets(spark, path).count() == 4
    evidence.store_packets(sent(("o:r#1", "d", None)), path)
    assert held() == {"o:r#1": "b", "o:r#2": "c", "o:r#3": "a", "o:r#4": "a"}


def test_manifest_defaults_and_round_trip(spark, tmp_path):
    wire = {"run_id": "r", "frames": {"count": 3, "width": 4, "height": 5}, "vram": {"peak_bytes": 9}, "diagnostics": {"native_npz": {"a.npz": ["depth"]}}}
    (tmp_path / "m.json").write_text(json.dumps(wire, indent=2))
    first = manifests.read_manifests(spark, str(tmp_path / "m.json"))
    row = manifests.flat_runs(first).first()
    assert (row.torch_peak_bytes, row.baseline_bytes, row.mock, row.artifacts, row.frame_count) == (0, 0, False, [], 3)
    manifests.write_manifests(first, str(tmp_path / "out"))
    again = manifests.read_manifests(spark, str(tmp_path / "out"))
    assert manifests.to_wire(again).collect() == manifests.to_wire(first).collect()


def test_frame_files_follow_their_number(spark, tmp_path):
    for name in ("frame-10.jpg", "frame-9.JPG", "cover.jpg", "frame-1.png"):
        (tmp_path / name).write_bytes(b"x")
    listed = catalog.frame_files(catalog.list_files(spark, str(tmp_path))).collect()
    assert [r.name for r in listed] == ["frame-9.JPG", "frame-10.jpg"]


def test_file_audit_reads_headers(spark, tmp_path):
    run = tmp_path / "r"
    run.mkdir()
    good = glb([[0, 0, 0]], [[0, 0, 0, 0]], [], np.eye(4).tolist())
    (run / "scene.glb").write_bytes(good)
    (run / "cut.glb").write_bytes(good[:-1])
    (run / "few.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 12\nend_header\n")
    facts = catalog.file_facts(spark, str(tmp_path))
    expected = facts.select("run_id", "name", F.col("length").alias("size_bytes"), F.col("digest").alias("sha256"))
    status = {r.name: r.status for r in catalog.artifact_status(expected, facts).collect()}
    assert status == {"scene.glb": "ok", "cut.glb": "truncated", "few.ply": "too few vertices"}


def test_cloud_text_has_header_and_ordered_lines(spark, tmp_path):
    rows = [("r", 0, i, i / 3, 0.0, 1e-6, 1, 2, 3) for i in range(10)]
    points = spark.createDataFrame(rows, "run_id string, frame int, px int, x double, y double, z double, r int, g int, b int")
    sinks.write_cloud_text(points, str(tmp_path / "out"), 5, ["px"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "lines")).collect()]
    assert len(lines) == 5 and lines[0] == "0 0 1e-06 1 2 3" and lines[1] == f"{2 / 3:.7g} 0 1e-06 1 2 3"
    head = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "headers")).collect())
    assert "element vertex 5" in head


def test_content_keys_ignore_map_order_and_follow_inputs(spark):
    digest = "a" * 64
    row = spark.range(1).select(
        D.content_key(F.lit("p"), F.lit("1"), F.create_map(F.lit("b"), F.lit(digest), F.lit("a"), F.lit(digest)), F.lit('{"x":1}'), "c/1").alias("k")
    ).first()
    import hashlib

    text = f'{{"contract_version":"c/1","input_content_sha256":{{"a":"{digest}","b":"{digest}"}},"parameters":{{"x":1}},"producer_node":"p","producer_version":"1"}}'
    assert row.k == hashlib.sha256(text.encode()).hexdigest()


def test_cycles_are_left_without_a_key(spark):
    steps = spark.createDataFrame([(n, "p", "1", "{}") for n in "abcd"], "node string, producer string, version string, params string")
    edges = spark.createDataFrame([("a", "o", "b", "i"), ("c", "o", "d", "i"), ("d", "o", "c", "i")], "src string, src_port string, dst string, dst_port string")
    keyed = {r.node for r in D.desired_keys(steps, edges, "c/1").collect()}
    assert keyed == {"a", "b"}
    reach = {(r.root, r.node) for r in D.closure(edges, steps.where("node in ('a', 'c')").select("node")).collect()}
    assert reach == {("a", "b"), ("c", "d")}


@pytest.mark.parametrize("value,text", [(0.1, "0.1"), (123456789.0, "1.234568e+08"), (1e-6, "1e-06"), (-2.0, "-2")])
def test_seven_digit_text(spark, value, text):
    assert spark.range(1).select(sinks.seven_digits(F.lit(value)).alias("t")).first().t == text
