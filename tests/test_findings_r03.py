"""One small test per finding of the third round."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import ngram_join, pieces
from plumbline.operators import audits, frames, ground, heights, ledger, masks, pixels, ranks, trials
from plumbline.plans import cloud_plans, fleet_plans, ground_plans, measure_plans, pixel_plans
from tests.conftest import SMALL


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_manifest_text_is_parsed_once(spark):
    plan = optimized(fleet_plans.manifest_round_trip(spark, SMALL))
    assert plan.count("from_json") == 2 and "Join" not in plan


def test_fixed_digits_round_the_exact_value(spark):
    halves = [k / 2000 for k in range(-3001, 3001, 2)] + [0.0625, -0.3125, 2.5, 0.2865, 1e17, 0.0, 4503599627370.4965]
    rows = spark.createDataFrame([(v,) for v in halves], "v double")
    exact = lambda v, d: f"{Decimal(v).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP):.{d}f}"
    for digits in (1, 3):
        found = {r.v: r.t for r in rows.select("v", trials.fixed(F.col("v"), digits).alias("t")).collect()}
        assert found == {v: exact(v, digits) for v in halves}


def test_attempts_updated_at_once_have_one_winner(spark):
    schema = "attempt_id int, run_id int, outcome string, updated_at int"
    rows = [(1, 3, "failed", 5), (1, 9, "failed", 5), (1, 4, "accepted", 5), (1, 10, "failed", 4)]
    for order in (rows, rows[::-1]):
        found = trials.latest_attempts(spark.createDataFrame(order, schema).coalesce(1)).collect()
        assert [tuple(r) for r in found] == [(1, 9, "failed", 5)]


def test_stored_words_are_two_bytes_an_id_and_odd_spaces_keep_their_units(spark):
    import sentencepiece

    texts = ["one two  three", " lead", "trail ", "", None, "a▁ b", "zq xw\nqz", "é☃ plain zqxw", " ", "▁", "x  ▁ y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartition(3)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encode(docs).collect():
        assert r.ids == (model.encode(r.text) if r.text else [])
        assert r.round_trip == (model.decode(r.ids) == (r.text or ""))
    assert pieces._kind(pieces.MODEL) is np.uint16


def test_words_stored_end_to_end_are_checked_one_by_one():
    words = pieces._Words(pieces.MODEL, iter(()))
    units = [pieces.SPACE + "the", "é☃", "ab"]
    ids = [pieces.merged(u) for u in units]

    def differs(parts):
        lengths = np.cumsum([len(u) for u in units])
        flat = np.array([i for part in parts for i in part], words.kind).tobytes()
        return words.any_differs("".join(units), lengths, flat, np.cumsum([len(p) for p in parts]))

    assert not differs(ids)
    assert differs([ids[0], ids[1][:-1], [ids[1][-1], *ids[2]]]) and differs([ids[0], ids[1], ids[0]])


def test_frame_files_are_padded_without_a_formatter(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 42, 9999, 10000, 123456)], "n long").select("n", frames.frame_file(F.col("n")).alias("f"))
    assert {r.n: r.f for r in rows.collect()} == {n: f"frame-{n:04d}.jpg" for n in (1, 42, 9999, 10000, 123456)}
    assert "format_string" not in optimized(fleet_plans.frame_descriptors(spark, SMALL))


def test_wanted_frames_meet_runs_before_these_are_unnested(spark):
    plan = optimized(fleet_plans.closest_frames(spark, SMALL))
    assert plan.index("Generate") < plan.index("Join")


def test_the_last_file_is_last_as_text(spark):
    for group in ([1, 42, 7], [9999, 10000], [10000, 99, 123456], [123456, 20000]):
        rows = spark.createDataFrame([(n,) for n in group], "n long").agg(frames.last_file(F.col("n")).alias("f"))
        assert rows.first().f == max(f"frame-{n:04d}.jpg" for n in group)
    plan = fleet_plans.frame_descriptors(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_words_between_spaces_are_found_as_they_stand(monkeypatch):
    monkeypatch.setattr(pieces, "SPACED", 4)
    words = pieces._Words(pieces.MODEL, iter(()))
    words.turn_to(0)
    texts = ["zq xw zq the", "the zq", "", " lead", "a  b", "a▁ b", "one two\nthree zq-xw", "v w x y z zq", "é☃ the"]
    for text in texts * 2:
        whole = b"".join(words.kind(i).tobytes() for u in pieces.units(text) for i in pieces.merged(u))
        assert words.coded(text) == whole and len(words.spaced) <= 4


def test_edges_are_grouped_without_texts_and_stay_where_they_are(spark):
    words = pieces.dealt(spark.createDataFrame([("▁abab",), ("▁c",)], "unit string"))
    plan = pieces.encode_words(words)._jdf.queryExecution().executedPlan().toString()
    grouping = [line for line in plan.splitlines() if "ObjectHashAggregate" in line]
    assert grouping and all("unit" not in line.split("functions=")[0] for line in grouping)
    assert plan.count("Exchange hashpartitioning") == 1


def test_percentiles_do_not_make_a_sketch_twice(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") % 977).cast("double").alias("v"))
    found = ranks.exact_percentiles(rows, ["g"], F.col("v"), {"low": 2, "mid": 50, "high": 98})
    # A sketch that is made again from parts in another order gives other bins than those already counted.
    assert "percentile_approx" not in optimized(found)
    for r in found.collect():
        own = sorted(i % 977 for i in range(5000) if i % 3 == r.g)
        assert (r.low, r.mid, r.high) == tuple(own[-(-len(own) * p // 100) - 1] for p in (2, 50, 98))
    placed = ranks.with_rank(rows, ["g"], F.col("v"), [])
    assert "percentile_approx" not in optimized(placed) and placed.count() == 5000


def test_a_raster_sorts_only_the_last_selected_points(spark):
    order = ["frame", "px"]
    rows = [(0, f, p, x, 0.5, z, s) for f, p, x, z, s in (
        (1, 1, 0.0, 5.0, False), (1, 2, 0.0, 2.0, False), (2, 1, 1.0, 1.0, False), (1, 3, 1.0, 7.0, True),
        (3, 1, 1.0, 8.0, True), (3, 2, 1.0, 6.0, True), (2, 9, 1.0, 9.0, None), (None, 4, 2.0, 3.0, True), (None, 5, 2.0, 4.0, True), (5, 1, 4.0, 0.0, False),
    )]
    points = spark.createDataFrame(rows, "run_id long, frame long, px long, x double, y double, z double, selected boolean")
    basis = spark.sql("SELECT 0L run_id, 1d rx, 0d ry, 0d rz, 0d sx, 1d sy, 0d sz, 0d fx, 0d fy, 1d fz")
    drawn = audits.raster(points, basis, 3, 3, order)
    found = sorted((r.points, r.depth, r.selected) for r in drawn.collect())
    assert found == [(2, 2.0, False), (2, 4.0, True), (5, 6.0, True)]
    plan = cloud_plans.view_raster(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("SortAggregate") == 2


def test_strokes_are_dealt_by_image_in_bounded_parts(spark, monkeypatch):
    strokes = spark.range(200).selectExpr(
        "id div 5 AS frame", "id AS seq", "double(id * 7 % 40) AS x0", "double(id * 11 % 30) AS y0",
        "double(id * 13 % 40) AS x1", "double(id * 5 % 30) AS y1", "1.5d + id % 4 AS radius", "id % 3 = 2 AS erase",
    )
    whole = {tuple(r) for r in masks.paint(strokes, 40, 30, ["frame"]).collect()}
    monkeypatch.setattr(masks, "STROKES", 30)
    parts = masks.paint(strokes, 40, 30, ["frame"])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 7), REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in parts.collect()} == whole


def test_extents_are_read_from_one_row_per_object_without_joins(spark):
    rows = spark.range(400).selectExpr(
        "1L AS run_id", "concat('o', id % 3) AS object_id", "id % 4 AS frame", "double(id * 37 % 101) / 50 AS h"
    )
    extent = heights.vertical_extent(rows, min_points=30)
    plan = extent._jdf.queryExecution().executedPlan().toString()
    # Each join of the points to themselves pins sort buffers in one task; some twenty of them ran out of memory.
    assert "Join" not in plan and "Join" not in heights.measure_height(rows)._jdf.queryExecution().executedPlan().toString()
    groups = {}
    for i in range(400):
        groups.setdefault((f"o{i % 3}", i % 4), []).append((i * 37 % 101) / 50)
    rank = lambda values, p: sorted(values)[-(-len(values) * p // 100) - 1]
    for r in extent.collect():
        own = groups[r.object_id, r.frame]
        near = [h for h in own if rank(own, 98) - 0.05 <= h <= rank(own, 98) + 0.05]
        spread = 1.4826 * rank([abs(h - rank(near, 50)) for h in near], 50) if len(near) >= 3 else 0.0
        assert (r.bottom, r.top, r.top_roughness) == (rank(own, 2), rank(own, 98), spread)


def test_both_centroids_come_from_one_join(spark):
    rows = [(1, "a", 0, h, h + 1, h, 0.0) for h in (0.0, 0.04, 0.5, 0.98, 1.0)]
    points = spark.createDataFrame(rows, "run_id long, object_id string, frame long, h double, x double, y double, z double")
    wanted = spark.createDataFrame([(1, "a", 0, 0.0, 2.0)], "run_id long, object_id string, frame long, bottom double, top double")
    found = heights.band_centroids(points, wanted, ("bottom", "top"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    r = found.first()
    assert (r.bottom_x, r.top_x, r.top_y) == (1.02, 2.0, 1.0)


def test_the_up_of_an_object_cloud_is_worked_out_once(spark, monkeypatch):
    given = measure_plans.G.estimate_gravity
    # Stands for sums whose parts arrive in another order each time, only larger.
    monkeypatch.setattr(measure_plans.G, "estimate_gravity", lambda f: given(f).withColumn("uy", F.col("uy") + F.rand() / 10))
    kept, planes = measure_plans.object_cloud(spark, SMALL)
    points = {}
    for r in kept.collect():
        points.setdefault(r.run_id, []).append((r.x, r.y, r.z))
    for r in planes.collect():
        along = sorted(r.nx * x + r.ny * y + r.nz * z for x, y, z in points[r.run_id])
        assert abs(along[-(-len(along) * 2 // 100) - 1] - r.elevation) < 1e-9


def test_a_measurement_joins_its_points_only_with_their_masks(spark):
    job = measure_plans.measurement_job(spark, SMALL)
    assert optimized(job).count("Join") == 2


def test_two_passes_put_the_cloud_in_order_once(spark, monkeypatch):
    asked = []
    given = ground.with_ordinal
    monkeypatch.setattr(ground, "with_ordinal", lambda *a, **k: asked.append(1) or given(*a, **k))
    passes = ground_plans.ground_two_pass(spark, SMALL).collect()
    assert len(asked) == 1 and {r["pass"] for r in passes} == {1, 2}


def test_faulty_ports_are_looked_for_once(spark, monkeypatch):
    seen = []
    given = ledger.cut_lineage
    monkeypatch.setattr(ledger, "cut_lineage", lambda df: seen.append(optimized(df)) or given(df))
    steps = spark.createDataFrame([(n, "p", "1", "{}") for n in "abcd"], "node string, producer string, version string, params string")
    edge = "src string, src_port string, dst string, dst_port string"
    sound = [("a", "out", "b", "in"), ("b", "out", "c", "in")]
    found = ledger.desired_keys(steps, spark.createDataFrame(sound, edge), "c").collect()
    assert {r.node for r in found} == set("abcd") and not any("LeftAnti" in plan for plan in seen)
    twice = spark.createDataFrame([*sound, ("a", "out", "c", "in")], edge)
    assert {r.node for r in ledger.desired_keys(steps, twice, "c").collect()} == set("abd")


def test_marks_are_counted_as_they_are_judged_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(pixels, "PIXELS_PER_ROW", 40)
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    rows = []
    for f in range(24):
        turn = 0.3 * (f % 3)
        c, s = float(np.cos(turn)), float(np.sin(turn))
        depth = rng.uniform(1, 4, 12).tolist()
        depth[f % 12] = [nan, inf, None, -1.0][f % 4]
        camera = [3.0, 0.0, 1.5, 0.0, 3.0, 1.0, 0.0, 0.0, 1.0], [c, 0.0, s, 0.1, 0.0, 1.0, 0.0, 0.2, -s, 0.0, c, 0.5 * (f % 2)]
        rows.append((f % 2, f, 4, 3, depth, *camera))
    rows.append((1, 90, 4, 3, [2.0] * 12, [3.0, 0.0, None, 0.0, 3.0, 1.0, 0.0, 0.0, 1.0], rows[0][6]))
    rows.append((1, 91, 4, 3, [2.0] * 11, *rows[0][5:]))
    rows.append((7, 92, 4, 3, [2.0] * 12, *rows[0][5:]))
    schema = "run_id long, frame long, width int, height int, depth array<double>, intrinsics array<double>, extrinsics array<double>"
    given = spark.createDataFrame(rows, schema).withColumn("confidence", F.lit(None).cast("array<double>"))
    spots = [(i % 2, i // 10, i, *map(float, rng.uniform(-3, 4, 3))) for i in range(300)] + [(0, 99, 0, nan, 1.0, 1.0), (1, 99, 1, 0.1, inf, 1.0)]
    marks = audits.overlay_marks(spark.createDataFrame(spots, "run_id long, frame long, px int, x double, y double, z double"), ["px"])
    one_by_one = pixels.view_visibility(marks, given).groupBy("run_id", "frame", "state").count().collect()
    counts = pixels.visibility_counts(marks, given)
    found = {(r.run_id, r.frame, s): r[s] for r in counts.collect() for s in pixels.STATES if r[s]}
    assert found == {tuple(r)[:3]: r[3] for r in one_by_one}
    assert {s for *_, s in found} == set(pixels.STATES) and (1, 90, "visible") not in found
    plan = pixel_plans.mark_visibility(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_m" not in plan


def test_words_are_cut_a_few_at_a_time_and_given_up_as_they_go(monkeypatch):
    rng = np.random.default_rng(5)
    words = {"".join(w) for w in rng.choice(list("aeiounrstl"), (2500, 11))} | {"the", "é☃"}
    whole = {u for u in pieces.units(" ".join(sorted(words))) if u not in pieces.vocabulary()[0]}
    cut, sizes = pieces.units, []
    monkeypatch.setattr(pieces, "CUT", 400)
    monkeypatch.setattr(pieces, "ROW", 300)
    monkeypatch.setattr(pieces, "units", lambda text, path: sizes.append(text.count(" ") + 1) or cut(text, path))
    seen = {"xq☃"}
    rows = list(pieces._handed_on(words, seen, pieces.MODEL))
    assert max(sizes) == 400 and max(map(len, rows)) == 300 and not words and not seen
    found = [u for row in rows for u in row.to_pylist()]
    assert len(found) == len(set(found)) and set(found) == whole | {"xq☃"}


def test_earlier_shingles_are_put_on_where_prefixes_are_compared(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BEFORE", 3)
    hashes = list(range(100, 170))
    rows = [(1, 2, 80, hashes, [0]), (3, 4, 70, hashes, [0]), (5, 6, 2, [7, 8], [0])]
    sets = spark.createDataFrame(rows, "one long, two long, n int, hashes array<long>, sketch array<long>")
    narrow = ngram_join._prefixes(sets, 85)
    assert "before" not in narrow.columns
    found = {(r.one, r.at): (r.hash, r.before) for r in ngram_join._with_before(narrow, sets, 85).collect()}
    # 68 of 80 and 60 of 70 are needed: 70 shared ones leave a prefix of 3 and of 11.
    expected = {(1, k): (100 + k, hashes[max(k - 3, 0) : k]) for k in range(3)}
    expected |= {(3, k): (100 + k, hashes[max(k - 3, 0) : k]) for k in range(11)} | {(5, 0): (7, [])}
    assert found == expected
