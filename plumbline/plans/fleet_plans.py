"""Frame numbering, fleet rules, manifests, registry, files-as-rows and ledger jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.operators import fleet as R, frames as J, ledger as D
from plumbline.operators.cloud import cloud_stats
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6, r6s
from plumbline.sources import catalog, manifests
from plumbline.streaming import runs as SR

RUNS = A.cte("runs")
DESCRIBED = """d AS (SELECT run_id, i AS npz_index, frame_count,
        CASE WHEN frame_count >= 128 THEN i + 1 ELSE CAST(floor(i * 127 / CAST(frame_count - 1 AS DOUBLE) + 5e-1) AS BIGINT) + 1 END AS spread, fps
      FROM (SELECT *, unnest(range(frame_count)) AS i FROM runs)),
    named AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN spread ELSE npz_index + 1 END AS canonical_index FROM d)"""


def described_runs(spark: SparkSession, sf: str) -> DataFrame:
    return A.runs(spark, sf).select(
        "run_id",
        "frame_count",
        "fps",
        F.lit(None).cast("double").alias("effective_fps"),
        (F.col("run_id") % 2 == 0).alias("canonical_frames"),
    )


@plan(
    "frame_descriptors",
    "J2, J3",
    RUNS
    + f""", {DESCRIBED} SELECT run_id, count(*) AS frames, CAST(sum(canonical_index) AS BIGINT) AS index_sum, max(canonical_index) AS last_index,
      max(printf('frame-%04d.jpg', canonical_index)) AS last_file, {r6('sum(npz_index / CAST(fps AS DOUBLE))', 'time_sum')} FROM named GROUP BY ALL""",
)
def frame_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    rows = J.recorded_descriptors(described_runs(spark, sf), 128)
    return publish(
        rows.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("frames"),
            F.sum("canonical_index").alias("index_sum"),
            F.max("canonical_index").alias("last_index"),
            J.last_file(F.col("canonical_index")).alias("last_file"),
            F.sum("timestamp_s").alias("time_sum"),
        )
    )


@plan(
    "closest_frames",
    "J1",
    RUNS
    + f""", {DESCRIBED} SELECT run_id, wanted, npz_index, canonical_index FROM (
      SELECT run_id, run_id % 150 AS wanted, npz_index, canonical_index, row_number() OVER (PARTITION BY run_id
        ORDER BY abs(canonical_index - run_id % 150), npz_index) AS k FROM named) WHERE k = 1""",
)
def closest_frames(spark: SparkSession, sf: str) -> DataFrame:
    runs = described_runs(spark, sf)
    wanted = runs.select("run_id", (F.col("run_id") % 150).alias("wanted"))
    return publish(J.closest_frames(J.recorded_descriptors(runs.join(wanted, "run_id"), 128, "wanted")))


@plan(
    "frame_ladder",
    "R9, J2",
    RUNS
    + """, l AS (SELECT run_id, frame_count, unnest([8, 32, 64, 112]) AS rung FROM runs),
    p AS (SELECT *, unnest(range(rung)) AS i FROM l WHERE rung <= frame_count)
    SELECT run_id AS clip_key, CAST(rung AS BIGINT) AS rung, count(*) AS picks,
      CAST(sum(CAST(floor(i * (frame_count - 1) / CAST(rung - 1 AS DOUBLE) + 5e-1) AS BIGINT)) AS BIGINT) AS index_sum FROM p GROUP BY ALL""",
)
def frame_ladder(spark: SparkSession, sf: str) -> DataFrame:
    clips = A.runs(spark, sf).select(
        F.col("run_id").alias("clip_key"),
        F.col("frame_count").alias("extracted"),
        F.array(*(F.lit(n) for n in (8, 32, 64, 112))).alias("counts"),
    )
    return publish(
        J.ladder(clips).groupBy("clip_key", "rung").agg(
            F.count(F.lit(1)).alias("picks"), F.sum("source_index").alias("index_sum")
        )
    )


@plan(
    "capture_plans",
    "R5, R6, R7, R8",
    RUNS
    + f""", p AS (SELECT *, greatest(1, CAST(floor(fps * duration_s) AS BIGINT)) AS asked, 90 * (run_id % 5) - 90 AS turn,
           greatest(width, height) AS longest FROM runs),
    q AS (SELECT *, CASE WHEN asked > 112 THEN 112 ELSE asked END AS plan_frames,
           greatest(2, CAST(floor(width * (1024e0 / longest) / 2e0 + 5e-1) AS BIGINT) * 2) AS w,
           greatest(2, CAST(floor(height * (1024e0 / longest) / 2e0 + 5e-1) AS BIGINT) * 2) AS h FROM p)
    SELECT run_id, plan_frames, {r6('CASE WHEN asked > 112 THEN 112 / duration_s ELSE fps END', 'effective_fps')}, asked > 112 AS capped, w AS plan_width, h AS plan_height,
      CAST((turn + 360) % 360 AS BIGINT) AS rotation, CAST(CASE WHEN (turn + 360) % 180 = 90 THEN height ELSE width END AS BIGINT) AS shown_width,
      CAST(floor(plan_frames * w * h * 83e-3 + 5e-1) AS BIGINT) AS low_bytes, CAST(floor(plan_frames * w * h * 156e-3 + 5e-1) AS BIGINT) AS high_bytes FROM q""",
)
def capture_plans(spark: SparkSession, sf: str) -> DataFrame:
    runs = A.runs(spark, sf)
    count, fps, capped = J.sample_plan(F.col("fps"), F.col("duration_s"), F.lit(112))
    width, height, _ = J.scale_plan(F.col("width"), F.col("height"))
    turn, shown, _ = J.display_size(F.col("width"), F.col("height"), F.lit(90) * (F.col("run_id") % 5) - 90)
    planned = runs.select(
        "run_id",
        count.alias("plan_frames"),
        fps.alias("effective_fps"),
        capped.alias("capped"),
        width.alias("plan_width"),
        height.alias("plan_height"),
        turn.alias("rotation"),
        shown.alias("shown_width"),
    )
    low, high = R.upload_bracket(F.col("plan_frames"), F.col("plan_width"), F.col("plan_height"))
    return publish(planned.withColumn("low_bytes", low).withColumn("high_bytes", high))


RESIDENT = 7_000_000_000


@plan(
    "memory_prediction",
    "J6, R1, R2, R4",
    RUNS
    + f""", l AS (SELECT * FROM (VALUES (32, 15294529536), (64, 18186502144), (112, 22848471040), (128, 23561502720), (144, 23493471109)) t(f, b)),
    m AS (SELECT f, CAST(max(b) OVER (ORDER BY f) AS DOUBLE) AS b FROM l),
    seg AS (SELECT f AS f0, b AS b0, lead(f) OVER (ORDER BY f) AS f1, lead(b) OVER (ORDER BY f) AS b1 FROM m),
    p AS (SELECT run_id, process_res, frame_count AS n, frame_count - 8 AS k FROM runs),
    v AS (SELECT run_id, process_res, k, CASE WHEN k <= 32 THEN greatest({RESIDENT}e0, 15294529536e0 * (k / 32e0))
            WHEN k >= 144 THEN 23561502720e0 + (23561502720e0 - 22848471040e0) / 32e0 * (k - 144)
            ELSE (SELECT max(b0 + (k - f0) / CAST(f1 - f0 AS DOUBLE) * (b1 - b0)) FROM seg WHERE k > f0 AND k <= f1) END AS bytes FROM p)
    SELECT run_id, k AS frames, {r6('bytes * (process_res / 504e0) * (process_res / 504e0) / 1e9', 'predicted_gb')},
      k IN (32, 64, 112, 128, 144) AND process_res = 504 AS measured, greatest(0, k * 70000000 - 5000000000) AS activation_bytes,
      {r6('k * 70000000 / 22e9', 'peak_fraction')} FROM v""",
)
def memory_prediction(spark: SparkSession, sf: str) -> DataFrame:
    frames = F.col("frames")
    runs = A.runs(spark, sf).withColumn("frames", F.col("frame_count") - 8)
    predicted, measured = R.predict_memory(frames, F.col("process_res"), RESIDENT)
    activation, share = R.memory_facts(
        frames * F.lit(70000000), F.lit(5000000000), F.lit(22000000000)
    )
    return publish(
        runs.select(
            "run_id",
            "frames",
            (predicted / f64(1e9)).alias("predicted_gb"),
            measured.alias("measured"),
            activation.alias("activation_bytes"),
            share.alias("peak_fraction"),
        )
    )


def nested_sweeps(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two sweep files of one document each: every eighth frame count measured, some again in the second."""
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    measured = A.runs(spark, sf).where(F.col("frame_count") % 8 == 0)
    peak = F.max(F.floor(F.col("duration_s") * f64(1e9))).cast("long").alias("peak_bytes")
    found = []
    for part in (measured.where(F.col("created_at") < cut), measured.where(F.col("created_at") >= cut)):
        rungs = part.groupBy(F.col("status").alias("label"), F.col("frame_count").cast("int").alias("frames"), "process_res").agg(peak)
        runs = F.collect_list(F.struct("frames", "process_res", "peak_bytes", F.lit(True).alias("ok"))).alias("runs")
        sweeps = rungs.groupBy("label").agg(runs).withColumn("contaminated", F.lit(False))
        folder = SR.fresh_folder(spark, "sweeps")
        sweeps.agg(F.collect_list(F.struct("label", "contaminated", "runs")).alias("sweeps")).write.json(folder)
        found.append(R.sweep_rungs(manifests.read_sweeps(spark, folder)).where("ok"))
    return found


@plan(
    "ladder_prediction",
    "J6, R1, S17",
    RUNS
    + f""", r AS (SELECT status AS label, process_res AS res, frame_count AS f, created_at >= TIMESTAMP '1998-01-01' AS batch,
      max(CAST(floor(duration_s * 1e9) AS BIGINT)) AS b FROM runs WHERE frame_count % 8 = 0 GROUP BY ALL),
    l AS (SELECT label, res, f, arg_max(b, batch) AS b FROM r GROUP BY ALL),
    m AS (SELECT label, res, f, CAST(max(b) OVER (PARTITION BY label, res ORDER BY f) AS DOUBLE) AS b FROM l),
    e AS (SELECT label, res, min(f) AS f0, min(b) AS b0, max(f) AS f9, max(b) AS b9 FROM m GROUP BY ALL),
    d AS (SELECT e.*, max(m.f) AS fd, max(m.b) AS bd FROM e LEFT JOIN m ON m.label = e.label AND m.res = e.res AND m.b < e.b9 GROUP BY ALL),
    g AS (SELECT label, res, f AS fa, b AS ba, lead(f) OVER w AS fb, lead(b) OVER w AS bb FROM m WINDOW w AS (PARTITION BY label, res ORDER BY f)),
    p AS (SELECT run_id, status AS label, frame_count - 8 AS k, process_res FROM runs),
    h AS (SELECT p.*, coalesce(o.res, t.res) AS res FROM p LEFT JOIN e o ON o.label = p.label AND o.res = p.process_res
      LEFT JOIN (SELECT label, max(res) AS res FROM e GROUP BY ALL) t ON t.label = p.label),
    v AS (SELECT h.*, CASE WHEN k <= f0 THEN greatest({RESIDENT}e0, b0 * (k / CAST(f0 AS DOUBLE)))
        WHEN k > f9 THEN b9 + coalesce((b9 - bd) / CAST(f9 - fd AS DOUBLE), 0e0) * (k - f9)
        ELSE ba + (k - fa) * ((bb - ba) / (fb - fa)) END AS bytes
      FROM h LEFT JOIN d ON d.label = h.label AND d.res = h.res LEFT JOIN g ON g.label = h.label AND g.res = h.res AND k > fa AND k <= fb)
    SELECT v.run_id, v.label, k AS frames, CAST(process_res AS BIGINT) AS process_res, CAST(v.res AS BIGINT) AS ladder_res,
      {r6('bytes * (process_res / CAST(v.res AS DOUBLE)) * (process_res / CAST(v.res AS DOUBLE)) / 1e9', 'predicted_gb')},
      process_res = v.res AND m.f IS NOT NULL AS measured FROM v LEFT JOIN m ON m.label = v.label AND m.res = v.res AND m.f = k""",
)
def ladder_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """The peak of every run by the ladders that nested sweeps measured, a later sweep's rungs over an earlier one's."""
    first, second = nested_sweeps(spark, sf)
    rungs = R.upsert_rungs(first, second).select("label", "process_res", "frames", "peak_bytes")
    runs = A.runs(spark, sf).select(
        "run_id", F.col("status").alias("label"), (F.col("frame_count") - 8).alias("frames"), "process_res"
    )
    predicted = R.predict_from_ladders(runs, rungs, RESIDENT)
    return publish(
        predicted.select(
            "run_id", "label", "frames", "process_res", "ladder_res", (F.col("predicted_bytes") / f64(1e9)).alias("predicted_gb"), "measured"
        )
    )


@plan(
    "allocator_fit",
    "R2, R3",
    RUNS
    + f""", l AS (SELECT process_res, frame_count AS frames, max(CAST(duration_s * 1e9 AS BIGINT)) AS peak FROM (
        SELECT process_res, frame_count, floor(duration_s * 1e9) / 1e9 AS duration_s FROM runs) GROUP BY ALL),
    m AS (SELECT process_res, frames, max(peak) OVER (PARTITION BY process_res ORDER BY frames) / 1073741824e0 AS gib FROM l)
    SELECT CAST(process_res AS BIGINT) AS process_res, count(*) AS runs, {r6('regr_slope(gib, frames)', 'gib_per_frame')}, {r6('regr_intercept(gib, frames)', 'base_gib')} FROM m GROUP BY process_res""",
)
def allocator_fit(spark: SparkSession, sf: str) -> DataFrame:
    rungs = A.runs(spark, sf).groupBy("process_res", F.col("frame_count").alias("frames")).agg(
        F.max(F.floor(F.col("duration_s") * f64(1e9))).alias("peak_bytes")
    )
    held = R.monotone_ladder(rungs, ["process_res"]).withColumnsRenamed(
        {"peak_bytes": "torch_peak_bytes", "frames": "frame_count"}
    )
    return publish(R.allocator_fit(held, ["process_res"]))


@plan(
    "parameter_errors",
    "R15",
    RUNS
    + """, e AS (SELECT run_id, CASE WHEN run_id % 9 = 0 THEN 0 ELSE fps * 2 END AS fps, CASE WHEN run_id % 4 > 0 THEN duration_s - 5e0 END AS duration_s, process_res * 3 AS res,
           frame_count * 4 AS cap, frame_count + run_id % 600 AS n FROM runs)
    SELECT run_id, CASE WHEN fps > 0 AND fps <= 60 THEN 0 ELSE 1 END + CASE WHEN duration_s IS NULL OR duration_s > 0 THEN 0 ELSE 1 END
      + CASE WHEN res BETWEEN 126 AND 1024 THEN 0 ELSE 1 END + CASE WHEN cap BETWEEN 2 AND 512 THEN 0 ELSE 1 END
      + CASE WHEN n >= 2 THEN 0 ELSE 1 END + CASE WHEN n <= cap THEN 0 ELSE 1 END AS errors FROM e""".replace(
        "SELECT run_id, CASE WHEN fps > 0", "SELECT run_id, CAST(CASE WHEN fps > 0"
    ).replace("ELSE 1 END AS errors", "ELSE 1 END AS BIGINT) AS errors"),
)
def parameter_errors(spark: SparkSession, sf: str) -> DataFrame:
    params = A.runs(spark, sf).select(
        "run_id",
        F.when(F.col("run_id") % 9 == 0, F.lit(0)).otherwise(F.col("fps") * 2).alias("fps"),
        F.when(F.col("run_id") % 4 > 0, F.col("duration_s") - f64(5)).alias("duration_s"),
        (F.col("process_res") * 3).alias("process_res"),
        (F.col("frame_count") * 4).alias("max_frames"),
        (F.col("frame_count") + F.col("run_id") % 600).alias("frame_count"),
    )
    return publish(params.select("run_id", F.size(R.parameter_errors(params)).alias("errors")))


@plan(
    "licence_rules",
    "R16",
    """ WITH d AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'academic_poc' ELSE 'demo' END AS profile,
        CASE p_partkey % 4 WHEN 0 THEN 'commercial' WHEN 1 THEN 'non_commercial' WHEN 2 THEN 'research_only' ELSE 'unknown' END AS licence FROM part)
    SELECT profile, licence, CASE WHEN profile = 'demo' THEN 'profile not permitted' WHEN licence = 'commercial' OR (profile = 'academic_poc' AND licence <> 'unknown') THEN NULL
      ELSE 'not eligible: ' || licence END AS refusal, count(*) AS models FROM d GROUP BY ALL""",
)
def licence_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    pick = lambda k, n, names: F.get(F.array(*(F.lit(v) for v in names)), (F.col(k) % n).cast("int"))
    d = p.select(
        pick("p_size", 3, ["production", "academic_poc", "demo"]).alias("profile"),
        pick("p_partkey", 4, ["commercial", "non_commercial", "research_only", "unknown"]).alias("licence"),
    )
    refusal = R.licence_eligible(F.col("profile"), F.col("licence"))
    return publish(d.groupBy("profile", "licence", refusal.alias("refusal")).agg(F.count(F.lit(1)).alias("models")))


@plan(
    "retention_report",
    "R13",
    """ SELECT o_orderstatus AS root, count(*) AS expired, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS bytes FROM (
      SELECT o_orderstatus, floor(o_totalprice) AS o_totalprice, o_orderdate FROM orders) WHERE o_orderdate < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 6 HOUR GROUP BY ALL""",
)
def retention_report(spark: SparkSession, sf: str) -> DataFrame:
    entries = A.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("root"), F.col("o_orderdate").alias("modified_at"), F.floor("o_totalprice").alias("length")
    )
    now = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    old = R.retention_candidates(entries, now, 6 * 3600)
    return publish(old.groupBy("root").agg(F.count(F.lit(1)).alias("expired"), F.sum("length").alias("bytes")))


def wire_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest texts from orders: older ones lack the allocator peak, and some lack artifacts."""
    r = A.runs(spark, sf)
    run = F.col("run_id").cast("string")
    k = F.col("run_id")
    name = F.concat(F.lit("scene"), (k % 3).cast("string"), F.lit(".glb"))
    durable = F.concat(F.lit("gs://lab/runs/transient/"), run, F.lit("/"), name)
    artifact = F.struct(
        F.lit("glb").alias("kind"),
        name.alias("name"),
        (k * 10).alias("size_bytes"),
        F.sha2(run, 256).alias("sha256"),
        F.concat(F.lit("/artifact/"), F.when(k % 6 > 0, run).otherwise(F.lit("other")), F.lit("/"), name).alias("url"),
        F.when(k % 4 == 0, durable).alias("gs_uri"),
    )
    wire = F.struct(
        run.alias("run_id"),
        F.struct(F.col("fps").cast("double").alias("fps"), "process_res", F.lit(256).alias("max_frames")).alias("params"),
        F.struct(
            F.col("frame_count").alias("count"), F.col("frame_count").alias("requested_count"), "width", "height", F.lit(False).alias("capped")
        ).alias("frames"),
        F.struct(F.col("duration_s").alias("gpu_seconds"), F.col("duration_s").alias("wall_seconds")).alias("timing"),
        F.struct((k * 1000).alias("peak_bytes"), F.when(k % 2 == 0, k * 900).alias("torch_peak_bytes")).alias("vram"),
        F.when(k % 5 > 0, F.array(artifact)).alias("artifacts"),
        F.struct(F.create_map(F.lit("native.npz"), F.array(F.lit("depth"), F.lit("conf"))).alias("native_npz")).alias("diagnostics"),
    )
    return r.select(k.alias("key"), F.to_json(wire).alias("text"))


@plan(
    "manifests",
    "S1, R7",
    RUNS
    + f""" SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(frame_count AS BIGINT) AS frame_count, {r6('duration_s', 'gpu_seconds')}, run_id * 1000 AS peak_bytes,
      CASE WHEN run_id % 2 = 0 THEN run_id * 900 ELSE 0 END AS torch_peak_bytes, CAST(0 AS BIGINT) AS baseline_bytes, false AS mock,
      CASE WHEN run_id % 5 > 0 THEN run_id * 10 ELSE 0 END AS saved_bytes FROM runs""",
)
def manifests_plan(spark: SparkSession, sf: str) -> DataFrame:
    flat = manifests.flat_runs(manifests.parse_manifests(wire_manifests(spark, sf), "text"))
    return publish(
        flat.select(
            "run_id", "frame_count", "gpu_seconds", "peak_bytes", "torch_peak_bytes", "baseline_bytes", "mock",
            R.saved_bytes(F.col("artifacts")).alias("saved_bytes"),
        )
    )


@plan(
    "manifest_round_trip",
    "S2",
    RUNS
    + """ SELECT CAST(run_id AS VARCHAR) AS run_id, true AS same, CAST(2 AS BIGINT) AS native_keys FROM runs""",
)
def manifest_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written out and read again, a manifest is unchanged."""
    first = manifests.to_wire(manifests.parse_manifests(wire_manifests(spark, sf), "text")).withColumnRenamed("manifest", "a")
    again = manifests.parse_manifests(first.drop("run_id"), "a", "a").withColumn("native_keys", F.size(F.col("diagnostics.native_npz")["native.npz"]))
    both = manifests.to_wire(again, "a", "native_keys")
    return publish(both.select("run_id", F.col("a").eqNullSafe(F.col("manifest")).alias("same"), "native_keys"))


@plan(
    "save_rules",
    "R12, R10, R11",
    RUNS
    + """ SELECT CAST(run_id AS VARCHAR) AS run_id, true AS safe_id, run_id % 5 = 0 OR run_id % 4 = 0 OR run_id % 6 > 0 AS trusted,
      run_id % 5 = 0 OR run_id % 4 > 0 AS needs_service, CASE run_id % 3 WHEN 0 THEN 'npz' WHEN 1 THEN 'npz_native' END AS kind,
      CASE WHEN run_id % 3 = 0 THEN 'local' WHEN run_id % 2 = 0 THEN 'degraded' ELSE 'gcs' END AS mode FROM runs""",
)
def save_rules(spark: SparkSession, sf: str) -> DataFrame:
    parsed = manifests.parse_manifests(wire_manifests(spark, sf), "text")
    k = F.col("run_id").cast("long")
    rules = R.save_rules(parsed, "lab")
    name = F.get(F.array(F.lit("bundle.npz"), F.lit("export.NPZ"), F.lit("notes.txt")), (k % 3).cast("int"))
    errors = F.when(k % 2 == 0, F.array(F.lit("denied"))).otherwise(F.array().cast("array<string>"))
    bucket = F.when(k % 3 > 0, F.lit("lab"))
    return publish(
        rules.withColumn("kind", R.artifact_kind(name, "bundle.npz")).withColumn("mode", R.publish_mode(bucket, errors))
    )


@plan(
    "run_catalogue",
    "S7",
    RUNS
    + """ SELECT run_id, run_id % 50 = 0 AS builtin, run_id % 50 = 0 OR status <> 'F' OR run_id % 3 > 0 AS available,
      CASE WHEN (run_id % 50 = 0 OR status = 'F') AND run_id % 3 > 0 THEN run_id * 7 ELSE 0 END AS size_bytes FROM runs""",
)
def run_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    r = A.runs(spark, sf)
    built = F.col("run_id") % 50 == 0
    shape = lambda df: df.select("run_id", "created_at", (built | (F.col("status") == "F")).alias("persisted"))
    sizes = r.where(F.col("run_id") % 3 > 0).select("run_id", (F.col("run_id") * 7).alias("size_bytes"))
    listed = catalog.run_catalogue(shape(r.where(built)), shape(r.where(~built)), sizes)
    return publish(listed.select("run_id", "builtin", "available", "size_bytes"))


@plan(
    "run_registry",
    "S18",
    """ WITH ev AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'register' WHEN 'view' THEN 'save' WHEN 'error' THEN 'delete' ELSE 'register' END AS action,
           user_id % 20 = 0 AS builtin, value FROM events),
    live AS (SELECT * FROM ev WHERE NOT (action = 'delete' AND builtin)),
    s AS (SELECT run_id, max(seq) FILTER (action = 'delete') AS del, max(seq) FILTER (action = 'register') AS reg, max(seq) FILTER (action = 'save') AS sav,
            arg_max(value, seq) FILTER (action = 'register') AS value, any_value(builtin) AS builtin FROM live GROUP BY ALL)
    SELECT run_id, coalesce(sav > reg, false) AS persisted, builtin, round(value + 1e-9, 6) + 0e0 AS value FROM s WHERE (del IS NULL OR reg > del) AND reg IS NOT NULL""",
)
def run_registry(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    kind = F.col("event_type")
    action = F.when(kind == "view", F.lit("save")).when(kind == "error", F.lit("delete")).otherwise(F.lit("register"))
    log = e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("user_id") % 20 == 0).alias("builtin"), "value"
    )
    return publish(R.current_registry(log))


@plan(
    "frame_folders",
    "S9, S10",
    RUNS
    + """, f AS (SELECT run_id, unnest([0, 1, 2]) AS priority FROM runs),
    c AS (SELECT f.run_id, priority, CASE priority WHEN 0 THEN frame_count - run_id % 3 WHEN 1 THEN frame_count - run_id % 2 ELSE frame_count END AS files,
            CASE WHEN run_id % 10 > 0 THEN frame_count END AS want FROM f JOIN runs USING (run_id))
    SELECT run_id, concat('run', run_id, '/d', min(priority)) AS folder FROM c WHERE want IS NULL OR files = want GROUP BY run_id""",
)
def frame_folders(spark: SparkSession, sf: str) -> DataFrame:
    r = A.runs(spark, sf)
    k = F.col("run_id")
    files = (
        F.when(F.col("priority") == 0, F.col("frame_count") - k % 3)
        .when(F.col("priority") == 1, F.col("frame_count") - k % 2)
        .otherwise(F.col("frame_count"))
    )
    folders = r.withColumn("priority", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "run_id",
        F.concat(F.lit("run"), k.cast("string"), F.lit("/d"), F.col("priority").cast("string")).alias("folder"),
        "priority",
        files.alias("files"),
    )
    wanted = r.select("run_id", F.when(k % 10 > 0, F.col("frame_count")).alias("frame_count"))
    return publish(catalog.choose_frame_folder(folders, wanted))


@plan(
    "artifact_audit",
    "S14",
    """ WITH e AS (SELECT source AS run_id, doc_id || CASE WHEN doc_id % 4 = 0 THEN '.glb' ELSE '.txt' END AS name, strlen(text) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size_bytes,
           CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 19 > 0 OR doc_id % 23 = 0),
    f AS (SELECT source AS run_id, doc_id || CASE WHEN doc_id % 4 = 0 THEN '.glb' ELSE '.txt' END AS name, strlen(text) AS length, sha256(text) AS digest,
           substr(text, 1, 4) = 'glTF' AS magic, CASE WHEN doc_id % 11 = 0 THEN strlen(text) + 5 END AS declared FROM documents WHERE doc_id % 23 > 0)
    SELECT run_id, name, size_bytes, length, CASE WHEN length IS NULL THEN 'missing' WHEN size_bytes IS NULL THEN 'unexpected' WHEN length <> size_bytes THEN 'size differs'
      WHEN digest <> sha256 THEN 'checksum differs' WHEN name LIKE '%.glb' AND NOT magic THEN 'wrong signature' WHEN declared IS NOT NULL THEN 'truncated' ELSE 'ok' END AS status
    FROM e FULL JOIN f USING (run_id, name)""",
)
def artifact_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts stand for stored artifacts; what is expected of them is perturbed by key."""
    d = A.table(spark, sf, "documents")
    k = F.col("doc_id")
    name = F.concat(k.cast("string"), F.when(k % 4 == 0, F.lit(".glb")).otherwise(F.lit(".txt")))
    size, digest = F.octet_length("text"), F.sha2("text", 256)
    # Unexpected and missing ones by rules that exclude each other, so that every document is on one side at least.
    expected = d.where((k % 19 > 0) | (k % 23 == 0)).select(
        F.col("source").alias("run_id"),
        name.alias("name"),
        (size + F.when(k % 13 == 0, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("size_bytes"),
        F.when(k % 17 == 0, F.lit("x")).otherwise(digest).alias("sha256"),
    )
    found = d.where(k % 23 > 0).select(
        F.col("source").alias("run_id"),
        name.alias("name"),
        size.cast("long").alias("length"),
        digest.alias("digest"),
        F.hex(F.encode(F.substring("text", 1, 12), "UTF-8")).alias("head"),
        F.when(k % 11 == 0, size + 5).alias("declared"),
        F.lit(None).cast("long").alias("vertices"),
    )
    return publish(catalog.artifact_status(expected, found))


@plan(
    "clip_identity",
    "S19",
    """ WITH f AS (SELECT conv_id, turn, sha256(text) AS digest FROM conversations)
    SELECT conv_id, count(*) AS frames, sha256('{"clip_seconds":' || 10 || ',"frame_sha256":["' || string_agg(digest, '","' ORDER BY turn)
      || '"],"source_url":"clip' || conv_id || '","window_start_seconds":' || conv_id % 7 || '}') AS identity FROM f GROUP BY conv_id""",
)
def clip_identity(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations")
    frames = c.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.sha2("text", 256).alias("digest"),
        F.concat(F.lit("clip"), F.col("conv_id").cast("string")).alias("source_url"),
        (F.col("conv_id") % 7).alias("start_s"),
        F.lit(10).alias("clip_s"),
    )
    return publish(catalog.clip_identity(frames, ["conv_id"]))


@plan(
    "sweep_rungs",
    "S17",
    RUNS
    + """, r AS (SELECT status AS label, frame_count AS frames, process_res, CASE WHEN created_at < TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS batch, max(run_id) AS peak FROM runs GROUP BY ALL)
    SELECT label, frames, CAST(process_res AS BIGINT) AS process_res, CAST(arg_max(batch, batch) AS BIGINT) AS batch, arg_max(peak, batch) AS peak_bytes FROM r GROUP BY ALL""",
)
def sweep_rungs(spark: SparkSession, sf: str) -> DataFrame:
    r = A.runs(spark, sf)
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    batch = F.when(F.col("created_at") < cut, F.lit(1)).otherwise(F.lit(2))
    rungs = r.groupBy(
        F.col("status").alias("label"), F.col("frame_count").alias("frames"), "process_res", batch.alias("batch")
    ).agg(F.max("run_id").alias("peak_bytes"))
    return publish(R.upsert_rungs(rungs.where(F.col("batch") == 1), rungs.where(F.col("batch") == 2)))


@plan(
    "run_facts",
    "R18",
    A.cte("pts")
    + f""", c AS (SELECT run_id, count(*) AS points, avg(y) AS cy FROM pts GROUP BY ALL),
    t AS (SELECT user_id % 10 AS run_id, count(*) AS trials, count(DISTINCT event_type) AS objects FROM events GROUP BY ALL)
    SELECT run_id, points, trials, objects, {r6('cy', 'centroid_y')} FROM c LEFT JOIN t USING (run_id)""",
)
def run_facts(spark: SparkSession, sf: str) -> DataFrame:
    stats = cloud_stats(A.points(spark, sf)).select("run_id", F.col("finite").alias("points"), F.col("centroid_y"))
    trials = A.trials(spark, sf).groupBy("run_id", "object_id").agg(F.count(F.lit(1)).alias("_n"))
    facts = trials.groupBy("run_id").agg(F.sum("_n").alias("trials"), F.count(F.lit(1)).alias("objects"))
    return publish(stats.join(facts, "run_id", "left"))


CONTRACT = "scene-contracts/1"


def step_key(inputs: str, params: str, producer: str) -> str:
    return (
        f"""sha256('{{"contract_version":"{CONTRACT}","input_content_sha256":' || {inputs} || ',"parameters":' || {params}"""
        f""" || ',"producer_node":"' || {producer} || '","producer_version":"1.0"}}')"""
    )


PARAMS = """'{"n":' || strlen(node) || '}'"""
KEYS = f"""k0 AS (SELECT DISTINCT src AS node, {step_key("'{}'", PARAMS.replace('node', 'src'), 'substr(src, 1, 1)')} AS key FROM edges WHERE src LIKE 'R%'),
""" + ",\n".join(
    f"""k{i} AS (SELECT dst AS node, {step_key("'{\"in\":\"' || sha256(key || '/out') || '\"}'", PARAMS.replace('node', 'dst'), 'substr(dst, 1, 1)')} AS key
        FROM edges JOIN k{i - 1} ON node = src)"""
    for i in (1, 2, 3)
) + ", keys AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)"


def desired(spark: SparkSession, sf: str) -> DataFrame:
    links = A.edges(spark, sf)
    nodes = links.select(F.col("src").alias("node")).union(links.select(F.col("dst"))).distinct()
    steps = nodes.select(
        "node",
        F.substring("node", 1, 1).alias("producer"),
        F.lit("1.0").alias("version"),
        F.concat(F.lit('{"n":'), F.length("node").cast("string"), F.lit("}")).alias("params"),
    )
    ports = links.select("src", F.lit("out").alias("src_port"), "dst", F.lit("in").alias("dst_port"))
    return D.desired_keys(steps, ports, CONTRACT)


@plan("desired_keys", "D1, D2", A.cte("edges") + f", {KEYS} SELECT node, key FROM keys")
def desired_keys(spark: SparkSession, sf: str) -> DataFrame:
    return publish(desired(spark, sf).select("node", "key"))


@plan(
    "stale_audit",
    "D3, D6",
    A.cte("edges")
    + f""", {KEYS}, a AS (SELECT node, CASE WHEN strlen(node) % 5 = 0 THEN NULL WHEN CAST(substr(node, 2) AS BIGINT) % 7 = 0 THEN 'old' ELSE key END AS held, key FROM keys)
    SELECT substr(node, 1, 1) AS kind, count(*) FILTER (held IS NOT DISTINCT FROM key) AS cached, count(*) FILTER (held IS DISTINCT FROM key) AS rerun_required FROM a GROUP BY ALL""",
)
def stale_audit(spark: SparkSession, sf: str) -> DataFrame:
    want = desired(spark, sf)
    held = want.where(F.length("node") % 5 != 0).select(
        "node", F.when(F.substring("node", 2, 20).cast("long") % 7 == 0, F.lit("old")).otherwise(F.col("key")).alias("key")
    )
    audit = D.stale_audit(held, want).withColumn("kind", F.substring("node", 1, 1))
    return publish(D.rerun_plan(audit, ["kind"]))


@plan(
    "lineage_downstream",
    "D4",
    A.cte("edges", recursive=True)
    + """, walk AS (SELECT DISTINCT src AS root, dst AS node, 1 AS depth FROM edges WHERE src LIKE 'R%'
      UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node)
    SELECT root, substr(node, 1, 1) AS kind, CAST(depth AS BIGINT) AS depth, count(*) AS nodes FROM walk GROUP BY ALL""",
)
def lineage_downstream(spark: SparkSession, sf: str) -> DataFrame:
    links = A.edges(spark, sf)
    roots = links.where(F.startswith(F.col("src"), F.lit("R"))).select(F.col("src").alias("node")).distinct()
    reach = D.closure(links, roots, downstream=True)
    kinds = reach.groupBy("root", F.substring("node", 1, 1).alias("kind"), "depth")
    return publish(kinds.agg(F.count(F.lit(1)).alias("nodes")))


@plan(
    "lineage_upstream",
    "D4",
    A.cte("edges", recursive=True)
    + """, walk AS (SELECT DISTINCT dst AS root, src AS node, 1 AS depth FROM edges WHERE dst LIKE 'C%'
      UNION SELECT w.root, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node)
    SELECT root, node, CAST(depth AS BIGINT) AS depth FROM walk""",
)
def lineage_upstream(spark: SparkSession, sf: str) -> DataFrame:
    links = A.edges(spark, sf)
    roots = links.where(F.startswith(F.col("dst"), F.lit("C"))).select(F.col("dst").alias("node")).distinct()
    return publish(D.closure(links, roots, downstream=False))
