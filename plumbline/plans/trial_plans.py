"""Repeat-trial, target, evidence and study jobs over the event view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64
from plumbline.operators import trials as T
from plumbline.plans import adapters as A
from plumbline.plans.registry import plan, publish, r6, r6s
from plumbline.sources import evidence as E, sinks
from plumbline.streaming import runs as SR

TRIALS = A.cte("targets", "trials")


@plan(
    "trial_numbers",
    "T8, T9, T12",
    TRIALS
    + """ SELECT run_id, object_id, event_id, trial_index, concat(object_id, ':', run_id, '#', trial_index) AS trial_id,
      concat_ws('@', concat(object_id, ':', run_id, '#', trial_index), sitting_id, event_id, coalesce(mask_digest, 'no-mask')) AS evidence_id
    FROM trials""",
)
def trial_numbers(spark: SparkSession, sf: str) -> DataFrame:
    numbered = A.numbered_trials(spark, sf)
    ident = T.evidence_id(
        F.col("trial_id"), F.col("sitting_id"), F.col("event_id"), F.col("mask_digest")
    )
    return publish(
        numbered.select(
            "run_id", "object_id", "event_id", "trial_index", "trial_id", ident.alias("evidence_id")
        )
    )


@plan(
    "trial_statistics",
    "T10",
    TRIALS
    + f""", s AS (SELECT run_id, object_id, sitting_id, count(*) AS n, avg(raw_m) AS m, max(raw_m) - min(raw_m) AS r FROM trials GROUP BY ALL),
    ss AS (SELECT run_id, object_id, count(*) AS sitting_count, max(r) FILTER (n >= 2) AS within_r,
             CASE WHEN count(*) >= 2 THEN max(m) - min(m) END AS between_r FROM s GROUP BY ALL),
    md AS (SELECT run_id, object_id, quantile_disc(raw_m, 5e-1) AS mid FROM trials GROUP BY ALL)
    SELECT run_id, object_id, count(*) AS n, {r6('avg(raw_m)', 'mean_m')}, {r6('any_value(mid)', 'median_m')}, {r6('min(raw_m)', 'min_m')},
      {r6('max(raw_m)', 'max_m')}, {r6('max(raw_m) - min(raw_m)', 'range_m')},
      {r6('CASE WHEN count(*) >= 3 THEN 14826e-4 * quantile_disc(abs(raw_m - mid), 5e-1) END', 'nmad_m')},
      {r6('CAST(quantile_disc(paint_ms, 5e-1) AS DOUBLE)', 'median_paint_ms')}, any_value(sitting_count) AS sitting_count,
      {r6('any_value(within_r)', 'within_sitting_range_m')}, {r6('any_value(between_r)', 'between_sitting_range_m')}
    FROM trials JOIN ss USING (run_id, object_id) JOIN md USING (run_id, object_id) GROUP BY run_id, object_id""",
)
def trial_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return publish(T.trial_stats(A.trials(spark, sf)))


@plan(
    "duplicate_masks",
    "T11",
    TRIALS
    + """ SELECT run_id, object_id, event_id, trial_index FROM (SELECT *, row_number() OVER (
        PARTITION BY run_id, object_id, mask_digest ORDER BY trial_index) AS k FROM trials) WHERE k > 1""",
)
def duplicate_masks(spark: SparkSession, sf: str) -> DataFrame:
    found = T.duplicate_masks(A.numbered_trials(spark, sf))
    return publish(found.select("run_id", "object_id", "event_id", "trial_index"))


@plan(
    "merged_trials",
    "T13",
    """ WITH t AS (SELECT event_id, event_type || ':' || user_id || '#' || event_id % 40 AS trial_id, CASE WHEN event_id % 9 > 0 THEN CAST(ts AS DATE) END AS day, value
           FROM events),
    local_ AS (SELECT * FROM t WHERE value < 1e1), disk AS (SELECT * FROM t WHERE value >= 1e1),
    fresh AS (SELECT DISTINCT trial_id, day FROM disk EXCEPT SELECT trial_id, day FROM local_)
    SELECT trial_id, day, 'local' AS origin, count(*) AS rows FROM local_ GROUP BY ALL
    UNION ALL SELECT trial_id, day, 'disk', 1 FROM fresh""",
)
def merged_trials(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    t = e.select(
        F.concat(
            "event_type", F.lit(":"), F.col("user_id").cast("string"), F.lit("#"), (F.col("event_id") % 40).cast("string")
        ).alias("trial_id"),
        F.when(F.col("event_id") % 9 > 0, F.to_date("ts")).alias("captured_at"),
        (F.col("value") < 10).alias("local"),
    )
    merged = T.merge_trials(t.where(F.col("local")), t.where(~F.col("local")))
    origin = F.when(F.col("local"), F.lit("local")).otherwise(F.lit("disk"))
    return publish(
        merged.groupBy("trial_id", F.col("captured_at").alias("day"), origin.alias("origin")).agg(
            F.count(F.lit(1)).alias("rows")
        )
    )


@plan(
    "migrated_trials",
    "T14",
    """ WITH RECURSIVE raw AS (SELECT event_id AS ord, event_type AS object_id,
             CASE WHEN event_id % 4 > 0 THEN 'run' || user_id % 10 ELSE 'old-' || user_id % 10 END AS run_id,
             CASE WHEN event_id % 3 = 0 THEN event_id % 500 END AS idx, event_id FROM events),
    seq AS (SELECT *, row_number() OVER (PARTITION BY object_id, run_id ORDER BY ord) AS pos FROM raw),
    walk AS (SELECT ord, object_id, run_id, pos, coalesce(idx, 1) AS trial_index, greatest(1, coalesce(idx, 1)) AS counter FROM seq WHERE pos = 1
             UNION ALL SELECT s.ord, s.object_id, s.run_id, s.pos, coalesce(s.idx, w.counter + 1), greatest(w.counter + 1, coalesce(s.idx, 0))
             FROM walk w JOIN seq s ON s.object_id = w.object_id AND s.run_id = w.run_id AND s.pos = w.pos + 1),
    named AS (SELECT *, CASE WHEN ord % 10 = 0 THEN 'kept#' || ord // 20 ELSE object_id || ':' || run_id || '#' || trial_index END AS trial_id,
             CASE WHEN ord % 8 > 0 THEN ord // 100 END AS captured_at FROM walk)
    SELECT ord, object_id, run_id, trial_index, trial_id, CASE WHEN ord % 6 > 0 THEN 's' || ord % 6 ELSE 'unrecorded' END AS sitting_id FROM (
      SELECT *, row_number() OVER (PARTITION BY trial_id, captured_at ORDER BY ord) AS k FROM named) WHERE captured_at IS NULL OR k = 1""",
)
def migrated_trials(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    k = F.col("event_id")
    setting = (F.col("user_id") % 10).cast("string")
    rows = e.select(
        k.alias("ord"),
        F.col("event_type").alias("object_id"),
        F.when(k % 4 > 0, F.concat(F.lit("run"), setting)).alias("run_id"),
        setting.alias("setting"),
        F.when(k % 3 == 0, k % 500).alias("trial_index"),
        F.when(k % 10 == 0, F.concat(F.lit("kept#"), F.expr("event_id div 20").cast("string"))).alias("trial_id"),
        F.when(k % 6 > 0, F.concat(F.lit("s"), (k % 6).cast("string"))).alias("sitting_id"),
        F.when(k % 8 > 0, F.expr("event_id div 100")).alias("captured_at"),
    )
    moved = T.migrate_trials(rows, "old-")
    return publish(moved.select("ord", "object_id", "run_id", "trial_index", "trial_id", "sitting_id"))


@plan(
    "rekeyed_masks",
    "T15",
    """ WITH t AS (SELECT DISTINCT c_nationkey AS clip, 'cust' || c_custkey % 997 AS subject FROM customer),
    own AS (SELECT subject, CASE WHEN min(clip) = max(clip) THEN 'clip' || min(clip) ELSE 'active' END AS clip FROM t GROUP BY ALL)
    SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 7 = 0 THEN 'x/y:1' ELSE coalesce(clip, 'active') || '/cust' || o_custkey || ':' || o_orderkey % 90 END AS key
    FROM orders LEFT JOIN own ON subject = 'cust' || o_custkey""",
)
def rekeyed_masks(spark: SparkSession, sf: str) -> DataFrame:
    c, o = A.table(spark, sf, "customer"), A.table(spark, sf, "orders")
    text = lambda v: v.cast("string")
    targets = c.select(
        F.concat(F.lit("clip"), text(F.col("c_nationkey"))).alias("clip_key"),
        F.concat(F.lit("cust"), text(F.col("c_custkey") % 997)).alias("object_id"),
        F.lit(None).cast("string").alias("mask_owner_id"),
    ).distinct()
    key = F.concat(F.lit("cust"), text(F.col("o_custkey")), F.lit(":"), text(F.col("o_orderkey") % 90))
    masks = o.select(
        F.col("o_orderkey").alias("order_key"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("x/y:1")).otherwise(key).alias("key"),
    )
    return publish(T.rekey_masks(masks, targets, "active"))


TARGET_SETS = """have AS (SELECT c_nationkey AS clip_key, 'obj' || c_custkey AS object_id, c_custkey % 5 = 0 AS builtin FROM customer WHERE c_acctbal > 0),
    offer AS (SELECT DISTINCT c_nationkey AS clip_key, 'obj' || o_custkey AS object_id FROM orders JOIN customer ON c_custkey = o_custkey)"""


def target_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, o = A.table(spark, sf, "customer"), A.table(spark, sf, "orders")
    name = lambda k: F.concat(F.lit("obj"), F.col(k).cast("string")).alias("object_id")
    have = c.where(F.col("c_acctbal") > 0).select(
        F.col("c_nationkey").cast("long").alias("clip_key"), name("c_custkey"), (F.col("c_custkey") % 5 == 0).alias("builtin")
    )
    offer = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").cast("long").alias("clip_key"), name("o_custkey"), F.lit(False).alias("builtin")
    )
    return have, offer


@plan(
    "restored_targets",
    "T16 (restore)",
    f"""WITH {TARGET_SETS} SELECT CAST(clip_key AS BIGINT) AS clip_key, object_id, builtin FROM have UNION ALL
    SELECT CAST(clip_key AS BIGINT), object_id, false FROM (SELECT clip_key, object_id FROM offer EXCEPT SELECT clip_key, object_id FROM have)""",
)
def restored_targets(spark: SparkSession, sf: str) -> DataFrame:
    return publish(T.restore_targets(*target_sets(spark, sf)))


@plan(
    "removed_targets",
    "T16 (cascade)",
    f"""WITH {TARGET_SETS}, gone AS (SELECT clip_key, object_id FROM have WHERE NOT builtin AND clip_key % 3 = 0),
    t AS (SELECT o_orderkey AS run_id, o_orderkey % 25 AS clip_key, 'obj' || o_custkey AS object_id FROM orders)
    SELECT run_id, object_id FROM t WHERE run_id % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.clip_key = t.clip_key AND g.object_id = t.object_id)""",
)
def removed_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Removing targets takes their trials within the clip's runs; removed runs take all of theirs."""
    have, _ = target_sets(spark, sf)
    o = A.table(spark, sf, "orders")
    trials = o.select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("obj"), F.col("o_custkey").cast("string")).alias("object_id")
    )
    clip_runs = o.select((F.col("o_orderkey") % 25).alias("clip_key"), F.col("o_orderkey").alias("run_id"))
    removals = have.where(F.col("clip_key") % 3 == 0).select("clip_key", "object_id")
    _, kept = T.remove_target(have, trials, removals, clip_runs)
    dropped = o.where(F.col("o_orderkey") % 11 == 0).select(F.col("o_orderkey").alias("run_id"))
    return publish(T.remove_runs(kept, dropped).select("run_id", "object_id"))


@plan(
    "target_names",
    "T17",
    """ WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'T' || p_size WHEN p_partkey % 3 = 1 THEN 'X' || p_size END AS code, p_name FROM part)
    SELECT p_brand, 'T' || (coalesce(max(CAST(nullif(regexp_extract(code, '^T(\\d+)$', 1), '') AS BIGINT)), 0) + 1) AS next_code,
      max(regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_brand || '!')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug
    FROM p GROUP BY ALL""",
)
def target_names(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("T"), size)).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("X"), size)
    )
    slug = T.target_slug(F.concat("p_name", F.lit(" "), "p_brand", F.lit("!")))
    named = p.withColumn("code", code)
    return publish(
        T.next_target_code(named, ["p_brand"]).join(
            named.groupBy("p_brand").agg(F.max(slug).alias("slug")), "p_brand"
        )
    )


REP = """med AS (SELECT run_id, object_id, median(raw_m) AS mid, count(*) AS candidates FROM trials GROUP BY ALL),
    rep AS (SELECT * FROM (SELECT t.*, candidates, row_number() OVER (PARTITION BY run_id, object_id
              ORDER BY round(abs(raw_m - mid), 12), trial_index) AS k FROM trials t JOIN med USING (run_id, object_id)) WHERE k = 1)"""


@plan(
    "representative_trials",
    "T18",
    TRIALS + f", {REP} SELECT run_id, object_id, event_id, trial_index, candidates, {r6s('raw_m')} FROM rep",
)
def representative_trials(spark: SparkSession, sf: str) -> DataFrame:
    chosen = T.representative_trials(A.numbered_trials(spark, sf))
    return publish(chosen.select("run_id", "object_id", "event_id", "trial_index", "candidates", "raw_m"))


@plan(
    "run_evidence",
    "T19",
    TRIALS
    + f""", {REP}, foc AS (SELECT t.*, candidates, row_number() OVER (PARTITION BY run_id, object_id ORDER BY trial_index) AS k
        FROM trials t JOIN med USING (run_id, object_id) WHERE run_id % 4 = 0 AND trial_index = 2)
    SELECT run_id, object_id, trial_index, false AS focused, code || ' · ' || printf('%.3f', raw_m) || ' m · median of ' || candidates AS label
      FROM rep JOIN targets USING (object_id) WHERE run_id % 4 <> 0
    UNION ALL SELECT run_id, object_id, trial_index, true, code || ' · ' || printf('%.3f', raw_m) || ' m · trial ' || trial_index || ' of ' || candidates
      FROM foc JOIN targets USING (object_id)""",
)
def run_evidence(spark: SparkSession, sf: str) -> DataFrame:
    numbered = A.numbered_trials(spark, sf).withColumn("ruler", F.struct(f64(0).alias("bottom"), F.col("raw_m").alias("top")))
    focused = numbered.where((F.col("run_id") % 4 == 0) & (F.col("trial_index") == 2)).select("trial_id", "captured_at")
    items = T.run_evidence(numbered, A.targets(spark), focused)
    return publish(items.select("run_id", "object_id", "trial_index", "focused", "label"))


@plan(
    "grading",
    "T21, T24",
    TRIALS
    + """, g AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'stale' WHEN event_id % 17 = 0 THEN 'failed' ELSE 'ok' END AS fl,
         CASE WHEN event_id % 11 > 0 THEN raw_m END AS raw, CASE WHEN event_id % 7 > 0 THEN truth_m END AS truth, event_id % 5 = 0 AS blind FROM trials),
    k AS (SELECT *, CASE WHEN fl <> 'ok' THEN 'refused' WHEN raw IS NULL THEN 'idle' WHEN blind THEN 'blind' WHEN truth IS NULL THEN 'ungraded' ELSE 'graded' END AS kind FROM g),
    e AS (SELECT *, printf('%.1f', (raw - truth) * 1e2) AS cm, printf('%.1f', (raw - truth) / truth * 1e2) AS pc FROM k)
    SELECT event_id, kind, CASE WHEN kind = 'blind' THEN '•••' WHEN kind IN ('graded', 'ungraded') THEN printf('%.3f', raw) || ' m' ELSE '—' END AS value_text,
      CASE WHEN kind IN ('blind', 'graded') AND truth IS NOT NULL THEN printf('%.3f', truth) || ' m' WHEN kind IN ('blind', 'ungraded') THEN 'no tape truth' ELSE '—' END AS truth_text,
      CASE WHEN kind = 'blind' THEN '•••' WHEN kind = 'graded' THEN CASE WHEN CAST(cm AS DOUBLE) = 0 THEN '0.0' WHEN raw > truth THEN '+' || cm ELSE cm END || ' cm' ELSE '—' END AS error_text,
      CASE WHEN kind = 'blind' THEN '•••' WHEN kind = 'graded' THEN CASE WHEN CAST(pc AS DOUBLE) = 0 THEN '0.0' WHEN raw > truth THEN '+' || pc ELSE pc END || '%' ELSE '—' END AS percent_text
    FROM e""",
)
def grading(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    floor = F.when(k % 13 == 0, F.lit("stale")).when(k % 17 == 0, F.lit("failed")).otherwise(F.lit("ok"))
    rows = A.trials(spark, sf).select(
        "event_id",
        floor.alias("floor_state"),
        F.when(k % 11 > 0, F.col("raw_m")).alias("raw_m"),
        F.when(k % 7 > 0, F.col("truth_m")).alias("truth_m"),
        (k % 5 == 0).alias("blind"),
    )
    graded = T.grade_readings(rows)
    return publish(graded.select("event_id", "kind", "value_text", "truth_text", "error_text", "percent_text"))


@plan(
    "attempt_outcomes",
    "T7",
    """ WITH a AS (SELECT event_id // 4 AS attempt, user_id % 10 AS run_id, CASE event_type WHEN 'click' THEN 'proposed' WHEN 'view' THEN 'accepted'
           WHEN 'signup' THEN 'abstained' WHEN 'purchase' THEN 'failed' ELSE 'proposed' END AS outcome, ts FROM events),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY ts DESC, outcome DESC) AS k FROM a) WHERE k = 1)
    SELECT run_id, count(*) AS total, count(*) FILTER (outcome = 'proposed') AS proposed, count(*) FILTER (outcome = 'accepted') AS accepted,
      count(*) FILTER (outcome = 'abstained') AS abstained, count(*) FILTER (outcome = 'failed') AS failed FROM l GROUP BY ALL""",
)
def attempt_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    # The outcome each event kind stands for.
    outcome = {"click": "proposed", "view": "accepted", "signup": "abstained", "purchase": "failed", "error": "proposed"}
    named = F.create_map(*(F.lit(v) for pair in outcome.items() for v in pair))[F.col("event_type")]
    attempts = e.select(
        F.expr("event_id div 4").alias("attempt_id"),
        (F.col("user_id") % 10).alias("run_id"),
        named.alias("outcome"),
        F.col("ts").alias("updated_at"),
    )
    return publish(T.attempt_counts(attempts, ["run_id"]))


def packet_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence packets as JSON text: two stored copies of some, a few broken, some with an older ruler."""
    t = A.trials(spark, sf)
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    ruler = F.struct(F.array(f64(0), f64(0), f64(0)).alias("bottom"), F.array(f64(0), F.col("raw_m"), f64(0)).alias("top"))
    run = text(F.col("run_id"))
    mask = F.struct(F.col("mask_digest").alias("digest"), F.array(F.lit(1), F.lit(2)).alias("runs"))
    observation = F.struct(
        F.concat("object_id", F.lit(":"), run, F.lit("#"), text(k % 50)).alias("id"),
        F.col("object_id").alias("objectId"),
        F.when(k % 23 > 0, run).otherwise(F.lit("elsewhere")).alias("runId"),
        F.col("raw_m").alias("rawM"),
        F.date_format("captured_at", "yyyy-MM-dd'T'HH").alias("capturedAt"),
        F.col("sitting_id").alias("sittingId"),
        F.when(k % 29 > 0, mask).alias("mask"),
        F.when(k % 2 == 0, ruler).alias("ruler"),
    )
    live = F.struct(F.struct(F.when(k % 3 == 0, ruler).alias("ruler"), F.lit("extent").alias("rulerKind")).alias("measurement"))
    packet = F.to_json(F.struct(run.alias("runId"), observation.alias("observation"), live.alias("live")))
    return t.select(
        F.struct((k % 2).alias("d"), k.alias("k")).alias("_rank"),
        "event_id",
        F.when(k % 31 == 0, F.substring(packet, 1, 40)).otherwise(packet).alias("text"),
    )


PACKETED = """pk AS (SELECT *, object_id || ':' || run_id || '#' || event_id % 50 AS oid, strftime(captured_at, '%Y-%m-%dT%H') AS cap,
        event_id % 29 > 0 AS masked FROM trials WHERE event_id % 31 > 0),
    ided AS (SELECT *, oid || '@' || sitting_id || '@' || cap || '@' || CASE WHEN masked THEN mask_digest ELSE 'no-mask' END AS evidence_id FROM pk)"""
PACKETS = PACKETED + """,
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY event_id % 2, event_id) AS k FROM ided) WHERE k = 1)"""


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_per_id(E.parse_packets(packet_texts(spark, sf), "text", "_rank"), "_rank")


@plan(
    "evidence_packets",
    "S6, T20",
    TRIALS
    + f", {PACKETS} SELECT evidence_id, object_id, CAST(run_id AS VARCHAR) AS run_id, {r6s('raw_m')}, event_id % 2 = 0 OR event_id % 3 = 0 AS has_ruler FROM once",
)
def evidence_packets(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.recovered_ruler(packets(spark, sf))
    return publish(
        rows.select(
            F.col("evidenceId").alias("evidence_id"),
            F.col("observation.objectId").alias("object_id"),
            F.col("runId").alias("run_id"),
            F.col("observation.rawM").alias("raw_m"),
            F.col("observation.ruler").isNotNull().alias("has_ruler"),
        )
    )


@plan(
    "evidence_checks",
    "S12",
    TRIALS
    + f""", {PACKETS} SELECT CAST(run_id AS VARCHAR) AS run_id, CASE WHEN event_id % 23 = 0 THEN 'run id does not match'
      WHEN NOT masked THEN 'no frozen mask' END AS fault, count(*) AS packets FROM once GROUP BY ALL""",
)
def evidence_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = packets(spark, sf).withColumn("fault", E.packet_fault(F.col("runId")))
    return publish(rows.groupBy(F.col("runId").alias("run_id"), "fault").agg(F.count(F.lit(1)).alias("packets")))


@plan(
    "evidence_archive",
    "S13",
    TRIALS
    + f""", {PACKETS} SELECT evidence_id, object_id IN ('click', 'error') AS archived,
      CAST(CASE WHEN object_id = 'click' THEN 2 WHEN object_id = 'error' THEN 1 END AS BIGINT) AS archive_seq FROM once""",
)
def evidence_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Archive two objects' packets; those of one were archived once before and are numbered after it."""
    rows = packets(spark, sf)
    before = rows.where(F.col("observation.objectId") == "click").select("evidenceId")
    objects = spark.createDataFrame([("click",), ("error",)], "object_id string")
    moved, live = E.archive_split(rows, before, "target removed", F.current_timestamp(), object_ids=objects)
    shape = lambda df, a, s: df.select(F.col("evidenceId").alias("evidence_id"), F.lit(a).alias("archived"), s)
    return publish(
        shape(moved, True, F.col("archive_seq").cast("long")).unionByName(
            shape(live, False, F.lit(None).cast("long").alias("archive_seq"))
        )
    )


@plan(
    "evidence_store",
    "S12, S13",
    TRIALS
    + f""", {PACKETED}, sent AS (SELECT * FROM (SELECT *, event_id % 2 AS batch, row_number() OVER (PARTITION BY event_id % 2, evidence_id ORDER BY event_id) AS k FROM ided)
      WHERE k = 1 AND event_id % 23 > 0 AND masked AND run_id <> 7),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY batch DESC) AS last FROM sent) WHERE last = 1)
    SELECT evidence_id, object_id, CAST(run_id AS VARCHAR) AS run_id, {r6s('raw_m')}, '2026-01-0' || (batch + 1) || 'T00:00:00Z' AS stored_at,
      'clip ' || run_id % 3 AS clip_name, object_id = 'click' AS archived, CASE WHEN object_id = 'click' THEN 1 END AS archive_seq FROM kept""",
)
def evidence_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches stored one after the other, one object's packets archived, all read back from the versions.

    The second batch sends some ids again; packets with a fault or of a run nobody registered are refused.
    """
    path = SR.fresh_folder(spark, "evidence-store")
    run = F.col("run_id")
    registry = A.trials(spark, sf).select("run_id").distinct().where(run != 7).select(
        run.cast("string").alias("run_id"),
        F.concat(F.lit("clip "), (run % 3).cast("string")).alias("clip_name"),
        F.sha2(run.cast("string"), 256).alias("clip_sha256"),
        (run < 3).alias("builtin"),
    )
    texts = packet_texts(spark, sf)
    for batch in range(2):
        rows = E.parse_packets(texts.where(F.col("event_id") % 2 == batch), "text", "_rank")
        E.store_packets(E.first_per_id(rows, "_rank"), path, registry, F.lit(f"2026-01-0{batch + 1}T00:00:00Z"))
    objects = spark.createDataFrame([("click",)], "object_id string")
    E.archive_packets(spark, path, "target removed", F.lit("2026-01-03T00:00:00Z"), object_ids=objects)
    shape = lambda df, archived: df.select(
        F.col("evidenceId").alias("evidence_id"),
        F.col("observation.objectId").alias("object_id"),
        F.col("runId").alias("run_id"),
        F.col("observation.rawM").alias("raw_m"),
        F.col("storedAt").alias("stored_at"),
        F.col("storage.clip_name").alias("clip_name"),
        F.lit(archived).alias("archived"),
        F.col("archive.seq").alias("archive_seq"),
    )
    return publish(shape(E.live_packets(spark, path), False).unionByName(shape(E.archived_packets(spark, path), True)))


@plan(
    "session_export",
    "S15",
    TRIALS
    + f""" SELECT run_id % 3 AS clip_key, 'observation' AS section, object_id || ':' || run_id || '#' || trial_index AS item, object_id, CAST(NULL AS VARCHAR) AS code,
      run_id, trial_index, {r6s('raw_m')}, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sitting_count FROM trials
    UNION ALL SELECT run_id % 3, 'repeatability', object_id || ':' || run_id, object_id, any_value(code), run_id, NULL, NULL, count(*), count(DISTINCT sitting_id)
      FROM trials JOIN targets USING (object_id) GROUP BY run_id, object_id""",
)
def session_export(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every clip's session, read back from its JSON."""
    numbered = A.numbered_trials(spark, sf)
    clip_runs = numbered.select((F.col("run_id") % 3).alias("clip_key"), "run_id").distinct()
    lines = sinks.session_export(numbered, A.targets(spark), clip_runs)
    record = "object_id string, code string, run_id long, trial_index long, raw_m double, n long, sitting_count long"
    return publish(lines.select("clip_key", "section", "item", F.from_json("json", record).alias("r")).select("clip_key", "section", "item", "r.*"))
