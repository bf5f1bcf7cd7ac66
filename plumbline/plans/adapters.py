"""The given tables seen as frames, masks, points, trials, runs, telemetry and lineage.

Each view exists twice: as a DataFrame for the jobs and as SQL text for the
independent check. Literals carry an exponent so both engines use doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64

SIDE = 8
FOCAL = 8.0
CENTRE = 3.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 depth map per embedding; a run is a label."""
    e = table(spark, sf_dir, "embeddings")
    i = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    value = lambda at: F.get("embedding", at).cast("double")
    c = F.when(F.col("vec_id") % 3 == 1, f64(1)).otherwise(f64(0.96))
    s = f64(0.28) * (F.col("vec_id") % 3 - 1)
    tx = f64(0.1) * (F.col("vec_id") % 50)
    tz = f64(0.02) * (F.col("vec_id") % 50)
    zero, one = f64(0), f64(1)
    return e.select(
        F.col("label").cast("long").alias("run_id"),
        F.col("vec_id").alias("frame"),
        F.lit(SIDE).alias("width"),
        F.lit(SIDE).alias("height"),
        F.transform(i, lambda at: f64(4) + f64(0.75) * value(at)).alias("depth"),
        F.transform(
            i, lambda at: f64(1) + f64(10) * F.abs(value((at * 7 + 3) % (SIDE * SIDE)))
        ).alias("confidence"),
        F.array(f64(FOCAL), zero, f64(CENTRE), zero, f64(FOCAL), f64(CENTRE), zero, zero, one).alias(
            "intrinsics"
        ),
        F.array(one, zero, zero, tx, zero, c, -s, f64(1.5), zero, s, c, tz).alias("extrinsics"),
    )


def coloured_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with colour maps; runs 8 and 9 lack one channel on some frames."""
    base = frames(spark, sf_dir)
    shade = lambda k: F.transform(
        "depth", lambda d: F.pmod(F.floor(d * f64(100)).cast("int") * k, F.lit(256))
    )
    gap = (F.col("run_id") >= 8) & (F.col("frame") % 2 == 1)
    return base.withColumns(
        {
            "r": shade(3),
            "g": shade(5),
            "b": F.when(~gap, shade(7)),
        }
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One display transform per run: a turn about z and a shift by run."""
    runs = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("run_id")).distinct()
    n = [f64(v) for v in (0.8, -0.6, 0, 0.6, 0.8, 0, 1, 0.5)]
    zero, one = f64(0), f64(1)
    return runs.select(
        "run_id",
        F.array(
            n[0], n[1], zero, f64(0.1) * F.col("run_id"),
            n[3], n[4], zero, zero,
            zero, zero, one, n[7],
            zero, zero, zero, one,
        ).alias("alignment"),
    )


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.pixels import pixels

    return pixels(frames(spark, sf_dir))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set pixels: the inner 6x6 where the surface is far enough away."""
    p = pixel_rows(spark, sf_dir)
    inner = F.col("x").between(1, 6) & F.col("y").between(1, 6) & (F.col("depth") > f64(3.85))
    name = F.concat(F.lit("obj"), (F.col("frame") % 3).cast("string"))
    return p.where(inner).select(
        "run_id", name.alias("object_id"), "frame", F.col("x").cast("long"), F.col("y").cast("long")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor, table top at 0.75 m and wall from lineitem; a frame is a block of orders."""
    li = table(spark, sf_dir, "lineitem")
    near = (F.col("l_discount") - f64(0.05)) * f64(0.04)
    y = (
        F.when(F.col("l_linenumber") % 4 == 0, near)
        .when(F.col("l_linenumber") % 4 == 1, f64(0.75) + near)
        .otherwise((F.col("l_orderkey") % 2500).cast("double") / f64(1000))
    )
    return li.select(
        (F.col("l_suppkey") % 10).alias("run_id"),
        F.expr("l_orderkey div 500").alias("frame"),
        (F.col("l_orderkey") % 500 * 8 + F.col("l_linenumber")).alias("px"),
        ((F.col("l_partkey") % 400).cast("double") / f64(100) - f64(2)).alias("x"),
        y.alias("y"),
        ((F.col("l_orderkey") % 397).cast("double") / f64(100) - f64(2)).alias("z"),
        (f64(1) + F.col("l_tax")).alias("weight"),
        (f64(1) + F.col("l_quantity") / f64(10)).alias("confidence"),
        (F.col("l_linenumber") * 30).cast("long").alias("r"),
        (F.col("l_partkey") % 256).alias("g"),
        F.col("l_suppkey").alias("b"),
    )


POINT_ORDER = ["px", "x", "y", "z", "weight", "confidence", "r", "g", "b"]


def ups(points_df: DataFrame) -> DataFrame:
    """+Y up for every run of the point view."""
    return points_df.select("run_id").distinct().select(
        "run_id", f64(0).alias("ux"), f64(1).alias("uy"), f64(0).alias("uz")
    )


def level_planes(points_df: DataFrame) -> DataFrame:
    """The plane y = 0 for every run of the point view."""
    return points_df.select("run_id").distinct().select(
        "run_id", f64(0).alias("nx"), f64(1).alias("ny"), f64(0).alias("nz"), f64(0).alias("d")
    )


# Fixed values of the target view: object, truth in metres.
TARGETS = [("click", 2.1), ("view", 0.75), ("signup", 0.45), ("purchase", 0.98), ("error", 0.3)]


def targets(spark: SparkSession) -> DataFrame:
    rows = [(o, f"T{i + 1}", t) for i, (o, t) in enumerate(TARGETS)]
    return spark.createDataFrame(rows, "object_id string, code string, truth_m double")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat readings from events; a sitting is a day."""
    e = table(spark, sf_dir, "events")
    truth = targets(spark).select("object_id", "truth_m")
    raw = F.col("truth_m") * (f64(0.95) + F.col("value") / f64(5000))
    return e.join(truth, F.col("event_type") == F.col("object_id")).select(
        (F.col("user_id") % 10).alias("run_id"),
        "object_id",
        "event_id",
        F.col("ts").alias("captured_at"),
        F.to_date("ts").cast("string").alias("sitting_id"),
        "truth_m",
        raw.alias("raw_m"),
        ((F.col("event_id") % 40).cast("double") / f64(1000)).alias("internal_spread_m"),
        (F.col("event_id") % 60000).alias("paint_ms"),
        F.substring(F.sha2("props", 256), 1, 16).alias("mask_digest"),
    )


def numbered_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.trials import number_new_trials

    base = trials(spark, sf_dir)
    none = spark.createDataFrame([], "object_id string, run_id long, trial_index long")
    return number_new_trials(none, base)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") % 100).alias("clip_key"),
        F.col("o_orderdate").alias("created_at"),
        (F.lit(32) + F.col("o_custkey") % 140).alias("frame_count"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(252))
        .when(F.col("o_orderkey") % 3 == 1, F.lit(356))
        .otherwise(F.lit(504))
        .alias("process_res"),
        (F.col("o_totalprice") / f64(10000)).alias("duration_s"),
        (F.lit(1) + F.col("o_orderkey") % 50).alias("fps"),
        (F.lit(1920) + F.col("o_custkey") % 1920).alias("width"),
        F.lit(1080).alias("height"),
        F.col("o_orderstatus").alias("status"),
    )


def telemetry(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 10).alias("run_id"),
        "event_id",
        "ts",
        F.round(F.col("value") * f64(1e8)).cast("long").alias("used_bytes"),
        (F.col("event_type") != "error").alias("available"),
        (F.col("event_type") != "signup").alias("model_loaded"),
    )


def scale_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances with a metric counterpart and its uncertainty; a request is a group of orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 100).alias("request_id"),
        F.col("l_quantity").alias("predicted"),
        (F.col("l_quantity") * (f64(0.9) + F.col("l_discount"))).alias("metric"),
        (f64(0.01) + F.col("l_tax")).alias("uncertainty"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    pair = lambda df, a, b: df.select(name(*a).alias("src"), name(*b).alias("dst"))
    return (
        pair(t("nation"), ("R", "n_regionkey"), ("N", "n_nationkey"))
        .unionByName(pair(t("customer"), ("N", "c_nationkey"), ("C", "c_custkey")))
        .unionByName(pair(t("orders"), ("C", "o_custkey"), ("O", "o_orderkey")))
    )


# The same views for the SQL check. Names are common table expressions.
SQL = {
    "px": """px AS (
        SELECT CAST(label AS BIGINT) AS run_id, vec_id AS frame, i % 8 AS x, i // 8 AS y, i AS px,
               4e0 + 75e-2 * CAST(embedding[i + 1] AS DOUBLE) AS depth,
               1e0 + 1e1 * abs(CAST(embedding[(i * 7 + 3) % 64 + 1] AS DOUBLE)) AS confidence
        FROM embeddings, (SELECT unnest(range(64)) AS i) r)""",
    "cam": """cam AS (
        SELECT CAST(label AS BIGINT) AS run_id, vec_id AS frame,
               CASE WHEN vec_id % 3 = 1 THEN 1e0 ELSE 96e-2 END AS c,
               28e-2 * (vec_id % 3 - 1) AS s,
               1e-1 * (vec_id % 50) AS tx, 15e-1 AS ty, 2e-2 * (vec_id % 50) AS tz
        FROM embeddings)""",
    "align": """align AS (
        SELECT DISTINCT CAST(label AS BIGINT) AS run_id, 1e-1 * label AS ax FROM embeddings)""",
    "mask": """mask AS (
        SELECT run_id, concat('obj', CAST(frame % 3 AS VARCHAR)) AS object_id, frame, x, y FROM px
        WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND depth > 385e-2)""",
    # Neighbours on the dense grid; outside the image counts as itself.
    "edge": """near AS (
        SELECT *, lag(depth, 1, depth) OVER (PARTITION BY run_id, frame, y ORDER BY x) AS l,
               lead(depth, 1, depth) OVER (PARTITION BY run_id, frame, y ORDER BY x) AS r,
               lag(depth, 1, depth) OVER (PARTITION BY run_id, frame, x ORDER BY y) AS u,
               lead(depth, 1, depth) OVER (PARTITION BY run_id, frame, x ORDER BY y) AS d
        FROM px),
    jump AS (
        SELECT run_id, frame, px, x, y, depth, confidence,
               greatest(abs(l - depth), abs(r - depth), abs(u - depth), abs(d - depth)) AS step
        FROM near)""",
    "world": """cast_out AS (
        SELECT j.*, (x - 35e-1) * depth / 8e0 - tx AS rx, (y - 35e-1) * depth / 8e0 - ty AS ry,
               depth - tz AS rz, c, s
        FROM jump j JOIN cam USING (run_id, frame)),
    world AS (
        SELECT *, rx AS wx, c * ry + s * rz AS wy, -s * ry + c * rz AS wz FROM cast_out)""",
    "pts": """pts AS (
        SELECT l_suppkey % 10 AS run_id, l_orderkey // 500 AS frame,
               l_orderkey % 500 * 8 + l_linenumber AS px,
               CAST(l_partkey % 400 AS DOUBLE) / 1e2 - 2e0 AS x,
               CASE l_linenumber % 4 WHEN 0 THEN (l_discount - 5e-2) * 4e-2
                                     WHEN 1 THEN 75e-2 + (l_discount - 5e-2) * 4e-2
                                     ELSE CAST(l_orderkey % 2500 AS DOUBLE) / 1e3 END AS y,
               CAST(l_orderkey % 397 AS DOUBLE) / 1e2 - 2e0 AS z,
               1e0 + l_tax AS weight, 1e0 + l_quantity / 1e1 AS confidence,
               CAST(l_linenumber * 30 AS BIGINT) AS r, l_partkey % 256 AS g, l_suppkey AS b
        FROM lineitem)""",
    "ord": """ord AS (
        SELECT *, row_number() OVER (PARTITION BY run_id
                    ORDER BY frame, px, x, y, z, weight, confidence, r, g, b) - 1 AS ord,
               count(*) OVER (PARTITION BY run_id) AS n
        FROM pts)""",
    "targets": """targets AS (
        SELECT * FROM (VALUES ('click', 'T1', 21e-1), ('view', 'T2', 75e-2), ('signup', 'T3', 45e-2),
                              ('purchase', 'T4', 98e-2), ('error', 'T5', 3e-1)) t(object_id, code, truth_m))""",
    "trials": """trials AS (
        SELECT user_id % 10 AS run_id, event_type AS object_id, event_id, ts AS captured_at,
               CAST(CAST(ts AS DATE) AS VARCHAR) AS sitting_id, truth_m,
               truth_m * (95e-2 + value / 5e3) AS raw_m,
               CAST(event_id % 40 AS DOUBLE) / 1e3 AS internal_spread_m, event_id % 60000 AS paint_ms,
               substr(sha256(props), 1, 16) AS mask_digest,
               row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id) AS trial_index
        FROM events JOIN targets ON event_type = object_id)""",
    "runs": """runs AS (
        SELECT o_orderkey AS run_id, o_custkey % 100 AS clip_key, o_orderdate AS created_at,
               32 + o_custkey % 140 AS frame_count,
               CASE o_orderkey % 3 WHEN 0 THEN 252 WHEN 1 THEN 356 ELSE 504 END AS process_res,
               o_totalprice / 1e4 AS duration_s, 1 + o_orderkey % 50 AS fps,
               1920 + o_custkey % 1920 AS width, 1080 AS height, o_orderstatus AS status
        FROM orders)""",
    "telemetry": """telemetry AS (
        SELECT user_id % 10 AS run_id, event_id, ts, CAST(round(value * 1e8) AS BIGINT) AS used_bytes,
               event_type <> 'error' AS available, event_type <> 'signup' AS model_loaded
        FROM events)""",
    "scale_obs": """scale_obs AS (
        SELECT l_orderkey % 100 AS request_id, l_quantity AS predicted,
               l_quantity * (9e-1 + l_discount) AS metric, 1e-2 + l_tax AS uncertainty,
               l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lineitem)""",
    "edges": """edges AS (
        SELECT concat('R', CAST(n_regionkey AS VARCHAR)) AS src, concat('N', CAST(n_nationkey AS VARCHAR)) AS dst FROM nation
        UNION ALL SELECT concat('N', CAST(c_nationkey AS VARCHAR)), concat('C', CAST(c_custkey AS VARCHAR)) FROM customer
        UNION ALL SELECT concat('C', CAST(o_custkey AS VARCHAR)), concat('O', CAST(o_orderkey AS VARCHAR)) FROM orders)""",
}


def cte(*names: str, recursive: bool = False) -> str:
    """WITH clause over the named views; what a view needs must be named before it."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
