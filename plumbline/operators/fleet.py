"""Fleet rules over run manifests: memory prediction, publication, retention, eligibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, half_up
from plumbline.operators.ranks import exploded
from plumbline.session import cut_lineage

GIB = 1073741824

# Measured driver peaks (frames, bytes) at the reference resolution.
MEASURED_PEAKS = [
    (32, 15294529536),
    (64, 18186502144),
    (112, 22848471040),
    (128, 23561502720),
    (144, 23493471109),
]
MEASURED_RES = 504
# Measured JPEG bytes per pixel, low and high.
JPEG_BYTES_PER_PIXEL = (0.083, 0.156)
# Artifact kind by file suffix.
ARTIFACT_KINDS = {
    "glb": "glb",
    "npz": "npz",
    "png": "depth_preview",
    "ply": "gs_ply",
    "mp4": "gs_video",
}
# Fixed value: the form of a safe run id.
RUN_ID_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
# Accepted licence classes per run profile.
PROFILE_LICENCES = {
    "production": ["commercial"],
    "academic_poc": ["commercial", "non_commercial", "research_only"],
}
# Request limits.
FPS_MAX = 60
RES_RANGE = (126, 1024)
FRAMES_RANGE = (2, 512)


def monotone_ladder(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """Running maximum of peak bytes over frame count. A ladder is a handful of measured rungs."""
    order = W.partitionBy(*keys).orderBy("frames").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ladder.withColumn("peak_bytes", F.max("peak_bytes").over(order))


def predict_memory(frames: Column, process_res: Column, resident_bytes: int) -> tuple[Column, Column]:
    """Predicted peak bytes and whether that exact configuration was measured.

    Below the first rung scales down (never under the resident model), between
    rungs interpolates, above extrapolates on the last distinct step, and
    resolution scales quadratically. The ladder here is the five fixed peaks;
    ``predict_from_ladders`` takes measured ones.
    """
    tops: list[tuple[int, int]] = []
    for n, peak in MEASURED_PEAKS:
        tops.append((n, max(peak, tops[-1][1] if tops else 0)))
    (f0, b0), (f1, b1), (fp, bp) = tops[0], tops[-1], tops[-3]
    slope = (b1 - bp) / (f1 - fp)
    value = F.when(
        frames <= f0, F.greatest(f64(resident_bytes), f64(b0) * (frames / f64(f0)))
    ).when(frames >= f1, f64(b1) + f64(slope) * (frames - f1))
    for (la, ba), (lb, bb) in zip(tops, tops[1:]):
        value = value.when(frames <= lb, f64(ba) + (frames - la) / f64(lb - la) * f64(bb - ba))
    ratio = process_res / f64(MEASURED_RES)
    measured = frames.isin([n for n, _ in MEASURED_PEAKS]) & (process_res == MEASURED_RES)
    return value * ratio * ratio, measured


#: Frame counts are joined to segments in buckets of so many.
BUCKET = 16


def ladder_segments(rungs: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of each measured ladder: keys, over, upto (frames), base_bytes, slope, offset, rung.

    ``rungs``: keys, frames, peak_bytes, one row per frame count, made non-decreasing first. A piece holds the
    frames in (over, upto]: up to the first rung peaks shrink in proportion, between rungs they are
    interpolated, beyond the last one (``upto`` NULL) they go on as from the last rung that was lower.
    """
    tops = monotone_ladder(rungs, keys)
    order = W.partitionBy(*keys).orderBy("frames")
    whole = W.partitionBy(*keys)
    lower = F.struct("frames", "peak_bytes")
    marked = tops.withColumns(
        {
            "_f": F.lag("frames").over(order),
            "_b": F.lag("peak_bytes").over(order),
            "_last": F.max("frames").over(whole),
            "_top": F.max("peak_bytes").over(whole),
        }
    ).withColumn("_low", F.max(F.when(F.col("peak_bytes") < F.col("_top"), lower)).over(whole))
    number = lambda c: F.col(c).cast("double")
    first = F.col("_f").isNull()
    inner = marked.select(
        *keys,
        F.coalesce("_f", F.lit(-1)).alias("over"),
        F.col("frames").alias("upto"),
        F.when(first, f64(0)).otherwise(number("_b")).alias("base_bytes"),
        F.when(first, number("peak_bytes") / F.col("frames"))
        .otherwise((number("peak_bytes") - number("_b")) / (F.col("frames") - F.col("_f")))
        .alias("slope"),
        F.coalesce("_f", F.lit(0)).alias("offset"),
        F.col("frames").alias("rung"),
    )
    beyond = marked.where("frames = _last").select(
        *keys,
        F.col("frames").alias("over"),
        F.lit(None).cast(marked.schema["frames"].dataType).alias("upto"),
        number("peak_bytes").alias("base_bytes"),
        F.coalesce((number("_top") - F.col("_low.peak_bytes")) / (F.col("frames") - F.col("_low.frames")), f64(0)).alias("slope"),
        F.col("frames").alias("offset"),
        F.lit(None).cast(marked.schema["frames"].dataType).alias("rung"),
    )
    return inner.unionByName(beyond)


def predict_from_ladders(runs: DataFrame, rungs: DataFrame, resident_bytes: int) -> DataFrame:
    """``runs`` (run_id, label, frames, process_res) with predicted_bytes, measured and ladder_res.

    ``rungs``: label, process_res, frames, peak_bytes. A run follows the ladder of its label at its resolution,
    or else that of the highest resolution measured for the label, scaled by the square of the ratio.
    Segments and runs meet on buckets of frame counts, and the exact range decides; a run beyond its
    ladder looks into the bucket where the ladder ends. Labels without a ladder give NULL. ``measured`` is
    true for a rung itself at its own resolution.
    """
    keys = ["label", "ladder_res"]
    ladders = cut_lineage(ladder_segments(rungs.withColumnRenamed("process_res", "ladder_res"), keys))
    ends = ladders.where(F.col("upto").isNull()).select(*keys, F.col("over").alias("_end"))
    own = ends.select("label", F.col("ladder_res").alias("process_res"), F.col("ladder_res").alias("_own"), F.col("_end").alias("_own_end"))
    best = ends.groupBy("label").agg(F.max_by(F.struct("ladder_res", "_end"), "ladder_res").alias("_best"))
    placed = runs.join(own, ["label", "process_res"], "left").join(best, "label", "left").select(
        *runs.columns,
        F.coalesce("_own", "_best.ladder_res").alias("ladder_res"),
        F.coalesce("_own_end", "_best._end").alias("_end"),
    )
    bucket = lambda c: F.floor(c / BUCKET)
    placed = placed.withColumn("_bucket", bucket(F.least(F.col("frames"), F.col("_end") + 1)))
    last = F.coalesce(F.col("upto"), F.col("over") + 1)
    spread = exploded(ladders.withColumn("_bucket", F.explode(F.sequence(bucket(F.greatest(F.col("over") + 1, F.lit(0))), bucket(last)))))
    inside = (F.col("p.frames") > F.col("s.over")) & F.coalesce(F.col("p.frames") <= F.col("s.upto"), F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_bucket"]])
    joined = placed.alias("p").join(spread.alias("s"), same & inside, "left")
    value = F.col("s.base_bytes") + F.col("s.slope") * (F.col("p.frames") - F.col("s.offset"))
    value = F.when(F.col("s.over") < 0, F.greatest(f64(resident_bytes), value)).otherwise(value)
    ratio = F.col("p.process_res") / F.col("p.ladder_res").cast("double")
    exact = (F.col("p.frames") == F.col("s.rung")) & (F.col("p.process_res") == F.col("p.ladder_res"))
    return joined.select(
        *[F.col(f"p.{c}") for c in runs.columns],
        (value * ratio * ratio).alias("predicted_bytes"),
        F.coalesce(exact, F.lit(False)).alias("measured"),
        F.col("p.ladder_res").alias("ladder_res"),
    )


def allocator_fit(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Line of allocator peak (GiB) against frame count."""
    y, x = F.col("torch_peak_bytes") / f64(GIB), F.col("frame_count").cast("double")
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.regr_slope(y, x).alias("gib_per_frame"),
        F.regr_intercept(y, x).alias("base_gib"),
    )


def memory_facts(peak: Column, baseline: Column, total: Column) -> tuple[Column, Column]:
    """Activation bytes over the resident model, and the peak's share of the device."""
    share = F.when(total > 0, peak / F.nullif(total, F.lit(0))).otherwise(f64(0))
    return F.greatest(F.lit(0), peak - baseline), share


def upload_bracket(frames: Column, width: Column, height: Column) -> tuple[Column, Column]:
    pixels = (frames * width * height).cast("double")
    low, high = JPEG_BYTES_PER_PIXEL
    return half_up(pixels * f64(low)), half_up(pixels * f64(high))


def saved_bytes(artifacts: Column) -> Column:
    """Bytes a save would fetch: the sum over a manifest's artifacts."""
    return F.aggregate(
        artifacts, F.lit(0).cast("long"), lambda total, a: total + F.coalesce(a["size_bytes"], F.lit(0))
    )


def artifact_kind(name: Column, bundle_name: str) -> Column:
    """Kind by suffix, NULL when not an artifact; only our own bundle is ``npz``."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kinds = F.create_map(*(F.lit(v) for pair in ARTIFACT_KINDS.items() for v in pair))
    kind = F.get(F.array(F.try_element_at(kinds, suffix)), F.lit(0))
    return F.when((kind == "npz") & (name != bundle_name), F.lit("npz_native")).otherwise(kind)


def publish_mode(bucket: Column, errors: Column) -> Column:
    return (
        F.when(F.coalesce(bucket, F.lit("")) == "", F.lit("local"))
        .when(F.size(errors) > 0, F.lit("degraded"))
        .otherwise(F.lit("gcs"))
    )


def trusted_artifact(artifact: Column, run_id: Column, bucket: str) -> Column:
    """The artifact's name is plain and its address is the one this run must have."""
    name, durable = artifact["name"], artifact["gs_uri"]
    plain = name.isNotNull() & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit(".."))
    expected = F.concat(F.lit(f"gs://{bucket}/runs/transient/"), run_id, F.lit("/"), name)
    local = F.concat(F.lit("/artifact/"), run_id, F.lit("/"), name)
    address = F.when(durable.isNotNull(), durable == expected).otherwise(artifact["url"] == local)
    return F.coalesce(plain & address, F.lit(False))


def save_rules(runs: DataFrame, bucket: str) -> DataFrame:
    """Safe id, trusted artifacts, and whether a save needs the service to be up."""
    run = F.col("run_id").cast("string")
    trusted = F.forall("artifacts", lambda a: trusted_artifact(a, run, bucket))
    durable = F.forall(
        "artifacts", lambda a: trusted_artifact(a, run, bucket) & a["gs_uri"].isNotNull()
    )
    none = F.coalesce(F.size("artifacts") <= 0, F.lit(True))
    return runs.select(
        "run_id",
        run.rlike(RUN_ID_PATTERN).alias("safe_id"),
        F.coalesce(trusted, F.lit(False)).alias("trusted"),
        (none | ~F.coalesce(durable, F.lit(False))).alias("needs_service"),
    )


def retention_candidates(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries older than the retention window. Reporting only: nothing is deleted."""
    cutoff = now - F.make_interval(secs=F.lit(ttl_seconds))
    return entries.where(F.col("modified_at") < cutoff)


def parameter_errors(params: DataFrame) -> Column:
    """Every broken limit of an inference request, as a list of short texts."""
    rules = [
        ((F.col("fps") > 0) & (F.col("fps") <= FPS_MAX), "fps must be in (0, 60]"),
        (
            F.col("duration_s").isNull() | (F.col("duration_s") > 0),
            "source duration must be positive",
        ),
        (F.col("process_res").between(*RES_RANGE), "process_res must be in [126, 1024]"),
        (F.col("max_frames").between(*FRAMES_RANGE), "max_frames must be in [2, 512]"),
        (F.col("frame_count") >= 2, "at least two frames are needed"),
        (F.col("frame_count") <= F.col("max_frames"), "frames exceed max_frames"),
    ]
    return F.array_compact(
        F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in rules))
    )


def licence_eligible(profile: Column, licence: Column) -> Column:
    """NULL when the model may be used under the profile, else why not."""
    allowed = reduce(
        lambda a, b: a | b,
        ((profile == p) & licence.isin(*classes) for p, classes in PROFILE_LICENCES.items()),
    )
    known = profile.isin(*PROFILE_LICENCES)
    return F.when(~known, F.lit("profile not permitted")).when(
        ~F.coalesce(allowed, F.lit(False)), F.concat(F.lit("not eligible: "), licence)
    )


def sweep_rungs(sweeps: DataFrame) -> DataFrame:
    """Nested sweeps to one row per measured rung."""
    return sweeps.select(
        "label", "date", "batch", F.explode("runs").alias("r")
    ).select("label", "date", "batch", "r.*")


def upsert_rungs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new measurement replaces only its own (label, frames, process_res); of one batch the largest row."""
    keys = ["label", "frames", "process_res"]
    columns = [c for c in stored.columns if c not in keys]
    both = stored.unionByName(incoming)
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), F.struct("batch", F.to_json(F.struct(*columns)))).alias("r"))
        .select(*keys, "r.*")
    )


def current_registry(events: DataFrame) -> DataFrame:
    """Latest state per run of an append-only registry; deleted runs drop out, built-ins cannot be deleted.

    ``events``: run_id, seq, action (register | save | delete), builtin and
    descriptive columns. Saving marks the run persisted. After a delete only a
    later register brings the run back, and only a save after that keeps it.
    """
    live = events.where(~((F.col("action") == "delete") & F.col("builtin")))
    columns = [c for c in live.columns if c not in ("run_id", "seq", "action")]
    is_ = lambda a: F.col("action") == a
    state = live.groupBy("run_id").agg(
        F.max(F.when(is_("delete"), F.col("seq"))).alias("_deleted"),
        F.max(F.when(is_("register"), F.col("seq"))).alias("_registered"),
        F.max(F.when(is_("save"), F.col("seq"))).alias("_saved"),
        F.max_by(F.struct(*columns), F.when(is_("register"), F.col("seq"))).alias("r"),
    )
    persisted = F.coalesce(F.col("_saved") > F.col("_registered"), F.lit(False))
    back = F.col("_deleted").isNull() | (F.col("_registered") > F.col("_deleted"))
    return state.where(back & F.col("r").isNotNull()).select(
        "run_id", persisted.alias("persisted"), "r.*"
    )
