"""Repeat measurements: identity, numbering, duplicates, statistics, merging, grading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite
from plumbline.operators.calibrate import MIN_TRIALS_FOR_SPREAD
from plumbline.operators.ranks import exact_nmad, exact_percentiles, with_ordinal
from plumbline.operators.scale import even_median

GROUP = ["object_id", "run_id"]

# Fixed value: the sitting given to rows recorded before sittings existed.
LEGACY_SITTING = "unrecorded"
MIGRATE_BLOCK = 65536
VEIL = "•••"
BLANK = "—"


def trial_id(object_id: Column, run_id: Column, index: Column) -> Column:
    return F.concat(object_id.cast("string"), F.lit(":"), run_id.cast("string"), F.lit("#"), index.cast("string"))


def trial_identity(trial: Column, captured_at: Column) -> Column:
    return F.concat_ws("@", trial, captured_at.cast("string"))


def evidence_id(trial: Column, sitting: Column, captured_at: Column, digest: Column) -> Column:
    return F.concat_ws(
        "@",
        trial,
        sitting.cast("string"),
        captured_at.cast("string"),
        F.coalesce(digest, F.lit("no-mask")),
    )


def number_new_trials(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Give new trials the next indices of their (object, run): highest ever used, plus one on.

    New arrivals are ordered by instant then id. Each hour is sorted on its own
    and earlier hours count as an offset.
    """
    used = existing.groupBy(*GROUP).agg(F.max("trial_index").alias("_used"))
    hourly = incoming.withColumn("_hour", F.date_trunc("hour", "captured_at"))
    placed = with_ordinal(hourly, GROUP, "_hour", ["captured_at", "event_id"], "_at")
    index = F.coalesce(F.col("_used"), F.lit(0)) + F.col("_at") + 1
    return (
        placed.join(used, GROUP, "left")
        .withColumn("trial_index", index.cast("long"))
        .withColumn("trial_id", trial_id(F.col("object_id"), F.col("run_id"), F.col("trial_index")))
        .drop("_at", "_used", "_hour", "group_rows")
    )


def duplicate_masks(trials: DataFrame) -> DataFrame:
    """Trials whose mask digest an earlier trial of the same (object, run) already used.

    Only the first index per digest is aggregated and joined back, so a digest
    shared by a third of the rows is not sorted in one task.
    """
    masked = trials.where(F.col("mask_digest").isNotNull())
    firsts = masked.groupBy(*GROUP, "mask_digest").agg(F.min("trial_index").alias("_first"))
    return (
        masked.join(firsts, [*GROUP, "mask_digest"])
        .where(F.col("trial_index") > F.col("_first"))
        .drop("_first")
    )


def trial_stats(trials: DataFrame) -> DataFrame:
    """Spread of repeat readings per (object, run), split within and between sittings."""
    rows = trials.where(finite(F.col("raw_m"))).withColumn(
        "_sitting", F.coalesce(F.col("sitting_id").cast("string"), F.lit(LEGACY_SITTING))
    )
    sittings = rows.groupBy(*GROUP, "_sitting").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("raw_m").alias("_sum"),
        F.avg("raw_m").alias("_mean"),
        F.min("raw_m").alias("_min"),
        F.max("raw_m").alias("_max"),
    )
    whole = sittings.groupBy(*GROUP).agg(
        F.sum("_n").alias("n"),
        (F.sum("_sum") / F.sum("_n")).alias("mean_m"),
        F.min("_min").alias("min_m"),
        F.max("_max").alias("max_m"),
        (F.max("_max") - F.min("_min")).alias("range_m"),
        F.count(F.lit(1)).alias("sitting_count"),
        F.max(F.when(F.col("_n") >= 2, F.col("_max") - F.col("_min"))).alias("within_sitting_range_m"),
        F.when(F.count(F.lit(1)) >= 2, F.max("_mean") - F.min("_mean")).alias(
            "between_sitting_range_m"
        ),
    )
    spread = exact_nmad(rows, GROUP, F.col("raw_m"), "_nmad", middle="median_m")
    paint = exact_percentiles(rows, GROUP, F.col("paint_ms"), {"median_paint_ms": 50}).drop("n")
    return (
        whole.join(spread, GROUP)
        .join(paint, GROUP, "left")
        .withColumn("nmad_m", F.when(F.col("n") >= MIN_TRIALS_FOR_SPREAD, F.col("_nmad")))
        .drop("_nmad")
    )


def _first_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``stored_seq`` (if there is one), then by the other columns."""
    rest = [c for c in rows.columns if c not in keys]
    rest = sorted(rest, key=lambda c: c != "stored_seq")
    first = F.min(F.struct(*rest)).alias("_r")
    return rows.groupBy(*keys).agg(first).select(*keys, "_r.*").select(*rows.columns)


def merge_trials(local: DataFrame, stored: DataFrame) -> DataFrame:
    """Local rows, then stored rows with an identity seen nowhere yet. Local rows without an instant all stay.

    Of stored rows that share an identity the smallest, by ``stored_seq`` if there is one and then by
    all columns, stays, in whatever order they are read.
    """
    timed = stored.where(F.col("captured_at").isNotNull())
    once = _first_of(timed, ["trial_id", "captured_at"])
    fresh = once.join(local.select("trial_id", "captured_at"), ["trial_id", "captured_at"], "left_anti")
    # Without an instant the identity is the id alone.
    loose = _first_of(stored.where(F.col("captured_at").isNull()), ["trial_id"])
    known = local.where(F.col("captured_at").isNull()).select("trial_id")
    fresh_loose = loose.join(known, ["trial_id"], "left_anti")
    return local.unionByName(fresh).unionByName(fresh_loose)


def migrate_trials(rows: DataFrame, legacy_prefix: str) -> DataFrame:
    """Bring old rows to the current shape: run id from setting, index, id, sitting.

    ``rows``: ord, object_id, run_id, setting, trial_index, trial_id, sitting_id,
    captured_at. A missing index continues after the highest value its group has
    reached so far in stored order; rows are de-duplicated by identity, but rows
    with no instant are never merged.
    """
    run = F.coalesce(F.col("run_id"), F.concat(F.lit(legacy_prefix), F.col("setting")))
    keys = ["object_id", "run_id"]
    blocked = rows.withColumn("run_id", run).withColumn("_block", F.expr(f"ord div {MIGRATE_BLOCK}"))
    placed = with_ordinal(blocked, keys, "_block", ["ord"], "_pos").withColumn(
        "_ahead", F.col("trial_index") - (F.col("_pos") + 1)
    )
    # A missing index is its position plus the furthest any earlier explicit index
    # has run ahead of its own: a prefix maximum, per block and then across blocks.
    tops = placed.groupBy(*keys, "_block").agg(F.max("_ahead").alias("_top"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*keys, "_block", F.max("_top").over(earlier).alias("_carried"))
    inside = W.partitionBy(*keys, "_block").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    lead = F.greatest(F.col("_inside"), F.col("_carried"), F.lit(0))
    lifted = placed.withColumn("_inside", F.max("_ahead").over(inside)).join(carried, [*keys, "_block"])
    index = F.coalesce(F.col("trial_index"), F.col("_pos") + 1 + lead).cast("long")
    keeps = F.coalesce(F.contains(F.col("trial_id"), F.lit("#")), F.lit(False))
    shaped = (
        lifted.withColumn("trial_index", index)
        .withColumn(
            "trial_id",
            F.when(keeps, F.col("trial_id")).otherwise(
                trial_id(F.col("object_id"), F.col("run_id"), F.col("trial_index"))
            ),
        )
        .withColumn("sitting_id", F.coalesce("sitting_id", F.lit(LEGACY_SITTING)))
        .drop("_pos", "_block", "_ahead", "_inside", "_carried", "group_rows", "setting")
    )
    timed = shaped.where(F.col("captured_at").isNotNull())
    firsts = timed.groupBy("trial_id", "captured_at").agg(F.min("ord").alias("ord"))
    kept = timed.join(firsts, ["trial_id", "captured_at", "ord"], "left_semi")
    return kept.unionByName(shaped.where(F.col("captured_at").isNull()))


def rekey_masks(masks: DataFrame, targets: DataFrame, active_clip: str) -> DataFrame:
    """File each old mask under the one clip that owns its subject, else under the active clip.

    ``masks``: key ('subject:frame', or already 'clip/subject:frame').
    """
    subject = F.regexp_extract("key", r"^(.*):[^:]*$", 1)
    owners = targets.groupBy(F.coalesce("mask_owner_id", "object_id").alias("subject")).agg(
        F.min("clip_key").alias("_low"), F.max("clip_key").alias("_high")
    )
    owner = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.lit(active_clip))
    placed = F.contains(F.col("key"), F.lit("/"))
    return (
        masks.withColumn("subject", subject)
        .join(owners, "subject", "left")
        .withColumn(
            "key",
            F.when(placed, F.col("key")).otherwise(F.concat_ws("/", owner.cast("string"), F.col("key"))),
        )
        .drop("subject", "_low", "_high")
    )


def restore_targets(existing: DataFrame, offered: DataFrame) -> DataFrame:
    """Existing targets plus offered ones whose (clip, id) is new; restored ones are not built in."""
    fresh = (
        offered.where(F.col("object_id").isNotNull())
        .transform(_first_of, ["clip_key", "object_id"])
        .join(existing.select("clip_key", "object_id"), ["clip_key", "object_id"], "left_anti")
        .withColumn("builtin", F.lit(False))
    )
    return existing.unionByName(fresh)


def remove_target(
    targets: DataFrame, trials: DataFrame, removals: DataFrame, clip_runs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop targets and, within their clip's runs, the trials that measured them. Built-ins stay."""
    gone = targets.where(~F.col("builtin")).join(removals, ["clip_key", "object_id"], "left_semi")
    # A trial meets its own run's clips only; one clip of several that removes the object is enough.
    placed = trials.select("object_id", "run_id").distinct().join(clip_runs.distinct(), "run_id")
    scope = placed.join(gone.select("clip_key", "object_id"), ["clip_key", "object_id"], "left_semi")
    scope = scope.select("object_id", "run_id").distinct()
    kept_targets = targets.join(gone.select("clip_key", "object_id"), ["clip_key", "object_id"], "left_anti")
    return kept_targets, trials.join(scope, ["object_id", "run_id"], "left_anti")


def remove_runs(trials: DataFrame, runs: DataFrame) -> DataFrame:
    return trials.join(runs.select("run_id"), "run_id", "left_anti")


def next_target_code(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    number = F.regexp_extract(F.coalesce("code", F.lit("")), r"^T(\d+)$", 1)
    highest = F.max(F.when(number != "", number.cast("long")))
    return targets.groupBy(*keys).agg(
        F.concat(F.lit("T"), (F.coalesce(highest, F.lit(0)) + 1).cast("string")).alias("next_code")
    )


def target_slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-|-$", "")
    return F.when(bare == "", F.lit("target")).otherwise(bare)


def representative_trials(trials: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """The trial nearest the averaged median of its group; the lower index wins a tie."""
    rows = trials.where(finite(F.col("raw_m")))
    middle = even_median(rows, list(keys), F.col("raw_m"), "_middle")
    # Equal to a trillionth counts as a tie.
    off = F.round(F.abs(F.col("raw_m") - F.col("_middle")), 12)
    counted = rows.join(middle, list(keys)).withColumn("_off", off)
    columns = [c for c in rows.columns if c not in keys]
    return (
        counted.groupBy(*keys)
        .agg(
            F.min_by(F.struct(*columns), F.struct("_off", "trial_index")).alias("t"),
            F.count(F.lit(1)).alias("candidates"),
        )
        .select(*keys, "candidates", "t.*")
    )


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits: the nearest to the exact binary value, true halves away from zero.

    The formatter rounds the shortest decimal that prints a double, so one just below a half went up.
    Where the product with ``2 * 10**digits`` is next to an odd number, the product's exact error tells
    on which side of the half the value lies.
    """
    v = F.abs(value.cast("double"))
    scale = f64(2 * 10**digits)
    shifted = v * f64(2**27 + 1)
    high = shifted - (shifted - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    half = F.rint(product)
    below = (product - half) + error
    below_half = (half % f64(2) == f64(1)) & (below < f64(0)) & (below > f64(-0.4))
    lower = value - F.signum(value) * f64(0.25 / 10**digits)
    return F.format_string(f"%.{digits}f", F.when(below_half, lower).otherwise(value))


def signed_text(value: Column, digits: int) -> Column:
    """``+1.2``, ``-0.4`` or an unsigned zero."""
    text = fixed(value, digits)
    zero = text.cast("double") == 0
    return (
        F.when(zero, F.lit(f"{0:.{digits}f}"))
        .when(value > 0, F.concat(F.lit("+"), text))
        .otherwise(text)
    )


def run_evidence(
    trials: DataFrame, targets: DataFrame, focused: DataFrame | None = None
) -> DataFrame:
    """The one ruler drawn per (object, run): a focused trial, else the representative one.

    ``trials`` with a NULL ruler are not candidates. ``focused``: trial_id, captured_at.
    """
    ruled = trials.where(F.col("ruler").isNotNull())
    chosen = representative_trials(ruled).withColumn("focused", F.lit(False))
    if focused is not None:
        picked = ruled.join(focused, ["trial_id", "captured_at"], "left_semi")
        sizes = ruled.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("candidates"))
        named = picked.join(sizes, GROUP).withColumn("focused", F.lit(True))
        rest = chosen.join(named.select(*GROUP).distinct(), GROUP, "left_anti")
        chosen = rest.unionByName(named.select(*chosen.columns))
    code = F.coalesce(F.col("code"), F.col("object_id").cast("string"))
    value = F.concat(code, F.lit(" · "), fixed(F.col("raw_m"), 3), F.lit(" m"))
    label = (
        F.when(F.col("candidates") < 2, value)
        .when(
            F.col("focused"),
            F.concat(
                value,
                F.lit(" · trial "),
                F.col("trial_index").cast("string"),
                F.lit(" of "),
                F.col("candidates").cast("string"),
            ),
        )
        .otherwise(F.concat(value, F.lit(" · median of "), F.col("candidates").cast("string")))
    )
    return chosen.join(targets.select("object_id", "code"), "object_id", "left").select(
        *GROUP, "trial_id", "trial_index", "candidates", code.alias("code"), label.alias("label"), "raw_m", "focused"
    )


def grade_readings(rows: DataFrame) -> DataFrame:
    """Read-out of one reading: refused, idle, blind, ungraded or graded, with its text.

    Reads floor_state (ok | failed | stale), raw_m, truth_m, blind. The floor is
    judged first: a height over a stale floor is not an answer.
    """
    raw, truth = F.col("raw_m"), F.col("truth_m")
    measured = F.coalesce(finite(raw), F.lit(False))
    known = F.coalesce(truth > 0, F.lit(False))
    kind = (
        F.when(F.col("floor_state") != "ok", F.lit("refused"))
        .when(~measured, F.lit("idle"))
        .when(F.col("blind"), F.lit("blind"))
        .when(~known, F.lit("ungraded"))
        .otherwise(F.lit("graded"))
    )
    k = F.col("kind")
    metres = lambda c: F.concat(fixed(c, 3), F.lit(" m"))
    value = F.when(k == "blind", F.lit(VEIL)).when(k.isin("graded", "ungraded"), metres(raw))
    truth_text = (
        F.when((k == "blind") & truth.isNotNull(), metres(truth))
        .when(k == "graded", metres(truth))
        .when(k.isin("blind", "ungraded"), F.lit("no tape truth"))
    )
    error = F.when(k == "blind", F.lit(VEIL)).when(
        k == "graded", F.concat(signed_text((raw - truth) * f64(100), 1), F.lit(" cm"))
    )
    percent = F.when(k == "blind", F.lit(VEIL)).when(
        k == "graded", F.concat(signed_text((raw - truth) / truth * f64(100), 1), F.lit("%"))
    )
    text = lambda c: F.coalesce(c, F.lit(BLANK))
    return rows.withColumn("kind", kind).withColumns(
        {
            "value_text": text(value),
            "truth_text": text(truth_text),
            "error_text": text(error),
            "percent_text": text(percent),
        }
    )


def study_groups(published: DataFrame) -> DataFrame:
    """Published trials per (run, target): averaged median, mean, spread, error and mask source."""
    keys = ["run_id", "object_id"]
    middle = even_median(published, keys, F.col("stored_m"), "median_m")
    stats = published.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("stored_m").alias("mean_m"),
        (F.max("stored_m") - F.min("stored_m")).alias("spread_m"),
        F.first("truth_m", ignorenulls=True).alias("truth_m"),
        F.bool_and("automatic").alias("_all"),
        F.bool_or("automatic").alias("_any"),
    )
    error = F.col("median_m") - F.col("truth_m")
    source = (
        F.when(F.col("_all"), F.lit("automatic"))
        .when(F.col("_any"), F.lit("mixed"))
        .otherwise(F.lit("brush"))
    )
    return stats.join(middle, keys).select(
        *keys,
        source.alias("mask_source"),
        "n",
        "median_m",
        "mean_m",
        "spread_m",
        "truth_m",
        error.alias("error_m"),
        (error / F.nullif(F.col("truth_m"), f64(0)) * f64(100)).alias("error_pct"),
    )


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """One row per attempt id: the most recently updated; ties go by outcome, then by the other columns."""
    first = ["updated_at", "outcome"]
    rest = [c for c in attempts.columns if c not in ("attempt_id", *first)]
    latest = F.max(F.struct(*first, *rest)).alias("a")
    return attempts.groupBy("attempt_id").agg(latest).select("attempt_id", "a.*").select(*attempts.columns)


def attempt_counts(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    # The outcomes an attempt can end in.
    outcomes = ["proposed", "accepted", "abstained", "failed"]
    return latest_attempts(attempts).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes),
    )
