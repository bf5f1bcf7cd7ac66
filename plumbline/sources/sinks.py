"""Exports: thinned clouds as text, sessions and study reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.cloud import thin_to
from plumbline.operators.trials import fixed, trial_stats


def seven_digits(value: Column) -> Column:
    """Seven significant digits without trailing zeros."""
    padded = F.format_string("%.7g", value)
    short = F.regexp_replace(padded, r"(\.\d*?)0+($|e)", "$1$2")
    return F.regexp_replace(short, r"\.($|e)", "$1")


def cloud_lines(points: DataFrame, max_points: int, order: list[str]) -> DataFrame:
    """One text line per kept point (x y z r g b), in stored order."""
    kept = thin_to(points, max_points, order)
    colour = [F.col(c) if c in points.columns else F.lit(0) for c in "rgb"]
    return kept.select(
        "run_id",
        "ord",
        F.concat_ws(
            " ",
            *(seven_digits(F.col(c)) for c in "xyz"),
            *(F.coalesce(c, F.lit(0)).cast("int").cast("string") for c in colour),
        ).alias("line"),
    )


def cloud_headers(lines: DataFrame) -> DataFrame:
    """The header that belongs in front of each run's lines."""
    # The text form of the point format.
    head = "ply\nformat ascii 1.0\nelement vertex "
    tail = (
        "\nproperty float x\nproperty float y\nproperty float z\n"
        "property uchar red\nproperty uchar green\nproperty uchar blue\nend_header"
    )
    counts = lines.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "run_id", F.concat(F.lit(head), F.col("n").cast("string"), F.lit(tail)).alias("header")
    )


def write_cloud_text(points: DataFrame, path: str, max_points: int, order: list[str]) -> None:
    """Headers and ordered lines, one folder per run."""
    lines = cloud_lines(points, max_points, order)
    cloud_headers(lines).withColumn("run", F.col("run_id")).select("run", "header").write.mode(
        "append"
    ).partitionBy("run").text(f"{path}/headers")
    lines.withColumn("run", F.col("run_id")).repartitionByRange("run", "ord").sortWithinPartitions(
        "run", "ord"
    ).select("run", "line").write.mode("append").partitionBy("run").text(f"{path}/lines")


def session_export(trials: DataFrame, targets: DataFrame, clip_runs: DataFrame) -> DataFrame:
    """One JSON document line per record of a clip's session: trials, then repeatability.

    ``clip_runs``: clip_key, run_id. Lines instead of one document, so a clip with
    many trials is never gathered in one row.
    """
    scoped = trials.join(clip_runs, "run_id")
    records = scoped.select(
        "clip_key",
        F.lit("observation").alias("section"),
        F.col("trial_id").alias("item"),
        F.to_json(F.struct("trial_id", "object_id", "run_id", "trial_index", "raw_m")).alias("json"),
    )
    stats = (
        trial_stats(scoped)
        .join(clip_runs, "run_id")
        .join(targets.select("object_id", "code"), "object_id", "left")
    )
    repeat = stats.select(
        "clip_key",
        F.lit("repeatability").alias("section"),
        F.concat_ws(":", F.col("object_id").cast("string"), F.col("run_id").cast("string")).alias("item"),
        F.to_json(F.struct("object_id", "code", "run_id", "n", "sitting_count")).alias("json"),
    )
    return records.unionByName(repeat)


def study_lines(groups: DataFrame) -> DataFrame:
    """Markdown row per target of the replay study."""
    dash = F.lit("—")
    text = lambda c, s: F.coalesce(F.concat(c, F.lit(s)), dash)
    plus = lambda c, n: F.concat(
        F.when(F.col(c) >= 0, F.lit("+")).otherwise(F.lit("")), fixed(F.col(c), n)
    )
    cells = [
        F.col("object_id").cast("string"),
        F.col("mask_source"),
        text(fixed(F.col("truth_m"), 3), " m"),
        F.col("n").cast("string"),
        text(fixed(F.col("median_m"), 4), " m"),
        text(F.when(F.col("error_m").isNotNull(), plus("error_m", 4)), " m"),
        text(F.when(F.col("error_pct").isNotNull(), plus("error_pct", 1)), "%"),
        text(fixed(F.col("spread_m") * 1000, 1), " mm"),
    ]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return groups.select("run_id", "object_id", row.alias("line"))


def write_study(groups: DataFrame, published: DataFrame, failures: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").parquet(f"{path}/targets")
    published.write.mode("overwrite").parquet(f"{path}/trials")
    failures.write.mode("overwrite").json(f"{path}/failures")
    study_lines(groups).select("line").write.mode("overwrite").text(f"{path}/summary")
