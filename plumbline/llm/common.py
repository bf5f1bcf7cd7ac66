"""What the operators share: the word pattern, given tables, tables in the shared folder, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import checkpoint_dir, cut_lineage

WORD = r"[^\x20\x09-\x0D]+"

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    job: Job
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches, rows: int = 256):
    """The same rows in smaller batches, so that Python lists of long texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below the one every executor can reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, group: str, order: list[str], name: str, groups: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``at``, the place (from 0) within the group by ``order``, NULLs first, and ``n``, the group's size.

    Rows are dealt out by ranges of (group, order), so a group with a third of all rows is spread over many
    tasks, and stored in that order; a place is the row's own number in its range plus what ranges before
    hold of the group. Rows that tie keep any order, the same in all later steps. ``groups`` (group, more)
    gives columns to all rows of a group. NULL is a group of its own. ``rows`` is read twice: store it first.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_tie"))
    placed = dealt.sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = stored(placed.withColumn("_row", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_row", 33))
    runs = placed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_r")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first")
    )
    before = Window.partitionBy("_group").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "*",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_group")).alias("n"),
    )
    more = []
    if groups is not None:
        more = [c for c in groups.columns if c != group]
        runs = runs.join(groups, F.col("_group").eqNullSafe(F.col(group)), "left").drop(group)
    both = placed.join(runs, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return both.select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("at"), "n", *more)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes with an edge.

    Each round every node takes the smallest label among its neighbours' and its own, and then its
    label's label, so the longest path halves; the labels of a round are written to the shared
    folder. Loops and repeated edges are harmless. No edges give no rows.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    labels = cut_lineage(labels)
    for _ in range(rounds):
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(seen, labels.node == seen.a).select(
            "node", "component", F.least("component", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("over"))
        step = cut_lineage(
            step.join(jump, "next", "left").select(
                "node",
                F.least("next", "over").alias("component"),
                (F.least("next", "over") < F.col("component")).alias("moved"),
            )
        )
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
