"""Mixing sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Query, n_words, table

#: Expected copies of a document stop here.
MOST_COPIES = 3
#: Prefix sums run over (source, size, block), so that no source or size is summed in one task.
BLOCKS = 64
WEIGHTS = (1.0, 2.0, 3.0)
SEED = "mix-1"


def source_targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target.

    Sources in code point order, NULL last, weigh ``weights`` repeating. Targets share the sum of all
    sizes by weight; one that passes ``most`` times its source's size stops there and what it had too
    much is shared again. That is the level L with sum(least(most * size, L * weight)) = total, found
    by ordering sources by the level at which they stop. One row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(ordered) - 1, len(weights)) + 1).cast("int"))
    everywhere = Window.partitionBy()
    upto = Window.orderBy("stops", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size").cast("double") * most)
        .withColumn("stops", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everywhere).cast("double"))
        .withColumn("weight_sum", F.sum("weight").over(everywhere))
        .withColumn("spent", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
        .withColumn("weight_spent", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / (F.col("weight_sum") - F.col("weight_spent")))
    )
    # The first source that does not stop fixes the level for itself and all after it.
    level = F.min(F.when(F.col("level") <= F.col("stops"), F.struct("stops", "level"))).over(everywhere)["level"]
    return ranked.withColumn("final", level).select(
        "source",
        "source_size",
        F.when(F.col("final").isNull() | (F.col("stops") < F.col("final")), F.col("most"))
        .otherwise(F.least("most", F.col("final") * F.col("weight")))
        .alias("target"),
    )


def random_offset(source: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) per source and seed; the same in every run."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / 4294967296.0


def mix(
    docs: DataFrame,
    size: Column,
    most: int = MOST_COPIES,
    weights: tuple[float, ...] = WEIGHTS,
    seed: str = SEED,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``docs`` (doc_id, source and others) with size, source_size, target and copies.

    Within a source documents stand in order of (size, doc_id mod blocks, doc_id); each is expected
    target / source_size times, the expectations are summed up along the order from one random offset
    per source, and a document is taken once per whole number its stretch crosses. Ordering by size
    keeps the words taken near the target. The prefix sum is one over the sizes of a source, one over
    the blocks of a size and one inside each block, so a source or a size with a third of all rows is
    many groups.

    NULL sources form a source of their own; documents of size 0 are taken by the same rule and weigh
    nothing; a source of only such documents has target 0 and is not taken; NULL doc_ids come first in
    block 0; repeated rows are rows of their own. Columns of ``docs`` that bear a helper's name
    (size, source_size, target, copies) are replaced; all others are kept. No documents give no rows.
    """
    sized = docs.drop("source_size", "target", "copies").withColumn("size", size)
    sized = sized.withColumn("_block", F.coalesce(F.pmod(F.col("doc_id"), F.lit(blocks)), F.lit(0)).cast("long"))
    counts = sized.groupBy("source", "size", "_block").agg(F.count(F.lit(1)).alias("_n"))
    sources = source_targets(
        counts.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), most, weights
    )
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    smaller = counts.groupBy("source", "size").agg(F.sum("_n").alias("_n"))
    smaller = smaller.select("source", "size", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    before = Window.partitionBy("source", "size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.alias("c").join(
        smaller.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.size") == F.col("b.size"))
    ).select("c.source", "c.size", "c._block", (F.col("b._below") + F.col("c._before")).alias("_start"))
    starts = starts.alias("c").join(
        sources.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))
    ).select("c.*", "t.source_size", "t.target")
    key = ["source", "size", "_block"]
    ranked = sized.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")).cast("long")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ratio = F.least(ratio, F.lit(float(most)))
    offset = random_offset(F.col("source"), seed)
    at = F.col("_start") + F.col("_rank")
    copies = F.floor(offset + ratio * at) - F.floor(offset + ratio * (at - 1))
    joined = ranked.alias("d").join(
        starts.alias("s"),
        F.col("d.source").eqNullSafe(F.col("s.source"))
        & (F.col("d.size") == F.col("s.size"))
        & (F.col("d._block") == F.col("s._block")),
    )
    return (
        joined.select("d.*", "s._start", "s.source_size", "s.target")
        .withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
        .drop("_start", "_rank", "_block")
    )


def taken(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs`` only."""
    mixed = mix(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("doc_id", "source", "_row", size.alias("_size")), F.col("_size"), **options)
    repeated = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("n"))
    return mix(sized, F.col("n")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_sql(size_sql: str, docs: str = "documents") -> str:
    """CTEs up to ``mixed``: (doc_id, source, size, source_size, target, copies) of the rows of ``docs``."""
    return f"""
 sized AS (SELECT doc_id, source, {size_sql} AS size, doc_id % {BLOCKS} AS block FROM {docs}),
 sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
 weighed AS (SELECT *, 1.0e0 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM sources),
 ranked AS (SELECT *, source_size * 3.0e0 AS most, source_size * 3.0e0 / weight AS stops,
   CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM weighed),
 levels AS (SELECT a.source, a.stops,
   (any_value(a.total) - coalesce(sum(b.most) FILTER (b.before), 0e0)) /
     sum(b.weight) FILTER (NOT b.before) AS level
   FROM ranked a, LATERAL (SELECT most, weight,
     (stops, source IS NULL, coalesce(source, '')) < (a.stops, a.source IS NULL, coalesce(a.source, '')) AS before
     FROM ranked) b
   GROUP BY a.source, a.stops),
 final AS (SELECT arg_min(level, stops) AS level FROM levels WHERE level <= stops),
 targets AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR stops < f.level THEN most
   ELSE least(most, f.level * weight) END AS target FROM ranked CROSS JOIN final f),
 placed AS (SELECT s.*, t.source_size, t.target,
   row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.block, s.doc_id) AS place,
   CAST('0x' || substr(md5('{SEED}:' || coalesce('s' || s.source, 'null')), 1, 8) AS BIGINT) / 4294967296e0 AS shift,
   least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END, 3e0) AS ratio
   FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
 mixed AS (SELECT doc_id, source, size, source_size, target, CAST(least(floor(shift + ratio * place)
   - floor(shift + ratio * (place - 1)), 3) AS BIGINT) AS copies FROM placed)"""


SIZE_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

QUERIES = {
    "op10_source_mix": Query(
        op10,
        f"WITH {mix_sql(SIZE_SQL)} SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, "
        "CAST(copies * size AS BIGINT) AS taken FROM mixed",
    )
}
