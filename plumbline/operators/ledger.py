"""Content keys of derived artefacts: identity, staleness, lineage closure, re-run plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def canonical_map(entries: Column) -> Column:
    """A map with its keys in order, so equal maps print equally."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def port_identity(upstream_key: Column, source_port: Column) -> Column:
    """What arrives on an input: the upstream key with the output port folded in."""
    return F.sha2(F.concat(upstream_key, F.lit("/"), source_port), 256)


def content_key(
    producer: Column, version: Column, inputs: Column, params: Column, contract: str
) -> Column:
    """SHA-256 of the canonical JSON identity of an output.

    ``inputs`` is a map of port to digest, ``params`` canonical JSON text. Object
    keys are in sorted order and there is no whitespace.
    """
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    member = lambda name, c: F.concat(
        F.lit(f'"{name}":'), F.regexp_replace(quoted(c), r'^\{"v":|\}$', "")
    )
    text = F.concat(
        F.lit("{"),
        member("contract_version", F.lit(contract)),
        F.lit(',"input_content_sha256":'),
        F.to_json(canonical_map(inputs)),
        F.lit(',"parameters":'),
        F.coalesce(params, F.lit("{}")),
        F.lit(","),
        member("producer_node", producer),
        F.lit(","),
        member("producer_version", version),
        F.lit("}"),
    )
    return F.sha2(text, 256)


def desired_keys(steps: DataFrame, edges: DataFrame, contract: str) -> DataFrame:
    """Key of every step from its own identity and the keys of what feeds it.

    ``steps``: node, producer, version, params (canonical JSON text). ``edges``:
    src, src_port, dst, dst_port. One round per topological depth; a step is keyed
    once all its inputs are, and a step on a cycle never is, nor is one with two
    edges into one port (see ``port_faults``). The inputs of a step are folded
    into a map, bounded by its port count.
    """
    # Looked for once; without one, no round has to take them out of the edges again.
    faulty = cut_lineage(port_faults(edges).select(F.col("node").alias("dst")).distinct())
    needs_all = edges
    if not faulty.isEmpty():
        edges = edges.join(faulty, "dst", "left_anti")
    empty = F.create_map().cast("map<string,string>")
    key = content_key(F.col("producer"), F.col("version"), F.col("inputs"), F.col("params"), contract)
    needs = needs_all.groupBy("dst").agg(F.count(F.lit(1)).alias("_needs"))
    pending = cut_lineage(
        steps.join(needs.withColumnRenamed("dst", "node"), "node", "left").fillna(0, ["_needs"])
    )
    sources = pending.where(F.col("_needs") == 0).withColumn("inputs", empty)
    keyed = cut_lineage(sources.select("node", key.alias("key")))
    layer = keyed
    while not layer.isEmpty():
        # A step is ready in the round that keys the last of its inputs, so only
        # steps fed by the newest layer are looked at.
        touched = edges.join(layer.select(F.col("node").alias("src")), "src", "left_semi")
        fed = edges.join(touched.select("dst").distinct(), "dst", "left_semi")
        arrived = (
            fed.join(keyed.select(F.col("node").alias("src"), "key"), "src")
            .groupBy("dst")
            .agg(
                F.count(F.lit(1)).alias("_have"),
                F.map_from_entries(
                    F.collect_list(
                        F.struct("dst_port", port_identity(F.col("key"), F.col("src_port")).alias("d"))
                    )
                ).alias("inputs"),
            )
            .withColumnRenamed("dst", "node")
        )
        ready = pending.join(arrived, "node").where(F.col("_have") == F.col("_needs"))
        layer = cut_lineage(ready.select("node", key.alias("key")))
        keyed = keyed.unionByName(layer)
    return keyed


def port_faults(edges: DataFrame) -> DataFrame:
    """(node, dst_port, sources, reason) of each input port that more than one edge feeds."""
    fed = edges.groupBy(F.col("dst").alias("node"), "dst_port").agg(F.count(F.lit(1)).alias("sources"))
    return fed.where("sources > 1").withColumn("reason", F.lit("several edges into one port"))


def stale_audit(held: DataFrame, desired: DataFrame) -> DataFrame:
    """Held key against desired key per step; a step never run is stale too."""
    return desired.withColumnRenamed("key", "desired").join(
        held.withColumnRenamed("key", "held"), "node", "left"
    ).withColumn("stale", ~F.col("held").eqNullSafe(F.col("desired")))


def rerun_plan(audit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return audit.groupBy(*keys).agg(
        F.count_if(~F.col("stale")).alias("cached"), F.count_if(F.col("stale")).alias("rerun_required")
    )


def closure(edges: DataFrame, roots: DataFrame, downstream: bool = True) -> DataFrame:
    """Every node reachable from each root: (root, node, depth), the root itself left out.

    Each round extends the frontier by one equi-join and drops what was already
    reached, so a node is expanded once per root.
    """
    here, there = ("src", "dst") if downstream else ("dst", "src")
    frontier = roots.select(F.col("node").alias("root"), "node").distinct()
    reached = frontier
    found: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        hop = (
            edges.select(F.col(here).alias("node"), F.col(there).alias("next"))
            .join(frontier, "node")
            .select("root", F.col("next").alias("node"))
            .distinct()
            .join(reached.select("root", "node"), ["root", "node"], "left_anti")
        )
        frontier = cut_lineage(hop)
        if frontier.isEmpty():
            break
        step = frontier.withColumn("depth", F.lit(depth).cast("long"))
        found = step if found is None else found.unionByName(step)
        reached = reached.unionByName(frontier)
    if found is None:
        return frontier.withColumn("depth", F.lit(0).cast("long"))
    return found
