"""A Merkle manifest of a dataset: one tree of digests per source, a tree over the sources, proofs and their check.

A node's siblings are found by an equi-join on their computed places: the row in slot zero of every 16 asks for
those up to 15 places further, and emits the parent. No group is gathered, and no join key is a source.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, in_order, stored, table

#: Children of a node.
FAN = 16
#: Characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOWER = (string.ascii_uppercase, string.ascii_lowercase)


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value ``-`` if NULL, else its UTF-8 byte count, ``:`` and the value itself."""
    told = []
    for v in values:
        v = v.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return digest(*told)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of ``path``, from the leaf's to the root's children, left to right."""
    return F.sha2(
        F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""),
        256,
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


@dataclass(frozen=True)
class Forest:
    """``nodes`` (tree, at, digest, n) and, level by level, the stored parents with their ``kids``."""

    nodes: DataFrame
    levels: list[DataFrame]


def _parents(nodes: DataFrame) -> DataFrame:
    """tree, at, n, kids, digest of the next level, of trees that have more than one node.

    The row in slot zero asks for its siblings' places, the last run's for fewer; what the equi-join finds
    meets under the parent, 16 rows at most. ``kids`` is the children's digests in a row.
    """
    live = nodes.where("n > 1")
    asked = live.where(F.col("at") % FAN == 0).select(
        "tree", "n", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + FAN, F.col("n")) - 1)).alias("at")
    )
    found = asked.join(live.select("tree", "at", "digest"), ["tree", "at"])
    sibling = F.struct("at", "digest")
    kids = F.array_join(F.transform(F.array_sort(F.collect_list(sibling)), lambda s: s["digest"]), "")
    runs = found.groupBy("tree", F.expr(f"at div {FAN}").alias("at")).agg(F.max("n").alias("n"), kids.alias("kids"))
    return runs.select("tree", "at", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "kids", F.sha2("kids", 256).alias("digest"))


def grow(nodes: DataFrame) -> Forest:
    """All levels over ``nodes`` (tree, at, digest, n and more); as many rounds as the largest tree is high."""
    nodes = stored(nodes, "merkle-leaves")
    most = nodes.agg(F.max("n")).head()[0] or 0
    levels, below = [], nodes
    while most > 1:
        below = stored(_parents(below), "merkle-level")
        levels.append(below)
        most = -(-most // FAN)
    return Forest(nodes, levels)


def tops(forest: Forest) -> DataFrame:
    """tree, digest: the last node of each tree; a lone leaf is its own."""
    found = forest.nodes.where("n = 1").select("tree", "digest")
    for level in forest.levels:
        found = found.union(level.where("n = 1").select("tree", "digest"))
    return found


def _beside(slot: Column, kids: Column) -> Column:
    """What stands before and after a child among its parent's children."""
    return F.struct(
        F.substring(kids, F.lit(1), slot * WIDTH).alias("before"),
        F.substring(kids, slot * WIDTH + WIDTH + 1, F.length(kids)).alias("after"),
    )


def descend(forest: Forest, crowns: DataFrame) -> DataFrame:
    """The forest's nodes with ``path``, the siblings from the node up, and the columns of ``crowns``.

    ``crowns``: tree, path (siblings above the tree), and columns that hold for a whole tree. Paths go
    from parents to children, at most 16 rows to a key.
    """
    more = [c for c in crowns.columns if c not in ("tree", "path")]

    def placed(rows: DataFrame, parents: DataFrame | None) -> DataFrame:
        own = [c for c in rows.columns]
        found = rows.where("n = 1").join(crowns, "tree").select(*own, "path", *more)
        if parents is None:
            return found
        above = parents.select("tree", F.col("at").alias("_up"), F.col("kids").alias("_kids"), "path", *more)
        inner = rows.where("n > 1").withColumn("_up", F.expr(f"at div {FAN}")).join(above, ["tree", "_up"])
        path = F.concat(F.array(_beside((F.col("at") % FAN).cast("int"), F.col("_kids"))), F.col("path"))
        return found.union(inner.select(*own, path.alias("path"), *more))

    below: DataFrame | None = None
    for level in reversed(forest.levels):
        below = placed(level, below)
    return placed(forest.nodes, below)


NO_PATH = "array<struct<before:string,after:string>>"


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str) -> DataFrame:
    """``rows`` with subroot (of the row's group), root and path (its siblings up to the root).

    ``group`` names the source, ``order`` the columns whose ascending order the leaves of a source take
    (NULLs first; rows that tie stand in any order), ``leaf`` the digest. NULL is a source of its own and
    stands first. Every row comes back once with all its columns, of any name (subroot, root and path are
    replaced); repeated rows are leaves of their own; no rows give no rows. Nothing is gathered: a source
    with a third of all rows is dealt out by ranges of ``order``.
    """
    kept = [c for c in rows.columns if c not in (leaf, "subroot", "root", "path")]
    sort = {f"o{i}": F.col(c) for i, c in enumerate(order) if c != leaf}
    inner = rows.select(
        F.struct(*kept).alias("kept"), F.col(group).alias("source"), *[c.alias(a) for a, c in sort.items()], F.col(leaf).alias("digest")
    )
    inner = stored(inner, "merkle-rows")
    sources = stored(inner.groupBy("source").agg(F.lit(0).alias("all")), "merkle-sources")
    sources = stored(in_order(sources, "all", ["source"], "merkle-sources"), "merkle-sources")
    trees = sources.select("source", F.col("at").alias("tree"))
    places = ["digest" if c == leaf else f"o{i}" for i, c in enumerate(order)]
    forest = grow(in_order(inner, "source", places, "merkle-order", trees).drop("source", *sort))
    subroots = stored(tops(forest), "merkle-subroots")

    n = sources.count()
    upper = grow(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(n).cast("long").alias("n"))
    )
    root = tops(upper).select("tree", F.lit(None).cast(NO_PATH).alias("path"), F.col("digest").alias("root"))
    root = root.withColumn("path", F.coalesce("path", F.array().cast(NO_PATH)))
    crowns = descend(upper, root).select(
        F.col("at").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    found = descend(forest, stored(crowns, "merkle-crowns"))
    return found.select("kept.*", F.col("digest").alias(leaf), "subroot", "root", "path")


def verified(leaf: Column, path: Column, root: Column) -> Column:
    """Whether a leaf, as it is now, still folds to the root."""
    return folded(leaf, path) == root


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    values = [F.col(c) for c in FIELDS]
    low = F.translate("text", *_LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        "doc_id",
        "source",
        leaf_digest(*values).alias("leaf"),
        F.when(tampered, leaf_digest(*values[:-1], low)).alias("altered"),
    )
    found = manifest(rows, "source", ["doc_id", "leaf"], "leaf")
    again = folded(F.coalesce("altered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# ---- the same in SQL, for trees of up to 16^LEVELS leaves


LEVELS = 6


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII ``text``: its bytes, each followed by eight shifts marked by -1."""
    bytes_ = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i]))"
    marks = f"flatten(list_transform({bytes_}, lambda b: [CAST(b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {marks}), lambda c, x: {step}), 4294967295)"


def _forest_sql(name: str) -> str:
    """CTEs over ``{name}0`` (tree, pos, h): levels, siblings of each node and the tops."""
    made = []
    for k in range(LEVELS):
        made.append(
            f""" {name}g{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, pos // {FAN} AS up FROM {name}{k}),
 {name}{k + 1} AS (SELECT tree, up AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}g{k} WHERE n > 1 GROUP BY tree, up),
 {name}s{k} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
   coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
   FROM {name}g{k} a JOIN {name}g{k} b ON a.tree = b.tree AND a.up = b.up WHERE a.n > 1 GROUP BY a.tree, a.pos)"""
        )
    made.append(
        f" {name}t AS (" + " UNION ALL ".join(f"SELECT tree, h FROM {name}g{k} WHERE n = 1" for k in range(LEVELS)) + ")"
    )
    return ",\n".join(made)


def _fold_sql(name: str, tree: str, at: str) -> tuple[str, str, str]:
    """Joins of a node's siblings level by level; their concatenation; the fold of ``{name}h``."""
    joins = "".join(
        f" LEFT JOIN {name}s{k} {name}x{k} ON {name}x{k}.tree = {tree} AND {name}x{k}.pos = {at} // {FAN**k}" for k in range(LEVELS)
    )
    told = " || ".join(f"coalesce({name}x{k}.before || {name}x{k}.after, '')" for k in range(LEVELS))
    return joins, told, ", ".join(f"{{b: {name}x{k}.before, a: {name}x{k}.after}}" for k in range(LEVELS))


def _leaf_sql(text: str) -> str:
    told = [f"coalesce(CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c}, '-')" for c in (
        "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text
    )]
    return "sha256(" + " || ".join(told) + ")"


def manifest_sql() -> str:
    low_joins, low_told, low_pairs = _fold_sql("l", "l0.tree", "l0.pos")
    top_joins, top_told, top_pairs = _fold_sql("t", "0", "l0.tree")
    letters = f"translate(text, '{_LOWER[0]}', '{_LOWER[1]}')"
    return f"""WITH r AS (SELECT doc_id, source, {_leaf_sql("text")} AS h, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0
   THEN {_leaf_sql(letters)} END AS altered FROM documents),
 l0 AS (SELECT doc_id, altered, h, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM r),
{_forest_sql("l")},
 t0 AS (SELECT 0 AS tree, tree AS pos, h FROM lt),
{_forest_sql("t")},
 p AS (SELECT l0.doc_id, l0.h AS leaf, s.h AS subroot, o.h AS root, sha256({low_told} || {top_told}) AS proof_sha256,
   list_reduce(list_prepend(coalesce(l0.altered, l0.h), list_transform(list_filter([{low_pairs}, {top_pairs}],
     lambda s: s.b IS NOT NULL), lambda s: s.b || '#' || s.a)),
     lambda h, s: sha256(split_part(s, '#', 1) || h || split_part(s, '#', 2))) AS folded_root
   FROM l0 JOIN lt s ON s.tree = l0.tree JOIN tt o ON TRUE{low_joins}{top_joins})
 SELECT *, folded_root = root AS verified FROM p"""


QUERIES = {"op11_merkle_manifest": Query(op11, manifest_sql())}
