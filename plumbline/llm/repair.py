"""Repair of conversations: the cheapest edits that give a sound order of roles, by iterative-deepening A*.

Rows of a conversation are searched in blocks, so that one conversation with a third of all rows is the work
of many tasks: a block is searched for each state it can be entered in and each it can be left in, the
blocks' costs are added up along the conversation, and the chosen entries and exits give the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, in_order, stored, table
from plumbline.llm.merkle import crc32_sql

#: Rows of a block.
BLOCK = 64
SPACE = r"\x20\x09-\x0D"
#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
#: What a place in the order of roles can be; END is what a conversation may stop in: START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT, END = range(5)
NONE = 1 << 40


def _given(q: int) -> int:
    """The state after the role that an inserted or re-roled row takes in state ``q``."""
    return ASSISTANT if q == USER else USER


def _kept(q: int, initial: str) -> int | None:
    """The state after a row that keeps its role, or None if the role can't stand here."""
    if initial == "s":
        return SYSTEM if q == START else None
    if initial == ("a" if q == USER else "u"):
        return _given(q)
    return None


def _reachable(marks: str, entry: int, goal: int) -> bool:
    if goal == START:
        return entry == START
    if goal == SYSTEM:
        return entry == SYSTEM or entry == START and any(marks[i : i + 2] in ("s.", "st") for i in range(0, len(marks), 2))
    return True


@lru_cache(maxsize=1 << 16)
def cheapest(marks: str, entry: int, goal: int) -> tuple[int, str] | None:
    """Cost and edits from ``entry`` to ``goal`` over rows given as initial and fault (``b d t .``) each.

    Depth first in the order D, I, K, R under a bound that rises to the least cost found above it. The
    bound of what is left counts the rows that have to go and the truncated ones. A state that failed
    keeps the cost it is known to need and is not entered again for less, so the first path that is
    accepted is the cheapest, and of equal ones the first in ASCII order. Rows may be inserted before
    every row, and at the end of a conversation (``goal`` END). None: no edits lead there.
    """
    n = len(marks) // 2
    if not _reachable(marks, entry, goal):
        return None
    rest = [0] * (n + 1)
    for i in reversed(range(n)):
        rest[i] = rest[i + 1] + (DELETE if marks[2 * i + 1] in "bd" else TRUNCATED if marks[2 * i + 1] == "t" else 0)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def accepted(i: int, q: int, left: int) -> int:
        """-1 if a path within ``left`` is found (``path`` then holds it backwards), else a cost it needs."""
        low = failed.get((i, q), rest[i])
        if low > left:
            return low
        if i == n and (q == goal or goal == END and q in (START, ASSISTANT)):
            return -1
        steps = []
        if i < n:
            initial, fault = marks[2 * i], marks[2 * i + 1]
            more = TRUNCATED if fault == "t" else 0
            steps.append(("D", DELETE, i + 1, q))
            steps.append(("I", INSERT, i, _given(q)))
            if fault not in "bd":
                kept = _kept(q, initial)
                if kept is not None:
                    steps.append(("K", KEEP + more, i + 1, kept))
                steps.append(("R", REROLE + more, i + 1, _given(q)))
        elif goal == END:
            steps.append(("I", INSERT, i, _given(q)))
        need = NONE
        for edit, cost, j, to in steps:
            found = accepted(j, to, left - cost)
            if found < 0:
                path.append(edit)
                return -1
            need = min(need, found + cost)
        failed[i, q] = need
        return need

    bound = rest[0]
    while True:
        need = accepted(0, entry, bound)
        if need < 0:
            return bound, "".join(reversed(path))
        bound = need


def edits(marks: str, entry: int, audit: str) -> list[list[tuple[str, str | None]]]:
    """For each row of a block its edits in order with the role they give (None: the row's own)."""
    rows: list[list[tuple[str, str | None]]] = [[]]
    q, i = entry, 0
    for edit in audit:
        role = None
        if edit in "IR":
            q = _given(q)
            role = "assistant" if q == ASSISTANT else "user"
        elif edit == "K":
            q = _kept(q, marks[2 * i])
        rows[-1].append((edit, role))
        if edit != "I":
            i += 1
            if 2 * i < len(marks):
                rows.append([])
    return rows


def exits(marks: str, first: bool, last: bool) -> list[tuple[int, int, int, int]]:
    """(entry, exit, cost, rank): rank is the place of the edits in ASCII order among those of one entry."""
    found = []
    for entry in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
        paths = [(goal, cheapest(marks, entry, goal)) for goal in ((END,) if last else (START, SYSTEM, USER, ASSISTANT))]
        ranked = sorted((p[1], goal, p[0]) for goal, p in paths if p)
        found += [(entry, goal, cost, rank) for rank, (_, goal, cost) in enumerate(ranked)]
    return found


def chosen(blocks: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """Entry and exit of each block of a conversation: cheapest in sum, then first in ASCII order.

    Edits of a block end with a row, so of two ways through it none begins the other, and the first block
    that differs decides.
    """
    left: list[dict[int, int]] = [{END: 0}]
    for block in reversed(blocks):
        need: dict[int, int] = {}
        for entry, goal, cost, _ in block:
            need[entry] = min(need.get(entry, NONE), cost + left[-1].get(goal, NONE))
        left.append(need)
    left.reverse()
    q, taken = START, []
    for k, block in enumerate(blocks):
        ways = [(rank, goal) for e, goal, cost, rank in block if e == q and cost + left[k + 1].get(goal, NONE) == left[k][q]]
        taken.append((q, min(ways)[1]))
        q = taken[-1][1]
    return taken


# ---- on Spark


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [out for row in batch.to_pylist() for out in of(row)]
        yield pa.RecordBatch.from_pylist(made, schema)


def fault(text: Column, seen: Column) -> Column:
    """b: blank, d: seen before, t: truncated, or a point; the first that holds."""
    return (
        F.when(~F.rlike(text, F.lit(f"[^{SPACE}]")), "b")
        .when(seen, "d")
        .when(~F.rlike(text, F.lit(rf"[.!?][{SPACE}]*\z")), "t")
        .otherwise(".")
    )


WAYS = pa.list_(pa.struct([(k, pa.int64()) for k in ("entry", "exit", "cost", "rank")]))
_WAYS = "array<struct<entry:bigint,exit:bigint,cost:bigint,rank:bigint>>"
STEPS = pa.list_(pa.struct([("edit", pa.string()), ("new_role", pa.string())]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(row):
        ways = exits(row["marks"], row["block"] == 0, row["last"])
        keys = ("entry", "exit", "cost", "rank")
        return [{"conv": row["conv"], "block": row["block"], "ways": [dict(zip(keys, w)) for w in ways]}]

    return _rows(batches, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("ways", WAYS)]), of)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(row):
        blocks = [[(w["entry"], w["exit"], w["cost"], w["rank"]) for w in b["ways"]] for b in row["blocks"]]
        return [
            {"conv": row["conv"], "block": b, "entry": entry, "exit": goal} for b, (entry, goal) in enumerate(chosen(blocks))
        ]

    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64())])
    return _rows(batches, schema, of)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(row):
        audit = cheapest(row["marks"], row["entry"], row["exit"])[1]
        for i, steps in enumerate(edits(row["marks"], row["entry"], audit)):
            yield {
                "conv": row["conv"],
                "at": row["block"] * BLOCK + i,
                "steps": [{"edit": e, "new_role": r} for e, r in steps],
            }

    return _rows(batches, pa.schema([("conv", pa.string()), ("at", pa.int64()), ("steps", STEPS)]), of)


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of all conversations, a row each: conv_id, at, step, edit, role, text, old_role, turn, fault, cost.

    Rows of a conversation stand by turn (NULL first), then role, then the text's md5; NULL role and text
    are one space. ``edit`` is K (kept), R (role changed), D (deleted; role and text are the old ones) or
    I (inserted with an empty text before the row it shares ``at`` with, or after the last one). Rows with
    an edit other than D, by (at, step), are the repaired conversation. ``old_role``, ``turn`` and
    ``fault`` are the row's own, NULL for inserted ones. Repeated rows are duplicates; roles without a
    character can't stand. NULL conv_ids are one conversation. Other columns do not pass. No rows, no edits.
    """
    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("text_key", F.md5("text"))
    placed = in_order(rows, "conv", ["turn", "role", "text_key"], "repair-rows")
    firsts = placed.groupBy("conv", "role", "text_key").agg(F.min("at").alias("at")).select("conv", "at", F.lit(False).alias("seen"))
    marked = placed.join(firsts, ["conv", "at"], "left").select(
        "conv", "at", "n", "turn", "role", fault(F.col("text"), F.coalesce("seen", F.lit(True))).alias("fault")
    )
    marked = stored(marked, "repair-marks")
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    pair = F.struct("at", F.concat(initial, F.col("fault")).alias("m"))
    blocks = (
        marked.groupBy("conv", F.expr(f"at div {BLOCK}").alias("block"))
        .agg(F.array_sort(F.collect_list(pair)).alias("pairs"), (F.max("at") == F.max("n") - 1).alias("last"))
        .select("conv", "block", "last", F.array_join(F.transform("pairs", lambda p: p["m"]), "").alias("marks"))
    )
    blocks = stored(blocks, "repair-blocks")
    ways = blocks.mapInArrow(_search, f"conv string, block long, ways {_WAYS}")
    whole = ways.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("blocks"))
    choice = whole.mapInArrow(_choose, "conv string, block long, entry long, exit long")
    steps = blocks.join(choice, ["conv", "block"]).mapInArrow(
        _edit, "conv string, at long, steps array<struct<edit:string,new_role:string>>"
    )
    own = marked.join(steps, ["conv", "at"]).select("conv", "at", "turn", "role", "fault", F.posexplode("steps").alias("step", "s"))
    texts = placed.select("conv", "at", "text")
    inserted = F.col("s.edit") == "I"
    stays = F.when(F.col("fault") == "t", TRUNCATED).otherwise(0)
    cost = (
        F.when(inserted, INSERT).when(F.col("s.edit") == "D", DELETE).when(F.col("s.edit") == "R", stays + REROLE).otherwise(stays)
    )
    return own.join(texts, ["conv", "at"]).select(
        F.when(F.col("conv") != "", F.col("conv")).cast(kind).alias("conv_id"),
        "at",
        F.col("step").cast("long").alias("step"),
        F.col("s.edit").alias("edit"),
        F.coalesce("s.new_role", "role").alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        F.when(~inserted, F.col("role")).alias("old_role"),
        F.when(~inserted, F.col("turn")).alias("turn"),
        F.when(~inserted, F.col("fault")).alias("fault"),
        cost.cast("long").alias("cost"),
    )


# ---- the query


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) mod 20; NULLs are one space."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.when(k == 0, F.array().cast("array<int>")).when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(role).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
LEGAL = {"su", "ua", "au"}


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits by conversation, in order, to illegal pairs, audit and digest; a conversation streams by."""
    now: list | None = None

    def closed(s) -> dict:
        return {"conv_id": s[0], "illegal": s[2], "audit": "".join(s[3]), "repaired_sha256": s[4].hexdigest()}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is None or now[0] != row["conv_id"]:
                if now is not None:
                    out.append(closed(now))
                now = [row["conv_id"], None, 0, [], hashlib.sha256(), False]
            if row["edit"] != "I":
                initial = row["old_role"][:1]
                now[2] += now[1] is not None and now[1] + initial not in LEGAL
                now[1] = initial
            now[3].append(row["edit"])
            if row["edit"] != "D":
                now[4].update(f"{chr(10) * now[5]}{row['role']}:{row['text']}".encode())
                now[5] = True
        yield pa.RecordBatch.from_pylist(out, SUMMARY)
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed(now)], SUMMARY)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    done = stored(repair(damage(given)), "repaired")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    count = lambda f: F.count_if(F.col("fault") == f)
    sums = done.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).alias("gaps"),
        count("b").alias("blank"),
        count("d").alias("duplicate"),
        count("t").alias("truncated"),
        F.sum("cost").alias("cost"),
    )
    # A digest runs from start to end: one task streams a conversation and holds one batch of it.
    streamed = done.select("conv_id", "at", "step", "edit", "role", "text", "old_role").repartition("conv_id")
    told = streamed.sortWithinPartitions("conv_id", "at", "step").mapInArrow(
        _summary, "conv_id long, illegal long, audit string, repaired_sha256 string"
    )
    both = sums.alias("s").join(told.alias("t"), F.col("s.conv_id").eqNullSafe(F.col("t.conv_id")))
    both = both.select("s.*", "t.illegal", "t.audit", "t.repaired_sha256")
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    all_ids = ids.join(both, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_ids.select(
        F.col("id").alias("conv_id"),
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# ---- the same in SQL: cheapest edits row by row, for each state the least (cost, edits)


def _inserted(q: str, *roles: str) -> str:
    lines = "".join(f" || chr(10) || '{r}:'" for r in roles)
    return f"CASE WHEN {q} IS NOT NULL THEN {{'c': {q}.c + {INSERT * len(roles)}, 'a': {q}.a || '{'I' * len(roles)}', 'o': {q}.o{lines}}} END"


def _least(*of: str) -> str:
    return f"list_min([{', '.join(of)}])"


def _took(p: str, edit: str, cost: str, when: str, line: str = "") -> str:
    return f"CASE WHEN {p} IS NOT NULL AND {when} THEN {{'c': {p}.c + {cost}, 'a': {p}.a || '{edit}', 'o': {p}.o{line}}} END"


def repair_sql() -> str:
    ok, t = "g.mark NOT IN ('b', 'd')", f"CASE WHEN g.mark = 't' THEN {TRUNCATED} ELSE 0 END"
    gone = [_took(f"p{q}", "D", str(DELETE), "TRUE") for q in range(4)]
    kept = lambda p, x: _took(p, "K", t, f"{ok} AND left(g.role, 1) = '{x}'", " || chr(10) || g.role || ':' || g.text")
    role = lambda p, r: _took(p, "R", f"{REROLE} + {t}", ok, f" || chr(10) || '{r}:' || g.text")
    to_user = [f(p, x) for p in ("p0", "p1", "p3") for f, x in ((kept, "u"), (role, "user"))]
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    blank = "{'c': 0, 'a': '', 'o': ''}"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   {crc32_sql(f"({key})")} % 20 AS k FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
   CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
   FROM c, (SELECT unnest([0, 1]) AS copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
 f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS pos FROM d),
 h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS past FROM f),
 g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'b' WHEN seen THEN 'd'
   WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*\\z') THEN 't' ELSE '.' END AS mark FROM h),
 w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, {blank} AS q0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)) AS q1,
   CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)) AS q2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)) AS q3 FROM conversations
  UNION ALL SELECT conv_id, pos, q0, q1, q2, q3 FROM (SELECT p.conv_id, p.pos + 1 AS pos, {gone[0]} AS q0,
   {_least(gone[1], kept("p0", "s"))} AS q1, {_least(gone[2], *to_user)} AS q2,
   {_least(gone[3], kept("p2", "a"), role("p2", "assistant"))} AS q3
   FROM (SELECT conv_id, pos, q0 AS p0, q1 AS p1,
     {_least("q2", *[_inserted(q, "user") for q in ("q0", "q1", "q3")])} AS p2,
     {_least("q3", _inserted("q2", "assistant"), *[_inserted(q, "user", "assistant") for q in ("q0", "q1")])} AS p3 FROM w) p
   JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.pos = p.pos)),
 z AS (SELECT conv_id, max(pos) AS pos FROM w GROUP BY conv_id),
 e AS (SELECT w.conv_id, {_least("q0", "q3", _inserted("q2", "assistant"), _inserted("q1", "user", "assistant"))} AS q
   FROM w JOIN z ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.pos = z.pos),
 s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (mark = 'b') AS blank,
   count(*) FILTER (mark = 'd') AS duplicate, count(*) FILTER (mark = 't') AS truncated,
   count(*) FILTER (past IS NOT NULL AND past || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
 SELECT CAST(e.conv_id AS BIGINT) AS conv_id, {", ".join(f"CAST(coalesce(s.{c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
 CAST(e.q.c AS BIGINT) AS cost, e.q.a AS audit, sha256(e.q.o[2:]) AS repaired_sha256
 FROM e LEFT JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id"""


QUERIES = {"op12_conversation_repair": Query(op12, repair_sql())}
