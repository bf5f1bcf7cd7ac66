"""Secrets in texts: a trigram index narrows each rule to candidate documents, which are then searched."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, table

#: Larger sets of strings for one stretch of a pattern are cut in two stretches.
MOST_STRINGS = 32


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + (
    f"|{_either_case('api')}_?{_either_case('key')}"
)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost and non-overlapping; ``least`` characters are needed in ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = [
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is too short holds no longer one, so the least length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("url_login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
]
RULES = BASE_RULES + MORE_RULES
REDACTED = "[secret]"


# ---- from a pattern to the trigrams it cannot do without


class _Stretch:
    """Strings a stretch of the pattern can be, and the clauses of the stretches before it."""

    def __init__(self) -> None:
        self.strings: set[str] = {""}
        self.clauses: list[list[frozenset[str]]] = []

    def add(self, choices: set[str]) -> None:
        if len(self.strings) * len(choices) > MOST_STRINGS:
            self.end()
        if len(choices) > MOST_STRINGS:
            self.end()
        else:
            self.strings = {a + b for a, b in product(self.strings, choices)}

    def end(self) -> None:
        """Close the stretch: one of its strings, and so all trigrams of one of them, must occur."""
        needs = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in self.strings]
        if all(needs):
            self.clauses.append(sorted(set(needs), key=sorted))
        self.strings = {""}


def _strings(parts) -> set[str] | None:
    """All strings that the parts can be, in lower case, if they are few."""
    inner = _Stretch()
    before: list = []
    for part in parts:
        if not _walk_one(part, inner):
            return None
        if inner.clauses != before:
            return None
    return inner.strings


def _walk_one(part, into: _Stretch) -> bool:
    """Add one parsed part to ``into``; False if it is not a small set of strings."""
    name, value = str(part[0]), part[1]
    choices: set[str] | None = None
    if name == "LITERAL":
        choices = {chr(value).lower()}
    elif name == "IN" and str(value[0][0]) != "NEGATE":
        points: set[str] = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                points.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < MOST_STRINGS:
                points |= {chr(p).lower() for p in range(v[0], v[1] + 1)}
            else:
                points |= {str(i) for i in range(MOST_STRINGS + 1)}
        choices = points
    elif name == "SUBPATTERN":
        choices = _strings(value[-1])
        if choices is None:
            for p in value[-1]:
                _walk_one(p, into)
            return False
    elif name == "BRANCH":
        sides = [_strings(p) for p in value[1]]
        choices = None if any(s is None for s in sides) else set().union(*sides)
    elif name == "MAX_REPEAT":
        low, high, item = value
        one = _strings(item)
        if one is not None and low <= 1 and high == 1:
            choices = one | ({""} if low == 0 else set())
        elif one is not None and low > 0 and len(one) <= MOST_STRINGS:
            for _ in range(min(low, 3)):
                into.add(one)
            if high != low or low > 3:
                into.end()
                return False
            return True
    if choices is None or len(choices) > MOST_STRINGS:
        into.end()
        return False
    into.add(choices)
    return True


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What every match of ``pattern`` holds, in lower case: for each clause the trigrams of at least
    one of its sets. No clause: nothing is certain, the rule has to scan all texts."""
    whole = _Stretch()
    for part in re._parser.parse(pattern):
        _walk_one(part, whole)
    whole.end()
    return whole.clauses


# ---- index, intersection, verification


def _needs(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame, list[str], list[int]]:
    """The queries as rows, their trigrams, and the rules without a query."""
    rows, full = [], []
    for r, rule in enumerate(rules):
        clauses = trigram_query(rule.pattern)
        if not clauses:
            full.append(r)
        for c, clause in enumerate(clauses):
            for a, grams in enumerate(clause):
                rows += [(g, r, c, a, len(grams), len(clauses)) for g in sorted(grams)]
    schema = "gram string, rule int, clause int, side int, n_grams int, n_clauses int"
    return spark.createDataFrame(rows, schema), sorted({r[0] for r in rows}), full


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): the inverted index, of those trigrams that some query asks for."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.filter(F.lit(grams), lambda g: F.contains(F.col("low"), g))
    return low.select("doc_id", F.explode(found).alias("gram"))


def candidates(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and the rules (their places in the list) whose trigram query the document fulfils.

    Postings of a query's trigrams are intersected per document: all trigrams of a side, one side of
    each clause, all clauses of a rule. Rows that share a doc_id are narrowed together.
    """
    rules = rules or RULES
    needs, grams, _ = _needs(docs.sparkSession, rules)
    sides = (
        postings(docs, grams)
        .distinct()
        .join(F.broadcast(needs), "gram")  # as many rows as the rules have trigrams
        .groupBy("doc_id", "rule", "clause", "side", "n_grams", "n_clauses")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = n_grams")
    )
    met = sides.groupBy("doc_id", "rule", "n_clauses").agg(F.count_distinct("clause").alias("n"))
    return met.where("n = n_clauses").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of ``rule`` as (start, rank, end), code points, end exclusive.

    Pieces between matches and the matches themselves alternate, so lengths sum up to places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(matches, F.length).alias("length"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    placed = F.aggregate(
        F.filter(sized, lambda m: m["length"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + m["length"]).alias("at"),
            F.when(
                m["value"] >= rule.least,
                F.array_append(
                    s["found"],
                    F.struct(
                        (s["at"] + m["gap"]).alias("start"),
                        F.lit(rank).alias("rank"),
                        (s["at"] + m["gap"] + m["length"]).alias("end"),
                    ),
                ),
            )
            .otherwise(s["found"])
            .alias("found"),
        ),
    )
    return F.when(F.rlike(text, pattern), placed["found"]).otherwise(empty)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``found``: (start, rank, end) of each secret, by start, then by rule.

    Every row of ``docs`` comes back once with all its columns (one named ``found`` is replaced);
    NULL and empty texts have no secrets; NULL doc_ids form one group of candidates. Candidates of a
    rule, and all documents for a rule without mandatory trigrams, are searched over the whole text.
    """
    rules = rules or RULES
    full = _needs(docs.sparkSession, rules)[2]
    docs = docs.drop("found")
    joined = (
        docs.alias("d")
        .join(candidates(docs, rules).alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left")
        .select("d.*", F.col("c.rules").alias("_rules"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for r, rule in enumerate(rules):
        spans = _spans(text, rule, r)
        if r not in full:
            spans = F.when(F.array_contains("_rules", r), spans)
        parts.append(F.coalesce(spans, F.array().cast("array<struct<start:int,rank:int,end:int>>")))
    return joined.withColumn("found", F.sort_array(F.concat(*parts))).drop("_rules")


def redacted(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``[secret]``; overlapping ones by one."""
    columns = docs.columns
    text = F.col("text")
    folded = F.aggregate(
        F.col("found"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, m: F.struct(
            F.greatest(s["at"], m["end"]).alias("at"),
            F.when(m["start"] < s["at"], s["out"])
            .otherwise(F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit(REDACTED)))
            .alias("out"),
        ),
    )
    clean = F.when(F.size("found") == 0, text).otherwise(
        F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text)))
    )
    return scan(docs, rules).withColumn("text", clean).select(*[F.col(f"`{c}`") for c in columns])


def _joined(found: Column, rules: list[Rule]) -> Column:
    names = F.lit([r.kind for r in rules])
    return F.array_join(
        F.transform(
            found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    ranks = F.transform("found", lambda s: s["rank"])
    counts = [
        (F.size(ranks) - F.size(F.array_remove(ranks, r))).cast("long").alias(f"n_{rule.kind}")
        for r, rule in enumerate(BASE_RULES)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("found"), RULES).alias("spans")
    )


def secrets_sql(docs: str = "documents") -> str:
    """CTEs up to ``found``: (id, rank, kind, start, stop) of every secret in the rows of ``texts``."""
    kinds = "\n UNION ALL ".join(
        f"""SELECT id, {r} AS rank, '{rule.kind}' AS kind, unnest(range(len(m))) + 1 AS k, gaps, m, v, {rule.least} AS least FROM (
   SELECT id, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS m,
   regexp_extract_all(text, p, {rule.group}) AS v
   FROM texts, (SELECT '{rule.pattern.replace("'", "''")}' AS p) WHERE regexp_matches(text, '{rule.pattern.replace("'", "''")}'))"""
        for r, rule in enumerate(RULES)
    )
    return f"""
 texts AS (SELECT row_number() OVER () AS id, * REPLACE (coalesce(text, '') AS text) FROM {docs}),
 matches AS ({kinds}),
 found AS (SELECT id, rank, kind,
   CAST(list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
   CAST(list_sum(list_transform(gaps[:k], lambda x: length(x))) + list_sum(list_transform(m[:k], lambda x: length(x))) AS BIGINT) AS stop
   FROM matches WHERE length(v[k]) >= least)"""


_COUNTS = ", ".join(f"count(*) FILTER (rank = {r}) AS n_{rule.kind}" for r, rule in enumerate(BASE_RULES))
_ONE = "kind || ':' || start || ':' || stop"
QUERIES = {
    "op7_secret_scan": Query(
        op7,
        f"""WITH {secrets_sql()} SELECT any_value(doc_id) AS doc_id, {_COUNTS},
 sha256(coalesce(string_agg({_ONE}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256,
 coalesce(string_agg({_ONE}, ',' ORDER BY start, rank), '') AS spans
 FROM texts LEFT JOIN found USING (id) GROUP BY id""",
    )
}
