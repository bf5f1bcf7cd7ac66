"""Personal data in texts: addresses and numbers by pattern, and the words that give them away by co-occurrence.

An entity (one address, number, ...) that occurs in several documents carries information: -log2 of the share
of documents that hold it. A word of such a document reveals as much of it as the pointwise mutual
information of the two over the whole corpus. Words that reveal most of an entity's information are
generalised, those that reveal nearly all of it removed, in the documents that hold the entity.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, stored, table


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds what ``plain`` (the same without look-around) finds leftmost; ``need`` is a string
    or pattern that every match holds; ``digits`` bounds the number of digits."""

    name: str
    pattern: str
    plain: str
    need: str
    digits: tuple[int, int] | None = None


_LOCAL, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Patterns start where a run of their signs starts or the last match has ended, and never give back what
#: they took: the same matches as ``plain``, in time linear in the text and without recursion.
KINDS = [
    Kind(
        "email",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}++(?:\.{_LABEL}++)++",
        rf"[{_LOCAL}]+@{_LABEL}+(\.{_LABEL}+)+",
        "@",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]\.[0-9]",
    ),
    Kind(
        # Only runs of 16 to 19 digits can be cards, so longer and shorter ones need no match.
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
        r"[0-9]([\x20-]?[0-9])+",
        r"[0-9](?:[\x20-]?[0-9]){15}",
        (16, 19),
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", (8, 15)),
]
#: Spans of words: replaced by what kind of word they are, or taken out.
WORDS = ("general", "removed")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents an entity and a word have to share, so that their co-occurrence says something.
SUPPORT = 3
#: Shares of an entity's information from which a word is generalised, and removed.
GENERAL, REMOVED = 0.8, 0.95
#: Words shorter than this are never touched.
SHORTEST = 3
#: Lengths are summed up in pieces of so many.
PIECE = 256
SPAN = "struct<rank:int,start:int,end:int,value:string>"
NO_SPANS = f"array<{SPAN}>"


def running(lengths: Column) -> Column:
    """Running sums of an array of integers, in pieces, so that long arrays take no quadratic time."""
    ints = "array<int>"

    def sums(values: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(F.lit(0).alias("sum"), F.array().cast(ints).alias("all")),
            lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.array_append(s["all"], s["sum"] + v).alias("all")),
        )["all"]

    def pieces(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(PIECE))
        return F.transform(starts, lambda s: sums(F.slice(values, s, PIECE)))

    def joined(parts: Column) -> Column:
        before = F.transform(F.array(sums(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))), lambda a: a)
        moved = F.transform(
            before,
            lambda b: F.transform(parts, lambda p, i: F.transform(p, lambda v: v + F.when(i == 0, 0).otherwise(F.get(b, i - 1)))),
        )
        return F.flatten(F.element_at(moved, 1))

    # An array of one element binds its value, so that it is worked out once.
    return F.element_at(F.transform(F.array(lengths), lambda v: F.element_at(F.transform(F.array(pieces(v)), joined), 1)), 1)


def _matches(text: Column, pattern: str, rank: int) -> Column:
    """All matches as (rank, start, end, value): what stands between matches and they themselves alternate."""
    bound = F.array(
        F.struct(
            F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"),
        )
    )

    def spans(b: Column) -> Column:
        steps = F.zip_with(
            F.slice(b["gaps"], 1, F.size(b["values"])), b["values"], lambda g, v: F.coalesce(g, F.lit(0)) + F.length(v)
        )
        return F.zip_with(
            running(steps),
            b["values"],
            lambda e, v: F.struct(
                F.lit(rank).alias("rank"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")
            ),
        )

    return F.element_at(F.transform(bound, spans), 1)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether every second digit from the right doubled, and digits of products summed, gives a multiple of ten."""
    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda s, i: s + F.element_at(
            F.array(*[F.lit(d) for d in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
            F.substring(digits, -i, F.lit(1)).cast("int") + F.when(i % 2 == 0, 11).otherwise(1),
        ),
    )
    return total % 10 == 0


def _holds(kind: Kind, value: Column) -> Column:
    if kind.name == "ip":
        return F.rlike(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind.digits is None:
        return F.lit(True)
    n = F.length(digits_of(value))
    in_bounds = n.between(*kind.digits)
    return in_bounds & luhn(digits_of(value)) if kind.name == "card" else in_bounds


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: (rank, start, end, value) of the base kinds in the whole text, by rank and start.

    Every row comes back once with all its columns (one named ``found`` is replaced), without a shuffle;
    NULL and empty texts hold nothing, repeated rows hold the same.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for rank, kind in enumerate(KINDS):
        there = F.contains(text, F.lit(kind.need)) if len(kind.need) == 1 else F.rlike(text, F.lit(kind.need))
        spans = F.filter(_matches(text, kind.pattern, rank), lambda s: _holds(kind, s["value"]))
        parts.append(F.when(there, spans).otherwise(F.array().cast(NO_SPANS)))
    return docs.withColumn("found", F.concat(*parts))


def entity(span: Column) -> Column:
    """One name for the same address or number however it is written: kind and digits, or the lower-case address."""
    value = F.when(span["rank"].isin(0, 1), F.translate(span["value"], UPPER, LOWER)).otherwise(digits_of(span["value"]))
    return F.concat(span["rank"].cast("string"), F.lit(":"), value)


def terms(text: Column) -> Column:
    """The distinct words of a text in lower case (A-Z): runs of letters, digits and signs beyond ASCII."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= SHORTEST)


def disclosure(held: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, revealing): which words stand in which texts with an entity, and which reveal one.

    ``held``: row, key (of the text), text and found, for rows with base spans; ``docs`` all documents. cells:
    key, entity, term; revealing: entity, term, share (of the entity's information that the word reveals).
    Rows with one text count as often as they occur, but their words are met once.
    """
    n = docs.count()
    # Entities by text, before anything is multiplied by words; copies are one row with their number.
    copies = held.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))
    one = held.select("row", "text", "found").join(copies, "row")
    one = stored(one.select("key", "copies", "text", F.array_distinct(F.transform("found", entity)).alias("entities")), "privacy-texts")
    pairs = one.select("key", "copies", F.explode("entities").alias("entity"))
    known = pairs.groupBy("entity").agg(F.sum("copies").alias("with_entity"))
    known = stored(known.where((F.col("with_entity") >= SUPPORT) & (F.col("with_entity") < n)), "privacy-entities")
    pairs = stored(pairs.join(known, "entity"), "privacy-pairs")
    worded = one.join(pairs.select("key").distinct(), "key", "left_semi")
    worded = worded.select("key", F.explode(terms(F.col("text"))).alias("term"))
    # Words' documents over the whole corpus, summed in each task before the shuffle.
    counts = docs.select(F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("term")
    counts = counts.agg(F.count(F.lit(1)).alias("with_term")).where(F.col("with_term") >= SUPPORT)
    rare = stored(counts.join(worded.select("term").distinct(), "term", "left_semi"), "privacy-words")
    cells = stored(worded.join(rare, "term").join(pairs, "key"), "privacy-cells")
    both = cells.groupBy("entity", "term", "with_entity", "with_term").agg(F.sum("copies").alias("together"))
    known_bits = F.log2(n / F.col("with_entity"))
    shared_bits = F.log2(F.col("together") * n / (F.col("with_entity").cast("double") * F.col("with_term")))
    told = both.where(F.col("together") >= SUPPORT).select("entity", "term", (shared_bits / known_bits).alias("share"))
    return cells.select("key", "entity", "term"), told.where(F.col("share") >= GENERAL)


def spans(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``found``: base spans and those of revealing words, by rank and start.

    Rows without a base span hold no entity and are left alone. Words inside a base span are covered
    already and get no span. Every row comes back once with all its columns (``found`` is replaced; row
    and key are kept out of the way in a struct), NULL texts and ids, repeated rows and empty tables
    included. ``keep_text`` False: texts of rows without a span may come back as NULL.
    """
    text = F.col("text") if keep_text else F.when(F.size("found") > 0, F.col("text"))
    columns = [c for c in docs.columns if c not in ("text", "found")]
    scanned = scan(docs.select(F.struct(*columns).alias("kept"), "text")).select("kept", text.alias("text"), "found")
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "privacy-rows")
    held = scanned.where(F.size("found") > 0).select("row", "text", "found", F.sha2("text", 256).alias("key"))
    cells, revealing = disclosure(held, docs.select("text"))
    marked = cells.join(revealing, ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))
    marks = F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("marks")
    marks = stored(marked.groupBy("key").agg(marks), "privacy-marks")
    words = stored(held.join(marks, "key").select("row", _word_spans().alias("more")), "privacy-spans")
    joined = scanned.join(words, "row", "left")
    found = F.concat("found", F.coalesce("more", F.array().cast(NO_SPANS)))
    return joined.select("kept.*", "text", F.array_sort(found).alias("found"))


def _word_spans() -> Column:
    """Spans of the words in ``marks`` (term to share) outside the base spans of ``found``."""
    base = len(KINDS)
    words = _matches(F.col("text"), TERM, base)
    marked = F.filter(words, lambda w: F.map_contains_key(F.col("marks"), F.translate(w["value"], UPPER, LOWER)))
    free = F.filter(marked, lambda w: ~F.exists("found", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return F.transform(
        free,
        lambda w: F.struct(
            F.when(F.element_at("marks", F.translate(w["value"], UPPER, LOWER)) >= REMOVED, base + 1).otherwise(base).alias("rank"),
            w["start"].alias("start"),
            w["end"].alias("end"),
            w["value"].alias("value"),
        ),
    )


NAMES = [k.name for k in KINDS] + list(WORDS)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cleaned: base spans become [email], [ip], ..., words that reveal much of an entity
    [name], [number] or [word], and words that reveal nearly all of it are taken out. Overlapping spans are
    replaced once, by the first. Rows, order of columns and awkward cases as in ``spans``."""
    text = F.col("text")

    def instead(m: Column) -> Column:
        base = F.concat(F.lit("["), F.get(F.lit(NAMES), m["rank"]), F.lit("]"))
        kind = (
            F.when(F.rlike(m["value"], F.lit("^[0-9]")), "[number]")
            .when(F.rlike(m["value"], F.lit("^[A-Z]")), "[name]")
            .otherwise("[word]")
        )
        return F.when(m["rank"] < len(KINDS), base).when(m["rank"] == len(KINDS), kind).otherwise("")

    by_start = F.array_sort(
        F.transform("found", lambda m: F.struct(m["start"], m["rank"], m["end"].alias("end"), m["value"].alias("value")))
    )
    folded = F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, m: F.struct(
            F.greatest(s["at"], m["end"]).alias("at"),
            F.when(m["start"] < s["at"], s["out"])
            .otherwise(F.array_append(s["out"], F.concat(F.substring(text, s["at"] + 1, m["start"] - s["at"]), instead(m))))
            .alias("out"),
        ),
    )
    clean = F.when(F.size("found") == 0, text).otherwise(
        F.concat(F.array_join(folded["out"], ""), F.substring(text, folded["at"] + 1, F.length(text)))
    )
    return spans(docs).withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(found: Column) -> Column:
    one = lambda s: F.concat_ws(":", F.get(F.lit(NAMES), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(docs, keep_text=False).select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < len(KINDS))
    ranks = F.transform("found", lambda s: s["rank"])
    counts = [
        (F.size(ranks) - F.size(F.array_remove(ranks, r))).cast("long").alias(f"n_{kind.name}") for r, kind in enumerate(KINDS)
    ]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


# ---- the same in SQL


def _matches_sql(rank: int, pattern: str, of: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT id, {rank} AS rank, start, stop, value FROM (SELECT id, unnest(range(len(m))) + 1 AS k, m[k] AS value,
   CAST(list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
   start + length(m[k]) AS stop FROM (SELECT id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS m FROM {of}
   WHERE regexp_matches(text, '{p}')))"""


def privacy_sql() -> str:
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    doubled = "[0, 2, 4, 6, 8, 1, 3, 5, 7, 9]"
    digit = f"CAST({digits}[-i] AS INTEGER)"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN ({doubled})[{digit} + 1] ELSE {digit} END)) % 10 = 0"
    holds = " ".join(
        f"WHEN {r} THEN "
        + (
            f"regexp_full_match(value, '{_BYTE}(?:\\.{_BYTE}){{3}}')"
            if k.name == "ip"
            else "TRUE"
            if k.digits is None
            else f"CASE WHEN length({digits}) BETWEEN {k.digits[0]} AND {k.digits[1]} THEN {luhn_sql if k.name == 'card' else 'TRUE'} ELSE FALSE END"
        )
        for r, k in enumerate(KINDS)
    )
    raw = "\n UNION ALL ".join(_matches_sql(r, k.plain, "texts") for r, k in enumerate(KINDS))
    low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    one = "['" + "', '".join(NAMES) + "'][rank + 1] || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (rank = {r}) AS n_{k.name}" for r, k in enumerate(KINDS))
    return f"""WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
 base AS (SELECT * FROM ({raw}) WHERE CASE rank {holds} END),
 held AS (SELECT DISTINCT id, rank || ':' || CASE WHEN rank < 2 THEN {low("value")} ELSE {digits} END AS entity FROM base),
 n AS (SELECT count(*) AS n FROM documents),
 known AS (SELECT entity, count(*) AS with_entity FROM held, n GROUP BY entity, n HAVING count(*) >= {SUPPORT} AND count(*) < n),
 words AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(regexp_extract_all({low("text")}, '{TERM}')) AS term FROM texts) WHERE length(term) >= {SHORTEST}),
 counts AS (SELECT term, count(*) AS with_term FROM words GROUP BY term HAVING count(*) >= {SUPPORT}),
 told AS (SELECT entity, term, log2(CAST(count(*) * n AS DOUBLE) / (CAST(with_entity AS DOUBLE) * with_term)) / log2(CAST(n AS DOUBLE) / with_entity) AS share
   FROM held JOIN known USING (entity) JOIN words USING (id) JOIN counts USING (term), n
   GROUP BY entity, term, n, with_entity, with_term HAVING count(*) >= {SUPPORT}),
 marks AS (SELECT id, term, max(share) AS share FROM held JOIN told USING (entity) JOIN words USING (id, term) WHERE share >= {GENERAL} GROUP BY id, term),
 placed AS ({_matches_sql(len(KINDS), TERM, "(SELECT * FROM texts WHERE id IN (SELECT id FROM marks))")}),
 more AS (SELECT a.id, CASE WHEN share >= {REMOVED} THEN {len(KINDS) + 1} ELSE {len(KINDS)} END AS rank, start, stop, value
   FROM placed a JOIN marks m ON m.id = a.id AND m.term = {low("a.value")}
   WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = a.id AND b.start < a.stop AND a.start < b.stop)),
 found AS (SELECT * FROM base UNION ALL SELECT * FROM more)
 SELECT any_value(doc_id) AS doc_id, {counts},
 sha256(coalesce(string_agg({one}, ',' ORDER BY rank, start) FILTER (rank < {len(KINDS)}), '')) AS base_sha256,
 coalesce(string_agg({one}, ',' ORDER BY rank, start), '') AS spans
 FROM texts LEFT JOIN found USING (id) GROUP BY id"""


QUERIES = {"op13_private_data": Query(op13, privacy_sql())}
