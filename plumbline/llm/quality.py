"""Quality by weak supervision: rules vote or abstain, their reliability is estimated, documents get a posterior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Query, table, words
from plumbline.session import cut_lineage

#: Votes: 2 good, 1 abstain, 0 bad. Each rule: name, SQL for a good vote, SQL for a bad one; the
#: text of both is understood by Spark and by the engine of the check.
RULES = [
    ("repetition", "FALSE", "20 * n_repeat_words > 7 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)"),
    ("symbols", "FALSE", "10 * n_symbols > n_words"),
    ("shouting", "FALSE", "2 * n_capitals > word_chars OR 4 * n_exclaims > n_words"),
    ("words", "FALSE", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("length", "n_words >= 100", "n_words < 50"),
    ("stops", "n_stops > 0 AND n_words <= 60 * n_stops AND n_words >= 3 * n_stops", "n_words > 300 * (n_stops + 1)"),
]
#: Class 0 is that of good documents, class j + 1 that of documents with the fault rule j looks for:
#: kinds of junk seldom fail two rules at once, so one bad class would only learn the largest kind.
CLASSES = len(RULES) + 1
ROUNDS = 20
#: Rounding of the reported posterior; a document is kept from KEEP on.
DIGITS = 6
KEEP = 0.5
#: Before the first round a document with no bad vote is good with this probability, else with the
#: other; the rest is shared by the faults voted for (by all faults, if none is).
FIRST = (0.999, 0.3)
#: Counts added to each vote of each rule, so that no vote ever has probability 0.
PRIOR_COUNT = 0.5
#: Pseudo-documents, as a share of all, that fail their own rule in each class of faults.
BELIEF = 0.01


def _drop_all_but(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, over whole texts.

    n_repeat_words counts the words that lie in a 3-word window found twice or more in the text;
    windows are compared by 64-bit hashes within their document. NULL and empty texts count 0
    everywhere. Other columns of ``docs`` do not pass.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", text.alias("_text")).select(
        "doc_id", "_text", words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(WORD))).alias("_lines"),
    )
    windows = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = counted.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _drop_all_but(F.col("_text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _drop_all_but(F.col("_text"), "A-Z").cast("long").alias("n_capitals"),
        _drop_all_but(F.col("_text"), "!").cast("long").alias("n_exclaims"),
        _drop_all_but(F.col("_text"), ".").cast("long").alias("n_stops"),
        windows.alias("_windows"),
    )
    # Only texts with a repeated window are sorted: equal windows then stand side by side.
    counted = counted.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    repeated = F.filter(
        F.transform(
            "_sorted",
            lambda w, k: F.when(
                (F.get("_sorted", k - 1)["h"] == w["h"]) | (F.get("_sorted", k + 1)["h"] == w["h"]), w["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    counted = counted.withColumn("_at", F.sort_array(repeated))
    covered = F.aggregate(
        F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - i, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_windows", "_sorted", "_at"
    )


def with_votes(counts: DataFrame) -> DataFrame:
    """base_failed and ``votes``, one small number per rule; failed documents vote too."""
    votes = [F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END") for _, good, bad in RULES]
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return counts.withColumn("base_failed", failed).withColumn("votes", F.array(*votes).cast("array<int>"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: ``prior`` (share of each class) and ``vote`` (probability of each vote of each rule in
    each class: its place is (class * rules + rule) * 3 + vote), by expectation-maximisation over the
    counts of vote patterns.

    Patterns are at most 3 to the number of rules, whatever the input, so they are counted by a
    grouped aggregate and folded in one row. Without documents the estimates are those of PRIOR_COUNT.
    """
    n = len(RULES)
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    faults = F.size(F.filter("votes", lambda v: v == 0))
    first = F.concat(
        F.array(F.when(faults > 0, FIRST[1]).otherwise(FIRST[0])),
        F.transform(
            "votes",
            lambda v: F.when(faults == 0, (1 - FIRST[0]) / n).when(v == 0, (1 - FIRST[1]) / faults).otherwise(0.0),
        ),
    )
    one = patterns.select(F.struct("votes", "n", first.alias("share")).alias("p")).agg(
        F.sort_array(F.collect_list("p")).alias("seen")
    )

    def maximise(seen: Column) -> Column:
        every = _sum(seen, lambda p: p["n"])

        def mass(c: Column) -> Column:
            return _sum(seen, lambda p: p["n"] * F.get(p["share"], c))

        def cell(k: Column) -> Column:
            c, rule, vote = (k / (3 * n)).cast("int"), F.pmod((k / 3).cast("int"), F.lit(n)), F.pmod(k, F.lit(3))
            hits = _sum(
                seen,
                lambda p: F.when(F.get(p["votes"], rule) == vote, p["n"] * F.get(p["share"], c)).otherwise(0.0),
            )
            own = F.when(c == rule + 1, every * BELIEF).otherwise(0.0)
            return (hits + PRIOR_COUNT + F.when(vote == 0, own).otherwise(0.0)) / (mass(c) + 3 * PRIOR_COUNT + own)

        return F.struct(
            F.transform(
                F.sequence(F.lit(0), F.lit(n)),
                lambda c: (mass(c) + PRIOR_COUNT) / (every + CLASSES * PRIOR_COUNT),
            ).alias("prior"),
            F.transform(F.sequence(F.lit(0), F.lit(CLASSES * 3 * n - 1)), cell).alias("vote"),
        )

    def expect(seen: Column, model: Column) -> Column:
        return F.transform(
            seen,
            lambda p: F.struct(
                p["votes"].alias("votes"), p["n"].alias("n"), shares(p["votes"], model).alias("share")
            ),
        )

    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(F.col("seen").alias("seen"), maximise(F.col("seen")).alias("model")),
        lambda s, _: _bound(
            expect(s["seen"], s["model"]), lambda seen: F.struct(seen.alias("seen"), maximise(seen).alias("model"))
        ),
    )
    return one.select(state["model"].alias("m")).select("m.*")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: it is the only item of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shares(votes: Column, model: Column) -> Column:
    """Probability of each class for a document with these votes."""
    n = len(RULES)

    def fit(prior: Column, c: Column) -> Column:
        return F.ln(prior) + _sum(
            F.transform(votes, lambda v, j: F.ln(F.get(model["vote"], (c * n + j) * 3 + v))), lambda x: x
        )

    def normal(fits: Column) -> Column:
        return F.transform(fits, lambda a: F.lit(1.0) / _sum(fits, lambda b: F.exp(b - a)))

    return _bound(F.transform(model["prior"], fit), normal)


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, quality (posterior) and kept.

    Only ``doc_id`` and ``text`` are read; repeated rows and NULL doc_ids are judged row by row and
    equal texts get equal verdicts. Empty and NULL texts fail the base rule. No documents give no rows.
    The counts are written to the shared folder once and read for the estimate and for the verdict.
    """
    voted = with_votes(cut_lineage(features(docs)))
    model = estimate(voted, rounds).select(F.struct("prior", "vote").alias("m")).scalar()
    scored = voted.withColumn("_model", model).withColumn(
        "quality", F.round(F.get(shares(F.col("votes"), F.col("_model")), F.lit(0)), DIGITS)
    )
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP)).drop("_model", "votes")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns. The verdict is joined back by doc_id;
    rows that share a doc_id go or stay together, by the best of them."""
    verdict = judge(docs).groupBy("doc_id").agg(F.max("kept").alias("_kept")).where("_kept")
    return (
        docs.alias("d")
        .join(verdict.alias("v"), F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")), "left_semi")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def quality_sql(docs: str = "documents") -> str:
    """CTEs up to ``judged``: doc_id, the counts, base_failed, quality, kept of the rows of ``docs``."""
    votes = "\n UNION ALL ".join(
        f"SELECT id, {j} AS rule, CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END AS vote FROM counted"
        for j, (_, good, bad) in enumerate(RULES)
    )
    parts = [
        f"""
 texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM {docs}),
 split AS (SELECT id, doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
   list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM texts),
 windows AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2]) AS n
   FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
 covered AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words
   FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY id),
 counted AS (SELECT s.id, doc_id, CAST(len(w) AS BIGINT) AS n_words,
   CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
   length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
   length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaims,
   length(regexp_replace(text, '[^.]+', '', 'g')) AS n_stops,
   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
   FROM split s LEFT JOIN covered c ON s.id = c.id),
 votes AS ({votes}),
 patterned AS (SELECT id, string_agg(vote, '' ORDER BY rule) AS pattern FROM votes GROUP BY id),
 patterns AS (SELECT pattern, count(*) * 1e0 AS n FROM patterned GROUP BY pattern),
 cells AS (SELECT pattern, rule, CAST(pattern[rule + 1] AS INT) AS vote FROM patterns, range({len(RULES)}) r(rule)),
 firsts AS (SELECT pattern, n, length(pattern) - length(replace(pattern, '0', '')) AS faults FROM patterns),
 p0 AS (SELECT pattern, n, c, CASE WHEN c = 0 THEN CASE WHEN faults > 0 THEN {FIRST[1]}e0 ELSE {FIRST[0]}e0 END
   WHEN faults = 0 THEN {1 - FIRST[0]}e0 / {len(RULES)} WHEN pattern[c] = '0' THEN {1 - FIRST[1]}e0 / faults
   ELSE 0e0 END AS share FROM firsts, range({CLASSES}) k(c))"""
    ]
    for k in range(ROUNDS + 1):
        parts.append(
            f""" t{k} AS (SELECT c, sum(n * share) AS mass, sum(n) AS every FROM p{k} GROUP BY c),
 m{k} AS (SELECT t.c, r.rule, v.vote,
   (coalesce(sum(n * share), 0e0) + {PRIOR_COUNT} + any_value(CASE WHEN t.c = r.rule + 1 AND v.vote = 0 THEN every * {BELIEF}e0 ELSE 0e0 END))
   / (any_value(mass) + {3 * PRIOR_COUNT} + any_value(CASE WHEN t.c = r.rule + 1 THEN every * {BELIEF}e0 ELSE 0e0 END)) AS p
   FROM t{k} t CROSS JOIN range({len(RULES)}) r(rule) CROSS JOIN range(3) v(vote)
   LEFT JOIN (SELECT s.rule, s.vote, p.* FROM cells s JOIN p{k} p USING (pattern)) x
   ON x.rule = r.rule AND x.vote = v.vote AND x.c = t.c GROUP BY t.c, r.rule, v.vote),
 f{k} AS (SELECT s.pattern, p.c, any_value(p.n) AS n,
   ln(any_value((mass + {PRIOR_COUNT}) / (every + {CLASSES * PRIOR_COUNT}))) + sum(ln(m.p)) AS fit
   FROM cells s JOIN p{k} p USING (pattern) JOIN t{k} t USING (c) JOIN m{k} m USING (c, rule, vote) GROUP BY s.pattern, p.c),
 p{k + 1} AS (SELECT a.pattern, a.c, any_value(a.n) AS n, 1e0 / sum(exp(b.fit - a.fit)) AS share
   FROM f{k} a JOIN f{k} b USING (pattern) GROUP BY a.pattern, a.c)"""
        )
    parts.append(
        f""" judged AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
   quality, NOT base_failed AND quality >= {KEEP} AS kept FROM
   (SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
   round(p.share, {DIGITS}) AS quality FROM counted c JOIN patterned x ON c.id = x.id
   JOIN p{ROUNDS + 1} p ON p.pattern = x.pattern AND p.c = 0))"""
    )
    return ",\n".join(parts)


QUERIES = {
    "op1_quality_rules": Query(
        op1,
        f"WITH {quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, "
        "base_failed, kept, quality FROM judged",
    )
}
