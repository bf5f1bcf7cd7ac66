"""Manifest, conversation repair and personal data against brute force and on awkward rows."""

import hashlib
import random
import re
from collections import Counter
from heapq import heappop, heappush
from math import log2

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle, privacy, repair
from plumbline.llm.common import in_order, stored


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- places within groups


def test_in_order_numbers_each_group(spark):
    rows = [(g, v) for g, n in (("a", 3000), (None, 40), ("b", 1)) for v in random.Random(n).sample(range(10 * n), n)]
    rows += [("a", None), ("a", 7), ("a", 7)]
    df = stored(spark.createDataFrame(rows, "g string, v long").repartition(7), "places")
    got = in_order(df, "g", ["v"], "places").collect()
    assert len(got) == len(rows)
    for g in ("a", None, "b"):
        mine = sorted((r.at, r.v) for r in got if r.g == g)
        values = [v for _, v in mine]
        assert [at for at, _ in mine] == list(range(len(mine)))
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))
        assert {r.n for r in got if r.g == g} == {len(mine)}
    assert in_order(df.where("FALSE"), "g", ["v"], "places").count() == 0


# ---- 11


def brute_tree(leaves):
    """Root, and for each leaf (siblings joined, path)."""
    paths = [[] for _ in leaves]
    owners = [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        ups, groups = [], []
        for k in range(0, len(leaves), 16):
            run = leaves[k : k + 16]
            for j in range(len(run)):
                for leaf in owners[k + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            ups.append(sha("".join(run)))
            groups.append(sum(owners[k : k + 16], []))
        leaves, owners = ups, groups
    return leaves[0], paths


def brute_manifest(rows):
    """rows (key, source, leaf) to {key: (leaf, subroot, root, proof)}; keys are unique and ordered."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((k, leaf) for k, source, leaf in rows if source == s)
        trees[s] = (own, *brute_tree([leaf for _, leaf in own]))
    root, above = brute_tree([trees[s][1] for s in sources])
    found = {}
    for i, s in enumerate(sources):
        own, subroot, paths = trees[s]
        for (key, leaf), path in zip(own, paths):
            found[key] = (leaf, subroot, root, sha("".join(a + b for a, b in path + above[i])))
    return found


@pytest.mark.parametrize("sizes", [{"x": 1}, {"x": 16, "y": 17}, {None: 1, "": 2, "é": 260, "z": 31}, {f"s{i:02}": 2 for i in range(18)}])
def test_manifest_is_the_brute_force_tree(spark, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k * 7 % 1009, source, sha(f"leaf {k}")))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumns(
        {c: F.lit(c) for c in ("tree", "at", "n", "digest", "path", "root", "kept")}
    )
    got = merkle.manifest(df, "source", ["doc_id"], "leaf")
    assert {"tree", "at", "n", "digest", "kept"} <= set(got.columns)
    got = got.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"),
        merkle.verified(F.col("leaf"), F.col("path"), F.col("root")).alias("ok"),
        merkle.verified(F.sha2("leaf", 256), F.col("path"), F.col("root")).alias("altered_ok"),
    ).collect()
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof) for r in got} == brute_manifest(rows)
    assert all(r.ok and not r.altered_ok for r in got)


def test_manifest_of_awkward_rows(spark):
    rows = [(None, None, sha("a")), (None, None, sha("a")), (1, "s", sha("b")), (1, "s", sha("b")), (1, "s", sha("c"))]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    got = merkle.manifest(df, "source", ["doc_id", "leaf"], "leaf")
    assert got.count() == 5
    assert got.where(~merkle.verified(F.col("leaf"), F.col("path"), F.col("root"))).count() == 0
    assert merkle.manifest(df.where("FALSE"), "source", ["doc_id"], "leaf").count() == 0


def test_leaf_digest_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, "ab"), ("", "ab"), ("a", "b"), ("é" * 100_000, None)], "x string, y string")
    got = [r[0] for r in df.select(merkle.leaf_digest(F.col("x"), F.col("y"))).collect()]
    assert got == [sha("-2:ab"), sha("0:2:ab"), sha("1:a1:b"), sha("200000:" + "é" * 100_000 + "-")]


# ---- 12


def brute_repair(marks):
    """Cheapest (cost, edits), ties ASCII-least, by uniform-cost search over whole strings."""
    n = len(marks) // 2
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heappop(heap)
        if i == n and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit
        key = (i, roles[-1:] or "^", len(audit) - len(audit.rstrip("I")) if i == n else -1)
        if key in done:
            continue
        done.add(key)
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        for r in allowed.replace("s", ""):
            if not audit.endswith("II"):
                heappush(heap, (cost + 2, audit + "I", i, roles + r))
        if i < n:
            initial, fault = marks[2 * i], marks[2 * i + 1]
            heappush(heap, (cost + 3, audit + "D", i + 1, roles))
            if fault not in "bd":
                more = fault == "t"
                if initial in allowed:
                    heappush(heap, (cost + more, audit + "K", i + 1, roles + initial))
                for r in allowed.replace("s", ""):
                    heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + r))


def random_marks(rng, n):
    return "".join(rng.choice("uuaaas ?") + rng.choice("......tttbd") for _ in range(n))


def test_cheapest_is_the_brute_force_one():
    rng = random.Random(5)
    for _ in range(400):
        marks = random_marks(rng, rng.randrange(9))
        assert repair.cheapest(marks, repair.START, repair.END) == brute_repair(marks), marks


def test_blocks_give_what_one_search_gives(monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 30)
        marks = random_marks(rng, n)
        cuts = [marks[2 * i : 2 * i + 8] for i in range(0, n, 4)]
        ways = [repair.exits(c, b == 0, b == len(cuts) - 1) for b, c in enumerate(cuts)]
        parts = [repair.cheapest(c, *way) for c, way in zip(cuts, repair.chosen(ways))]
        whole = repair.cheapest(marks, repair.START, repair.END)
        assert (sum(c for c, _ in parts), "".join(a for _, a in parts)) == whole, marks


CHAT = "conv_id long, turn long, role string, text string, fault string, cost string, at string, n string"


def chat(spark, rows):
    return spark.createDataFrame([(*r, "f", "c", "a", "n") for r in rows], CHAT)


def repaired(df):
    rows = repair.repair(df).orderBy("at", "step").collect()
    found = {}
    for r in rows:
        found.setdefault(r.conv_id, []).append(r)
    return found


def test_repair_of_awkward_rows(spark):
    rows = [
        (1, None, "user", "first."), (1, 0, "assistant", "fine."), (1, 0, "assistant", "fine."), (1, 5, "user", " \t"),
        (2, 0, None, None), (3, 0, "", "no role."), (None, 0, "user", "open"), (None, 0, "system", "s."),
        (4, 0, "tool", "x" * 200_000 + "."), (4, 1, "assistant", "ok!\n"),
    ]
    got = repaired(chat(spark, rows))
    tell = {k: ("".join(r.edit for r in v), [(r.role, r.text) for r in v if r.edit != "D"]) for k, v in got.items()}
    assert tell[1] == ("KKDD", [("user", "first."), ("assistant", "fine.")])
    assert tell[2] == ("D", [])
    assert tell[3][0] == "D"
    assert tell[None] == ("KKI", [("system", "s."), ("user", "open"), ("assistant", "")])
    assert tell[4][0] == "RK" and tell[4][1][0] == ("user", "x" * 200_000 + ".")
    assert [r.cost for r in got[None]] == [0, 1, 2]
    assert repair.repair(chat(spark, rows).where("FALSE")).count() == 0


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(7)
    rows = [(9, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["yes.", "no", f"text {i}.", f"open {i}"])) for i in range(300)]
    got = repaired(chat(spark, rows).repartition(5))[9]
    seen, marks = set(), ""
    for _, _, role, text in rows:
        fault = "d" if (role, text) in seen else "." if text.endswith(".") else "t"
        seen.add((role, text))
        marks += role[0] + fault
    assert ("".join(r.edit for r in got), sum(r.cost for r in got)) == repair.cheapest(marks, repair.START, repair.END)[::-1]
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in got if r.edit != "D"))


# ---- 13


DOCS = "doc_id long, text string, found int, row int, key string, marks string, copies int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, -1, -2, "k", "m", -3) for r in rows], DOCS)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_base(text):
    found = []
    for rank, kind in enumerate(privacy.KINDS):
        for m in re.finditer(kind.plain, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind.name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind.digits and not kind.digits[0] <= len(digits) <= kind.digits[1]:
                continue
            if kind.name == "card" and not luhn(digits):
                continue
            found.append((rank, m.start(), m.end(), m[0]))
    return found


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "x@y.zz", "_", "1", "12", "255", "256", ".4", " ", "-", "+1", "(", ")", "4539 1488 0343 6467", "4539148803436467", "é", "\U0001f600", "+1 (017) 555-7713", "169.122.221.182", "0", "  "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    texts += ["a@b.c%x@y.z@w.org", "1.2.3.4.5.6.7.8", "0001.02.3.4", "1" * 40, "+" + "1 " * 30, "a" * 50_000 + "@x.y", "9 " * 20_000, "a@" + "b." * 9000 + "c", None, ""]
    got = privacy.scan(documents(spark, list(enumerate(texts))).repartition(8)).select("doc_id", "found").collect()
    for r in got:
        assert [tuple(s) for s in r.found] == brute_base(texts[r.doc_id]), texts[r.doc_id]


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [i % 7 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        got = df.select(privacy.running(F.col("v"))).head()[0]
        assert got == [sum(values[: i + 1]) for i in range(n)]


def brute_words(rows):
    """(document's place, rank, start, end) of the words that reveal an entity."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    base = [brute_base(t) for _, t in rows]
    name = lambda s: (s[0], low(s[3]) if s[0] < 2 else re.sub("[^0-9]", "", s[3]))
    held = [{name(s) for s in b} for b in base]
    words = [{w for w in re.findall(privacy.TERM, low(t or "")) if len(w) >= privacy.SHORTEST} for _, t in rows]
    n, with_e, with_t = len(rows), Counter(e for h in held for e in h), Counter(w for ws in words for w in ws)
    both = Counter((e, w) for h, ws in zip(held, words) for e in h for w in ws)
    share = {}
    for (e, w), c in both.items():
        if c >= privacy.SUPPORT and with_e[e] < n:
            share[e, w] = log2(c * n / (with_e[e] * with_t[w])) / log2(n / with_e[e])
    found = set()
    for i, (_, t) in enumerate(rows):
        for m in re.finditer(privacy.TERM, t or ""):
            best = max((share.get((e, low(m[0])), 0) for e in held[i]), default=0)
            if best >= privacy.GENERAL and not any(s[1] < m.end() and m.start() < s[2] for s in base[i]):
                found.add((i, 5 if best >= privacy.REMOVED else 4, m.start(), m.end()))
    return found


def private_rows():
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = rng.sample(plain, 12)
        if i % 12 == 0:
            words[3:3] = ["Nightjar", "write", "to", "J.Doe@mail.example.com" if i % 24 else "j.doe@MAIL.example.com", "pass:", "4711x"]
        if i % 20 == 7:
            words.append("Nightjar" if i in (7, 27, 47) else "heron")
        if i % 15 == 4:
            words += ["+1 (017) 555-7713", "Lagoon"]
        rows.append((i, " ".join(words)))
    rows += [rows[12], rows[12], (None, rows[24][1]), (500, None), (501, ""), (502, "Nightjar " * 3000 + "j.doe@mail.example.com")]
    return rows


def test_revealing_words_are_the_brute_force_ones(spark):
    rows = private_rows()
    df = documents(spark, [(i, t) for i, (_, t) in enumerate(rows)]).repartition(6)
    got = privacy.spans(df).collect()
    assert len(got) == len(rows) and {r.row for r in got} == {-2}
    words = {(r.doc_id, s.rank, s.start, s.end) for r in got for s in r.found if s.rank >= 4}
    assert words == brute_words(rows)
    assert {w[1] for w in words} == {4, 5}
    for r in got:
        assert [tuple(s) for s in r.found if s.rank < 4] == brute_base(rows[r.doc_id][1])


def test_sanitised_texts(spark):
    rows = private_rows()
    df = documents(spark, rows)
    got = privacy.sanitised(df)
    assert got.columns == df.columns
    texts = [r.text for r in got.collect()]
    assert len(texts) == len(rows) and texts.count(None) == 1
    assert not any("@" in t for t in texts if t) and not any("4711x" in t for t in texts if t)
    assert "[email]" in " ".join(t for t in texts if t) and "[phone]" in " ".join(t for t in texts if t)
    clean = {t for _, t in rows if t and "@" not in t and "555" not in t}
    assert clean <= set(texts)
    assert privacy.sanitised(df.where("FALSE")).count() == 0
