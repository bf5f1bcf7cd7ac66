"""SentencePiece encoding and decoding over a relational lattice of substrings and pieces."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, shared_folder, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words up to so many characters pass through the lattice; their cuts fit in one whole number.
LONGEST = 62
#: Longer pieces do not occur in the vocabulary.
PIECE = 16
#: Distinct words a task gathers before it hands them on to the lattice, and before it stores them with
#: their ids, and words of one row handed on. The first holds those of most stretches, which are then handed on once.
ASKED, GATHERED, ROW = 400_000, 60_000, 5_000
#: What is stored of the words of a row: end to end, how long each is, their ids, and how many each has.
STORED = ["words", "lengths", "word_ids", "counts"]
#: Words a task keeps at hand beside those stored for it; the rest is merged again when it is met again.
AT_HAND = 20_000
#: Words between spaces whose ids a task keeps at hand as a whole.
SPACED = 50_000
#: Words between spaces that are cut into units at once.
CUT = 10_000
#: Characters of text whose words a task holds at once (a longer text is a stretch of its own).
STRETCH = 16_000_000
#: An edge in one whole number: rank, start, end, id, from the top.
_RANK, _START, _END, _ID = 40, 32, 24, (1 << 24) - 1


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> tuple[dict[str, tuple[int, float]], int]:
    """Pieces with id and score, and the id of byte 0 of the fallback; a task keeps nothing else of the model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(len(m)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return {m.id_to_piece(i): (i, m.get_score(i)) for i in plain}, m.piece_to_id("<0x00>")


@lru_cache(maxsize=2)
def ranks(path: str = MODEL) -> dict[float, int]:
    """The place of each score among the vocabulary's, best first."""
    return {s: k for k, s in enumerate(sorted({s for _, s in vocabulary(path)[0].values()}, reverse=True))}


def piece_table(spark: SparkSession, path: str = MODEL) -> DataFrame:
    """(piece, id, score, rank): as many rows as the vocabulary, whatever the corpus."""
    place = ranks(path)
    rows = [(p, i, s, place[s]) for p, (i, s) in vocabulary(path)[0].items()]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank int")


@lru_cache(maxsize=2)
def _neighbours(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point (0: in no piece of two or more), and which numbers stand side by side in a piece."""
    pairs = {p[k : k + 2] for p in vocabulary(path)[0] for k in range(len(p) - 1)}
    letters = {c: k + 1 for k, c in enumerate(sorted({c for pair in pairs for c in pair}))}
    numbers = np.zeros(0x110000, np.int32)
    numbers[[ord(c) for c in letters]] = list(letters.values())
    together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
    for a, b in pairs:
        together[letters[a], letters[b]] = True
    return numbers, together


def units(text: str, path: str = MODEL) -> list[str]:
    """The text, with marks for spaces, cut wherever no piece holds the two neighbouring characters.

    A merge makes a piece that holds the characters on both sides of its seam, so no merge crosses a
    cut and units can be encoded by themselves.
    """
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    numbers, together = _neighbours(path)
    at = numbers[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
    apart = ~together.ravel()[at[:-1] * len(together) + at[1:]]
    places = [0, *(np.flatnonzero(apart) + 1).tolist(), len(marked)]
    return [marked[a:b] for a, b in zip(places, places[1:])]


@lru_cache(maxsize=2)
def _cut_at_spaces(path: str) -> bool:
    """Whether the mark for a space follows nothing but itself in any piece."""
    numbers, together = _neighbours(path)
    mark = numbers[ord(SPACE)]
    return not np.delete(together[:, mark], mark).any()


def _parted(text: str, path: str) -> list[str] | None:
    """The words of a text that single spaces part, if units end at them; else None."""
    if text and _cut_at_spaces(path) and SPACE not in text and "  " not in f" {text} ":
        return text.split(" ")
    return None


@lru_cache(maxsize=2)
def _kind(path: str) -> type:
    """The narrowest kind of number that holds every id."""
    known, byte = vocabulary(path)
    return np.uint16 if max(byte + 255, *(i for i, _ in known.values())) < 1 << 16 else np.int32


# ---- the lattice


def _full(start: Column, end: Column) -> Column:
    return F.struct(F.col("score"), start.alias("start"), end.alias("end"), F.col("id"))


def _packed(start: Column, end: Column) -> Column:
    """Edges that sort by rank, then start; they are a sixth as wide as ``_full`` ones."""
    up = [F.shiftleft(c.cast("long"), n) for c, n in ((F.col("rank"), _RANK), (start, _START), (end, _END), (F.col("id"), 0))]
    return up[0].bitwiseOR(up[1]).bitwiseOR(up[2]).bitwiseOR(up[3])


def lattice(words: DataFrame, pieces: DataFrame, edge: Callable[[Column, Column], Column] = _full) -> DataFrame:
    """``words`` (unit, distinct, and other columns) with ``edges``: (score, start, end, id) of each substring that
    is a piece, or what ``edge`` makes of start and end and the columns of ``pieces``.

    Substrings up to the longest piece are exploded and equi-joined to the piece table, which the
    vocabulary bounds; edges are grouped by word where its substrings were made: ``words`` are dealt out by
    a hash (``_hash``, ``dealt``), which every substring keeps, so there is no exchange. Each word also sends
    one empty substring, which meets an empty piece and carries the word and the other columns: words without
    any piece stay, and the words need not be joined to their edges again. The hash and a number within the
    partition stand for the word in the grouping key, so that what is sorted is narrow and holds no texts.
    """
    if "_hash" not in words.columns:
        words = dealt(words)
    carried = [c for c in words.columns if c != "_hash"]
    length = F.length("unit")
    numbered = words.select("*", F.monotonically_increasing_id().alias("_word"), length.alias("_n"))
    starts = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_start"))
    shortest = F.when(F.col("_start") == 0, 0).otherwise(1)
    longest = F.least(F.lit(PIECE), F.col("_n") - F.col("_start"))
    spans = starts.select("_hash", "_word", *carried, "_start", F.explode(F.sequence(shortest, longest)).alias("_len"))
    first = [F.when(F.col("_len") == 0, F.col(c)).alias(c) for c in carried]
    text = F.substring("unit", F.col("_start") + 1, F.col("_len")).alias("piece")
    cut = spans.select("_hash", "_word", *first, "_start", "_len", text)
    empty = pieces.sparkSession.createDataFrame([("", *[None] * (len(pieces.columns) - 1))], pieces.schema)
    joined = cut.join(F.broadcast(pieces.union(empty)), "piece")
    found = F.when(F.col("_len") > 0, edge(F.col("_start"), F.col("_start") + F.col("_len"))).alias("_edge")
    own = [F.first(c, ignorenulls=True).alias(c) for c in carried]
    edges = joined.select("_hash", "_word", *carried, found)
    return edges.groupBy("_hash", "_word").agg(*own, F.collect_list("_edge").alias("edges")).drop("_hash", "_word")


def dealt(words: DataFrame) -> DataFrame:
    """``words`` with ``_hash``, dealt out by it: rows of one unit are in one partition."""
    return words.withColumn("_hash", F.xxhash64("unit")).repartition("_hash")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def fold_merges(n: Column, edges: Column) -> Column:
    """The cuts of a word after all merges of a byte-pair model, as bits of a whole number.

    The fold starts with a cut at every character. Each step takes the best edge (highest score, then
    leftmost) that spans exactly two neighbouring parts, and drops the cut between them.
    """
    ranked = F.transform(
        F.sort_array(
            F.transform(
                F.filter(edges, lambda e: e["end"] - e["start"] > 1),
                lambda e: F.struct((-e["score"]).alias("rank"), e["start"].alias("start"), e["end"].alias("end")),
            )
        ),
        lambda e: F.struct(
            _bit(e["start"]).bitwiseOR(_bit(e["end"])).alias("ends"),
            (_bit(e["end"]) - _bit(e["start"] + 1)).alias("inside"),
        ),
    )

    def step(cuts: Column, ranked: Column) -> Column:
        fits = F.filter(
            ranked,
            lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inside"])) == 1),
        )
        return F.when(F.size(fits) > 0, cuts.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0))["inside"]))).otherwise(cuts)

    every = _bit(n + 1) - F.lit(1).cast("long")
    return F.element_at(
        F.transform(
            F.array(ranked),
            lambda r: F.aggregate(F.sequence(F.lit(1), F.least(n, F.size(r)) + 1), every, lambda cuts, _: step(cuts, r)),
        ),
        1,
    )


def _at(edge: Column, place: int) -> Column:
    """The eight bits of a packed edge from ``place`` on."""
    return F.shiftright(edge, place).bitwiseAND(F.lit(255).cast("long")).cast("int")


def fold_in_order(n: Column, edges: Column) -> Column:
    """The cuts ``fold_merges`` gives, by one pass over packed edges, for words without pieces ``out_of_order``."""

    def step(cuts: Column, e: Column) -> Column:
        start, end = _at(e, _START), _at(e, _END)
        ends, inside = _bit(start).bitwiseOR(_bit(end)), _bit(end) - _bit(start + 1)
        fits = (cuts.bitwiseAND(ends) == ends) & (F.bit_count(cuts.bitwiseAND(inside)) == 1)
        return F.when(fits, cuts.bitwiseAND(F.bitwise_not(inside))).otherwise(cuts)

    ranked = F.sort_array(F.filter(edges, lambda e: _at(e, _END) - _at(e, _START) > 1))
    return F.aggregate(ranked, _bit(n + 1) - F.lit(1).cast("long"), step)


def fold_viterbi(n: Column, edges: Column) -> Column:
    """The cuts of the best segmentation of a word by summed scores, for a unigram model.

    Edges are folded in order of their start; the state holds for each place the best score up to
    there and its cuts. Places no edge reaches stay at NULL, and so may the result.
    """
    ordered = F.sort_array(
        F.transform(edges, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score")))
    )
    blank = F.struct(F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("cuts"))
    first = F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("cuts"))
    start = F.concat(F.array(first), F.array_repeat(blank, n))

    def relax(best: Column, e: Column) -> Column:
        came = F.get(best, e["start"])
        total = came["score"] + e["score"]
        return F.transform(
            best,
            lambda b, at: F.when(
                (at == e["end"]) & total.isNotNull() & (b["score"].isNull() | (total > b["score"])),
                F.struct(total.alias("score"), came["cuts"].bitwiseOR(_bit(e["end"])).alias("cuts")),
            ).otherwise(b),
        )

    done = F.get(F.aggregate(ordered, start, relax), n)
    return F.when(done["score"].isNotNull(), done["cuts"])


def ids_of(unit: Column, cuts: Column, edges: Column, byte: int) -> Column:
    """The ids of the parts between cuts; a character without a piece becomes the ids of its bytes."""
    cut_at = F.filter(
        F.sequence(F.lit(0), F.length(unit)), lambda at: cuts.bitwiseAND(_bit(at)) != F.lit(0).cast("long")
    )

    def part(places: Column, at: Column, k: Column) -> Column:
        end = F.get(places, k + 1)
        own = F.filter(edges, lambda e: (e["start"] == at) & (e["end"] == end))
        code = F.hex(F.encode(F.substring(unit, at + 1, F.lit(1)), "UTF-8"))
        raw = F.transform(
            F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1),
            lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + byte,
        )
        return F.when(end.isNull(), F.array().cast("array<int>")).when(F.size(own) > 0, F.array(F.get(own, F.lit(0))["id"])).otherwise(raw)

    # The places are worked out once: they are the only item of an array.
    parts = F.transform(F.array(cut_at), lambda places: F.transform(places, lambda at, k: part(places, at, k)))
    return F.flatten(F.element_at(parts, 1))


def _unpacked(edges: Column) -> Column:
    return F.transform(
        edges,
        lambda e: F.struct(
            (-F.shiftright(e, _RANK)).cast("double").alias("score"), _at(e, _START).alias("start"), _at(e, _END).alias("end"),
            e.bitwiseAND(F.lit(_ID).cast("long")).cast("int").alias("id"),
        ),
    )


def _ids_packed(unit: Column, cuts: Column, edges: Column, byte: int) -> Column:
    """``ids_of`` over packed edges: those between neighbouring cuts, by start, if they cover the word."""

    def used(e: Column) -> Column:
        start, end = _at(e, _START), _at(e, _END)
        ends = _bit(start).bitwiseOR(_bit(end))
        return cuts.bitwiseAND(ends.bitwiseOR(_bit(end) - _bit(start + 1))) == ends

    low = F.lit((1 << _RANK) - 1)
    mine = F.sort_array(F.transform(F.filter(edges, used), lambda e: e.bitwiseAND(low)))
    ids = F.transform(mine, lambda e: e.bitwiseAND(F.lit(_ID).cast("long")).cast("int"))
    return F.element_at(
        F.transform(
            F.array(ids),
            lambda found: F.when(F.size(found) == F.bit_count(cuts) - 1, found).otherwise(
                ids_of(unit, cuts, _unpacked(edges), byte)
            ),
        ),
        1,
    )


@lru_cache(maxsize=2)
def out_of_order(path: str = MODEL) -> list[int]:
    """The ids of pieces in whose making a merge is followed by one that is not behind it by rank and place.

    What happens inside a piece before it is made does not depend on what is around it, so the merges of
    each piece by itself show all ways in which a merge can lead to another. In a word without such pieces
    the best merge left is never one that has just become possible, and one pass in order is enough.
    """
    known, _ = vocabulary(path)
    made = {i: _merges(p, known)[1] for p, (i, _) in known.items()}
    return sorted(i for i, m in made.items() if any(a >= b for a, b in zip(m, m[1:])))


def encode_words(words: DataFrame, path: str = MODEL) -> DataFrame:
    """``words`` (unit: distinct, not NULL, 1 to ``LONGEST`` characters) with their ids."""
    joined = lattice(words, piece_table(words.sparkSession, path), _packed)
    n, edges = F.length("unit"), F.col("edges")
    odd = F.exists(edges, lambda e: e.bitwiseAND(F.lit(_ID).cast("long")).isin(out_of_order(path)))
    cuts_of = F.when(odd, fold_merges(n, _unpacked(edges))).otherwise(fold_in_order(n, edges))
    # The cuts are bound to a name of the lambda: as a column they might be worked out at each use.
    ids = F.transform(F.array(cuts_of), lambda cuts: _ids_packed(F.col("unit"), cuts, edges, vocabulary(path)[1]))
    return joined.withColumn("ids", F.element_at(ids, 1)).drop("edges")


def merged(unit: str, path: str = MODEL) -> list[int]:
    """The same merges for one word of any length, by a heap: for words longer than ``LONGEST``, and for
    those that a repeated task meets and the stored words do not hold."""
    known, byte = vocabulary(path)
    if unit in known:
        return [known[unit][0]]
    out: list[int] = []
    for p in _merges(unit, known)[0]:
        if p in known:
            out.append(known[p][0])
        else:
            out.extend(byte + x for x in p.encode("utf-8", "surrogatepass"))
    return out


def _merges(unit: str, known: dict[str, tuple[int, float]]) -> tuple[list[str], list[tuple[float, int]]]:
    """The parts of a word after all merges, and rank and place of each merge in the order in which they came."""
    done: list[tuple[float, int]] = []
    parts, after = list(unit), list(range(1, len(unit) + 1))
    before = list(range(-1, len(unit) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < len(unit) and (pair := parts[a] + parts[b]) in known:
            heapq.heappush(heap, (-known[pair][1], a, pair))

    for a in range(len(unit) - 1):
        offer(a)
    while heap:
        rank, a, pair = heapq.heappop(heap)
        b = after[a]
        if parts[a] == "" or b >= len(unit) or parts[a] + parts[b] != pair:
            continue
        done.append((rank, a))
        parts[a], parts[b], after[a] = pair, "", after[b]
        if after[b] < len(unit):
            before[after[b]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    return [p for p in parts if p], done


# ---- documents


def _stretches(texts: Iterator[str | None]) -> Iterator[tuple[int, str]]:
    """Each text with the number of its stretch: a new one begins when ``STRETCH`` characters are passed."""
    stretch, n = 0, 0
    for text in texts:
        if n and n + len(text or "") > STRETCH:
            stretch, n = stretch + 1, 0
        n += len(text or "")
        yield stretch, text or ""


def _unknown(cut: list[str], path: str) -> Iterator[str]:
    """The units that are no piece themselves, as far as they pass through the lattice."""
    known = vocabulary(path)[0]
    return (u for u in cut if u not in known and len(u) <= LONGEST)


def _handed_on(spaced: set[str], seen: set[str], path: str) -> Iterator[pa.Array]:
    """The units of ``spaced`` and those ``seen`` in rows of ``ROW``; words leave one set as they enter the other
    or a row, so that a task holds each about once, and both sets are empty in the end."""
    while spaced:
        seen.update(_unknown(units(" ".join(spaced.pop() for _ in range(min(CUT, len(spaced)))), path), path))
    while seen:
        yield pa.array([seen.pop() for _ in range(min(ROW, len(seen)))], pa.string())


def _words_of(docs: DataFrame, path: str) -> DataFrame:
    """(unit, block): the distinct words of each stretch of a partition that are no piece themselves; the block
    is the partition's number and, in the low 24 bits, the stretch's."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, seen = set(), set()
        block, last = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            for part in _handed_on(spaced, seen, path):
                own = pa.array([(block[0] << 24) + last] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([part, own], ["unit", "block"])

        def texts() -> Iterator[str | None]:
            for batch in slices(batches):
                block[:] = batch.column("block")[:1].to_pylist()
                yield from batch.column("text").to_pylist()

        for stretch, text in _stretches(texts()):
            if stretch != last or len(spaced) + len(seen) > ASKED:
                yield from emit()
                last = stretch
            # Where single spaces part the words, units end at them, and each word is cut once.
            if parts := _parted(text, path):
                spaced.update(parts)
            else:
                seen.update(_unknown(units(text, path), path))
        if spaced or seen:
            yield from emit()

    return docs.select("text", F.spark_partition_id().alias("block")).mapInArrow(gather, "unit string, block long")


class _Words(dict):
    """Words with their ids as bytes: the pieces, those stored for the stretch at hand, and up to
    ``AT_HAND`` that were met beside them. ``wrong`` tells whether any word of the stretch decodes to something else."""

    def __init__(self, path: str, stored: Iterator[tuple[int, str, bytes, bytes, bytes]]):
        self.path, self.stored, self.ahead, self.stretch, self.wrong = path, stored, None, -1, False
        self.data, self.kind = _bytes_of(path), _kind(path)
        self.sizes = np.zeros(max(self.data) + 1, np.int64)
        self.sizes[list(self.data)] = [len(v) for v in self.data.values()]
        self.spaced: dict[str, bytes] = {}

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.data.__getitem__, np.frombuffer(ids, self.kind).tolist()))

    def differs(self, unit: str, ids: bytes) -> bool:
        return self.decoded(ids) != unit.replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def any_differs(self, text: str, lengths: np.ndarray, ids: bytes, counts: np.ndarray) -> bool:
        """``differs`` for words that stand one after the other: all bytes are equal, and so is each word's end."""
        raw = text.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        ends = np.append(begins, len(raw))[lengths]
        made = np.cumsum(self.sizes[np.frombuffer(ids, self.kind)])[counts - 1]
        return self.decoded(ids) != raw or not np.array_equal(ends, made)

    def turn_to(self, stretch: int) -> None:
        """Forget the words of the last stretch and read this one's; stretches are stored in order."""
        if stretch == self.stretch:
            return
        self.clear()
        self.spaced = {}
        self.update((p, self.kind(i).tobytes()) for p, (i, _) in vocabulary(self.path)[0].items())
        self.stretch, self.met, self.wrong = stretch, [], False
        self.ahead = self.ahead or next(self.stored, None)
        while self.ahead and self.ahead[0] <= stretch:
            if self.ahead[0] == stretch:
                _, text, lengths, ids, counts = self.ahead
                lengths, counts = (np.cumsum(np.frombuffer(x, np.uint8), dtype=np.int64) for x in (lengths, counts))
                ends, stops = lengths.tolist(), (counts * np.dtype(self.kind).itemsize).tolist()
                words = (text[a:b] for a, b in zip([0, *ends], ends))
                self.update(zip(words, (ids[a:b] for a, b in zip([0, *stops], stops))))
                self.wrong = self.wrong or self.any_differs(text, lengths, ids, counts)
            self.ahead = next(self.stored, None)

    def __missing__(self, unit: str) -> bytes:
        if len(self.met) >= AT_HAND:
            for u in self.met:
                del self[u]
            self.met = []
        self.met.append(unit)
        ids = self[unit] = np.array(merged(unit, self.path), self.kind).tobytes()
        self.wrong = self.wrong or self.differs(unit, ids)
        return ids

    def coded(self, text: str) -> bytes:
        """The ids of a text. Words between single spaces are cut once and then found as they stand, up to ``SPACED``."""
        parts = _parted(text, self.path)
        if parts is None:
            return b"".join(map(self.__getitem__, units(text, self.path)))
        new = set(parts).difference(self.spaced)
        if len(self.spaced) + len(new) > SPACED:
            self.spaced, new = {}, set(parts)
        if len(new) > SPACED:
            return b"".join(map(self.__getitem__, units(text, self.path)))
        if new:
            cut = units(" ".join(new), self.path)
            begins = [k for k, u in enumerate(cut) if u[0] == SPACE]
            ids = list(map(self.__getitem__, cut))
            own = (ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(begins, [*begins[1:], len(cut)]))
            self.spaced.update(zip(new, own))
        return b"".join(map(self.spaced.__getitem__, parts))

    def gives(self, text: str, ids: bytes) -> bool:
        """Whether the text's ids decode to it. If each word's do, the text's give the text with marks as spaces."""
        if not self.wrong:
            return SPACE not in text
        return self.decoded(ids).removeprefix(b" ") == text.encode("utf-8", "surrogatepass")


def encode(docs: DataFrame, path: str = MODEL, column: str = "ids", checked: str = "round_trip") -> DataFrame:
    """``docs`` with ``column``: the ids of ``text``, equal to those of the model's own library, and
    ``checked``: whether they decode to the text, found out in the same pass over it.

    The words of all texts are made distinct over the corpus, sent through the lattice once, and written
    to the shared folder by the partition of ``docs`` that asked for them; each partition then reads
    its own words, a stretch of texts at a time, and puts the texts together, so texts are never shuffled. NULL and empty texts have
    no ids. All columns and rows of ``docs`` stay (any named like ``column`` or ``checked`` are replaced); only texts
    with the mark for a space itself do not decode to themselves, as the model has it.
    """
    spark = docs.sparkSession
    docs = docs.drop(column, checked)
    asked = dealt(_words_of(docs, path)).groupBy("_hash", "unit").agg(F.collect_set("block").alias("blocks"))
    coded = encode_words(asked, path)
    folder = shared_folder(spark, "words")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of words end to end with their lengths, and ids with their counts: a byte of each per word."""
        kind = _kind(path)
        held: dict[int, list[tuple[str, bytes, bytes, bytes]]] = {}
        n = 0

        def emit() -> pa.RecordBatch:
            texts, *raw = zip(*(("".join(t), *map(b"".join, rest)) for t, *rest in (zip(*parts) for parts in held.values())))
            places = np.array(list(held), np.int64)
            numbers = [pa.array((places >> 24).astype(np.int32)), pa.array((places % (1 << 24)).astype(np.int32))]
            columns = [*numbers, pa.array(texts, pa.string()), *(pa.array(x, pa.binary()) for x in raw)]
            return pa.RecordBatch.from_arrays(columns, ["block", "stretch", *STORED])

        for batch in filter(len, batches):
            units_, blocks, ids = (batch.column(c) for c in ("unit", "blocks", "ids"))
            offsets = blocks.offsets.to_numpy()
            flat = blocks.values.to_numpy()[offsets[0] : offsets[-1]]
            order = np.argsort(flat, kind="stable")
            rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets))[order])
            words, own, of = units_.take(rows), ids.take(rows), flat[order]
            seams = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            lengths = pc.utf8_length(words).to_numpy().astype(np.uint8)
            places = own.offsets.to_numpy()
            counts, numbers = np.diff(places).astype(np.uint8), own.values.to_numpy().astype(kind)
            for a, b in zip(seams, seams[1:]):
                text = "".join(words.slice(a, b - a).to_pylist())
                part = text, lengths[a:b].tobytes(), numbers[places[a] : places[b]].tobytes(), counts[a:b].tobytes()
                held.setdefault(int(of[a]), []).append(part)
            n += len(of)
            if n > GATHERED:
                yield emit()
                held, n = {}, 0
        if held:
            yield emit()

    answers = coded.select("unit", "blocks", "ids").mapInArrow(
        packed, "block int, stretch int, words string, lengths binary, word_ids binary, counts binary"
    )
    answers.repartition("block").sortWithinPartitions("block", "stretch").write.partitionBy("block").option("compression", "zstd").parquet(folder)
    address = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    names = docs.columns

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        sliced: list[pa.RecordBatch] = []

        def texts() -> Iterator[str | None]:
            for batch in slices(batches):
                sliced.append(batch)
                yield from batch.column("text").to_pylist()

        def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(out), words.kind).astype(np.int32)
            offsets = pa.array((np.cumsum([0, *map(len, out)]) // np.dtype(words.kind).itemsize).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
            arrays = [*(batch.column(c) for c in names), ids, pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, [*names, column, checked])

        out, same = [], []
        for stretch, text in _stretches(texts()):
            if words is None:
                words = _Words(path, _stored_words(address, sliced[0].column("_block")[0].as_py()))
            words.turn_to(stretch)
            out.append(words.coded(text))
            same.append(words.gives(text, out[-1]))
            if len(out) == sliced[0].num_rows:
                yield answer(sliced.pop(0))
                out, same = [], []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("_block", F.spark_partition_id()).mapInArrow(
        assemble, f"{schema}, `{column}` array<int>, `{checked}` boolean"
    )


def _stored_words(address: str, block: int) -> Iterator[tuple[int, str, bytes, bytes, bytes]]:
    """Stretch, words, lengths, ids and counts of the block's rows, by stretch; the rows of a block are in one file."""
    store, root = fs.FileSystem.from_uri(address)
    found = store.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    for info in found:
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["stretch", *STORED]):
                    yield tuple(batch.column(c)[0].as_py() for c in ("stretch", *STORED))


def _bytes_of(path: str) -> dict[int, bytes]:
    """The bytes each id stands for."""
    known, byte = vocabulary(path)
    return {i: p.replace(SPACE, " ").encode() for p, (i, _) in known.items()} | {byte + b: bytes([b]) for b in range(256)}


def decode(rows: DataFrame, path: str = MODEL, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids: pieces in order, bytes joined, the first space left out."""
    names = [c for c in rows.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = _bytes_of(path)
        for batch in slices(batches):
            texts = []
            for ids in batch.column(column).to_pylist():
                raw = b"".join(map(data.__getitem__, ids or []))
                texts.append(raw.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, into])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(
        run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{into}` string"
    )


def encoded_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by commas) and round_trip (decoding gives the text)."""
    coded = encode(docs.select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "round_trip",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sentencepiece": Query(op8)}
