"""Removal of repeated passages: buckets of suffixes refined by the identifiers at later offsets.

Sorting all suffixes of a corpus is not needed to find strings of a fixed length that start earlier: it
is enough to part the suffixes into buckets that agree on that many bytes. Identifiers of short
strings make those of longer ones (the one at a place and the one some offset later, again and again),
and each step uses the identifiers of the step before it. Only suffixes at the places where a window's
smallest short identifier changes are handed on; the others share their bucket with the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, slices, stored, table

#: Bytes of a passage, and of the strings that make the first buckets.
PASSAGE, FIRST = 100, 32
WINDOW = PASSAGE - FIRST + 1
#: Starts that are handed on together are cut after so many; a run that may hold one passage twice, as
#: text of a short period does, is marked by TWICE in its number of starts.
RUN, TWICE = WINDOW, 128
#: Texts are worked on in pieces of so many bytes, and runs gathered from so many before they are dealt out.
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 24 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LETTER = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of two adjacent or overlapping strings from theirs."""
    mixed = a * _A + b * _B
    mixed ^= mixed >> np.uint64(31)
    return mixed * _A


def identifiers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the identifiers of the FIRST, of twice FIRST and of the PASSAGE bytes from there on."""
    now, size = _LETTER[raw], 1
    while size < FIRST:
        now = _joined(now[:-size], now[size:])
        size *= 2
    first = now
    double = _joined(now[:-size], now[size:])
    rest = PASSAGE - 2 * size
    return first, double, _joined(double[: len(double) - rest], double[rest:])


def smallest(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each ``window`` values in a row."""
    n = len(values)
    full = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    table_ = full.reshape(-1, window)
    ahead = np.minimum.accumulate(table_, axis=1).ravel()
    back = np.minimum.accumulate(table_[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - window + 1], ahead[window - 1 : n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bucket, content, sides, text, start, starts) of the runs of passage starts in each text.

    A passage's bucket is the smallest identifier of its FIRST-byte strings. Neighbouring starts with
    one bucket and one place of it are one run; ``content`` identifies the bytes that its passages cover together. A passage
    can be twice in a run only if a window of it holds its smallest identifier twice. ``sides`` are short
    identifiers of the 2 * FIRST bytes that end with the run's smallest string and of those that begin
    with it (0: beyond the text): two runs with a passage in common agree in one of them.
    """
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.uint64)
    if len(raw) < PASSAGE:
        return empty, empty, np.zeros((0, 2), np.uint32), *(np.zeros(0, np.int64),) * 3
    ends = np.cumsum(sizes)
    first, double, passage = identifiers(raw)
    key = _joined(first, first)
    bucket = smallest(key, WINDOW)
    none = np.zeros(WINDOW - 1, np.uint64)
    chosen = np.flatnonzero(key == ~smallest(~np.r_[none, bucket, none], WINDOW))
    tie = np.flatnonzero((key[chosen[1:]] == key[chosen[:-1]]) & (np.diff(chosen) < WINDOW))
    twice = np.zeros(len(key) + 1, np.int32)
    np.add.at(twice, np.maximum(chosen[tie + 1] - WINDOW + 1, 0), 1)
    np.add.at(twice, chosen[tie] + 1, -1)
    twice = np.cumsum(twice)[: len(passage)] > 0
    at = np.arange(len(passage))
    text = np.repeat(np.arange(len(texts)), sizes)[: len(passage)]
    valid = at + PASSAGE <= ends[text]
    fresh = np.r_[True, (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])]
    # Equal smallest strings WINDOW apart lie in no window together and leave the bucket as it is, but the
    # place moves: a run of its own begins, as sides are those of one place.
    moved = (key[chosen[1:]] == key[chosen[:-1]]) & (np.diff(chosen) == WINDOW)
    fresh[chosen[:-1][moved] + 1] = True
    start = np.flatnonzero(fresh)
    inside = at - np.repeat(start, np.diff(np.r_[start, len(at)]))
    fresh |= inside % RUN == 0
    fresh, at, bucket, text, passage, twice = (x[valid] for x in (fresh, at, bucket, text, passage, twice))
    start = np.flatnonzero(fresh)
    if not len(start):
        return empty, empty, np.zeros((0, 2), np.uint32), *(np.zeros(0, np.int64),) * 3
    last = np.r_[start[1:], len(at)] - 1
    content = _joined(_joined(passage[start], passage[last]), (last - start).astype(np.uint64))
    begin = ends[text[start]] - sizes[text[start]]
    starts = last - start + 1 + TWICE * np.logical_or.reduceat(twice, start)
    # The place of a run's smallest string: the first chosen one in its last window with that identifier.
    near = np.searchsorted(chosen, at[last])
    while len(off := np.flatnonzero(key[chosen[near]] != bucket[start])):
        near[off] += 1
    place = chosen[near]
    short = (double >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    left = np.where(place - FIRST >= begin, short[np.maximum(place - FIRST, 0)], 0)
    right = np.where(place + 2 * FIRST <= ends[text[start]], short[np.minimum(place, len(short) - 1)], 0)
    sides = np.stack([left, right], 1).astype(np.uint32)
    return bucket[start], content, sides, text[start], at[start] - begin, starts


def _later(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """True for rows whose ``keys`` an earlier row, by ``order``, has too."""
    by = np.lexsort((*order[::-1], *keys[::-1]))
    same = np.zeros(len(by), bool)
    if len(by):
        same[1:] = np.logical_and.reduce([k[by][1:] == k[by][:-1] for k in keys])
    out = np.zeros(len(by), bool)
    out[by] = same
    return out


def _part(bucket: np.ndarray, parts: int) -> np.ndarray:
    """Buckets are smallest identifiers, so they crowd at the low end and are mixed once more."""
    return ((bucket * _B) >> np.uint64(48)).astype(np.int64) * parts >> 16


def _shared(bucket: np.ndarray, side: np.ndarray) -> np.ndarray:
    """True for rows whose bucket and side, if not 0, another row has too."""
    by = np.lexsort((side, bucket))
    same = (bucket[by][1:] == bucket[by][:-1]) & (side[by][1:] == side[by][:-1]) & (side[by][1:] != 0)
    out = np.zeros(len(by), bool)
    out[by] = np.r_[same, False] | np.r_[False, same] if len(by) else False
    return out


_PACKED = "part int, bucket binary, content binary, sides binary, text binary, start binary, starts binary, gone binary, docs binary"


def _packed_runs(docs: DataFrame, parts: int) -> DataFrame:
    """Runs of each block of texts, dealt out by bucket. What a block holds twice is settled in it: the
    later run goes (``gone``), the first one alone is handed on, so a block hands on a bucket's content once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        found: list[tuple[np.ndarray, ...]] = []
        piece: list[bytes] = []
        held = piece_held = 0

        def search() -> None:
            nonlocal piece, piece_held
            bucket, content, sides, text, start, starts = runs(piece)
            found.append((bucket, content, sides, text + len(ids) - len(piece), start, starts))
            piece, piece_held = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            if piece:
                search()
            if not found:
                return
            bucket, content, sides, text, start, starts = (np.concatenate(c) for c in zip(*found))
            names = np.array(ids, np.int64).reshape(-1, 2)
            later = _later((bucket, content), (names[text, 0], names[text, 1], start))
            part = _part(bucket, parts)
            by = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[by], np.arange(parts + 1))
            for p in range(parts):
                mine = by[bounds[p] : bounds[p + 1]]
                if not len(mine):
                    continue
                used, own = np.unique(text[mine], return_inverse=True)
                new, old = ~later[mine], later[mine]
                row = [
                    bucket[mine][new].tobytes(), content[mine][new].tobytes(), sides[mine][new].tobytes(), own[new].astype(np.int32).tobytes(),
                    start[mine][new].astype(np.int32).tobytes(), starts[mine][new].astype(np.uint8).tobytes(),
                    np.stack([own[old], start[mine][old], starts[mine][old] % TWICE], 1).astype(np.int32).tobytes(),
                    names[used].tobytes(),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in row)],
                    ["part", "bucket", "content", "sides", "text", "start", "starts", "gone", "docs"],
                )

        for batch in slices(batches):
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text"))):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < PASSAGE:
                    continue
                ids.append((doc, mark))
                piece.append(data)
                piece_held += len(data)
                held += len(data)
                if piece_held >= PIECE_BYTES:
                    search()
                if held >= BLOCK_BYTES:
                    yield from emit()
                    ids, found, held = [], [], 0
        yield from emit()

    return docs.mapInArrow(pack, _PACKED)


def _by_part(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """The packed rows of one part after the other."""
    part, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", *names))):
            if row[0] != part and rows:
                yield rows
                rows = []
            part = row[0]
            rows.append(row[1:])
    if rows:
        yield rows


def _refined(packed: DataFrame, parts: int) -> DataFrame:
    """(doc, mark, gone, open): per document of a part the runs that go, and those left to look into.

    A run whose content an earlier run of its bucket has goes as a whole. Of the first runs of each
    content those are looked into byte by byte that agree with another one on a side (the bucket refined
    by what lies at later and at earlier offsets), and those of a bucket that may hold a passage twice.
    """

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches, ["bucket", "content", "sides", "text", "start", "starts", "gone", "docs"]):
            offsets = np.cumsum([0, *(len(r[7]) // 16 for r in rows)])
            names = np.concatenate([np.frombuffer(r[7], np.int64).reshape(-1, 2) for r in rows])
            bucket = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
            content = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
            sides = np.concatenate([np.frombuffer(r[2], np.uint32).reshape(-1, 2) for r in rows])
            text = np.concatenate([np.frombuffer(r[3], np.int32) + o for r, o in zip(rows, offsets)])
            start = np.concatenate([np.frombuffer(r[4], np.int32) for r in rows])
            starts = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows]).astype(np.int32)
            settled = [np.frombuffer(r[6], np.int32).reshape(-1, 3) + [o, 0, 0] for r, o in zip(rows, offsets)]
            later = _later((bucket, content), (names[text, 0], names[text, 1], start))
            first = np.flatnonzero(~later)
            agree = _shared(bucket[first], sides[first, 0]) | _shared(bucket[first], sides[first, 1])
            # Where a run has its smallest string twice, sides say nothing: all of its bucket stays open.
            agree |= np.isin(bucket[first], bucket[first][starts[first] >= TWICE])
            first = first[agree]
            starts %= TWICE
            gone = np.concatenate([*settled, np.stack([text[later], start[later], starts[later]], 1)])
            # A block may have named a document that another row of the part names too: by name now.
            yield from _per_document(names, gone, np.stack([text[first], start[first], starts[first]], 1), bucket[first])

    return (
        packed.repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(refine, "doc long, mark long, gone binary, open binary")
    )


def _per_document(names, gone: np.ndarray, open_: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    entries: dict[int, list[bytes]] = {}
    for side, rows, more in ((0, gone, None), (1, open_, bucket)):
        by = np.argsort(rows[:, 0], kind="stable")
        rows = rows[by]
        cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True]) if len(rows) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            packed = np.ascontiguousarray(rows[a:b, 1:], np.int32)
            if more is not None:
                packed = np.hstack([packed, more[by[a:b]].view(np.int32).reshape(-1, 2)])
            entries.setdefault(int(rows[a, 0]), [b"", b""])[side] = packed.tobytes()
    keys = list(entries)
    for at in range(0, len(keys), 10_000):
        some = keys[at : at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names[some, 0]), pa.array(names[some, 1]),
                pa.array([entries[k][0] for k in some], pa.binary()), pa.array([entries[k][1] for k in some], pa.binary()),
            ],
            ["doc", "mark", "gone", "open"],
        )


def _contents(docs: DataFrame, parts: int) -> DataFrame:
    """The bytes of the open runs of ``docs`` (doc, mark, text, open), dealt out by bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            per_part: dict[int, list[tuple]] = {}
            for doc, mark, text, opened in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "open"))):
                data = text.encode("utf-8", "surrogatepass")
                for packed in opened:
                    rows = np.frombuffer(packed, np.int32).reshape(-1, 4)
                    bucket = np.ascontiguousarray(rows[:, 2:]).view(np.uint64).ravel()
                    part = _part(bucket, parts)
                    for p, b, (start, starts) in zip(part.tolist(), bucket.tolist(), rows[:, :2].tolist()):
                        per_part.setdefault(p, []).append((b, doc, mark, start, data[start : start + starts + PASSAGE - 1]))
            for p, entries in per_part.items():
                bucket, doc, mark, start, data = zip(*entries)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p], pa.int32()), pa.array([np.array(bucket, np.uint64).tobytes()]),
                        pa.array([np.array([doc, mark], np.int64).T.tobytes()]), pa.array([np.array(start, np.int32).tobytes()]),
                        pa.array([np.array([len(d) for d in data], np.int32).tobytes()]), pa.array([b"".join(data)]),
                    ],
                    ["part", "bucket", "docs", "start", "sizes", "data"],
                )

    return docs.mapInArrow(cut, "part int, bucket binary, docs binary, start binary, sizes binary, data binary")


def _settled(contents: DataFrame, parts: int) -> DataFrame:
    """(doc, mark, gone): the passages of open runs that start earlier elsewhere."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches, ["bucket", "docs", "start", "sizes", "data"]):
            bucket = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
            names = np.concatenate([np.frombuffer(r[1], np.int64).reshape(-1, 2) for r in rows])
            start = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
            sizes = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
            data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            begin = np.cumsum(sizes) - sizes
            unique, number = np.unique(names, axis=0, return_inverse=True)
            gone = []
            # Some buckets at a time, so that identifiers take little memory.
            by = np.argsort(bucket, kind="stable")
            piece = np.cumsum(sizes[by]) // PIECE_BYTES
            cut = np.flatnonzero(np.diff(piece)) + 1
            cut = np.searchsorted(bucket[by], bucket[by][cut]) if len(cut) else cut
            for some in np.split(by, np.unique(cut)):
                if not len(some):
                    continue
                joined = np.concatenate([data[begin[k] : begin[k] + sizes[k]] for k in some])
                passage = identifiers(joined)[2]
                n = sizes[some] - PASSAGE + 1
                run = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                own = passage[(np.cumsum(sizes[some]) - sizes[some])[run] + inside]
                run = some[run]
                later = _later((bucket[run], own), (names[run, 0], names[run, 1], start[run] + inside))
                run, inside = run[later], inside[later]
                gone.append(np.stack([number.reshape(-1)[run], start[run] + inside, np.ones(len(run), np.int64)], 1))
            gone = np.concatenate(gone)
            none = np.zeros((0, 3), np.int64)
            for batch in _per_document(unique, gone, none, np.zeros(0, np.uint64)):
                yield batch.select(["doc", "mark", "gone"])

    return (
        contents.repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(settle, "doc long, mark long, gone binary")
    )


def covered(gone: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches that the passages of ``gone`` cover."""
    edge = np.zeros(size + 1, np.int32)
    for packed in gone:
        rows = np.frombuffer(packed, np.int32).reshape(-1, 2)
        np.add.at(edge, rows[:, 0], 1)
        np.add.at(edge, np.minimum(rows[:, 0] + rows[:, 1] - 1 + PASSAGE, size), -1)
    mask = np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0]
    step = np.diff(mask)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def removed_passages(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``removed``: the stretches (begin, end) of bytes that passages cover
    which start earlier, in UTF-8, in order.

    Earlier is a smaller doc_id, or an earlier start in the same text. NULL texts are empty and NULL
    doc_ids come first. Rows that share a doc_id are ordered by a hash of their text; rows repeated
    outright are one text and each get its result. Texts under 100 bytes hold no passage. Memory of a
    task grows with its longest text, about a hundred bytes a byte. Other columns do not pass.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))
    found = stored(_refined(_packed_runs(rows.select("doc", "mark", "text"), parts), parts), "passages")
    opened = found.where(F.length("open") > 0).groupBy("doc", "mark").agg(F.collect_list("open").alias("open"))
    once = rows.join(opened, ["doc", "mark"]).select("doc", "mark", "text", "open")
    settled = _settled(_contents(once, parts), parts)
    gone = found.where(F.length("gone") > 0).select("doc", "mark", "gone").unionByName(settled)
    gone = gone.groupBy("doc", "mark").agg(F.collect_list("gone").alias("gone"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                begin, end = covered(packed or [], len(text.encode("utf-8", "surrogatepass"))) if packed else ([], [])
                out.append([{"begin": int(a), "end": int(b)} for a, b in zip(begin, end)])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(out, kind)], ["doc_id", "text", "removed"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(gone, ["doc", "mark"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(spans, f"doc_id {kind}, text string, removed array<struct<begin:long,end:long>>")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
                data, kept, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
                for r in removed:
                    kept.update(data[at : r["begin"]])
                    at = r["end"]
                kept.update(data[at:])
                rows.append((len(data), sum(r["end"] - r["begin"] for r in removed), len(removed), kept.hexdigest()))
            n, gone, spans, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    found = removed_passages(table(spark, sf_dir, "documents"))
    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op3_suffix_dedup": Query(op3)}
