"""Jaccard join of documents on word n-grams: rare-first prefixes, length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, components, slices, stored, table
from plumbline.session import cut_lineage

#: Words of an n-gram and the smallest similarity, in percent.
WORDS, PERCENT = 4, 85
#: Texts of so many bytes are gathered before their n-grams are handed on, so that rows are worth packing.
BLOCK_BYTES = 24 << 20
#: Shingles of a part of the hash range, which one task sorts: parts are as many as the shingles ask for.
PART_SHINGLES = 4 << 20
#: Whole numbers of a set's parity sketch, 64 bits each.
SKETCH = 16
#: A prefix shingle is compared with so many of those before it in its set's prefix, so that a pair of sets that
#: share a run of them meets once. Pairs that meet again further on are made distinct afterwards.
BEFORE = 16

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``data``, in order; words are parted by ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    if starts[0]:
        return word_hashes(data[starts[0] :])
    # Each byte is mixed with its place in its word; a word's hash is the mixed sum.
    place = (np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))).astype(np.uint64)
    byte = _mixed((place << np.uint64(8)) + raw + _MIX[0])
    byte[~inside] = 0
    return _mixed(np.add.reduceat(byte, starts) + (ends - starts).astype(np.uint64))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a text, A-Z lowered; a shorter text is one."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if len(words) == 0:
        return words
    size = min(n, len(words))
    mixed = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        mixed = _mixed(mixed * _MIX[0] + words[k : len(words) - size + 1 + k])
    return np.unique(mixed)


def _packed(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, which tell n-grams apart from here on."""
    return np.ascontiguousarray((hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    """The hashes with their lower 16 bits 0, so that they can be packed again."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH buckets of hashes whether it holds an odd number of them, as bits.

    Buckets that differ between two sets each hold a shingle that only one of them has.
    """
    odd = np.bincount((_mixed(hashes.view(np.uint64)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _set_id(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    if not len(hashes):
        return 0, 0
    one = int(np.add.reduce(_mixed(hashes + _MIX[0])))
    two = int(np.add.reduce(_mixed(hashes ^ _MIX[1])))
    return one - (1 << 63), (two ^ len(hashes)) - (1 << 63)


def shingle_sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and the two halves of the set's name; the empty set has n_shingles 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, ones, twos = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, n)
                one, two = _set_id(own)
                sizes.append(len(own))
                ones.append(one)
                twos.append(two)
            arrays = [batch.column("doc_id"), *(pa.array(a, pa.int64()) for a in (sizes, ones, twos))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "one", "two"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, one long, two long"
    )


def _narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    top = int(numbers.max(initial=0))
    return numbers.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``_narrow`` packed."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if data else np.zeros(0, np.int64)


_BLOCK = "part int, names binary, sizes binary, counts binary, hashes binary, df binary"


def _block(part: int, names: np.ndarray, sizes: np.ndarray, counts: np.ndarray, hashes: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    """One row: sets by name, their sizes, how many hashes each has here, and the hashes and counts in that order."""
    columns = [names.tobytes(), _narrow(sizes), _narrow(counts), _packed(hashes), _narrow(df)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)],
        ["part", "names", "sizes", "counts", "hashes", "df"],
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks of each part as one: names and sizes of its distinct sets, owner (a set's place), hash and count."""

    def whole(rows: list) -> tuple[np.ndarray, ...]:
        names = [np.frombuffer(r[0], np.int64).reshape(-1, 2) for r in rows]
        sizes = np.concatenate([_wide(r[1], len(m)) for r, m in zip(rows, names)])
        counts = np.concatenate([_wide(r[2], len(m)) for r, m in zip(rows, names)])
        hashes = np.concatenate([_unpacked(r[3]) for r in rows])
        df = np.concatenate([_wide(r[4], len(r[3]) // 6) for r in rows])
        _, first, number = np.unique(names := np.concatenate(names), axis=0, return_index=True, return_inverse=True)
        return names[first], sizes[first], np.repeat(number.reshape(-1), counts), hashes, df

    part, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "names", "sizes", "counts", "hashes", "df"))):
            if row[0] != part and rows:
                yield whole(rows)
                rows = []
            part = row[0]
            rows.append(row[1:])
    if rows:
        yield whole(rows)


def shared_shingles(docs: DataFrame, n: int = WORDS, parts: int = 8) -> DataFrame:
    """The shingles of each distinct set that some other set holds too, with ``df``, in how many distinct
    sets each occurs, as blocks (``_block``) dealt out by the sets' names to ``parts`` parts.

    Sets are named, not numbered, so equal texts are one set wherever they stand. A task gathers the
    sets of a block of texts, each set once, and hands each of ``parts`` parts of the hash range on as one
    packed row; a part is then sorted, shingles of one set fall out, and the others go back with their counts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, held = [], set(), 0

        def emit() -> Iterator[pa.RecordBatch]:
            if not sets:
                return
            sizes = np.array([len(s[1]) for s in sets])
            names = np.array([s[0] for s in sets], np.int64)
            hashes = np.concatenate([s[1] for s in sets])
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                mine = order[bounds[p] : bounds[p + 1]]
                if len(mine):
                    own, counts = np.unique(owner[mine], return_counts=True)
                    yield _block(p, names[own], sizes[own], counts, hashes[mine], np.zeros(0, np.int64))

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                own = shingles(text, n)
                name = _set_id(own)
                held += len(text or "")
                if len(own) and name not in seen:
                    seen.add(name)
                    sets.append((name, own))
                if held >= BLOCK_BYTES:
                    yield from emit()
                    sets, seen, held = [], set(), 0
        yield from emit()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, owner, hashes, _ in _gathered(batches):
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            # The same set from several blocks counts once.
            fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
            hashes, owner = hashes[fresh], owner[fresh]
            start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            df = np.diff(np.r_[start, len(hashes)])
            df = np.repeat(df, df)
            shared = df > 1
            hashes, owner, df = hashes[shared], owner[shared], df[shared]
            goes = (names[:, 0] % parts).astype(np.int32)
            order = np.lexsort((owner, goes[owner]))
            hashes, owner, df = hashes[order], owner[order], df[order]
            bounds = np.searchsorted(goes[owner], np.arange(parts + 1))
            for p in range(parts):
                mine = slice(bounds[p], bounds[p + 1])
                if bounds[p] < bounds[p + 1]:
                    own, counts = np.unique(owner[mine], return_counts=True)
                    yield _block(p, names[own], sizes[own], counts, hashes[mine], df[mine])

    packed = docs.select("text").mapInArrow(pack, _BLOCK)
    counted = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, _BLOCK)
    return counted.repartition(parts, "part").sortWithinPartitions("part")


def _sets_of(shared: DataFrame, percent: int) -> DataFrame:
    """One row per set that can reach ``percent`` with another: one, two, n, shared hashes rare-first
    and their parities.

    A set's shingles stand by (df, hash); those in no other set come first and can match nothing. With
    m of n shingles shared, m of n must reach ``percent``, else the set is similar to none.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, owner, hashes, df in _gathered(batches):
            held = np.bincount(owner, minlength=len(names))
            able = held * 100 >= sizes * percent
            keep = able[owner]
            hashes, owner, df = hashes[keep], owner[keep], df[keep]
            order = np.lexsort((hashes, df, owner))
            hashes = hashes[order].view(np.int64)
            own = np.flatnonzero(able)
            bounds = np.r_[0, np.cumsum(held[own])]
            for at in range(0, len(own), 1000):
                mine, cuts = own[at : at + 1000], bounds[at : at + 1001]
                sketch = [parities(hashes[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
                arrays = [pa.array(names[mine, 0]), pa.array(names[mine, 1]), pa.array(sizes[mine].astype(np.int32))]
                lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(hashes[cuts[0] : cuts[-1]]))
                arrays += [lists, pa.array(sketch, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["one", "two", "n", "hashes", "sketch"])

    return shared.mapInArrow(merge, "one long, two long, n int, hashes array<long>, sketch array<long>")


def _prefix(percent: int):
    """A set's rare-first prefix, without the shingles no other set has."""
    need = F.ceil(F.col("n") * percent / 100)
    length = F.col("n") - need + 1 - (F.col("n") - F.size("hashes"))
    return F.slice("hashes", 1, length.cast("int"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(one, two, n, m, at, hash): the shingles of each set's prefix by place."""
    return sets.select("one", "two", "n", F.size("hashes").alias("m"), F.posexplode(_prefix(percent)).alias("at", "hash"))


def _with_before(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of prefix shingles with their sets' sketches and ``before``: the last ``BEFORE`` shingles of the prefix that
    come before the row's. They are put on where they are compared, as they are far wider than a row without them."""
    first = F.greatest(F.col("at") - BEFORE, F.lit(0))
    joined = rows.join(sets.select("one", "two", "sketch", _prefix(percent).alias("prefix")), ["one", "two"])
    return joined.withColumn("before", F.slice("prefix", first + 1, F.col("at") - first)).drop("prefix")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a1, a2, b1, b2) with the exact similarity: ``both`` shared shingles and the two sizes."""
    left = sets.select(F.col("one").alias("a1"), F.col("two").alias("a2"), F.col("n").alias("an"), F.col("hashes").alias("ah"))
    right = sets.select(F.col("one").alias("b1"), F.col("two").alias("b2"), F.col("n").alias("bn"), F.col("hashes").alias("bh"))
    joined = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            both = []
            for a, b in zip(batch.column("ah"), batch.column("bh")):
                x = a.values.to_numpy(zero_copy_only=False)
                y = b.values.to_numpy(zero_copy_only=False)
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
            keep = [batch.column(c) for c in ("a1", "a2", "b1", "b2", "an", "bn")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(both, pa.int64())], ["a1", "a2", "b1", "b2", "an", "bn", "both"]
            )

    return joined.select("a1", "a2", "b1", "b2", "an", "bn", "ah", "bh").mapInArrow(
        overlap, "a1 long, a2 long, b1 long, b2 long, an int, bn int, both long"
    )


_LINKED = "100 * both >= {p} * (an + bn - both)"
_PAIR = ["a1", "a2", "b1", "b2"]


def _may_link(percent: int):
    """Length, positional and suffix filters for two sets that share a prefix shingle, as a condition.

    Length: sizes apart by more than ``percent`` cannot be similar. Positional: at the shared shingle
    the rest of both lists must still reach the overlap that is needed. Suffix: neither may the shingles
    that the sets share with others at all be too few.
    """
    need = F.ceil((F.col("an") + F.col("bn")) * percent / F.lit(100.0 + percent) - 1e-9)
    return (
        (F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent)
        & (F.least(F.col("am") - F.col("a_at"), F.col("bm") - F.col("b_at")) + F.least("a_at", "b_at") >= need)
        & (F.least("am", "bm") >= need)
    )


def _not_too_far(percent: int):
    """The suffix filter in full: shingles in no other set, and buckets of the rest whose parities differ,
    are shingles that only one of the sets has; their number may not exceed what similarity allows."""
    need = F.ceil((F.col("an") + F.col("bn")) * percent / F.lit(100.0 + percent) - 1e-9)
    apart = sum((F.bit_count(F.get("a_sketch", F.lit(k)).bitwiseXOR(F.get("b_sketch", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    alone = F.col("an") - F.col("am") + F.col("bn") - F.col("bm")
    return alone + apart <= F.col("an") + F.col("bn") - 2 * need


def _side(prefixes: DataFrame, side: str) -> DataFrame:
    names = {"one": f"{side}1", "two": f"{side}2", "n": f"{side}n", "m": f"{side}m", "at": f"{side}_at"}
    more = {c: f"{side}_{c}" for c in ("far", "sketch", "before")} | {"g1": f"{side}g1", "g2": f"{side}g2"}
    return prefixes.select("hash", *[F.col(k).alias(v) for k, v in (names | more).items() if k in prefixes.columns])


def set_groups(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(one, two, g1, g2): each distinct set that is linked with another, and the group that links make of it.

    1. Each prefix shingle's smallest set is its head. A set is verified with the head most of its
       shingles have: one pair per set, whatever the size of a group. Sets so linked are groups.
    2. Then with its other heads, as far as they are of other groups.
    3. Then all pairs of sets of different groups that share a prefix shingle. If distances d and e to
       the shingle's head are known and differ by more than the distance allowed, the pair is dropped:
       distances obey the triangle inequality. So it is if the sets' parity sketches are too far apart,
       and where the shingle is not the first that the pair shares. Each pair left is verified once.

    After each step groups are what further links join: links inside a group are not handed on.
    """
    sets = stored(_sets_of(shared, percent), "sets")
    prefixes = stored(_prefixes(sets, percent), "prefixes")
    heads = prefixes.groupBy("hash").agg(
        F.min(F.struct("n", "one", "two", "m", "at")).alias("h"), F.count(F.lit(1)).alias("c")
    )
    heads = cut_lineage(heads.where("c > 1").select("hash", "h.*"))
    star = _side(heads, "a").join(_side(prefixes, "b"), "hash").where(
        _may_link(percent) & ((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")))
    )
    star = cut_lineage(star.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("c")))
    nearest = star.groupBy("b1", "b2").agg(F.max(F.struct("c", "a1", "a2")).alias("h"))
    measured = cut_lineage(verify(nearest.select("h.a1", "h.a2", "b1", "b2"), sets, percent))
    links = measured.where(_LINKED.format(p=percent)).select(*_PAIR)

    groups = cut_lineage(_groups(links))
    others = _apart(star.select(*_PAIR).join(measured.select(*_PAIR), _PAIR, "left_anti"), groups)
    second = cut_lineage(verify(others, sets, percent))
    groups = cut_lineage(_merged(groups, second.where(_LINKED.format(p=percent)).select(*_PAIR)))
    measured = measured.unionByName(second)

    far = measured.select(
        F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("b1").alias("one"), F.col("b2").alias("two"),
        (1 - F.col("both") / (F.col("an") + F.col("bn") - F.col("both"))).alias("far"),
    )
    placed = prefixes.join(heads.select("hash", F.col("one").alias("h1"), F.col("two").alias("h2")), "hash")
    placed = placed.join(far, ["h1", "h2", "one", "two"], "left").join(groups, ["one", "two"], "left")
    is_head = (F.col("one") == F.col("h1")) & (F.col("two") == F.col("h2"))
    placed = stored(
        placed.select(
            "hash", "one", "two", "n", "m", "at", F.coalesce("g1", "one").alias("g1"), F.coalesce("g2", "two").alias("g2"),
            F.when(is_head, 0.0).otherwise(F.col("far")).alias("far"),
        ),
        "placed",
    )
    # Only shingles that still hold more than one group have anything left to compare.
    mixed = placed.groupBy("hash").agg(F.min(F.struct("g1", "g2")).alias("low"), F.max(F.struct("g1", "g2")).alias("high"))
    open_ = _with_before(placed.join(mixed.where("low <> high").select("hash"), "hash"), sets, percent)
    apart = F.coalesce(F.abs(F.col("a_far") - F.col("b_far")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    pairs = _side(open_, "a").join(_side(open_, "b"), "hash").where(
        (F.struct("an", "a1", "a2") < F.struct("bn", "b1", "b2"))
        & ((F.col("ag1") != F.col("bg1")) | (F.col("ag2") != F.col("bg2")))
        & ~F.arrays_overlap("a_before", "b_before")
        & _may_link(percent)
        & apart
        & _not_too_far(percent)
    )
    pairs = pairs.select(*_PAIR).distinct().join(measured.select(*_PAIR), _PAIR, "left_anti")
    more = verify(pairs, sets, percent).where(_LINKED.format(p=percent)).select(*_PAIR)
    return _merged(groups, more)


def _with_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs`` with ``ag`` and ``bg``, the names of their sets' groups; a set in none is its own."""
    for side in "ab":
        one, two = f"{side}1", f"{side}2"
        named = groups.select(F.col("one").alias(one), F.col("two").alias(two), F.struct(F.col("g1").alias("one"), F.col("g2").alias("two")).alias("g"))
        own = F.struct(F.col(one).alias("one"), F.col(two).alias("two"))
        pairs = pairs.join(named, [one, two], "left").withColumn(f"{side}g", F.coalesce("g", own)).drop("g")
    return pairs


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose sets are not of one group."""
    return _with_groups(pairs, groups).where("ag <> bg").select(*_PAIR)


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` joined by ``links`` between their sets, and by those of sets in none as yet.

    Links between the same two groups are one edge, so a group of very many near copies whose pairs all
    link makes no more edges than it has groups that met.
    """
    edges = cut_lineage(_with_groups(links, groups).select(F.col("ag").alias("a"), F.col("bg").alias("b")).distinct())
    found = components(edges).select(F.col("node.one").alias("g1"), F.col("node.two").alias("g2"), "component")
    old = groups.join(found, ["g1", "g2"], "left").select(
        "one", "two", F.coalesce("component.one", "g1").alias("g1"), F.coalesce("component.two", "g2").alias("g2")
    )
    fresh = found.join(groups.select(F.col("g1"), F.col("g2")), ["g1", "g2"], "left_anti")
    return old.unionByName(fresh.select(F.col("g1").alias("one"), F.col("g2").alias("two"), F.col("component.one").alias("g1"), F.col("component.two").alias("g2")))


def _groups(links: DataFrame) -> DataFrame:
    """(one, two, g1, g2): each linked set and its group's name."""
    a, b = F.struct(F.col("a1").alias("one"), F.col("a2").alias("two")), F.struct(F.col("b1").alias("one"), F.col("b2").alias("two"))
    found = components(links.select(a.alias("a"), b.alias("b")))
    return found.select("node.one", "node.two", F.col("component.one").alias("g1"), F.col("component.two").alias("g2"))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more are linked.
    NULL, empty and wordless texts have an empty set, n_shingles 0, and are linked with nothing. Equal
    sets are one set throughout, so a third of all rows may be copies. A NULL doc_id stays NULL in
    both columns and does not name a component; rows that share a doc_id share the smallest component
    of theirs. Only ``doc_id`` and ``text`` are read. No documents give no rows.
    """
    named = stored(shingle_sets(docs, n), "named")
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_SHINGLES))
    groups = set_groups(shared_shingles(docs, n, parts), percent)
    full = named.where("n_shingles > 0")
    heads = full.groupBy("one", "two").agg(F.min("doc_id").alias("first"))
    grouped = heads.join(groups, ["one", "two"], "left")
    least = grouped.where("g1 IS NOT NULL").groupBy("g1", "g2").agg(F.min("first").alias("least"))
    classes = grouped.join(least, ["g1", "g2"], "left").select("one", "two", F.coalesce("least", "first").alias("component"))
    joined = named.join(classes, ["one", "two"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    return joined.select("doc_id", "n_shingles", F.least(F.coalesce(own, "doc_id"), "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id, with all columns.

    Rows are told apart by a number of their own, so rows that share a doc_id or have none (NULL comes
    last in a group) are documents like others, and repeated rows leave one. Texts without a word are
    linked with nothing and stay. No documents give no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = stored(whole.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), n, percent)
    named = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", F.col("doc.doc_id").alias("id")), "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("first")
    kept = named.groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def links_sql(docs: str = "documents", n: int = WORDS, percent: int = PERCENT) -> str:
    """Recursive CTEs up to ``reach``: (doc_id, component_id) of the rows of ``docs``, by comparing all
    pairs that share an n-gram."""
    return f"""
 split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
 grams AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ')
   ELSE array_to_string(w[i:i + {n - 1}], ' ') END AS g
   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM split WHERE len(w) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b USING (g)
   WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
   WHERE 100 * c >= {percent} * (x.n + y.n - c)),
 walk(doc_id, via) AS (SELECT doc_id, doc_id FROM split UNION SELECT walk.doc_id, links.b FROM walk JOIN links ON via = links.a),
 reach AS (SELECT doc_id, min(via) AS component_id FROM walk GROUP BY doc_id)"""


QUERIES = {
    "op2_ngram_join": Query(
        op2,
        f"""WITH RECURSIVE {links_sql()} SELECT s.doc_id, coalesce(n, 0) AS n_shingles, component_id
 FROM split s LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.doc_id = s.doc_id""",
    )
}
