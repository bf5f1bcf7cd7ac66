"""Toxicity by a subsequence string kernel and a linear machine over Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, slices, table

#: Length of the subsequences that the kernel counts, and what each letter of their span weighs.
LENGTH = 4
DECAY = 0.8
#: The kernel of the machine is the string kernel to this power: whole matches stand out from part ones.
DEGREE = 2
#: A word with a smaller share of a landmark's letters in their order has nothing to do with it.
NEAR = 0.75
#: Words are compared with landmarks of up to 8, 16 and 24 letters in all windows of the lengths given: that
#: of the longest such landmark, and a wider one for insults with letters put between.
WINDOWS = {8: (8, 12), 16: (16, 24), 24: (24, 36)}
#: The bounded sample the machine is fitted on: labelled rows of each class, by the hash of their id.
SAMPLE = {1: 2000, 0: 3000}
#: Letter runs that may become landmarks, as well as whole words of up to the longest window's landmark.
RUNS = (4, 5, 6, 7, 8)
BACKGROUND = 12
#: A run is a landmark if so large a share of the documents with it are toxic, if chance explains its count with odds of less than exp(-SURPRISE) among all runs
#: seen, and if no more than SHARED of its toxic documents have an earlier landmark's run as well. Words on
#: one stem are landmarks of their own where their endings mark different documents.
PRECISION = 0.9
SURPRISE = 3.0
SHARED = 0.9
#: Sentences per document that stand for it in training, those nearest to a landmark.
SENTENCES = 8
#: A sentence of a toxic document is toxic if its kernel with a landmark reaches this share of the
#: landmark's kernel with itself; its other sentences are not used, as nobody has labelled them.
TOXIC_FROM = 0.5
HELD_OUT_OF = 5
#: A worker forgets the words it has scored after so many.
REMEMBERED = 400_000

_SIGNS = str.maketrans("013457@$", "oieastas")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?:(?<=\s)|^)\w(?:\s\w){3,}(?=\s|$)")
_SENTENCE = re.compile(r"[^.!?\n]+")


def letters(token: str) -> str:
    """The letters of a token in lower case; signs that stand for letters are read as those.

    ``1d-i.o_t`` gives ``idiot``. Digits and signs at the ends of a word with letters are dropped
    together with all other signs.
    """
    if token.isalpha():
        return token
    core = token.strip("!?.,;:'\"()[]{}<>*#&%-_+=~`/\\|")
    if any(c.isalpha() for c in core):
        core = core.translate(_SIGNS)
    return _NOT_LETTERS.sub("", core)


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text in lower case, and words spelled with spaces joined to one, also without
    their first and last letter, which may be words of their own."""
    low = text.lower()
    found = set(low.split())
    for m in _SPACED.finditer(low):
        word = "".join(m[0].split())
        found.update((word, word[1:], word[:-1]))
    return found


# ---- the kernel


def as_codes(words: list[str], width: int) -> np.ndarray:
    """One row of code points per word, filled up with 0."""
    joined = "".join(w[:width].ljust(width, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def kernel(landmark: str | None, codes: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Sum over common subsequences of ``length`` letters of decay to the power of both spans, of the
    landmark and each row, or of each row and itself.

    The usual recursion: ``tails[i]`` holds for each place what the landmark read so far offers as the
    first i letters of a subsequence, with its span counted up to the end of both strings.
    """
    n, width = codes.shape
    apart = np.arange(width)[None, :] - np.arange(width)[:, None]
    fading = np.where(apart >= 0, decay ** np.maximum(apart, 0), 0.0)
    tails = np.zeros((length, n, width + 1))
    tails[0] = 1.0
    total = np.zeros(n)
    letters_ = [ord(c) for c in landmark] if landmark is not None else [codes[:, j, None] for j in range(width)]
    for letter in letters_:
        same = (codes == letter) & (codes != 0)
        total += ((tails[length - 1][:, :-1] * same).sum(axis=1)) * decay * decay
        for i in range(length - 1, 0, -1):
            run = (same * tails[i - 1][:, :-1]) @ fading
            tails[i][:, 1:] = decay * tails[i][:, 1:] + decay * decay * run
    return total


def common_letters(landmarks: list[str], codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row and each landmark, by bit vectors.

    The kernel counts as 0 where it is below ``NEAR`` of the landmark (it is 0 below ``LENGTH``), so
    only the other cells are worked out.
    """
    alphabet = sorted({ord(c) for m in landmarks for c in m})
    place = np.zeros(0x110000, np.uint8)
    place[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint8)
    masks = np.zeros((len(alphabet) + 1, len(landmarks)), np.uint32)
    for k, m in enumerate(landmarks):
        for at, c in enumerate(m):
            masks[place[ord(c)], k] |= 1 << at
    full = np.array([(1 << len(m)) - 1 for m in landmarks], np.uint32)
    state = np.repeat(full[None, :], len(codes), axis=0)
    known = place[codes]
    for j in range(codes.shape[1]):
        hit = state & masks[known[:, j]]
        state = ((state + hit) | (state - hit)) & full
    return np.bitwise_count(~state & full)


@dataclass(frozen=True)
class Machine:
    """Landmarks, the map from kernels to their feature space folded into ``weights``, and the scale."""

    landmarks: tuple[str, ...]
    norms: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def similarities(words: list[str], landmarks: tuple[str, ...], norms: np.ndarray) -> np.ndarray:
    """Cosine of each word and each landmark in the string kernel's space, to the power of ``DEGREE``; a
    word that repeats a landmark's pieces is not nearer for it. The best of a long word's windows counts.
    Words are marked at both ends, as landmarks that stand at a word's end are."""
    words = [f"^{w}$" for w in words]
    out = np.zeros((len(words), len(landmarks)))
    least = np.array([max(LENGTH, np.ceil(NEAR * len(m))) for m in landmarks])
    near = _letters_held(words, landmarks) >= least
    for longest, widths in WINDOWS.items():
        mine = [k for k, m in enumerate(landmarks) if _longest(m) == longest]
        if not mine:
            continue
        pieces, owner = [], []
        for i in np.flatnonzero(near[:, mine].any(axis=1)).tolist():
            w = words[i]
            for width in widths[: 1 if len(w) <= widths[0] else 2]:
                last = max(len(w) - width, 0)
                pieces += [w[at : at + width] for at in range(last + 1)]
                owner += [i] * (last + 1)
        owner = np.array(owner, np.int64)
        for at in range(0, len(pieces), 50_000):
            codes, own = as_codes(pieces[at : at + 50_000], max(widths)), owner[at : at + 50_000]
            cells = {}
            for k in mine:
                rows = np.flatnonzero(near[own, k])
                cells[k] = rows[common_letters([landmarks[k]], codes[rows])[:, 0] >= least[k]]
            size = np.ones(len(codes))
            some = np.unique(np.concatenate(list(cells.values())))
            if len(some):
                size[some] = np.sqrt(np.maximum(kernel(None, codes[some]), 1e-12))
            for k, rows in cells.items():
                if len(rows):
                    found = kernel(landmarks[k], codes[rows]) / norms[k] / size[rows]
                    np.maximum.at(out[:, k], own[rows], found**DEGREE)
    return out


def _longest(landmark: str) -> int:
    """The class of WINDOWS that a landmark is in."""
    return next(n for n in WINDOWS if len(landmark) <= n)


def _letters_held(words: list[str], landmarks: tuple[str, ...]) -> np.ndarray:
    """How many of each landmark's letters each word has somewhere: at least as many as any window has in order."""
    alphabet = sorted({ord(c) for m in landmarks for c in m})
    place = np.zeros(0x110000, np.int32)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    counts = np.zeros((len(alphabet) + 1, len(landmarks)), np.float32)
    for k, m in enumerate(landmarks):
        for c in m:
            counts[place[ord(c)], k] += 1
    has = np.zeros((len(words), len(alphabet) + 1), np.float32)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    has[np.repeat(np.arange(len(words)), [len(w) for w in words]), place[codes]] = 1
    return has @ counts


def margins(words: list[str], machine: Machine) -> np.ndarray:
    return similarities(words, machine.landmarks, machine.norms) @ machine.weights + machine.bias


# ---- fitting on the bounded sample


def sample(docs: DataFrame, labels: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """text and toxic of at most ``sizes`` labelled documents per class, none of them held out.

    Labels are drawn by the hash of their doc_id; they are so few that they are sent to the documents.
    Rows without a label or doc_id are left out; of several labels of a document the largest counts.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = [
        one.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in sizes.items()
    ]
    both = drawn[0].unionAll(drawn[1])
    return docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").select("text", "toxic")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0


def _runs(text: str) -> set[str]:
    found: set[str] = set()
    for word in {letters(t) for t in tokens(text)}:
        marked = f"^{word}$"
        for n in RUNS:
            found.update(marked[i : i + n] for i in range(len(marked) - n + 1))
        if RUNS[-1] < len(marked) <= max(WINDOWS):
            found.add(marked)
    return found


def choose_landmarks(drawn: DataFrame) -> list[str]:
    """Letter runs that mark toxic documents, by how far their counts are from chance.

    Runs are counted over the sample by a grouped aggregate; those that qualify are listed per toxic
    document, and of runs that mark the same documents (pieces of one insult) one is chosen, on that
    list. Nothing but the sample bounds how many qualify and how many are chosen.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                runs = pa.array(sorted(_runs(text or "")), pa.string())
                yield pa.RecordBatch.from_arrays([runs, pa.array([toxic] * len(runs), pa.int32())], ["run", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    share = sizes[1] / (sizes[0] + sizes[1])
    counts = drawn.mapInArrow(spread, "run string, toxic int").groupBy("run").agg(
        F.sum("toxic").cast("double").alias("hits"), F.sum(1 - F.col("toxic")).cast("double").alias("misses")
    )
    every = F.col("hits") + F.col("misses")
    surprise = F.col("hits") * F.log(F.col("hits") / (every * share)) + F.when(
        F.col("misses") > 0, F.col("misses") * F.log(F.col("misses") / (every * (1 - share)))
    ).otherwise(0.0)
    ranked = counts.where("hits >= 2").where(F.col("hits") >= every * PRECISION).withColumn("surprise", surprise)
    total = F.lit(counts.count())
    best = [
        r["run"]
        for r in ranked.where(F.col("surprise") > F.log(total) + SURPRISE)
        .orderBy(F.round("surprise", 6).desc(), F.length("run").desc(), "run")
        .collect()
    ]
    places = {run: i for i, run in enumerate(best)}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            has = [sorted(places[r] for r in _runs(t or "") if r in places) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int32()))], ["has"])

    held = drawn.where("toxic = 1").select("text").mapInArrow(listed, "has array<int>").collect()
    marked: list[set[int]] = [set() for _ in best]
    for i, r in enumerate(held):
        for k in r["has"]:
            marked[k].add(i)
    chosen: list[int] = []
    for k in range(len(best)):
        if all(len(marked[k] & marked[c]) <= SHARED * len(marked[k]) for c in chosen):
            chosen.append(k)
    return [best[k] for k in chosen]


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss: Newton steps over the rows inside the margin."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    ridge = np.eye(design.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        inside = y * (design @ w) < 1
        a = design[inside] * weight[inside, None]
        step = np.linalg.solve(ridge + 2 * cost * a.T @ design[inside], 2 * cost * a.T @ y[inside])
        if np.allclose(step, w, atol=1e-9):
            break
        w = step
    return w[:-1], float(w[-1])


def fit_scale(margin: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that turn margins of documents to probabilities, by Newton's method."""
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    design = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - target) + 1e-6 * w
        w = w - np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] | None = None) -> Machine | None:
    """The machine, fitted on sentences of the sample, each seen as its word nearest to a landmark.

    Sentences of clean documents are clean, those of toxic ones toxic if they come near a landmark.
    None if a class has no labelled document or nothing marks the toxic ones.
    """
    drawn = sample(docs, labels, sizes or SAMPLE)
    hostile = choose_landmarks(drawn)
    if not hostile:
        return None
    landmarks = tuple(hostile + _usual_words(drawn, hostile))
    norms = np.array([np.sqrt(kernel(m, as_codes([m], len(m)))[0]) for m in landmarks])

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            vectors = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [[{letters(t) for t in tokens(p)} for p in _SENTENCE.findall(text)] for text in texts]
            words = sorted(set().union(*(words for part in parts for words in part)))
            near = similarities(words, landmarks, norms).astype(np.float32)
            strength = near[:, : len(hostile)].max(axis=1, initial=0.0).tolist()
            place = {w: i for i, w in enumerate(words)}
            for part in parts:
                tops = {max((place[w] for w in own), key=strength.__getitem__) for own in part if own}
                tops = sorted(tops, key=strength.__getitem__, reverse=True)[:SENTENCES]
                vectors.append(near[tops].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(vectors, pa.binary())], ["toxic", "near"])

    rows = [r for r in drawn.mapInArrow(sentences, "toxic int, near binary").collect() if r["near"]]
    each = [np.frombuffer(r["near"], np.float32).reshape(-1, len(landmarks)) for r in rows]
    near = np.concatenate(each).astype(np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(e) for e in each])
    toxic = np.array([r["toxic"] for r in rows]) == 1
    # Nyström: features are the kernels times the inverse root of the landmarks' own kernels.
    own = np.stack([kernel(m, as_codes(list(landmarks), max(WINDOWS))) / norms[i] / norms for i, m in enumerate(landmarks)])
    values, vectors = np.linalg.eigh(((own + own.T) / 2) ** DEGREE)
    x = near @ (root := vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T)
    close = near[:, : len(hostile)].max(axis=1) >= TOXIC_FROM
    used = ~toxic[doc] | close
    y = np.where(toxic[doc], 1.0, -1.0)[used]
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w, bias = fit_line(x[used], y, weight)
    found = x @ w + bias
    most = np.full(len(rows), -np.inf)
    np.maximum.at(most, doc, found)
    slope, shift = fit_scale(most, toxic)
    return Machine(landmarks, norms, root @ w, bias, slope, shift)


def _usual_words(drawn: DataFrame, hostile: list[str]) -> list[str]:
    """Common words of clean documents as further landmarks, so that the machine knows them as well."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            words = [
                w for t in batch.column("text").to_pylist() for w in {letters(t) for t in tokens(t or "")}
                if LENGTH <= len(w) <= RUNS[-1]
            ]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    counts = drawn.where("toxic = 0").select("text").mapInArrow(spread, "word string").groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(BACKGROUND).collect()
    return [r["word"] for r in top if r["word"] not in hostile]


# ---- scoring


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every row of ``docs``: that of the word with the largest margin.

    Only ``text`` is read. A text without words, and NULL, has the score of a word that shares nothing
    with a landmark; without a machine all scores are 0. No shuffle; a worker keeps the words it knows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        least = machine.bias if machine else 0.0
        for batch in slices(batches, 1024):
            texts = batch.column("text").to_pylist()
            if machine is None:
                scores = np.zeros(len(texts))
            else:
                each = [tokens(t) if t else set() for t in texts]
                new = list(set().union(*each) - known.keys())
                plain: dict[str, list[str]] = {}
                for t in new:
                    plain.setdefault(letters(t), []).append(t)
                for word, margin in zip(plain, margins(list(plain), machine).tolist()):
                    for t in plain[word]:
                        known[t] = margin
                best = np.array([max(map(known.__getitem__, e), default=least) for e in each])
                scores = 1 / (1 + np.exp(-np.clip(machine.slope * best + machine.shift, -30, 30)))
                if len(known) > REMEMBERED:
                    known = {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op6_toxicity": Query(op6)}
