"""Hashed text features, and the training loop that the two classifiers share.

A feature is a slot among 2**20.  Words are what bytes between ASCII white space
are, in lower case and without marks.  A document's features are the distinct slots
of its words, word pairs, skip pairs (one word left out), and the heads of longer
words; each counts once, so a long text is not toxic or poor for its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._arrow import give_back, map_batches, project, slices, texts_of

BITS = 20
SLOTS = 1 << BITS
MARKS = b".,!?;:\"()"
HEADS = (5, 7)
_DOWN = np.uint64(64 - BITS)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0xBF58476D1CE4E5B9))

#: Bound on the labelled rows that are learned from.
SAMPLE_ROWS = 16_000
EPOCHS = 3


def _crc(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def slots(texts: list[bytes], extra: Callable[[bytes], list[bytes]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document number, slot) of all feature occurrences of many texts; ``extra`` names further features of a text."""
    words: list[bytes] = []
    counts = []
    for text in texts:
        own = text.lower().translate(None, MARKS).split()
        counts.append(len(own))
        words += own
    docs, found = [], []
    if words:
        of = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        h = _crc(words)
        docs.append(of)
        found.append(h * _A >> _DOWN)
        for gap, mix in ((1, _B), (2, _C)):
            same = of[gap:] == of[:-gap]
            docs.append(of[gap:][same])
            found.append(((h[:-gap] * _A + h[gap:]) * mix >> _DOWN)[same])
        for n in HEADS:
            long = [i for i, w in enumerate(words) if len(w) > n]
            docs.append(of[long])
            found.append(_crc([words[i][:n] for i in long]) * _D >> _DOWN)
    if extra:
        named = [extra(text) for text in texts]
        docs.append(np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in named]))
        found.append(_crc([x for own in named for x in own]) * _A >> _DOWN)
    if not docs:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(docs), np.concatenate(found).astype(np.int32)


def margins(texts: list[bytes], weights: np.ndarray, extra: Callable[[bytes], list[bytes]] | None = None) -> np.ndarray:
    """Sum of the weights of each text's distinct features."""
    docs, found = slots(texts, extra)
    hit = np.flatnonzero(weights[found])
    key = np.unique(docs[hit].astype(np.int64) << BITS | found[hit])
    return np.bincount(key >> BITS, weights[key & (SLOTS - 1)], len(texts))


class Ftrl:
    """FTRL-proximal state: per-coordinate rates, L1 sparsity."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(SLOTS), np.zeros(SLOTS)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def update(self, at: np.ndarray, w: np.ndarray, gradient: float) -> None:
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def labelled(docs: DataFrame, labels: DataFrame, grade: str, rows: int, extra: Callable[[bytes], list[bytes]] | None = None, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id") -> DataFrame:
    """(grade, slots, rank) of at most ``rows`` labelled documents, those whose id hashes lowest.

    Ids whose crc32 is a multiple of 5 are held out.  An id labelled more than once
    counts with its highest grade; null ids and grades do not count.  The sample is what is
    broadcast, so its bound is the bound of the broadcast; no text is shuffled.
    """
    keys = F.col(f"`{label_id}`").alias("key"), F.expr(grade).cast("int").alias("grade")
    own = labels.select(*keys).filter("key IS NOT NULL AND grade IS NOT NULL").filter(F.crc32(F.col("key").cast("string").cast("binary")) % 5 != 0)
    sample = own.groupBy("key").agg(F.max("grade").alias("grade")).withColumn("rank", F.xxhash64("key")).orderBy("rank", "key").limit(rows)
    joined = project(docs, key=doc_id, text=text).join(F.broadcast(sample), "key")

    def kernel(part: pa.RecordBatch) -> dict[str, object]:
        texts = texts_of(part.column("text"))
        own = [np.unique(slots([x], extra)[1]) for x in texts]
        return {"grade": part.column("grade"), "rank": part.column("rank"), "slots": pa.array(own, pa.list_(pa.int32()))}

    return map_batches(joined.select("grade", "rank", "text"), kernel, "grade int, rank long, slots array<int>")


class Learner:
    """What ``train`` carries from epoch to epoch: FTRL state and a few other numbers (``rest``)."""

    def __init__(self, model: Ftrl, rest: list[float]):
        self.model, self.rest = model, np.array(rest, np.float64)

    def visit(self, own: np.ndarray, grade: int) -> None:
        """Learn from one document: the slots of its features, and its grade."""
        raise NotImplementedError


def _order(epoch: int) -> list[Column]:
    return [F.xxhash64("rank", F.lit(epoch)), F.col("rank"), F.col("grade"), F.size("slots"), F.xxhash64("slots")]


def in_order(sample: DataFrame, epoch: int) -> DataFrame:
    """The written sample in one partition, in the seeded order of an epoch: one task reads it and sorts it, nothing is shuffled."""
    return sample.coalesce(1).sortWithinPartitions(*_order(epoch))


_STATE = "z binary, n binary, rest binary"


def train(sample: DataFrame, make: Callable[[dict[int, int]], Learner]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Slots and weights other than 0, and the other numbers, after EPOCHS passes over the bounded sample.

    ``make`` starts a learner from the rows of each grade; with fewer than two grades it is not trained.  An epoch is
    one task, as the rows depend on each other; it streams them, so a sample of very long documents takes
    time and no memory.  The state, 16 MB, is written by one epoch and read first by the next; only weights reach the driver.
    """
    sample = materialize(sample, "labelled")
    counts = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return np.empty(0, np.int64), np.empty(0), make(counts).rest.tolist()
    empty = [F.lit(None).cast("binary").alias(x) for x in ("z", "n", "rest")]
    rows = sample.select(F.lit(1).alias("kind"), "grade", "rank", "slots", *empty)
    state = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make(counts)
        for batch in batches:
            for kind, grade, slots, *held in zip(batch.column("kind").to_pylist(), batch.column("grade").to_pylist(), batch.column("slots"), *(batch.column(x) for x in ("z", "n", "rest")), strict=True):
                if kind:
                    own.visit(slots.values.to_numpy() if slots.is_valid else np.empty(0, np.int32), grade)
                else:
                    own.model.z, own.model.n, own.rest = (np.frombuffer(x.as_buffer(), np.float64).copy() for x in held)
        made = pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (own.model.z, own.model.n, own.rest)], ["z", "n", "rest"])
        del own
        give_back()
        yield made

    for epoch in range(EPOCHS):
        feed = rows
        if state is not None:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in sample.schema if f.name in ("grade", "rank", "slots")]
            feed = rows.unionByName(state.select(F.lit(0).alias("kind"), *none, "z", "n", "rest"))
        state = materialize(feed.coalesce(1).sortWithinPartitions("kind", *_order(epoch)).mapInArrow(run, _STATE), "training-state")

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in zip(*(batch.column(x) for x in ("z", "n", "rest")), strict=True):
                own = make(counts)
                own.model.z, own.model.n, rest = (np.frombuffer(x.as_buffer(), np.float64) for x in held)
                found = own.model.weights()
                at = np.flatnonzero(found)
                yield pa.record_batch([pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([found[at].tolist()], pa.list_(pa.float64())), pa.array([rest.tolist()], pa.list_(pa.float64()))], ["at", "weight", "rest"])
                del own, found

    last = state.mapInArrow(weights, "at array<long>, weight array<double>, rest array<double>").first()
    return np.array(last["at"], np.int64), np.array(last["weight"], np.float64), list(last["rest"])


def score(docs: DataFrame, at: np.ndarray, weight: np.ndarray, finish: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, extra: Callable[[bytes], list[bytes]] | None = None) -> DataFrame:
    """Score every whole text of (doc_id, text, ...) with broadcast weights: at most 2**20 of them, 12 MB."""
    held = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weight.astype(np.float64)))
    passed = [x for x in docs.columns if x != "text"]

    def run_with(part: pa.RecordBatch, dense: np.ndarray) -> dict[str, object]:
        return {k: part.column(k) for k in passed} | finish(margins(texts_of(part.column("text")), dense, extra))

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    arrow = to_arrow_schema(T._parse_datatype_string(f"{kinds}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(SLOTS)
        dense[held.value[0]] = held.value[1]
        for batch in batches:
            for part in slices(batch, "text"):
                made = run_with(part, dense)
                yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return docs.mapInArrow(run, f"{kinds}, {schema}")
