"""Line dedup: repeated long lines stay only in the document with the largest id.

The key of a line is the line without ASCII white space at both ends, A-Z in lower
case.  Keys of at least ``least_chars`` code points that ``least_docs`` documents hold lose all
their lines except in the largest doc_id that holds them.

1. Every task marks its documents' keys in two Bloom filters: seen once, seen
   twice.  Filters are cut into segments and merged segment by segment (what two
   tasks have seen once each has been seen twice), so no task holds more than one merged
   segment.  Marked bits travel as positions, not as whole filters.
2. Only keys that the twice-seen filter holds are suspected; each task sends one
   row per suspected key (digest, documents, largest id), the exact counts are
   summed, and those that reach ``least_docs`` are the repeated keys.
3. Documents drop lines of repeated keys whose largest id is not theirs.

Each filter of a pair has ``bits_per_line`` bits for each long line, and never more than ``filter_bytes``, which
bounds the broadcast and what a task holds.  Where more are wanted, the keys are cut by their digests
into as many ranges, each with a pair of filters and a pass of its own; keys are then made from the texts once and written
(24 bytes a line, in order of ranges within a file, so that a pass reads its own pages), without a shuffle.  A cluster
sets ``filter_bytes`` by its executors' memory: 2 GB hold some 1 billion lines a pass.

The repeated keys are broadcast up to ``broadcast_bytes``; beyond that, lines are joined with them by digest, hot
digests salted, and documents get their dropped digests by a join on the document.

A digest has 128 bits (two keys share one by chance with probability 2**-128).

Defined results
* null or empty text: one empty line, nothing dropped, ``kept`` text ''.
* null doc_id: below every other id, so its lines are dropped where another holds them.
* repeated rows, rows with equal ids: each row is a document of its own; all rows with
  the largest id keep a line (ties).
* very long texts and lines: whole.  A key repeated within one document counts once.
* other columns: passed through by ``dedup_lines``; one named like an output column
  (n_lines, n_dropped) is replaced.  Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from ._arrow import SPACE, project, slices, texts_of

PROBES = 4
SEGMENT_BITS = 1 << 19  # 64 kB
NULL_ID = -(1 << 63)


def line_keys(text: bytes, least_chars: int) -> list[bytes | None]:
    """The key of each line; null where it is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        n = len(key)
        if n < least_chars or n < 4 * least_chars and len(key.decode()) < least_chars:
            out.append(None)
        else:
            out.append(key)
    return out


def _probes(low: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each 64-bit hash, all in one segment of the filter."""
    low = low.astype(np.uint64)
    segment = (low >> np.uint64(32)) % np.uint64(bits // SEGMENT_BITS)
    a, b = low & np.uint64(0xFFFFFFFF), (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) | np.uint64(1)
    inside = (a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(SEGMENT_BITS)
    return (segment[:, None] * np.uint64(SEGMENT_BITS) + inside).astype(np.int64)


def _mark(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


class Filters:
    """A pair of packed Bloom filters of equal size: keys seen once, keys seen twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Add the distinct keys of documents; a hash that comes twice has been seen twice."""
        if not len(hashes):
            return
        own, counts = np.unique(hashes, return_counts=True)
        at = _probes(own, self.bits)
        again = (counts > 1) | holds(self.once, own, self.bits)
        _mark(self.twice, at[again].ravel())
        _mark(self.once, at.ravel())


def holds(twice: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes a packed filter holds."""
    at = _probes(hashes, bits)
    return ((twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _digests(texts: list[bytes], least_chars: int) -> Iterator[tuple[int, set[bytes]]]:
    """(place of the document, digests of its distinct keys)."""
    digest = xxhash.xxh3_128_digest
    for i, text in enumerate(texts):
        yield i, {digest(k) for k in line_keys(text, least_chars) if k is not None}


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of digests: one chooses the range, the other goes into the filters."""
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _keys_of(batch: pa.RecordBatch, least_chars: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(documents, digests) of a batch of texts, or of written keys."""
    if "digest" in batch.schema.names:
        yield batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
        return
    for part in slices(batch, "text"):
        ids = [NULL_ID if x is None else x for x in part.column("doc_id").to_pylist()]
        found = [(ids[i], d) for i, own in _digests(texts_of(part.column("text")), least_chars) for d in own]
        yield [x for x, _ in found], [d for _, d in found]


def _written_keys(docs: DataFrame, passes: int, least_chars: int) -> DataFrame:
    """(pass, doc_id, digest) of every long line's key, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, digests in _keys_of(batch, least_chars):
                of = (_halves(digests)[0] % np.uint64(passes)).astype(np.int32)
                yield pa.record_batch([pa.array(of), pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["pass", "doc_id", "digest"])

    return materialize(docs.mapInArrow(run, "pass int, doc_id long, digest binary").sortWithinPartitions("pass"), "line-keys")


def twice_filter(keys: DataFrame, bits: int, least_chars: int) -> np.ndarray:
    """The merged twice-seen filter, packed; ``bits`` bounds what reaches the driver (bits / 8 bytes).  keys: (doc_id, text) or (doc_id, digest)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filters(bits)
        for batch in batches:
            for _, digests in _keys_of(batch, least_chars):
                held.add(_halves(digests)[1])
        for kind, marked in ((1, held.once), (2, held.twice)):
            for s in range(bits // SEGMENT_BITS):
                own = np.flatnonzero(np.unpackbits(marked[s * SEGMENT_BITS >> 3 : (s + 1) * SEGMENT_BITS >> 3], bitorder="little"))
                if not len(own):
                    continue
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([kind], pa.int32()), pa.array([_pack(own)], pa.binary())], ["segment", "kind", "marks"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for batch in batches:
            for s, kind, marks in zip(*(batch.column(k).to_pylist() for k in ("segment", "kind", "marks")), strict=True):
                if s != now:
                    if now is not None:
                        yield _segment(now, twice)
                    now, once, twice = s, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                own = _unpack(marks)
                if kind == 1:
                    twice[own[once[own]]] = True
                    once[own] = True
                else:
                    twice[own] = True
        if now is not None:
            yield _segment(now, twice)

    marked = keys.mapInArrow(mark, "segment int, kind int, marks binary")
    merged = marked.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for row in merged.collect():
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _pack(at: np.ndarray) -> bytes:
    """Positions in a segment: as they are while few, as a bitmap otherwise."""
    if len(at) * 32 < SEGMENT_BITS:
        return b"p" + at.astype(np.int32).tobytes()
    marked = np.zeros(SEGMENT_BITS, bool)
    marked[at] = True
    return b"b" + np.packbits(marked, bitorder="little").tobytes()


def _unpack(marks: bytes) -> np.ndarray:
    if marks[:1] == b"p":
        return np.frombuffer(marks, np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8, offset=1), bitorder="little"))


def _segment(s: int, twice: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])


def repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, filter_bytes: int = 64 << 20, bits_per_line: int = 16) -> DataFrame:
    """(digest, largest), written: repeated keys and the largest id that holds each.  docs: (doc_id, text)."""
    # an upper bound of the long lines, counted in the JVM: lines, and no more than bytes allow
    long_lines = docs.agg(F.sum(F.least(F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(1)), F.ceil(F.octet_length("text") / (least_chars + 1)) + 1))).first()[0] or 0
    wanted, most = math.ceil(long_lines * bits_per_line / SEGMENT_BITS), max(filter_bytes * 8 // SEGMENT_BITS, 1)
    passes = max(1, math.ceil(wanted / most))
    bits = max(1, math.ceil(wanted / passes)) * SEGMENT_BITS
    if passes == 1:
        return materialize(_repeated(docs, bits, least_chars, least_docs), "repeated-lines")
    keys = _written_keys(docs, passes, least_chars)
    found = [materialize(_repeated(keys.filter(F.col("pass") == k).select("doc_id", "digest"), bits, least_chars, least_docs), "repeated-lines") for k in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _repeated(keys: DataFrame, bits: int, least_chars: int, least_docs: int) -> DataFrame:
    """One pass: filters, suspects, exact counts."""
    held = keys.sparkSession.sparkContext.broadcast(twice_filter(keys, bits, least_chars))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per suspected key and task (or per million keys): documents that hold it, largest id."""
        found: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], ["digest", "n", "largest"])
            found.clear()
            return rows

        for batch in batches:
            for ids, digests in _keys_of(batch, least_chars):
                for i in np.flatnonzero(holds(held.value, _halves(digests)[1], bits)).tolist() if digests else ():
                    own = found.get(digests[i])
                    if own is None:
                        found[digests[i]] = [1, ids[i]]
                    else:
                        own[0] += 1
                        own[1] = max(own[1], ids[i])
                if len(found) > 1_000_000:
                    yield flush()
        yield flush()

    rows = keys.mapInArrow(suspect, "digest binary, n long, largest long")
    counted = rows.groupBy("digest").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
    return counted.filter(F.col("n") >= least_docs).select("digest", "largest")


def _drop(schema: T.StructType, text: str, least_chars: int, of_batch):
    """Kernel that gives the user's rows with their text rewritten; ``of_batch`` gives, per row, a function from digest to whether it goes."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kept, n_lines, n_dropped = [], [], []
                for own, goes in zip(texts_of(part.column("text")), of_batch(part), strict=True):
                    lines = own.split(b"\n")
                    stay = [x for x, k in zip(lines, line_keys(own, least_chars), strict=True) if k is None or not goes(xxhash.xxh3_128_digest(k))]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(own if len(stay) == len(lines) else b"\n".join(stay))
                row, names = part.column("row"), [f.name for f in part.column("row").type]
                made = {text: pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else row.field(names.index(f.name)) for f in arrow], schema=arrow)

    return run


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5, filter_bytes: int = 64 << 20, broadcast_bytes: int = 16 << 20, bits_per_line: int = 16) -> DataFrame:
    """The documents with their kept text, and ``n_lines`` and ``n_dropped`` (in place of columns of these names); other columns pass through."""
    spark = docs.sparkSession
    base = project(docs, doc_id=doc_id, text=text)
    repeated = repeated_lines(base, least_chars, least_docs, filter_bytes, bits_per_line)
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    out = T.StructType([*(T.StructField(text, T.StringType()) if f.name == text else f for f in docs.schema if f.name not in ("n_lines", "n_dropped")), *counts])
    # the user's row is one struct, so that none of its columns meets one of ours; its text travels beside it
    rest = [F.col(f"`{f.name}`") for f in out if f.name != text and f not in counts]
    keyed = docs.select(F.struct(*(rest or [F.lit(0).alias("none")])).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("key"))
    if repeated.count() * 24 <= broadcast_bytes:
        # 24 bytes a key, at most broadcast_bytes; about 130 a key once it is a table in a worker
        table = spark.sparkContext.broadcast({bytes(r["digest"]): r["largest"] for r in repeated.toLocalIterator()})

        def by_table(part: pa.RecordBatch):
            largest = table.value
            for key in part.column("key").to_pylist():
                own = NULL_ID if key is None else key
                yield lambda digest, own=own: largest.get(digest, own) != own

        return keyed.mapInArrow(_drop(out, text, least_chars, by_table), out)
    return _drop_joined(keyed, repeated, out, text, least_chars)


def _drop_joined(keyed: DataFrame, repeated: DataFrame, out: T.StructType, text: str, least_chars: int, salts: int = 32) -> DataFrame:
    """Dropped digests by joins: for more repeated keys than a broadcast may hold."""
    rows = materialize(keyed.withColumn("at", F.monotonically_increasing_id()), "line-rows")  # the row number is fixed before it is used twice

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, ids = part.column("at").to_pylist(), [NULL_ID if x is None else x for x in part.column("key").to_pylist()]
                made = [(at[i], ids[i], d) for i, own in _digests(texts_of(part.column("text")), least_chars) for d in own]
                columns = list(zip(*made, strict=True)) if made else [()] * 3
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["at", "doc", "digest"])

    held = rows.select("at", "key", "text").mapInArrow(keys, "at long, doc long, digest binary").withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int"))
    spread = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    goes = held.join(spread, ["digest", "salt"]).filter("doc <> largest").groupBy("at").agg(F.collect_list("digest").alias("gone"))
    joined = rows.join(goes, "at", "left")

    def by_row(part: pa.RecordBatch):
        for gone in part.column("gone").to_pylist():
            yield (lambda digest: False) if not gone else set(gone).__contains__

    return joined.mapInArrow(_drop(out, text, least_chars, by_row), out)
