"""Content-defined chunking fingerprints.

A gear hash rolls over the UTF-8 bytes; where its value meets a mask a chunk may
end.  Chunk lengths are normalised: a stricter mask holds up to the normal
length, an easier one after it, and a chunk ends at the greatest length in any
case.  A boundary depends on the last 32 bytes only, so text moved by an insertion
is cut at the same places again.  A fingerprint is the set of chunk digests with
their lengths; the share of one set's bytes that another holds measures
containment.

Defined results
* null text: as the empty text; its fingerprint is the empty string.  Two empty
  fingerprints are alike (1.0), an empty one and any other are not (0.0).
* equal texts: equal fingerprints, whatever else their rows hold.
* rows with equal doc_id: ordered by a hash of their text, so reruns agree; rows equal in both
  follow one another.  null doc_id comes before all others.
* one document only: it is its own next document.  Empty table: empty result.
* very long texts: chunked whole; memory is a small multiple of one text.
* other columns, whatever their names: ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._arrow import give_back, project, texts_of

LEAST, NORMAL, MOST = 12, 32, 128
STRICT, EASY = np.uint32(0x7E000000), np.uint32(0x78000000)  # 6 bits before the normal length, 4 after
_PART = 1 << 16

GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of GEAR[b[i-k]] << k for k in 0..31, by doubling."""
    out = np.empty(len(data), np.uint32)
    for start in range(0, len(data), _PART):  # parts that fit the cache, each with 31 bytes of run-up
        lead = min(start, 31)
        h = GEAR[data[start - lead : start + _PART]]
        for k in (1, 2, 4, 8, 16):
            if len(h) > k:
                add = h[:-k] << np.uint32(k)
                h[k:] += add
        out[start : start + _PART] = h[lead:]
    return out


def chunk_ends(text: bytes) -> list[int]:
    """End offsets of the chunks of a text."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = gear(np.frombuffer(text, np.uint8))
    easy = np.flatnonzero((h & EASY) == 0) + 1
    hard = ((h[easy - 1] & STRICT) == 0).tolist()
    easy = easy.tolist()
    ends, start, k, m = [], 0, 0, len(easy)
    while n - start > LEAST:
        low, middle, high = start + LEAST, start + NORMAL, min(start + MOST, n)
        while k < m and easy[k] < low:
            k += 1
        cut, j = high, k
        while j < m and (at := easy[j]) < high:
            if at >= middle or hard[j]:
                cut = at
                break
            j += 1
        ends.append(cut)
        start, k = cut, j
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: bytes) -> dict[int, int]:
    """Digest (48 bits) of each distinct chunk -> its length in bytes."""
    held, start, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in chunk_ends(text):
        held[digest(text[start:end]) >> 16] = end - start
        start = end
    return held


def render(chunks: dict[int, int]) -> str:
    """The fingerprint as text: base64 of sorted (digest, length) records of 7 bytes."""
    return base64.b64encode(b"".join([(k << 8 | chunks[k]).to_bytes(7, "big") for k in sorted(chunks)])).decode()


def parse(fingerprint: str) -> dict[int, int]:
    raw = base64.b64decode(fingerprint)
    records = [int.from_bytes(raw[i : i + 7], "big") for i in range(0, len(raw), 7)]
    return {x >> 8: x & 255 for x in records}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's chunk bytes that b holds; 1.0 if both are empty."""
    if not a:
        return 0.0 if b else 1.0
    return sum([n for k, n in a.items() if k in b]) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every document; needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x.decode()) for x in texts], pa.int64()), pa.array([render(chunk_set(x)) for x in texts])], ["doc_id", "n_chars", "fingerprint"])

    return project(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PACKED = "part int, halo boolean, doc_id long, tie long, packed binary"
#: Stands for a null doc_id, which comes before all others.
_NULL = -(1 << 63) - 1

#: (doc_id, tie, lane): where a range begins.
Lead = tuple[int, int, int]


def _least(bounds: list[Lead]):
    """Kernel over (doc_id, tie): the least key of each range that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for key, tie in zip(batch.column("doc_id").fill_null(0).to_pylist(), batch.column("tie").to_pylist(), strict=True):
                part = bisect.bisect_right(bounds, (key, tie, 0))
                if part not in found or (key, tie) < found[part]:
                    found[part] = (key, tie)
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([x for x, _ in found.values()], pa.int64()), pa.array([x for _, x in found.values()], pa.int64())], ["part", "doc_id", "tie"])

    return run


def range_leads(keys: DataFrame, n: int, parts: int) -> tuple[list[Lead], dict[tuple[int, int], int]]:
    """Where ranges begin, each at a row that is there, and in how many lanes equal rows are dealt.

    keys: (doc_id, tie).  Bounds are approximate quantiles of doc_id; an id with the rows of two ranges or more is cut by the hash
    of the text; rows equal in both, if so many, are dealt to lanes, which are ranges of their own.  Some ``parts`` ranges, and
    as many cuts and lanes at most, come to the driver.
    """
    share = 2 * n / parts
    known = keys.filter("doc_id IS NOT NULL")
    marks = known.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] if parts > 1 else None
    bounds = {(m, -(1 << 63), 0) for m in marks or []}
    own = lambda x: _NULL if x is None else x
    wide = [(own(r["doc_id"]), r["count"]) for r in keys.groupBy("doc_id").count().filter(F.col("count") > share).collect()] if parts > 1 else []
    for key, count in wide:
        cuts = int(count * parts / n) + 1
        bounds |= {(key, -(1 << 63) + (j << 64) // cuts, 0) for j in range(cuts)}
    equal = [((own(r["doc_id"]), r["tie"]), int(r["count"] * parts / n) + 1) for r in keys.groupBy("doc_id", "tie").count().filter(F.col("count") > share).collect()] if wide else []
    inner = sorted(b for b in bounds if b[0] != _NULL)
    leads: list[Lead] = []
    for rows, cut in ((known, inner), (keys.filter("doc_id IS NULL"), sorted((0, t, lane) for k, t, lane in bounds if k == _NULL))):
        found = rows.mapInArrow(_least(cut), "part int, doc_id long, tie long").groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("x")).collect()
        leads += [(_NULL if rows is not known else r["x"]["doc_id"], r["x"]["tie"], 0) for r in found]
    return sorted({*leads, *((*key, lane) for key, lanes in equal for lane in range(lanes))}), dict(equal)


def _packer(held):
    """Kernel of the map side: place every row in its range, with its text compressed.

    The row that leads a range is sent to the range before it as well (halo), equal ones once a task; the
    first range comes after the last.  Of rows in lanes a task sends the first to the last lane, so
    that those of the other lanes are followed by one like them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, lanes = held.value
        begins: dict[tuple[int, int], list[int]] = {}
        for part, lead in enumerate(leads):
            begins.setdefault(lead[:2], []).append(part)
        sent: dict[tuple[int, int], int] = {}
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for doc, tie, text in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), texts_of(batch.column("text")), strict=True):
                key, packed = (_NULL if doc is None else doc, tie), squeeze.compress(text)
                of = begins.get(key)
                turn = sent.get(key, 0) if of else 0
                lane = (lanes[key] - 1 - turn) % lanes[key] if key in lanes else 0
                rows.append((bisect.bisect_right(leads, (*key, lane)) - 1, False, doc, tie, packed))
                if of:
                    if not turn:
                        rows += [((part - 1) % len(leads), True, doc, tie, packed) for part in of]
                    sent[key] = turn + 1
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.record_batch([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["part", "halo", "doc_id", "tie", "packed"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted ranges; each ends with the row that follows it, of which only the first copy counts."""
    expand = zstandard.ZstdDecompressor()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in _OUT.split(", ")]
    last: tuple | None = None
    for batch in batches:
        rows = []
        for key, halo, packed in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "halo", "packed")), strict=True):
            if halo and last is None:
                continue
            raw = expand.decompress(packed)
            text, chunks = raw.decode(), chunk_set(raw)
            if last is not None:
                was, old, held = last
                new = edited(old, text).encode()
                changed = chunk_set(new)
                rows.append((was, len(old), hashlib.sha256(new).hexdigest(), render(held), render(changed), containment(held, changed), containment(held, chunks)))
            last = None if halo else (key, text, chunks)
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.record_batch([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names)
    give_back()


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = 4096) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness (see the module).

    The texts are brought into order of doc_id and text hash by one shuffle, compressed, in ranges of about ``range_rows`` rows (up to
    20,000 ranges; beyond that they hold more rows, and as they are walked row by row their size is no matter).  No id,
    and no group of equal rows, is left to one range (see ``range_leads``), no window runs over the
    whole table, and no range needs another.
    """
    spark = docs.sparkSession
    base = project(docs, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = materialize(base.select(F.col("doc_id").cast("long").alias("doc_id"), "tie"), "fingerprint-keys")
    n = keys.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    held = spark.sparkContext.broadcast(range_leads(keys, n, int(min(max(n // range_rows, 1), 20_000))))
    placed = base.mapInArrow(_packer(held), _PACKED)
    ordered = placed.repartition("part").sortWithinPartitions("part", "halo", F.col("doc_id").asc_nulls_first(), "tie")
    return ordered.select("doc_id", "halo", "packed").mapInArrow(_compare, _OUT)
