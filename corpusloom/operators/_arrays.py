"""Arrow kernels over (doc_id, tokens): tokens of a batch become numbers, and counts are summed before they leave the task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import text as fn

#: Bytes of text that is split into words at a time, and words that are handed on together.
TEXT_BYTES, WORDS = 1 << 22, 1 << 21
#: Bytes of terms that may be broadcast as a table of ids; beyond it terms travel as strings.
TERM_BYTES = 64 << 20


def words(texts: pa.Array, classes: np.ndarray) -> pa.ListArray:
    """What ``fn.word_tokens`` makes of each text, for a column at once (null: no words).  classes: ``fn.word_classes``.

    A connecting character is part of a word if one ends before it and the class it needs follows, so each place is told by its neighbours.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer().to_pybytes()
    try:
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no text are no part of a word
        return words(pa.array([x.decode(errors="replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string()), classes)
    kind = classes[points]
    held = np.zeros(len(kind) + 2, bool)  # with a place on either side
    held[1:-1] = (kind & 3) > 0
    if len(kind) > 2:
        before, at, after = held[1:-3].copy(), kind[1:-1], kind[2:]
        held[2:-2] |= before & ((at >> 2 & after & 3) > 0)
    edges = np.flatnonzero(held[1:] != held[:-1])
    start, end, held = edges[::2], edges[1::2], held[1:-1]
    if len(points) == len(whole):
        kept, upto = np.frombuffer(whole, np.uint8)[held], np.cumsum(end - start)
    else:
        size = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int8)
        kept, upto = np.frombuffer(whole, np.uint8)[np.repeat(held, size)], np.cumsum(size * held, dtype=np.int64)[end - 1]
    offsets = np.concatenate([[0], upto]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(kept))
    first = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first), pa.int32()), found)


def reader(frame: DataFrame):
    """What gives a task of ``frame`` batches of (doc_id, tokens): they are these already, or (doc_id, text), which is split into words here."""
    if "tokens" in frame.columns:
        return lambda batches: batches
    sent = frame.sparkSession.sparkContext.broadcast(fn.word_classes(frame.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for part in slices([batch], "text", TEXT_BYTES):
                split = words(part.column("text"), sent.value)
                held.append(pa.record_batch([*(part.column(c) for c in part.schema.names if c != "text"), split], [*(c for c in part.schema.names if c != "text"), "tokens"]))
                n += len(split.values)
                if n >= WORDS:
                    yield pa.concat_batches(held)
                    held, n = [], 0
            if held:
                yield pa.concat_batches(held)

    return read


def encoded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct values of a list column, and for each element its value's number and its row.  Null elements are dropped."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column), dtype=np.int64), sizes)
    flat = pc.dictionary_encode(column.flatten())
    numbers = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = numbers >= 0
    return flat.dictionary, numbers[known], rows[known]


def row_counts(rows: np.ndarray, columns: np.ndarray, width: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sum of weights) of each cell that occurs."""
    cells, at = np.unique(rows * width + columns, return_inverse=True)
    return cells // max(width, 1), cells % max(width, 1), np.bincount(at, weights, len(cells))


def pair_counts(numbers: np.ndarray, rows: np.ndarray, code: np.ndarray, sign: np.ndarray | None, window: int, context: str, binary: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, counts by distance) of pairs of codes within ``window`` positions of one row.

    ``code`` gives the column of each number, below 0 if it has none; such tokens keep their position.  ``sign`` makes
    a pair count the product of its signs.  ``binary`` counts a token once for each occurrence before it, at its nearest place.
    """
    n, width = len(numbers), int(code.max(initial=-1)) + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, window + 1):
        if n <= d:
            found.append((np.empty(0, np.int64), np.empty(0)))
            continue
        a, b = numbers[:-d], numbers[d:]
        fits = (rows[d:] == rows[:-d]) & (code[a] >= 0) & (code[b] >= 0)
        if binary:
            for e in range(1, d):
                fits &= b != numbers[e : n - d + e]
        a, b = a[fits], b[fits]
        i, j = code[a], code[b]
        if context == "left":
            i, j = j, i
        elif context == "symmetric":
            i, j = np.minimum(i, j), np.maximum(i, j)
        keys, at = np.unique(i * width + j, return_inverse=True)
        found.append((keys, np.bincount(at, None if sign is None else sign[a] * sign[b], len(keys))))
    keys = np.unique(np.concatenate([x for x, _ in found]))
    counts = np.zeros((len(keys), window), np.int64)
    for d, (own, n_own) in enumerate(found):
        counts[np.searchsorted(keys, own), d] = n_own
    return keys // max(width, 1), keys % max(width, 1), counts


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds many more than ``most`` list elements (bytes of a text), nor more than ``rows`` rows (one row at least)."""
    for batch in batches:
        length = pc.binary_length if pa.types.is_string(batch.column(column).type) else pc.list_value_length
        sizes = pc.fill_null(length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            upto = np.cumsum(sizes[start : start + rows] if rows else sizes[start:])
            n = max(min(int(np.searchsorted(upto, most, "right")), rows or batch.num_rows), 1)
            yield batch.slice(start, n)
            start += n


def row_ranges(rows: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of elements that hold whole rows and not many more than ``most`` elements (one row at least).  ``rows`` is sorted."""
    start = 0
    while start < len(rows):
        stop = len(rows)
        if stop - start > most:
            stop = int(np.searchsorted(rows, rows[start + most], "left"))
            if stop <= start:
                stop = int(np.searchsorted(rows, rows[start], "right"))
        yield slice(start, stop)
        start = stop
