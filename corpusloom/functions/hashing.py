"""MurmurHash3 (x86, 32 bits) of UTF-8 bytes, for feature hashing.

The JVM's own hash expression treats the tail of a string differently, so this is an Arrow
kernel: terms of equal length are hashed together, four bytes of all of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seeds of the bucket and of the sign.
BUCKET_SEED, SIGN_SEED = 3120602769, 79193439
_U = np.uint32


def _scramble(k: np.ndarray) -> np.ndarray:
    k = k * _U(0xCC9E2D51)
    return (k << _U(15) | k >> _U(17)) * _U(0x1B873593)


def _equal_length(data: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the rows of a matrix of bytes."""
    n, length = data.shape
    h, whole = np.full(n, seed, _U), length & ~3
    blocks = np.ascontiguousarray(data[:, :whole]).view("<u4") if whole else np.empty((n, 0), _U)
    for k in range(whole // 4):
        h ^= _scramble(blocks[:, k])
        h = (h << _U(13) | h >> _U(19)) * _U(5) + _U(0xE6546B64)
    if length > whole:
        tail = np.zeros((n, 4), np.uint8)
        tail[:, : length - whole] = data[:, whole:]
        h ^= _scramble(tail.view("<u4")[:, 0])
    h ^= _U(length)
    h = (h ^ h >> _U(16)) * _U(0x85EBCA6B)
    h = (h ^ h >> _U(13)) * _U(0xC2B2AE35)
    return h ^ h >> _U(16)


def murmur3_of(terms: pa.Array, *seeds: int) -> list[np.ndarray]:
    """Unsigned 32-bit hashes of a string array without nulls, one array a seed."""
    terms = terms.cast(pa.large_binary())
    n = len(terms)
    at = np.frombuffer(terms.buffers()[1], np.int64, n + 1, terms.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(terms.buffers()[2], np.uint8) if n and terms.buffers()[2] else np.empty(0, np.uint8)
    sizes, out = np.diff(at), [np.empty(n, _U) for _ in seeds]
    for length in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == length)
        data = raw[at[of][:, None] + np.arange(length)[None, :]] if length else np.empty((len(of), 0), np.uint8)
        for made, seed in zip(out, seeds, strict=True):
            made[of] = _equal_length(data, seed)
    return out


def murmur3(data: bytes, seed: int) -> int:
    """Unsigned 32-bit hash of one string."""
    return int(murmur3_of(pa.array([data], pa.binary()), seed)[0][0])


def _mapped(terms: pd.Series, seed: int, of) -> pd.Series:
    known = terms.notna().to_numpy()
    made = np.zeros(len(terms), np.int64)
    made[known] = of(murmur3_of(pa.array(terms[known], pa.string()), seed)[0])
    return pd.Series(made).astype("Int64").mask(~known)


def bucket(term: Column, size: int) -> Column:
    """Feature bucket in 0..size-1; null for null."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for terms in batches:
            yield _mapped(terms, BUCKET_SEED, lambda h: h.astype(np.int64) % size)

    return of(term)


def sign(term: Column) -> Column:
    """-1 where the sign hash, read as a signed number, is negative; else 1."""

    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for terms in batches:
            yield _mapped(terms, SIGN_SEED, lambda h: 1 - 2 * (h >> _U(31)).astype(np.int64))

    return of(term)


def murmur3_sql(term: str, seed: int) -> str:
    """The unsigned hash as DuckDB SQL, for checks: lambdas over lists of one element stand for names."""
    mod, le = 1 << 32, "('0x' || substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2))::UBIGINT"
    rot = lambda x, r: f"(({x} % {1 << (32 - r)}) * {1 << r} + {x} // {1 << (32 - r)})"
    each = lambda values, body: f"list_transform({values}, lambda k: {body})"
    scrambled = lambda values: each(each(values, f"(k * {0xCC9E2D51}) % {mod}"), f"({rot('k', 15)} * {0x1B873593}) % {mod}")
    digits, n = f"hex(encode({term}))", f"strlen({term})"
    blocks = scrambled(f"list_transform(range(0, {n} // 4), lambda i: {le.format(f'substr({digits}, (8 * i + 1)::INT, 8)')})")
    rest = le.format(f"rpad(substr({digits}, (8 * ({n} // 4) + 1)::INT), 8, '0')")
    tail = scrambled(f"[CASE WHEN {n} % 4 > 0 THEN {rest} ELSE 0::UBIGINT END]") + "[1]"
    body = f"list_reduce(list_prepend({seed}::UBIGINT, {blocks}), lambda h, k: ({rot('xor(h, k)', 13)} * 5 + {0xE6546B64}) % {mod})"
    mixed = each(f"[xor(xor({body}, {tail}), {n}::UBIGINT)]", f"(xor(k, k >> 16) * {0x85EBCA6B}) % {mod}")
    return each(each(mixed, f"(xor(k, k >> 13) * {0xC2B2AE35}) % {mod}"), "xor(k, k >> 16)") + "[1]"
