"""Sharding by extendible hashing: a directory over hash-prefix bits.

A document hashes to 60 bits of the MD5 of its id.  A bucket is a prefix of some
depth; it is split on its next bit only while it holds more than ``limit`` bytes, so
the directory is deep where the hash space is full and shallow elsewhere.

The table is aggregated to cells, prefixes at a first depth at which most cells
fit; only cells that do not fit are counted again, a few bits deeper each
time.  All sums are partial first, so what is shuffled is cells, not documents.  Leaves
follow from the cells: the shortest prefix that fits.

Rows whose ids are equal share a hash and cannot be parted by its bits.  If they
exceed the limit together, their bucket continues on the bits of their text, and at last
of their place in the table, which parts rows that are equal throughout.

Defined results
* a single document above the limit: a shard of its own (or with empty ones of its prefix).
* null or empty text: 0 bytes, still in a shard.  null doc_id: hashed as the empty id.
* repeated rows: each is placed; very long texts: counted whole.
* other columns, whatever their names: ignored by ``assign``, written by ``write_shards``.  Empty table: empty result.
* shard numbers follow the order of prefixes, from 0; ties cannot occur.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._arrow import free_name, project, ranked

BITS = 60
DEEPER = 8
LEVELS = 3  # id, text, place: 60 bits each


def _hash(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of a row's hashes, as a string of 0 and 1."""
    return F.substring(F.concat(*(F.lpad(F.bin(f"h{k}"), BITS, "0") for k in range(LEVELS))), 1, depth)


def hashed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """(doc_id, place, bytes, h0, h1, h2); the place is the row's number in the scan unless a column holds it."""
    base = project(docs, doc_id=doc_id, text=text, **({"place": place} if place else {}))
    base = base if place else base.withColumn("place", F.monotonically_increasing_id())
    h = [_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), _hash(F.coalesce("text", F.lit(""))), _hash(F.col("place").cast("string"))]
    return base.select("doc_id", "place", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), *(x.alias(f"h{k}") for k, x in enumerate(h)))


def cells(rows: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """(cell, bytes, docs): prefixes that fit, one document, or all bits used; and the depths they have."""
    total, n = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    depth = max(0, math.ceil(math.log2(max(total / limit, 1)))) + 3 if n else 0
    sums = (F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
    big = materialize(rows.groupBy(_prefix(depth).alias("cell")).agg(*sums), "shard-cells")
    done, depths, over = [], [depth], (F.col("bytes") > limit) & (F.col("docs") > 1)
    while True:
        wide = big.filter(over).select(F.col("cell").alias("wide"))
        if depth >= BITS * LEVELS or not wide.head(1):
            done.append(big)
            break
        done.append(big.filter(~over))
        inside = rows.join(wide, _prefix(depth) == F.col("wide"), "left_semi")
        depth = min(depth + DEEPER, BITS * LEVELS)
        depths.append(depth)
        big = materialize(inside.groupBy(_prefix(depth).alias("cell")).agg(*sums), "shard-cells")
    return reduce(DataFrame.unionByName, done), depths


def directory(found: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The leaves (shard, prefix, depth, shard_bytes, shard_docs), and (cell, shard ...) for every cell."""
    prefix = F.expr("substring(cell, 1, depth)").alias("prefix")
    spread = found.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(0), F.length("cell"))).alias("depth"))
    held = spread.select(prefix, "depth", "bytes", "docs", (F.col("depth") == F.length("cell")).alias("whole")).groupBy("prefix", "depth")
    held = held.agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.max("whole").alias("whole"))
    fits = materialize(held.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | F.col("whole")).drop("whole"), "shard-fits")
    up = F.when(F.col("depth") > 0, F.expr("substring(prefix, 1, depth - 1)"))
    leaves = fits.withColumn("up", up).join(fits.select(F.col("prefix").alias("up")), "up", "left_anti").drop("up")
    leaves = materialize(ranked(leaves, "prefix").withColumnRenamed("place", "shard"), "shard-leaves")
    of_cell = spread.select("cell", prefix).join(leaves, "prefix").select("cell", "prefix", "depth", "shard", "shard_bytes", "shard_docs")
    return leaves, of_cell


def assign(docs: DataFrame, limit: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, bytes, shard, prefix, depth, shard_bytes, shard_docs) of every row."""
    return _assign(materialize(hashed(docs, doc_id, text), "shard-rows"), limit)


def _assign(rows: DataFrame, limit: int) -> DataFrame:
    found, depths = cells(rows, limit)
    _, of_cell = directory(materialize(found, "shard-cells"), limit)
    # one candidate a row unless some cells had to be split further
    keyed = rows.select("doc_id", "place", "bytes", F.explode(F.array(*map(_prefix, depths))).alias("cell"))
    return keyed.join(of_cell, "cell").drop("cell")


def write_shards(docs: DataFrame, path: str, limit: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", folder: str = "shard") -> DataFrame:
    """Write the documents with all their columns, one folder ``shard=N`` of Parquet each, and return the assignment.

    If a column is called like the folder, the folder gets underscores until its name is free.
    """
    folder = free_name(docs, folder)
    # the user's row is one struct, so that none of its columns meets one of ours
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    staged = materialize(docs.select(row, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("place")), "shard-staged")
    rows = hashed(staged, place="place")
    placed = materialize(_assign(materialize(rows, "shard-rows"), limit), "shard-placed")
    joined = staged.select("row", "place").join(placed.select("place", F.col("shard").alias("to")), "place")
    joined.repartition("to").select("row.*", F.col("to").alias(folder)).write.partitionBy(folder).parquet(path)
    return placed
