"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sources in code point order (null last) take the given weights in turn.  They
   share ``share`` times all words by weight; a target stops at ``most`` times its source's
   size and the excess is shared again by weight until none is above.
2. All targets together are counted in blocks of BLOCK words; that many seats are shared out.  A seat goes
   to the highest quotient target / (2 * seats + 1), first between sources and then, within a
   source, between shards by their sizes, which gives each shard an integer quota.
   Seats are not dealt one by one: each starts with its share rounded, and only the seats that rounding gave
   too many or too few are moved by their quotients, which leads to the same seats.
3. A shard lines up its documents of a source in a seeded order, cuts the line into
   blocks, and takes its quota from the front; beyond the line's end it goes round once more.
   So at most one document is cut per shard, source and round.

What is shuffled is (id, source, size), never text.  A source with a third of all
rows is spread over all shards; a shard has about ``shard_docs`` documents, whatever the
table holds, and there are LEAST_SHARDS at least.  Sources are ranked by ranges and shared by repeated sums, so neither
one task nor the driver holds all of them.

Defined results
* null or empty text: size 0, never taken.  null source: a source of its own, last.
* null doc_id: mixed like any other.  Rows with equal ids: each is mixed by itself, in an order
  seeded by id and text; rows equal in id, source and text are interchangeable.
* all sizes 0, or no rows: targets and taken words 0; empty table: empty result.
* very long texts: counted whole.  Other columns, whatever their names: ignored by ``mix``, passed by ``take``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from ._arrow import give_back, project, ranked, slices, texts_of

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 16
LEAST_SHARDS = 4
BROADCAST_BYTES = 64 << 20
#: Bytes that a row of the plan takes in a broadcast.
PLAN_ROW = 192


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    """Place of a document in the seeded order, as hexadecimal digits."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(own.cast("binary"))


def document_sizes(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, key): words of every whole text, counted in the JVM."""
    own = project(docs, doc_id=doc_id, source=source, text=text)
    return own.select("doc_id", "source", _size(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Add ``target``.  sources: (source, source_size, ...).  Each round is one sum over the sources."""
    turn = F.pmod(F.col("place"), F.lit(len(weights)))
    weight: Column = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int"))
    weighed = materialize(ranked(sources, "source").withColumn("weight", weight), "mix-sources")
    cap = most * F.col("source_size")
    wanted = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        held, rest = weighed.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        new = (wanted - held) / rest if rest else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double"))).drop("weight", "place")


def _moved(first: DataFrame, keys: list[str], votes: str) -> DataFrame:
    """(keys, short, order): the quotients at which the missing (short > 0) or surplus seats may go.

    first: (keys, votes, base, short, share, cells).  A group of ``cells`` members moves |short| seats in all; the
    divisor that does it moves at most share * (|short| + cells) + 1 of them in one member, so that many quotients enter.
    """
    entries = (F.ceil((F.abs("short") + F.col("cells")) * F.col("share")) + 1).cast("int")
    spread = first.filter(F.col("short") != 0).select(*keys, votes, "base", "short", F.explode(F.sequence(F.lit(1), entries)).alias("k"))
    number = F.when(F.col("short") > 0, F.col("base") + F.col("k")).otherwise(F.col("base") - F.col("k") + 1)
    spread = spread.withColumn("number", number).filter("number > 0")
    quotient = F.col(votes) / (2 * F.col("number") - 1)
    return spread.select(*keys, "short", "k", F.when(F.col("short") > 0, -quotient).otherwise(quotient).alias("order"))


def source_seats(sources: DataFrame, house: int) -> DataFrame:
    """Sainte-Laguë between sources.  sources: (source, target, ...) -> + seats, ``house`` of them in all (none if all targets are 0)."""
    total, n = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    share = F.col("target") / F.lit(total) if total > 0 else F.lit(0.0)
    first = materialize(sources.withColumn("share", share).withColumn("base", F.floor(share * house + 0.5).cast("long")), "mix-seats")
    short = house - (first.agg(F.sum("base")).first()[0] or 0) if total > 0 else 0
    moved = _moved(first.withColumns({"short": F.lit(short), "cells": F.lit(n)}), ["source"], "target")
    # ranked by ranges: the sources may be many
    placed = ranked(moved.withColumn("at", F.struct("order", F.col("source").isNull(), "source", "k")), "at").filter(F.col("place") < abs(short))
    change = placed.groupBy(F.col("source").alias("c_source")).agg(F.count("*").alias("change"))
    joined = first.join(change, F.col("source").eqNullSafe(F.col("c_source")), "left")
    step = F.coalesce("change", F.lit(0)) * (1 if short > 0 else -1)
    return joined.withColumn("seats", F.col("base") + step).drop("share", "base", "change", "c_source")


def shard_quotas(cells: DataFrame) -> DataFrame:
    """Sainte-Laguë within each source.  cells: (source, shard, cell_size, source_size, seats) -> + quota."""
    share = F.coalesce(F.try_divide(F.col("cell_size"), F.col("source_size")), F.lit(0.0))
    own = Window.partitionBy("source")
    first = cells.withColumn("share", share).withColumn("base", F.floor(F.col("cell_size") * F.coalesce(F.try_divide(F.col("seats"), F.col("source_size")), F.lit(0.0)) + 0.5).cast("long"))
    first = first.withColumns({"short": F.col("seats") - F.sum("base").over(own), "cells": F.count("*").over(own)})
    moved = _moved(first, ["source", "shard"], "cell_size")
    moved = moved.withColumn("rank", F.row_number().over(own.orderBy("order", "shard", "k"))).filter(F.col("rank") <= F.abs("short"))
    change = moved.groupBy("source", "shard").agg(F.sum(F.signum("short")).cast("long").alias("change")).withColumnsRenamed({"source": "c_source", "shard": "c_shard"})
    joined = first.join(change, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("shard") == F.col("c_shard")), "left")
    return joined.withColumn("quota", F.col("base") + F.coalesce("change", F.lit(0))).drop("share", "base", "short", "cells", "change", "c_source", "c_shard")


def _planned(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int, shard_docs: int) -> DataFrame:
    """sizes, written: (doc_id, source, size, key) -> + source_size, target, taken."""
    n_shards = max(LEAST_SHARDS, -(-sizes.count() // shard_docs))
    placed = sizes.withColumn("shard", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % n_shards).cast("int"))
    cells = materialize(placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size")), "mix-cells")
    sources = materialize(targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most), "mix-targets")
    house = math.floor((sources.agg(F.sum("target")).first()[0] or 0.0) / BLOCK + 0.5)
    sources = source_seats(sources, house).withColumnRenamed("source", "t_source")
    quotas = shard_quotas(cells.join(sources, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source"))
    quotas = materialize(quotas, "mix-quotas").withColumnsRenamed({"source": "q_source", "shard": "q_shard"})
    line = Window.partitionBy("source", "shard").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("start", F.sum("size").over(line) - F.col("size"))
    lined = lined.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    once = lambda offset: F.least(F.greatest(F.col("quota") * BLOCK - offset - F.col("start"), F.lit(0)), F.col("size"))
    taken = once(F.lit(0)) + once(F.col("cell_size"))
    return lined.select("doc_id", "source", "size", "key", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", shard_docs: int = 50_000, **columns: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document, and its place in the mix."""
    sizes = materialize(document_sizes(docs, seed, **columns), "mix-sizes")
    return _planned(sizes, weights, share, most, shard_docs).drop("key")


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", shard_docs: int = 50_000, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mixed documents, with the columns of ``docs`` (``n_chars``, if there, is set anew).

    A document comes once for each round that takes it; where the end of a round cuts
    it, with its words up to the cut.  Rows equal in id, source and text share
    their taken words equally.  What is joined with the texts is one row per taken document.
    """
    sizes = materialize(document_sizes(docs, seed, doc_id, source, text), "mix-sizes")
    plan = _planned(sizes, weights, share, most, shard_docs).filter("size > 0").groupBy(F.unhex("key").alias("plan_key"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("plan_source"))
    plan = materialize(plan.agg(F.max("size").alias("plan_size"), F.floor(F.sum("taken") / F.count("*")).cast("long").alias("taken")).filter("taken > 0"), "mix-plan")
    if plan.count() * PLAN_ROW <= BROADCAST_BYTES:  # else both sides are shuffled by key
        plan = F.broadcast(plan)
    # the user's row is one struct, so that none of its columns meets one of ours
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed)).alias("row_key"), F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("row_source"))
    joined = packed.join(plan, (F.col("row_key") == F.col("plan_key")) & (F.col("row_source") == F.col("plan_source"))).select("row", "plan_size", "taken", F.col("row").getField(text).alias("own_text"))
    arrow = to_arrow_schema(docs.schema)
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "own_text"):
                at, texts = [], []
                for i, (own, size, taken) in enumerate(zip(texts_of(batch.column("own_text")), batch.column("plan_size").to_pylist(), batch.column("taken").to_pylist(), strict=True)):
                    while taken > 0:
                        at.append(i)
                        if taken >= size:
                            texts.append(own)
                        else:
                            texts.append(own[: next(islice(word.finditer(own), taken - 1, None)).end()])
                        taken -= size
                row = batch.column("row").take(pa.array(at, pa.int64()))
                made = {text: pa.array(texts, pa.binary()).cast(pa.string()), n_chars: pa.array([len(x.decode()) for x in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else row.field(i) for i, f in enumerate(arrow)], schema=arrow)
        give_back()

    return joined.mapInArrow(run, docs.schema)
