"""Document-term and term-co-occurrence matrices as long tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing
from ..functions import text as fn
from ..session import materialize
from . import _arrays
from .ranking import with_rank
from .vocabulary import Vocabulary


#: Pairs that a task makes at a time, and rows of a batch that leaves it.
MADE, BATCH_ROWS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class VocabVectorizer:
    """Columns are the terms of a vocabulary."""

    vocabulary: Vocabulary

    def grams(self, tokens: DataFrame) -> DataFrame:
        return self.vocabulary.grams(tokens)


@dataclass(frozen=True)
class HashVectorizer:
    """Columns are hash buckets; with ``signed`` a term counts +1 or -1."""

    hash_size: int = 1 << 18
    ngram: tuple[int, int] = (1, 1)
    signed: bool = False

    def grams(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("tokens", fn.ngrams(F.col("tokens"), *self.ngram))

    def codes(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        """Bucket of each term, and its sign if terms have one."""
        if not self.signed:
            return hashing.murmur3_of(terms, hashing.BUCKET_SEED)[0].astype(np.int64) % self.hash_size, None
        h, s = hashing.murmur3_of(terms, hashing.BUCKET_SEED, hashing.SIGN_SEED)
        return h.astype(np.int64) % self.hash_size, 1 - 2 * (s >> np.uint32(31)).astype(np.int64)


def create_dtm(tokens: DataFrame, vectorizer: VocabVectorizer | HashVectorizer) -> DataFrame:
    """(doc_id, column, value): how often a document holds a term (or bucket).

    Documents without known terms have no cells; their ids are in ``tokens``.  A signed
    sum of 0 stays as a cell.
    """
    grams = vectorizer.grams(tokens)
    grams = grams.select("doc_id", "text" if "text" in grams.columns else "tokens")
    read = _arrays.reader(grams)
    names = vectorizer.vocabulary.terms.select("term") if isinstance(vectorizer, VocabVectorizer) else None
    sent = _sent(materialize(names.distinct(), "dtm-terms")) if names is not None else None
    hashed = names is None
    codes, width, kind = (vectorizer.codes, vectorizer.hash_size, T.LongType()) if hashed else (None, None, T.StringType())
    out = T.StructType([grams.schema["doc_id"], T.StructField("columns", T.ArrayType(kind)), T.StructField("values", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _arrays.slices(read(batches), "tokens", 1 << 18):
            terms, numbers, rows = _arrays.encoded(part.column("tokens"))
            if hashed:
                code, sign = codes(terms)
                row, column, value = _arrays.row_counts(rows, code[numbers], width, None if sign is None else sign[numbers])
                columns = pa.array(column)
            else:
                known = np.ones(len(terms), bool) if sent is None else pc.is_in(terms, sent.value).to_numpy(zero_copy_only=False)
                held = known[numbers]
                row, column, value = _arrays.row_counts(rows[held], numbers[held], len(terms))
                columns = terms.take(pa.array(column))
            of, start = np.unique(row, return_index=True)
            ends = pa.array(np.append(start, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (columns, pa.array(value.astype(np.int32)))]
            yield pa.record_batch([part.column("doc_id").take(pa.array(of)), *lists], ["doc_id", "columns", "values"])

    # a row's cells are summed where the row lies and travel as one row; rows of one document meet here, and what goes by document needs no further shuffle
    met = grams.mapInArrow(run, out).repartition("doc_id").select("doc_id", F.explode(F.arrays_zip("columns", "values")).alias("cell"))
    cells = met.groupBy("doc_id", F.col("cell.columns").alias("column")).agg(F.sum("cell.values").cast("double").alias("value"))
    if hashed or sent is not None:
        return cells
    return cells.join(names.withColumnRenamed("term", "column"), "column", "left_semi").select("doc_id", "column", "value")


def _sent(terms: DataFrame):
    """Distinct terms as a sorted array for every task, or nothing if they exceed TERM_BYTES.  terms: (term)."""
    if (terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) > _arrays.TERM_BYTES:
        return None
    names = pa.array(sorted(r["term"] for r in terms.toLocalIterator()), pa.string())
    return terms.sparkSession.sparkContext.broadcast(names)


def create_tcm(tokens: DataFrame, vectorizer: VocabVectorizer | HashVectorizer, window: int = 5, context: str = "symmetric", weights: list[float] | None = None, binary: bool = False) -> DataFrame:
    """(i, j, value): weighted co-occurrence within a window of positions.

    Positions count all tokens that stopword removal leaves, known or not.  ``right``: j follows
    i; ``left``: the transpose; ``symmetric``: both, kept once as a pair with i <= j (by column).
    Pairs are made from numbers, MADE at a time, and summed by distance, so one shuffle by pair
    remains and a task's memory does not follow the length of its batch; sums are of whole numbers, and weights come last, so reruns agree to the last bit.  The terms of a
    vocabulary are broadcast up to TERM_BYTES; beyond that all pairs travel as strings and unknown ones go after the sum.
    """
    weights = weights if weights is not None else [1 / d for d in range(1, window + 1)]
    if len(weights) != window:
        raise ValueError("need one weight per distance")
    if context not in ("symmetric", "right", "left"):
        raise ValueError("context is symmetric, right or left")
    grams = vectorizer.grams(tokens).select("tokens")
    hashed = isinstance(vectorizer, HashVectorizer)
    own = None if hashed else materialize(vectorizer.vocabulary.terms.select("term").distinct(), "tcm-terms")
    sent = None if hashed else _sent(own)
    codes = vectorizer.codes if hashed else None
    kind, text = ("string", True) if not hashed and sent is None else ("long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _arrays.slices(batches, "tokens"):
            terms, numbers, rows = _arrays.encoded(part.column("tokens"))
            sign = None
            if hashed:
                code, sign = codes(terms)
            elif text:
                order = pc.sort_indices(terms).to_numpy()
                code = np.empty(len(terms), np.int64)
                code[order] = np.arange(len(terms))
            else:
                code = pc.fill_null(pc.index_in(terms, sent.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in _arrays.row_ranges(rows, max(MADE // window, 1)):
                i, j, counts = _arrays.pair_counts(numbers[at], rows[at], code, sign, window, context, binary)
                for cut in (slice(k, k + BATCH_ROWS) for k in range(0, len(i), BATCH_ROWS)):
                    ends = [terms.take(pa.array(order[x[cut]])) if text else pa.array(x[cut]) for x in (i, j)]
                    yield pa.record_batch([*ends, *(pa.array(counts[cut, d], pa.int32()) for d in range(window))], ["i", "j", *(f"n{d}" for d in range(window))])

    pairs = grams.mapInArrow(run, ", ".join([f"i {kind}, j {kind}", *(f"n{d} int" for d in range(window))]))
    summed = pairs.groupBy("i", "j").agg(*(F.sum(f"n{d}").alias(f"n{d}") for d in range(window)))
    value = reduce(lambda s, x: s + x, [F.col(f"n{d}") * F.lit(float(w)) for d, w in enumerate(weights)])
    cells = summed.select("i", "j", value.alias("value"))
    if text:
        known = lambda side: own.select(F.col("term").alias(side))
        return cells.join(known("i"), "i", "left_semi").join(known("j"), "j", "left_semi")
    if hashed:
        return cells

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.record_batch([sent.value.take(part.column(0)), sent.value.take(part.column(1)), part.column(2)], ["i", "j", "value"])

    return cells.mapInArrow(named, "i string, j string, value double")


def word_count(tokens: DataFrame, vectorizer: VocabVectorizer) -> DataFrame:
    """(term, n): occurrences of known terms, what a co-occurrence matrix's margins are compared with."""
    terms = vectorizer.grams(tokens).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(vectorizer.vocabulary.terms.select("term"), "term", "left_semi")


def stack(*matrices: DataFrame) -> DataFrame:
    """Rows of several matrices with the same columns, one below the other."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out


def lda_c(dtm: DataFrame, ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, idx, cnt): per document its 0-based term ids and whole counts, in order of ids; empty documents too.

    ids: (term, term_id).
    """
    cells = dtm.join(ids.select(F.col("term").alias("column"), "term_id"), "column")
    lists = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", F.floor("value").cast("int").alias("n")))).alias("cells"))
    full = docs.select("doc_id").join(lists, "doc_id", "left")
    part = lambda name, kind: F.coalesce(F.transform("cells", lambda c: c[name]), F.array().cast(f"array<{kind}>"))
    return full.select("doc_id", part("term_id", "long").alias("idx"), part("n", "int").alias("cnt"))


def as_vectors(dtm: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, features): rows as sparse vectors for MLlib."""
    make = F.udf(lambda at, values: SparseVector(size, at, values), VectorUDT())
    cells = dtm.join(ids.select(F.col("term").alias("column"), "term_id"), "column")
    lists = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "value"))).alias("cells"))
    return lists.select("doc_id", make(F.transform("cells", lambda c: c["term_id"]), F.transform("cells", lambda c: c["value"])).alias("features"))


#: Terms of a document that are paired in one go; a document of more is cut into blocks that other tasks take.
PAIR_BLOCK = 2048
#: Terms whose pairs a task sums in a table of its own: the most frequent ones.
TABLE_TERMS = 2048


def cross_product(dtm: DataFrame) -> DataFrame:
    """(i, j, value): in how many documents two terms occur together; both halves and the diagonal.

    Pairs are made within each document's row, not by a join of the table with itself, as numbers and once a pair (i <= j);
    those of the TABLE_TERMS most frequent terms are summed in a table a task, the others MADE at a time, before they
    are shuffled.  Documents of more than PAIR_BLOCK terms are dealt out as pairs of blocks, so none is left to one task.
    """
    spark, held = dtm.sparkSession, materialize(dtm.filter("value <> 0").select("doc_id", "column").distinct(), "cross-cells")
    # numbers by frequency, so that the table has the terms with most pairs
    found = held.groupBy("column").agg(F.count("*").alias("n"))
    ids = materialize(with_rank(found, "at", F.col("n").desc(), F.col("column").asc()).select("column", "at"), "cross-terms")
    width = max(ids.count(), 1)
    rows = held.join(ids, "column").groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("a"))
    size = F.size("a")
    small = rows.filter(size <= PAIR_BLOCK).select("a", F.col("a").alias("b"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / PAIR_BLOCK).cast("int")), lambda k: F.slice("a", k * PAIR_BLOCK + 1, F.lit(PAIR_BLOCK)))
    wide = rows.filter(size > PAIR_BLOCK).select("doc_id", blocks.alias("blocks"))
    wide = wide.select("doc_id", F.posexplode("blocks").alias("p", "a"), "blocks").select("doc_id", "p", "a", F.posexplode("blocks").alias("q", "b")).filter("p <= q")
    spread = wide.repartition("doc_id", "p", "q").select("a", "b")
    most = min(TABLE_TERMS, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rest, waiting = np.zeros((most, most), np.int32), [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate([np.empty(0, np.int64), *rest]), return_counts=True)
            for k in range(0, len(keys), BATCH_ROWS):
                cut = keys[k : k + BATCH_ROWS]
                yield pa.record_batch([pa.array(cut // width), pa.array(cut % width), pa.array(n[k : k + BATCH_ROWS])], ["i", "j", "n"])

        for batch in batches:
            for a, b in zip(*(_lists(batch.column(c)) for c in ("a", "b")), strict=True):
                near_a, near_b = (int(np.searchsorted(x, most)) for x in (a, b))
                if near_a and near_b:
                    table[np.ix_(a[:near_a], b[:near_b])] += 1
                keys = np.concatenate([(a[:near_a, None] * width + b[near_b:]).ravel(), (a[near_a:, None] * width + b).ravel()])
                keys = keys[keys // width <= keys % width]
                rest.append(keys)
                waiting += len(keys)
                if waiting > 4 * MADE:
                    yield from summed()
                    rest, waiting = [], 0
        yield from summed()
        i, j = np.nonzero(np.triu(table))
        for k in range(0, len(i), BATCH_ROWS):
            x, y = i[k : k + BATCH_ROWS], j[k : k + BATCH_ROWS]
            yield pa.record_batch([pa.array(x), pa.array(y), pa.array(table[x, y].astype(np.int64))], ["i", "j", "n"])

    pairs = small.unionByName(spread).mapInArrow(run, "i long, j long, n long")
    summed = pairs.groupBy("i", "j").agg(F.sum("n").cast("double").alias("value"))
    both = summed.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("x"), "value").select("x.i", "x.j", "value")
    plain = isinstance(dtm.schema["column"].dataType, T.StringType)
    if not plain or (ids.agg(F.sum(F.octet_length("column") + 8)).first()[0] or 0) > _arrays.TERM_BYTES:
        of = lambda side: ids.select(F.col("at").alias(side), F.col("column").alias(f"{side}_"))
        return both.join(of("i"), "i").join(of("j"), "j").select(F.col("i_").alias("i"), F.col("j_").alias("j"), "value")
    place = ids.toArrow()
    order = pa.array(np.argsort(place.column("at").to_numpy()))
    named_by = spark.sparkContext.broadcast(place.column("column").combine_chunks().cast(pa.string()).take(order))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.record_batch([named_by.value.take(part.column(0)), named_by.value.take(part.column(1)), part.column(2)], ["i", "j", "value"])

    return both.mapInArrow(named, "i string, j string, value double")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as slices of one array."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return iter(np.split(column.flatten().to_numpy(), np.cumsum(sizes)[:-1]))
