"""Listed rows: a matrix as (doc_id, at, values), one row a document with its term ids (ascending) and their values.

Models and row-wise measures read this form: numbers instead of strings, and nothing to collect again by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import _arrays, vectorize
from .vocabulary import Vocabulary

#: Cells that a task holds at a time, and those between two additions to its sums.
CELLS, SUMMED = 1 << 19, 1 << 21


def is_listed(m: DataFrame) -> bool:
    return "at" in m.columns


def _schema(m: DataFrame) -> T.StructType:
    return T.StructType([m.schema["doc_id"], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def lists(sizes: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """List columns with ``sizes`` elements a row."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in columns]


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id occurs twice; only ids are shuffled."""
    return docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def rows_of(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed rows of a long matrix (doc_id, column, value); a matrix of listed rows stays.  ids: (term, term_id)."""
    if is_listed(m):
        return m
    cells = m.join(ids.select(F.col("term").alias("column"), F.col("term_id").cast("int").alias("at")), "column")
    held = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", F.col("value").cast("double").alias("value")))).alias("cells"))
    return held.select("doc_id", F.col("cells.at").alias("at"), F.col("cells.value").alias("values"))


def create_rows(tokens: DataFrame, vocabulary: Vocabulary, ids: DataFrame) -> DataFrame:
    """Counts of a vocabulary's terms as listed rows; documents without known terms have none.

    Ids are looked up once a batch for each of its terms.  Rows of one document are added up: only if an id occurs twice
    are rows shuffled.  A vocabulary above TERM_BYTES goes by the long matrix and joins.
    """
    grams = vocabulary.grams(tokens)
    grams = grams.select("doc_id", "text" if "text" in grams.columns else "tokens")
    read = _arrays.reader(grams)
    ids = ids.select("term", "term_id")
    if (ids.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) > _arrays.TERM_BYTES:
        return rows_of(vectorize.create_dtm(tokens, vectorize.VocabVectorizer(vocabulary)), ids)
    held = ids.toArrow()
    names, numbers = held.column("term").combine_chunks().cast(pa.string()), held.column("term_id").to_numpy()
    sent, out = tokens.sparkSession.sparkContext.broadcast((names, numbers)), _schema(grams)
    width = int(numbers.max(initial=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = sent.value
        for part in _arrays.slices(read(batches), "tokens"):
            terms, own, row = _arrays.encoded(part.column("tokens"))
            place = pc.index_in(terms, names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.where(place >= 0, numbers[np.maximum(place, 0)], -1)[own] if len(numbers) else np.full(len(own), -1)
            row, at, n = _arrays.row_counts(row[code >= 0], code[code >= 0], width)
            of, sizes = np.unique(row, return_counts=True)
            yield pa.record_batch([part.column("doc_id").take(pa.array(of)), *lists(sizes, at.astype(np.int32), n.astype(float))], ["doc_id", "at", "values"])

    made = grams.mapInArrow(run, out)
    if unique_ids(grams):
        return made

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _arrays.slices(batches, "at", CELLS):
            sizes, at, values = cells_of(part)
            row, at, values = _arrays.row_counts(np.repeat(np.arange(len(sizes)), sizes), at, width, values)
            yield pa.record_batch([part.column("doc_id"), *lists(np.bincount(row, minlength=len(sizes)), at.astype(np.int32), values)], ["doc_id", "at", "values"])

    met = made.groupBy("doc_id").agg(F.flatten(F.collect_list(F.struct("at", "values"))["at"]).alias("at"), F.flatten(F.collect_list(F.struct("at", "values"))["values"]).alias("values"))
    return met.mapInArrow(added, out)


def cells_of(part: pa.RecordBatch, at: str = "at", values: str = "values") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each row, ids, values) of a batch of listed rows."""
    sizes = pc.fill_null(pc.list_value_length(part.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, part.column(at).flatten().to_numpy().astype(np.int64), part.column(values).flatten().to_numpy()


def column_sums(rows: DataFrame, width: int, k: int, of, at: str = "at", values: str = "values") -> np.ndarray:
    """(width x k) sums over all rows; ``of(sizes, at, values, total)`` adds a batch's part to ``total``, the sums that a task holds.

    A task sends its sums once, in ranges of ids, which are added up by range: the driver gets one array.
    """
    step = max((1 << 17) // k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, k), order="F")
        for part in _arrays.slices(batches, at, SUMMED):
            of(*cells_of(part, at, values), total)
        for r in range(0, width, step):
            cut = total[r : r + step]
            if cut.any():
                yield pa.record_batch([pa.array([r]), pa.array([np.ascontiguousarray(cut).tobytes()], pa.binary())], ["r", "x"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in batches:
            for r, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = np.frombuffer(x.as_buffer())
                held[r] = held[r] + own if r in held else own
        for r, x in held.items():
            yield pa.record_batch([pa.array([r]), pa.array([x.tobytes()], pa.binary())], ["r", "x"])

    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, 2)
    made = rows.select(at, values).coalesce(tasks).mapInArrow(run, "r long, x binary")
    whole = np.zeros((width, k))
    for row in made.repartition(tasks, "r").mapInArrow(added, "r long, x binary").collect():  # one job; width x k numbers
        own = np.frombuffer(row["x"]).reshape(-1, k)
        whole[row["r"] : row["r"] + len(own)] += own
    return whole


def mapped(rows: DataFrame, of) -> DataFrame:
    """Listed rows with values ``of(sizes, at, values)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _arrays.slices(batches, "at", CELLS):
            sizes, at, values = cells_of(part)
            yield pa.record_batch([part.column("doc_id"), *lists(sizes, at.astype(np.int32), of(sizes, at, values))], ["doc_id", "at", "values"])

    return rows.select("doc_id", "at", "values").mapInArrow(run, _schema(rows))


def tf_idf(rows: DataFrame, width: int, n_docs: int) -> DataFrame:
    """``TfIdf().fit_transform`` on listed rows: shares of a row times ln(1 + N / df); written once."""

    def df(sizes, at, values, total):
        total[:, 0] += np.bincount(at[values != 0], minlength=len(total))

    held = column_sums(rows, width, 1, df)[:, 0]
    sent = rows.sparkSession.sparkContext.broadcast(np.log1p(np.divide(n_docs, held, out=np.zeros(width), where=held > 0)))

    def weighed(sizes, at, values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.bincount(row, values, len(sizes))[row]
        return np.divide(values, whole, out=np.zeros(len(values)), where=whole != 0) * sent.value[at]

    return materialize(mapped(rows, weighed), "tfidf-rows")
