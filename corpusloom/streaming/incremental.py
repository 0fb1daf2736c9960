"""Incremental vocabularies and matrices over a stream of documents.

Counts are sums, so each micro-batch is counted by itself and appended under its batch
id; the state is the sum over batches.  A batch that is replayed after a failure
overwrites its own folder, which makes the sink idempotent.  Every document must
arrive whole and once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.vectorize import VocabVectorizer, create_dtm, create_tcm
from ..operators.vocabulary import Vocabulary, create_vocabulary
from ..sources.documents import tokens


def start(stream: DataFrame, count: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write ``count(batch)`` of every micro-batch to ``path``, one folder a batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def vocabulary_counts(tokenize: Callable[[Column], Column], preprocess: Callable[[Column], Column] = F.lower, **parameters: object) -> Callable[[DataFrame], DataFrame]:
    """Term counts of a batch of (doc_id, text); the row with a null term carries the number of documents."""

    def count(batch: DataFrame) -> DataFrame:
        made = create_vocabulary(tokens(batch, preprocess, tokenize), **parameters)
        total = batch.sparkSession.createDataFrame([(None, 0, made.document_count)], "term string, term_count long, doc_count long")
        return made.terms.unionByName(total)

    return count


def merged_vocabulary(spark: SparkSession, path: str, **parameters: object) -> Vocabulary:
    """The vocabulary of all batches so far."""
    rows = spark.read.parquet(path)
    summed = rows.groupBy("term").agg(F.sum("term_count").alias("term_count"), F.sum("doc_count").alias("doc_count"))
    n = rows.filter("term IS NULL").agg(F.coalesce(F.sum("doc_count"), F.lit(0))).first()[0]
    return Vocabulary(summed.filter("term IS NOT NULL"), n, **parameters)


def dtm_cells(vectorizer: VocabVectorizer, tokenize: Callable[[Column], Column], preprocess: Callable[[Column], Column] = F.lower) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: create_dtm(tokens(batch, preprocess, tokenize), vectorizer)


def tcm_cells(vectorizer: VocabVectorizer, tokenize: Callable[[Column], Column], preprocess: Callable[[Column], Column] = F.lower, **parameters: object) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: create_tcm(tokens(batch, preprocess, tokenize), vectorizer, **parameters)


def merged_cells(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Sum of ``value`` over all batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("value").alias("value"))


def windowed_term_counts(stream: DataFrame, ts: str, term: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(window_start, term, n) in event time; rows later than the watermark are dropped by the engine."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(term).alias("term")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "term", "n")
