"""Vocabularies: statistics of terms, as mergeable tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from . import _arrays
from .ranking import with_rank


@dataclass(frozen=True)
class Vocabulary:
    """Terms with counts, and how they were made.

    terms: (term, term_count, doc_count).  ``doc_count`` counts the documents (or
    windows) that hold a term, ``document_count`` all of them, empty ones too.
    """

    terms: DataFrame
    document_count: int | None
    ngram: tuple[int, int] = (1, 1)
    stopwords: tuple[str, ...] = ()
    sep: str = "_"
    by_count_desc: bool = False

    def with_ids(self) -> DataFrame:
        """Terms with ``term_id``: their place by (count, term), or by count descending after a top-n cut."""
        count = F.coalesce("term_count", F.lit(0))
        return with_rank(self.terms, "term_id", count.desc() if self.by_count_desc else count.asc(), F.col("term").asc())

    def grams(self, tokens: DataFrame) -> DataFrame:
        """(doc_id, tokens) with this vocabulary's stopwords removed and n-grams made; texts stay if their words are the terms."""
        if "text" in tokens.columns:
            if self.ngram == (1, 1) and not self.stopwords:
                return tokens
            tokens = tokens.select("doc_id", F.coalesce(fn.word_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        return tokens.withColumn("tokens", fn.ngrams(F.col("tokens"), *self.ngram, list(self.stopwords), self.sep))

    def __repr__(self) -> str:
        return f"Vocabulary(documents={self.document_count}, ngram={self.ngram}, stopwords={len(self.stopwords)}, sep={self.sep!r})"


def create_vocabulary(tokens: DataFrame, ngram: tuple[int, int] = (1, 1), stopwords: list[str] = (), sep: str = "_", window: int = 0) -> Vocabulary:
    """Vocabulary of (doc_id, tokens), or (doc_id, text).  With ``window`` every window of that many tokens counts as a document.

    One shuffle: a document's tokens add to the term count and its distinct tokens to the document
    count, summed within a batch first.
    """
    if len(sep) != 1:
        raise ValueError("the separator must be one character")
    made = Vocabulary(tokens, None, tuple(ngram), tuple(stopwords), sep)
    grams, n_docs = made.grams(tokens), None
    if window > 0:
        if "text" in grams.columns:
            raise ValueError("windows are of tokens")
        n_docs = grams.agg(F.coalesce(F.sum(F.greatest(F.size("tokens") - window + 1, F.lit(1))), F.lit(0))).first()[0]
        grams = grams.select("doc_id", F.explode(fn.windows(F.col("tokens"), window)).alias("tokens"))
        grams = grams.withColumn("tokens", F.array_distinct("tokens"))  # a token counts once a window

    own = grams.select("text" if "text" in grams.columns else "tokens")
    read = _arrays.reader(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _arrays.slices(read(batches), "tokens"):
            found, numbers, rows = _arrays.encoded(part.column("tokens"))
            held = np.unique(rows * len(found) + numbers) % max(len(found), 1)
            yield pa.record_batch([found, pa.array(np.bincount(numbers, minlength=len(found))), pa.array(np.bincount(held, minlength=len(found)))], ["term", "n", "d"])

    # occurrences and rows are counted where the rows lie; what is shuffled are the terms of a batch
    counted = own.mapInArrow(run, "term string, n long, d long").groupBy("term").agg(F.sum("n").alias("term_count"), F.sum("d").alias("doc_count"))
    terms = counted.filter("term <> ''").select("term", F.col("term_count").cast("long"), F.col("doc_count").cast("long"))
    return replace(made, terms=terms, document_count=tokens.count() if n_docs is None else n_docs)


def counts_by(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, n, d): occurrences by term and what ``doc_id`` names, a language say, and rows that hold the term; summed within a
    batch before the one shuffle.  tokens: (doc_id, tokens) or (doc_id, text)."""
    own = tokens.select("doc_id", "text" if "text" in tokens.columns else "tokens")
    read = _arrays.reader(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _arrays.slices(read(batches), "tokens", _arrays.WORDS):
            found, numbers, rows = _arrays.encoded(part.column("tokens"))
            keys = part.column("doc_id").dictionary_encode("encode")
            row, term, n = _arrays.row_counts(rows, numbers, len(found))
            cells = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * len(found) + term
            every = len(keys.dictionary) * len(found)
            if every <= 8 * len(cells):  # few keys: a place for each of their terms
                d, n = (np.bincount(cells, weights, every) for weights in (None, n))
                held = np.flatnonzero(d)
                d, n = d[held], n[held].astype(np.int64)
            else:
                held, at = np.unique(cells, return_inverse=True)
                d, n = np.bincount(at), np.bincount(at, n).astype(np.int64)
            yield pa.record_batch([keys.dictionary.take(pa.array(held // max(len(found), 1))), found.take(pa.array(held % max(len(found), 1))), pa.array(n), pa.array(d)], ["doc_id", "term", "n", "d"])

    out = T.StructType([own.schema["doc_id"], *T._parse_datatype_string("term string, n long, d long")])
    return own.mapInArrow(run, out).groupBy("doc_id", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def vocabulary_of_counts(counts: DataFrame, document_count: int) -> Vocabulary:
    """The vocabulary that ``create_vocabulary`` makes of the same rows, from their ``counts_by``."""
    terms = counts.filter("term <> ''").groupBy("term").agg(F.sum("n").cast("long").alias("term_count"), F.sum("d").cast("long").alias("doc_count"))
    return Vocabulary(terms, document_count)


def vocabulary_of_terms(terms: DataFrame, ngram: tuple[int, int] = (1, 1), stopwords: list[str] = (), sep: str = "_") -> Vocabulary:
    """A vocabulary given by its terms; counts are unknown (null).  terms: (term)."""
    own = terms.select("term").filter("term IS NOT NULL AND term <> ''").distinct()
    if stopwords:
        own = own.filter(~F.col("term").isin(*stopwords))
    null = F.lit(None).cast("long")
    return Vocabulary(own.select("term", null.alias("term_count"), null.alias("doc_count")), None, tuple(ngram), tuple(stopwords), sep)


def combine(*vocabularies: Vocabulary) -> Vocabulary:
    """Sum of vocabularies: union of stopwords, n-gram range and separator of the first."""
    union = reduce(DataFrame.unionByName, [v.terms for v in vocabularies])
    terms = union.groupBy("term").agg(F.sum("term_count").alias("term_count"), F.sum("doc_count").alias("doc_count"))
    stopwords = tuple(dict.fromkeys(w for v in vocabularies for w in v.stopwords))
    counts = [v.document_count for v in vocabularies]
    return replace(vocabularies[0], terms=terms, stopwords=stopwords, document_count=None if None in counts else sum(counts), by_count_desc=False)


def prune(v: Vocabulary, term_count_min: int = 1, term_count_max: float = float("inf"), doc_proportion_min: float = 0.0, doc_proportion_max: float = 1.0, doc_count_min: int = 1, doc_count_max: float = float("inf"), vocab_term_max: float = float("inf")) -> Vocabulary:
    """Terms within all bounds (inclusive); then the ``vocab_term_max`` most frequent, ties by term.

    ``document_count`` stays what it was.  Bounds on counts leave terms of unknown count alone.
    """
    within = lambda c, low, high: F.coalesce((c >= low) & (c <= high), F.lit(True))
    terms = v.terms.filter(within(F.col("term_count"), term_count_min, term_count_max) & within(F.col("doc_count"), doc_count_min, doc_count_max))
    if v.document_count and (doc_proportion_min > 0 or doc_proportion_max < 1):
        terms = terms.filter(within(F.col("doc_count") / v.document_count, doc_proportion_min, doc_proportion_max))
    if vocab_term_max != float("inf"):
        terms = terms.orderBy(F.desc("term_count"), "term").limit(int(vocab_term_max))
        return replace(v, terms=terms, by_count_desc=True)
    return replace(v, terms=terms)
