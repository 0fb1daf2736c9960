"""Topic model: latent Dirichlet allocation by Metropolis-Hastings with delayed counts.

A document is one row with its tokens' terms and topics.  In an iteration every token
gets two proposals: one from its term's counts, accepted by the document's, and one
from the document, accepted by the term's.  Counts of terms and topics are those of the
iteration's start, so documents are independent and a frequent term needs no group of
its own.  The table of counts is broadcast up to COUNT_BYTES; beyond it, each
document's terms bring their counts by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import log, materialize
from . import _arrays
from .rows import cells_of, column_sums, is_listed, lists, rows_of

COUNT_BYTES = 64 << 20
#: Tokens that are swept at a time; their arrays stay in a core's cache.
SWEPT = 1 << 16


_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from keys and the number of the draw alone, so they do not depend on batches or tasks."""
    x = keys + np.uint64(draw + 1) * _MIX[0]
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0**-53


@dataclass
class _Tokens:
    """All tokens of a batch of documents: their terms and topics, and for each the number and key of its document."""

    terms: np.ndarray
    z: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    of_term: np.ndarray  # counts of each token's term (tokens x topics)

    def sweep(self, totals: np.ndarray, alpha: float, beta: float, beta_sum: float, seed: int) -> None:
        """One iteration over every document of the batch at once."""
        k, n, z, doc = len(totals), len(self.z), self.z, self.doc
        if not n:
            return
        at = np.arange(n)
        keys = self.keys + np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
        weight = self.of_term + beta
        upto = weight.cumsum(axis=1)
        proposal = np.minimum((upto < (_uniform(keys, 0) * upto[:, -1])[:, None]).sum(axis=1), k - 1)
        own = np.bincount(doc * k + z, minlength=len(self.sizes) * k).reshape(-1, k)
        ratio = (own[doc, proposal] + alpha) / (own[doc, z] + alpha) * (totals[z] + beta_sum) / (totals[proposal] + beta_sum)
        z = np.where(_uniform(keys, 1) < ratio, proposal, z)
        size, starts = self.sizes[doc], (np.cumsum(self.sizes) - self.sizes)[doc]
        other = z[starts + np.minimum((_uniform(keys, 2) * size).astype(np.int64), size - 1)]
        proposal = np.where(_uniform(keys, 3) < size / (size + k * alpha), other, (_uniform(keys, 4) * k).astype(np.int64))
        ratio = weight[at, proposal] / weight[at, z] * (totals[z] + beta_sum) / (totals[proposal] + beta_sum)
        self.z = np.where(_uniform(keys, 5) < ratio, proposal, z)


@dataclass
class LatentDirichletAllocation:
    """``counts``: (term_id, n) with n the term's tokens in each topic."""

    n_topics: int = 10
    doc_topic_prior: float | None = None
    topic_word_prior: float | None = None
    n_iter_inference: int = 10
    #: The normaliser's prior: topics times prior, as the sampler's usual formulation here has it, or terms times prior.
    per_term_normalizer: bool = False
    seed: int = 1
    counts: DataFrame | None = None
    trace: list[tuple[int, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.doc_topic_prior = self.doc_topic_prior or 50 / self.n_topics
        self.topic_word_prior = self.topic_word_prior or 1 / self.n_topics

    @staticmethod
    def rows(dtm: DataFrame, ids: DataFrame) -> DataFrame:
        """(doc_id, terms): a document's term ids, each as often as it occurs.  dtm: long or listed rows."""
        listed = rows_of(dtm if is_listed(dtm) else dtm.filter("value >= 1"), ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _arrays.slices(batches, "at"):
                sizes, at, values = cells_of(part)
                n, row = np.floor(np.maximum(values, 0)).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
                own = np.bincount(row, n, len(sizes)).astype(np.int64)
                made = pa.record_batch([part.column("doc_id"), *lists(own, np.repeat(at, n).astype(np.int32))], ["doc_id", "terms"])
                yield made.filter(pa.array(own > 0))

        return listed.select("doc_id", "at", "values").mapInArrow(run, T.StructType([listed.schema["doc_id"], T.StructField("terms", T.ArrayType(T.IntegerType()))]))

    def _counts(self, state: DataFrame) -> DataFrame:
        k = self.n_topics

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _arrays.slices(batches, "terms"):
                _, term, z = cells_of(part, "terms", "z")
                terms, at = np.unique(term, return_inverse=True)
                n = np.bincount(at * k + z, minlength=len(terms) * k).reshape(-1, k)
                yield pa.record_batch([pa.array(terms), *(pa.array(n[:, j]) for j in range(k))], ["term_id", *(f"n{j}" for j in range(k))])

        made = state.select("terms", "z").mapInArrow(run, ", ".join(["term_id long", *(f"n{j} long" for j in range(k))]))
        summed = made.groupBy("term_id").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(k)))
        return summed.select("term_id", F.array(*(F.col(f"n{j}") for j in range(k))).alias("n"))

    def _summed(self, state: DataFrame, width: int) -> np.ndarray:
        """Counts as an array with a row for each term id, and one of zeros at the end: a task sends one table."""
        k = self.n_topics

        def of(sizes: np.ndarray, terms: np.ndarray, z: np.ndarray, total: np.ndarray) -> None:
            for j in range(k):
                total[:, j] += np.bincount(terms[z == j], minlength=len(total))

        return column_sums(state, width + 1, k, of, "terms", "z")

    def _listed(self, counts: np.ndarray, spark: SparkSession) -> DataFrame:
        """(term_id, n) of an array of counts, terms that occur alone."""
        at = np.flatnonzero(counts.any(axis=1))
        n = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * self.n_topics, pa.int32()), pa.array(counts[at].astype(np.int64).ravel()))
        return spark.createDataFrame(pa.table({"term_id": pa.array(at.astype(np.int64)), "n": n}))

    def _dense(self, counts: DataFrame) -> np.ndarray:
        """Counts as an array with a row for each term id, and one of zeros at the end."""
        held = counts.toArrow()
        at = held.column("term_id").to_numpy()
        dense = np.zeros((int(at.max(initial=-1)) + 2, self.n_topics))
        dense[at] = held.column("n").combine_chunks().flatten().to_numpy().reshape(-1, self.n_topics)
        return dense

    def _with_counts(self, state: DataFrame, counts: DataFrame | np.ndarray):
        """The documents with what their terms need, and a reader that gives (doc_ids, lists of terms, tokens) by batch.

        ``counts`` is an array if it may be broadcast, else a table.
        """
        k = self.n_topics
        if isinstance(counts, np.ndarray):
            sent, source = state.sparkSession.sparkContext.broadcast(counts), state.withColumn("of", F.lit(None).cast("array<array<bigint>>"))
        else:
            sent = None
            exploded = state.select("doc_id", "z", F.posexplode("terms").alias("pos", "term_id")).join(counts, "term_id", "left")
            none = F.array_repeat(F.lit(0).cast("long"), k)
            source = exploded.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term_id", F.coalesce("n", none).alias("n"), F.get("z", F.col("pos")).alias("z")))).alias("x"))
            source = source.select("doc_id", F.transform("x", lambda x: x["term_id"]).alias("terms"), F.transform("x", lambda x: x["z"]).alias("z"), F.transform("x", lambda x: x["n"]).alias("of"))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, _Tokens]]:
            for part in _arrays.slices(batches, "terms", SWEPT):
                lists = part.column("terms")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                terms, z = lists.flatten().to_numpy().astype(np.int64), part.column("z").flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(terms)) - (np.cumsum(sizes) - sizes)[doc]
                keys = part.column("key").to_numpy().astype(np.uint64)[doc] + place.astype(np.uint64) * _MIX[1]
                of = sent.value[np.minimum(terms, len(sent.value) - 1)] if sent is not None else part.column("of").flatten().flatten().to_numpy().reshape(-1, k).astype(float)
                yield part.column("doc_id"), lists, _Tokens(terms, z, doc, sizes, keys, of)

        return source.select("doc_id", "terms", "z", "of", F.xxhash64("doc_id").alias("key")), read

    def fit(self, dtm: DataFrame, ids: DataFrame, n_iter: int = 100, check_every: int = 10, tol: float = 1e-3) -> LatentDirichletAllocation:
        """Sample until the pseudo log-likelihood grows by less than ``tol`` (relative) between checks."""
        k, seed = self.n_topics, self.seed
        start = F.transform("terms", lambda t, i: F.pmod(F.xxhash64(F.col("doc_id"), i, F.lit(seed)), F.lit(k)).cast("int"))
        state = materialize(self.rows(dtm, ids).withColumn("z", start), "lda-state")
        out = T.StructType([state.schema["doc_id"], *T._parse_datatype_string("terms array<int>, z array<int>")])
        n_terms, width = ids.agg(F.count("*"), F.coalesce(F.max("term_id"), F.lit(-1)) + 1).first()
        small = width * k * 8 <= COUNT_BYTES
        take = lambda state: self._summed(state, width) if small else materialize(self._counts(state), "lda-counts")
        beta_sum = self.topic_word_prior * (n_terms if self.per_term_normalizer else k)
        before, self.trace = float("-inf"), []
        counts = take(state)
        for i in range(1, n_iter + 1):
            source, read = self._with_counts(state, counts)
            state = materialize(source.mapInArrow(self._iteration(read, self._totals(counts), beta_sum, i), out), "lda-state")
            counts = take(state)
            if i % check_every == 0:
                now = self._likelihood(counts, beta_sum)
                self.trace.append((i, now))
                log.info("topic model: iteration %d, pseudo log-likelihood %.3f", i, now)
                if before > float("-inf") and before / now - 1 < tol:
                    break
                before = now
        self.counts = materialize(self._listed(counts, state.sparkSession), "lda-counts") if small else counts
        return self

    def _iteration(self, read, totals: np.ndarray, beta_sum: float, i: int):
        alpha, beta, seed = self.doc_topic_prior, self.topic_word_prior, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc_ids, lists, tokens in read(batches):
                tokens.sweep(totals, alpha, beta, beta_sum, (seed << 20) + i)
                at = pa.array(np.concatenate([[0], np.cumsum(tokens.sizes)]), pa.int32())
                yield pa.record_batch([doc_ids, lists.cast(pa.list_(pa.int32())), pa.ListArray.from_arrays(at, pa.array(tokens.z, pa.int32()))], ["doc_id", "terms", "z"])

        return run

    def _totals(self, counts: DataFrame | np.ndarray) -> np.ndarray:
        if isinstance(counts, np.ndarray):
            return counts.sum(axis=0)
        return np.array(counts.agg(*(F.coalesce(F.sum(F.get("n", F.lit(k))), F.lit(0)) for k in range(self.n_topics))).first(), float)

    def _likelihood(self, counts: DataFrame | np.ndarray, beta_sum: float) -> float:
        totals = self._totals(counts)
        if isinstance(counts, np.ndarray):
            cells = float((counts * np.log(np.where(counts > 0, counts + self.topic_word_prior, 1.0))).sum())
        else:
            cell = F.aggregate("n", F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x + self.topic_word_prior)).otherwise(F.lit(0.0)))
            cells = float(counts.agg(F.coalesce(F.sum(cell), F.lit(0.0))).first()[0])
        return cells - float((totals * np.log(totals + beta_sum)).sum())

    def transform(self, dtm: DataFrame, ids: DataFrame) -> DataFrame:
        """(doc_id, topics): shares from the last ``n_iter_inference`` samples with frozen term counts; all in one pass."""
        k, alpha, beta, seed, rounds = self.n_topics, self.doc_topic_prior, self.topic_word_prior, self.seed, self.n_iter_inference
        totals = self._totals(self.counts)
        beta_sum = beta * (self.counts.count() if self.per_term_normalizer else k)
        start = F.transform("terms", lambda t, i: F.pmod(F.xxhash64(F.col("doc_id"), i, F.lit(seed)), F.lit(k)).cast("int"))
        state = self.rows(dtm, ids).withColumn("z", start)

        source, read = self._with_counts(state, self._dense(self.counts) if self.counts.count() * k * 8 <= COUNT_BYTES else self.counts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc_ids, _, tokens in read(batches):
                total = np.zeros(len(tokens.sizes) * k)
                for r in range(rounds):
                    tokens.sweep(totals, alpha, beta, beta_sum, (seed << 20) - 1 - r)
                    total += np.bincount(tokens.doc * k + tokens.z, minlength=len(total))
                share = total.reshape(-1, k)
                share = share / np.maximum(share.sum(axis=1, keepdims=True), 1)
                yield pa.record_batch([doc_ids, *lists(np.full(len(share), k), share.ravel())], ["doc_id", "topics"])

        return source.mapInArrow(run, T.StructType([state.schema["doc_id"], *T._parse_datatype_string("topics array<double>")]))

    def fit_transform(self, dtm: DataFrame, ids: DataFrame, **parameters: object) -> DataFrame:
        return self.fit(dtm, ids, **parameters).transform(dtm, ids)

    def topic_word(self) -> DataFrame:
        """(topic, term_id, n, share): share of the term in its topic."""
        long = self.counts.select("term_id", F.posexplode("n").alias("topic", "n"))
        totals = self._totals(self.counts)
        total = F.element_at(F.array(*(F.lit(float(max(x, 1))) for x in totals)), F.col("topic") + 1)
        return long.select("topic", "term_id", "n", (F.col("n") / total).alias("share"))

    def top_words(self, n: int = 10, relevance: float = 1.0) -> DataFrame:
        """(topic, term_id, place): the n most relevant terms of each topic."""
        return top_words(self.topic_word(), n, relevance)


    def viewer(self, n_terms: int = 30) -> dict[str, object]:
        """What a topic viewer draws, ready for JSON: topics with their place in a plane and share, and their terms with smoothed shares.

        The terms are the ``n_terms`` most relevant of each topic at a relevance of 1 and of 0 (a report of bounded size).
        The map needs the shares of all terms: topics x terms numbers, bounded as the model's counts are for a broadcast.
        """
        n = self.counts.count()
        if n * self.n_topics * 8 > COUNT_BYTES:
            raise ValueError("too many terms for a map; prune the vocabulary")
        held = self.counts.orderBy("term_id").toArrow()
        phi = held.column("n").combine_chunks().flatten().to_numpy().reshape(-1, self.n_topics).T + self.topic_word_prior
        totals = self._totals(self.counts)
        phi = phi / phi.sum(axis=1, keepdims=True)
        place = topic_map(phi) if self.n_topics > 2 and n else np.zeros((self.n_topics, 2))
        at = {t: k for k, t in enumerate(held.column("term_id").to_pylist())}
        both = self.top_words(n_terms, 1.0).unionByName(self.top_words(n_terms, 0.0)).select("topic", "term_id").distinct()
        terms = [{"topic": r["topic"], "term_id": r["term_id"], "share": float(phi[r["topic"], at[r["term_id"]]])} for r in both.orderBy("topic", "term_id").collect()]
        topics = [{"topic": k, "x": float(x), "y": float(y), "share": float(totals[k] / max(totals.sum(), 1))} for k, (x, y) in enumerate(place)]
        return {"topics": topics, "terms": terms}


def top_words(topic_word: DataFrame, n: int = 10, relevance: float = 1.0) -> DataFrame:
    """Terms by relevance * ln share + (1 - relevance) * ln (share / share in all topics).  topic_word: (topic, term_id, n, share)."""
    total = topic_word.agg(F.sum("n")).first()[0] or 1
    overall = topic_word.groupBy("term_id").agg((F.sum("n") / total).alias("overall"))
    scored = topic_word.filter("n > 0").join(overall, "term_id").withColumn("relevance", relevance * F.ln("share") + (1 - relevance) * F.ln(F.col("share") / F.col("overall")))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("relevance"), "term_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= n).select("topic", "term_id", "place")


def topic_map(phi: np.ndarray) -> np.ndarray:
    """Topics (rows of phi) placed in a plane: classical scaling of their Jensen-Shannon divergences."""
    p = phi / phi.sum(axis=1, keepdims=True)
    entropy = lambda a, m: np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum()
    d = np.array([[0.5 * entropy(a, (a + b) / 2) + 0.5 * entropy(b, (a + b) / 2) for b in p] for a in p])
    centre = np.eye(len(p)) - 1 / len(p)
    value, vector = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    return vector[:, ::-1][:, :2] * np.sqrt(np.maximum(value[::-1][:2], 0))
