"""Latent semantic analysis: truncated singular value decomposition of a document-term matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import log, materialize
from . import _arrays
from .rows import CELLS, cells_of, column_sums, is_listed, rows_of

#: Bytes of a block of vectors as long as the vocabulary: what a pass sends out, and what a task adds up.
BLOCK_BYTES = 64 << 20
#: Bytes of vectors and their images that the driver holds before it starts again from the best vectors.
HELD_BYTES = 256 << 20


def _times(sizes: np.ndarray, at: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of a batch times q, a column at a time."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.stack([np.bincount(row, values * q[:, j].take(at), len(sizes)) for j in range(q.shape[1])], axis=1)


@dataclass
class LatentSemanticAnalysis:
    """``topics``: (column, v) with v the term's loadings; ``singular``: singular values.

    Block Krylov iteration: a pass over the listed rows multiplies a block of vectors by the Gram matrix where the rows
    lie, so only vectors as long as the vocabulary reach the driver.  It ends when the residuals of all vectors are
    below ``tol`` of their eigenvalues.  Signs are set so that each loading of greatest size is positive.
    """

    n_topics: int = 10
    tol: float = 1e-10
    max_passes: int = 300
    topics: DataFrame | None = None
    singular: np.ndarray | None = None
    explained: np.ndarray | None = None
    total_variance: float | None = None
    passes: int = 0
    loadings: np.ndarray | None = None

    def fit(self, dtm: DataFrame, ids: DataFrame, n_docs: int) -> LatentSemanticAnalysis:
        """dtm: long or listed rows; ids: (term, term_id); n_docs counts empty documents too."""
        spark, width = dtm.sparkSession, ids.count()
        rows = dtm if is_listed(dtm) else materialize(rows_of(dtm, ids), "lsa-rows")
        values, v, sums, squares = self._decompose(rows, width)
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
        self.singular, self.loadings = np.sqrt(values), v
        table = spark.createDataFrame(pa.table({"term_id": pa.array(np.arange(width), pa.int32()), "v": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))})) if width else spark.createDataFrame([], "term_id int, v array<double>")
        self.topics = ids.select(F.col("term").alias("column"), "term_id").join(table, "term_id").select("column", "v")
        # population variance of the scores and of all columns, implicit zeros included
        self.explained = values / n_docs - (sums @ v / n_docs) ** 2
        self.total_variance = float(squares / n_docs - ((sums / n_docs) ** 2).sum())
        return self

    def _decompose(self, rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(eigenvalues, vectors) of the Gram matrix, greatest first; column sums; sum of squares."""
        context = rows.sparkSession.sparkContext
        k = min(self.n_topics, width)
        block = max(min(k + 5, width, BLOCK_BYTES // (8 * max(width, 1))), 1)
        keep = min(width, k + 5)
        most = max(keep + 2 * block, HELD_BYTES // (16 * max(width, 1)))

        def gram(q: np.ndarray, first: bool) -> np.ndarray:
            """Gram matrix times q; at first also the columns' sums and sums of squares."""
            sent, b = context.broadcast(np.asfortranarray(q)), q.shape[1]

            def of(sizes, at, values, total):
                n, y = len(total), _times(sizes, at, values, sent.value)
                for j in range(b):
                    total[:, j] += np.bincount(at, values * np.repeat(y[:, j], sizes), n)
                if first:
                    total[:, b] += np.bincount(at, values, n)
                    total[:, b + 1] += np.bincount(at, values * values, n)

            made = column_sums(rows, width, b + 2 * first, of)
            sent.destroy()
            self.passes += 1
            return made

        def orthogonal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
            """An orthonormal basis of what x adds to ``basis``."""
            scale = np.linalg.norm(x, axis=0)
            x = x[:, scale > 0] / scale[scale > 0]
            for _ in range(2):
                x = x - basis @ (basis.T @ x)
            q, r = np.linalg.qr(x)
            q = q[:, np.abs(np.diag(r)) > 1e-10]
            q = q - basis @ (basis.T @ q)
            return np.linalg.qr(q)[0] if q.shape[1] else q

        self.passes = 0
        if not k:
            return np.zeros(0), np.zeros((width, 0)), np.zeros(width), 0.0
        q = np.linalg.qr(np.random.default_rng(1).standard_normal((width, block)))[0]
        made = gram(q, True)
        sums, squares = made[:, -2], float(made[:, -1].sum())
        basis, image = q, made[:, :-2]
        last = image
        while True:
            small = basis.T @ image
            values, u = np.linalg.eigh((small + small.T) / 2)
            values, u = values[::-1], u[:, ::-1]
            n = min(k, len(values))
            vectors, residual = basis @ u[:, :n], image @ u[:, :n]
            residual = residual - vectors * values[:n]
            error = np.linalg.norm(residual, axis=0)
            log.info("lsa: pass %d, %d vectors, error %.2e", self.passes, basis.shape[1], (error / np.maximum(values[:n], 1e-300)).max())
            if n == k and (error <= self.tol * np.maximum(values[:n], values[0] * 1e-18)).all() or self.passes >= self.max_passes or basis.shape[1] >= width:
                break
            more = last
            if basis.shape[1] + block > most:  # from the best vectors, with their images
                u = u[:, :keep]
                more = np.concatenate([orthogonal(last, basis), residual], axis=1)
                basis, image = basis @ u, image @ u
            q = orthogonal(more, basis)[:, :block]
            if not q.shape[1]:
                break
            last = gram(q, False)
            basis, image = np.concatenate([basis, q], axis=1), np.concatenate([image, last], axis=1)
        held = values[:n] > values[0] * 1e-18  # singular values above 1e-9 of the greatest, as Spark's solver has it
        return values[:n][held], vectors[:, held], sums, squares

    def transform(self, dtm: DataFrame) -> DataFrame:
        """(doc_id, topics) = rows times loadings; the same for training rows as the fit gives."""
        k = len(self.singular)
        if is_listed(dtm):
            return self._transform_rows(dtm)
        joined = dtm.join(self.topics, "column")
        return joined.groupBy("doc_id").agg(F.array(*(F.sum(F.col("value") * F.get("v", F.lit(i))) for i in range(k))).alias("topics"))

    def _transform_rows(self, rows: DataFrame) -> DataFrame:
        sent, k = rows.sparkSession.sparkContext.broadcast(np.asfortranarray(self.loadings)), len(self.singular)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _arrays.slices(batches, "at", CELLS):
                score = _times(*cells_of(part), sent.value)
                yield pa.record_batch([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), k).cast(pa.list_(pa.float64()))], ["doc_id", "topics"])

        return rows.select("doc_id", "at", "values").mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("topics", T.ArrayType(T.DoubleType()))]))

    def fit_transform(self, dtm: DataFrame, ids: DataFrame, n_docs: int) -> DataFrame:
        return self.fit(dtm, ids, n_docs).transform(dtm)

    def explained_variance_ratio(self) -> np.ndarray:
        return self.explained / self.total_variance
