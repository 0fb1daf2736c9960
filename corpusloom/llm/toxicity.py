"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, word pairs, skip pairs and heads of long words are hashed to 2**20 slots;
per-coordinate learning rates and L1 leave some hundred weights, which are broadcast.
Training uses a bounded sample (SAMPLE_ROWS labelled rows, see ``_hashed``), scoring covers every whole text in one pass without a shuffle.

Defined results
* null or empty text: the score of a text without features (the intercept alone).
* null doc_id: scored, ``held_out`` false.  Repeated rows: each is scored.
* a label that is null or whose id is null or held out: not learned from; repeated
  labels of an id count as its highest.
* no labels at all: every score is 0; labels of one class only: the class's smoothed rate.
* very long texts: every word counts.  Other columns, whatever their names: ignored.
* empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashed
from ._arrow import give_back, project, slices, texts_of

ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 1.0


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Toxicity(_hashed.Learner):
    """Logistic loss; ``rest`` is the intercept and the sum of its squared gradients."""

    def __init__(self, counts: dict[int, int]):
        n, bad = sum(counts.values()), sum(x for grade, x in counts.items() if grade)
        rate = (bad + 0.5) / (n + 1)
        super().__init__(_hashed.Ftrl(ALPHA, BETA, L1, L2), [float(np.log(rate / (1 - rate))) if n else -40.0, 1.0])

    def visit(self, own: np.ndarray, grade: int) -> None:
        w = self.model.weights(own)
        gradient = float(sigmoid(w.sum() + self.rest[0])) - float(grade > 0)
        self.model.update(own, w, gradient)
        self.rest[1] += gradient * gradient
        self.rest[0] -= 0.1 * gradient / self.rest[1] ** 0.5


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample_rows: int = _hashed.SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights other than 0, and the intercept."""
    at, weight, (bias, *_) = _hashed.train(_hashed.labelled(docs, labels, label, sample_rows, doc_id=doc_id, text=text), Toxicity)
    return at, weight, bias


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample_rows: int = _hashed.SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    at, weight, bias = learn(docs, labels, label, doc_id, text, sample_rows)
    scored = _hashed.score(project(docs, doc_id=doc_id, text=text), at, weight, lambda m: {"score": sigmoid(m + bias)}, "score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", **parameters: object) -> DataFrame:
    """The rows of ``docs`` whose score stays below 0.5, as they are; filtered where they are read."""
    at, weight, bias = learn(docs, labels, text=text, **parameters)
    held = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(_hashed.SLOTS)
        dense[held.value[0]] = held.value[1]
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(sigmoid(_hashed.margins(texts_of(part.column(text)), dense) + bias) < 0.5))
        give_back()

    return docs.mapInArrow(run, docs.schema)
