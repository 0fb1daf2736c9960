"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - margin), with one set of hashed-text weights
for all grades and ordered thresholds.  Weights are learned with per-coordinate rates
and L1 from a bounded sample (see ``_hashed``).  Besides words, the text's shape is
hashed: rates of symbols, shouting, repeated words and lines in a few steps each.  The
model gives the expected grade and the tail probabilities for selection.

Grades: 0 poor, 1 good but toxic, 2 good; from the label columns ``quality`` and ``toxic``.

Defined results
* null or empty text: judged by its shape (no words) alone.
* null doc_id and repeated rows: each row is judged by itself.
* a label with a null part, a null id or a held-out id: not learned from; repeated
  labels of an id count as its highest grade.
* no labels: all grades equally likely.  A grade never seen: its thresholds stay
  ordered, at a distance.
* very long texts: every word counts.  Other columns, whatever their names: ignored.
* empty table: empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashed
from ._arrow import SPACE, project
from .quality_rules import SYMBOLS, dup_lines, repeat_words
from .toxicity import sigmoid

GRADE = "CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END"
N_GRADES = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 1.0
_STEPS = (0, 5, 10, 20, 50, 100, 200, 350, 500, 700, 1000)


def shape(text: bytes) -> list[bytes]:
    """Names of the shape features of a text: rates in per mille, in steps."""
    words = text.split()
    n = max(len(words), 1)
    chars = max(len(text) - (len(text) - len(text.translate(None, SPACE))), 1)
    dups, lines = dup_lines(text)
    rates = {
        "symbols": (len(text) - len(text.translate(None, SYMBOLS))) * 1000 // chars,
        "shouts": text.count(b"!!") * 1000 // n,
        "upper": sum(map(bytes.isupper, words)) * 1000 // n,
        "repeats": repeat_words(words) * 1000 // n,
        "dups": dups * 1000 // max(lines, 1),
    }
    named = [f"\0{k}>{step}".encode() for k, v in rates.items() for step in _STEPS if v > step]
    return named + [f"\0words>{1 << k}".encode() for k in range(12) if len(words) > 1 << k]


class Ordinal(_hashed.Learner):
    """Cumulative-link loss; ``rest`` holds the ordered thresholds and the sums of their squared gradients."""

    def __init__(self, counts: dict[int, int]):
        n = np.array([counts.get(k, 0) for k in range(N_GRADES)], float)
        share = np.cumsum(n + 0.5)[:-1] / (n.sum() + 0.5 * N_GRADES)
        super().__init__(_hashed.Ftrl(ALPHA, BETA, L1, L2), [*np.log(share / (1 - share)), *[1.0] * (N_GRADES - 1)])

    def visit(self, own: np.ndarray, grade: int) -> None:
        last = N_GRADES - 1
        cuts, seen = self.rest[:last], self.rest[last:]  # views
        w = self.model.weights(own)
        margin = w.sum()
        below = float(sigmoid(cuts[grade - 1] - margin)) if grade else 0.0
        upto = float(sigmoid(cuts[grade] - margin)) if grade < last else 1.0
        mass = max(upto - below, 1e-6)
        self.model.update(own, w, 1.0 - upto - below)
        for k, g in ((grade, -upto * (1 - upto) / mass), (grade - 1, below * (1 - below) / mass)):
            if 0 <= k < last and g:
                seen[k] += g * g
                cuts[k] -= 0.1 * g / seen[k] ** 0.5
        cuts[:] = np.maximum.accumulate(cuts + np.arange(last) * 1e-9)


def quality_grades(docs: DataFrame, labels: DataFrame, grade: str = GRADE, doc_id: str = "doc_id", text: str = "text", sample_rows: int = _hashed.SAMPLE_ROWS, keep_at: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_grade1, p_grade2, kept): kept if P(grade >= 1) reaches ``keep_at``."""
    sample = _hashed.labelled(docs, labels, grade, sample_rows, shape, doc_id=doc_id, text=text)
    at, weight, rest = _hashed.train(sample, Ordinal)
    cuts = rest[: N_GRADES - 1]

    def finish(margin: np.ndarray) -> dict[str, np.ndarray]:
        tails = [1.0 - sigmoid(cut - margin) for cut in cuts]
        return {"expected_grade": np.sum(tails, axis=0) if len(margin) else margin, "p_grade1": tails[0], "p_grade2": tails[1]}

    scored = _hashed.score(project(docs, doc_id=doc_id, text=text), at, weight, finish, "expected_grade double, p_grade1 double, p_grade2 double", shape)
    return scored.withColumn("kept", F.col("p_grade1") >= keep_at)
