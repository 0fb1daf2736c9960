"""Reweighting of document-term matrices: TF-IDF and bi-normal separation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import qnorm
from .matrix import normalize


@dataclass
class TfIdf:
    """idf is ln(1 + N / df), or ln(N / df) unless smooth; N counts all documents, empty ones too."""

    smooth_idf: bool = True
    norm: str = "l1"
    sublinear_tf: bool = False
    idf: DataFrame | None = None

    def prepare(self, dtm: DataFrame) -> DataFrame:
        if self.sublinear_tf:
            dtm = dtm.withColumn("value", F.when(F.col("value") != 0, 1 + F.ln("value")).otherwise(F.col("value")))
        return normalize(dtm, self.norm)

    def fit(self, dtm: DataFrame, n_docs: int) -> TfIdf:
        ratio = F.lit(float(n_docs)) / F.count(F.when(F.col("value") != 0, 1))
        self.idf = dtm.groupBy("column").agg((F.log1p(ratio) if self.smooth_idf else F.ln(ratio)).alias("idf"))
        return self

    def transform(self, dtm: DataFrame) -> DataFrame:
        if self.idf is None:
            raise ValueError("fit before transform")
        return self.prepare(dtm).join(self.idf, "column").select("doc_id", "column", (F.col("value") * F.col("idf")).alias("value"))

    def fit_transform(self, dtm: DataFrame, n_docs: int) -> DataFrame:
        return self.fit(dtm, n_docs).transform(dtm)


@dataclass
class BiNormalSeparation:
    """Cells become |bns| of their term: quantile of its rate among positives less that among negatives."""

    threshold: float = 0.0005
    stat: DataFrame | None = None

    def fit(self, dtm: DataFrame, y: DataFrame, terms: DataFrame) -> BiNormalSeparation:
        """y: (doc_id, positive boolean) of all documents; terms: (term), those absent from dtm count as never seen."""
        n_pos, n_neg = y.agg(F.count(F.when(F.col("positive"), 1)), F.count(F.when(~F.col("positive"), 1))).first()
        held = dtm.filter("value <> 0").join(y, "doc_id").groupBy("column").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("n"))
        full = terms.select("term").join(held, F.col("term") == F.col("column"), "left")
        clip = lambda c, n: F.least(F.greatest(F.coalesce(F.try_divide(c, F.lit(float(n))), F.lit(0.0)), F.lit(self.threshold)), F.lit(1 - self.threshold))
        bns: Column = qnorm(clip(F.col("p"), n_pos)) - qnorm(clip(F.col("n"), n_neg))
        self.stat = full.select("term", F.abs(bns).alias("bns"), (bns > 0).alias("positive"))
        return self

    def transform(self, dtm: DataFrame) -> DataFrame:
        if self.stat is None:
            raise ValueError("fit before transform")
        return dtm.filter("value <> 0").join(self.stat, F.col("column") == F.col("term")).select("doc_id", "column", F.col("bns").alias("value"))

    def fit_transform(self, dtm: DataFrame, y: DataFrame, terms: DataFrame) -> DataFrame:
        return self.fit(dtm, y, terms).transform(dtm)
