"""Evaluation: perplexity, topic coherence, analogies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similarity

METRICS = tuple(f"mean_{x}" for x in "pmi npmi logratio difference npmi_cosim npmi_cosim2".split())


def perplexity(dtm: DataFrame, topic_word: DataFrame, doc_topic: DataFrame) -> DataFrame:
    """One row (perplexity): exp(-sum x ln(theta . phi + 1e-16) / sum x).

    topic_word: (column, phi array); doc_topic: (doc_id, theta array).
    """
    joined = dtm.join(topic_word, "column").join(doc_topic, "doc_id")
    p = F.aggregate(F.zip_with("theta", "phi", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return joined.agg(F.exp(-F.sum(F.col("value") * F.ln(p + 1e-16)) / F.sum("value")).alias("perplexity"))


def coherence(top_terms: DataFrame, tcm: DataFrame, metrics: tuple[str, ...] = METRICS, smooth: float = 1e-12, n_docs: int = -1) -> DataFrame:
    """(topic, metric, value): coherence of topics' top terms by a symmetric co-occurrence matrix.

    top_terms: (topic, place, term); tcm: (i, j, value) with both halves and the diagonal.
    Only cells of top terms take part.  A topic with fewer than two known terms has null.
    """
    unknown = [m for m in metrics if m not in METRICS]
    if unknown or (n_docs <= 0 and set(metrics) != {"mean_logratio"}):
        raise ValueError(f"unknown metrics {unknown}" if unknown else "n_docs must be given")
    top_terms = top_terms.select("topic", "place", "term")
    own = top_terms.select("term").distinct()
    cells = tcm.join(own.select(F.col("term").alias("i")), "i", "left_semi").join(own.select(F.col("term").alias("j")), "j", "left_semi")
    known = cells.filter("i = j").select(F.col("i").alias("term"), F.col("value").alias("n"))
    # the order in which terms first appear over all topics decides which of a pair is the earlier one
    first = top_terms.groupBy("term").agg(F.min(F.struct("topic", "place")).alias("first"))
    terms = top_terms.join(known, "term").join(first, "term")
    side = lambda name, alias: F.col(name).alias(alias)
    a = terms.select("topic", side("term", "a"), side("place", "pa"), side("n", "na"), side("first", "fa"))
    b = terms.select("topic", side("term", "b"), side("place", "pb"), side("n", "nb"), side("first", "fb"))
    pairs = a.join(b, "topic").filter("pa < pb").join(cells.select(side("i", "a"), side("j", "b"), side("value", "nab")), ["a", "b"], "left")
    pairs = pairs.withColumn("nab", F.coalesce("nab", F.lit(0.0)))
    n = F.lit(float(max(n_docs, 1)))
    pa, pb, pab = F.col("na") / n, F.col("nb") / n, F.col("nab") / n
    pmi = F.log2(pab + smooth) - F.log2(pa) - F.log2(pb)
    npmi = pmi / -F.log2(pab + smooth)
    low = F.when(F.col("fa") < F.col("fb"), F.col("na")).otherwise(F.col("nb"))
    made: dict[str, Column] = {"mean_logratio": F.ln((F.col("nab") + smooth) / low), "mean_pmi": pmi, "mean_npmi": npmi, "mean_difference": pab / pa - pb}
    simple = [m for m in metrics if m in made]
    out = pairs.groupBy("topic").agg(*(F.avg(made[m]).alias(m) for m in simple)) if simple else None
    parts = [out.select("topic", F.lit(m).alias("metric"), F.col(m).alias("value")) for m in simple] if out is not None else []
    for m in metrics:
        if m in made:
            continue
        # rows of the symmetric npmi matrix, its diagonal included
        square = a.join(b, "topic").join(cells.select(side("i", "a"), side("j", "b"), side("value", "nab")), ["a", "b"], "left").withColumn("nab", F.coalesce("nab", F.lit(0.0)))
        square = square.withColumn("x", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(npmi))
        rows = square.groupBy("topic", "a").agg(F.transform(F.sort_array(F.collect_list(F.struct("pb", "x"))), lambda s: s["x"]).alias("row"))
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        if m == "mean_npmi_cosim":
            sums = square.groupBy("topic", "b", "pb").agg(F.sum("x").alias("s")).groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("pb", "s"))), lambda s: s["s"]).alias("total"))
            cos = rows.join(sums, "topic").select("topic", (dot("row", "total") / F.sqrt(dot("row", "row") * dot("total", "total"))).alias("c"))
        else:
            other = rows.select("topic", side("a", "b"), side("row", "row2"))
            cos = rows.join(other, "topic").filter("a < b").select("topic", (dot("row", "row2") / F.sqrt(dot("row", "row") * dot("row2", "row2"))).alias("c"))
        counts = terms.groupBy("topic").agg(F.count("*").alias("k")).filter("k > 1")
        parts.append(cos.join(counts, "topic", "left_semi").groupBy("topic").agg(F.avg("c").alias("value")).select("topic", F.lit(m).alias("metric"), "value"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    wanted = top_terms.select("topic").distinct().select("topic", F.explode(F.array(*(F.lit(m) for m in metrics))).alias("metric"))
    return wanted.join(found, ["topic", "metric"], "left")


def analogies(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(category, question, predicted, actual): the term nearest to b + c - a by cosine, a, b and c excluded.

    questions: (category, question, a, b, c, d); vectors: (id, v).  Questions go out in blocks.
    """
    scaled = vectors.select("id", similarity.unit(F.col("v"), "l2").alias("v"))
    asked = questions
    for k in "abc":
        asked = asked.join(scaled.select(F.col("id").alias(k), F.col("v").alias(f"v{k}")), k)
    target = F.zip_with(F.zip_with("vb", "vc", lambda x, y: x + y), "va", lambda x, y: x - y)
    queries = asked.select(F.col("question").cast("long").alias("id"), target.alias("v"))
    # the best four of a task hold one that is none of a, b, c
    close = similarity.dense(queries, scaled, "cosine", "l2", top=4).withColumnRenamed("x_id", "question")
    free = close.join(questions.select("question", "a", "b", "c"), "question").filter("y_id <> a AND y_id <> b AND y_id <> c")
    best = free.groupBy("question").agg(F.max(F.struct("value", -F.col("y_id"))).alias("best"))
    return questions.join(best, "question").select("category", "question", (-F.col("best.col2")).alias("predicted"), F.col("d").alias("actual"))


def accuracy(answers: DataFrame) -> DataFrame:
    """(category, n, share right)."""
    return answers.groupBy("category").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("accuracy"))


