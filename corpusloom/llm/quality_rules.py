"""Quality rules whose cutoffs come from the data: one mergeable sketch per language and source.

Every document gets a few counts (words, symbols, repeated lines, repeated
windows, shouting).  Fixed base rules reject the hopeless ones.  For the others
each feature is summarised per (lang, source) by a log-linear quantile sketch: a
histogram whose integer bins keep the top five bits of a value, so a quantile is
right to within 1/16 of its value.  Two sketches merge by adding counts, so they are
built by partial aggregation: a source with a third of all rows sends at most
one row per bin and task.  A group's sketch is merged with its language's, the latter scaled to
PRIOR documents, so that a group of a few documents follows its language.

Fences lie REACH quartile ranges beyond the quartiles, on a logarithmic scale: upper = q3 * (q3 / q1) ** REACH,
lower = q1 / (q3 / q1) ** REACH.  There is no constant in them; rates of counts that are mostly 0 get one more
count in numerator and denominator, which gives them a spread by the documents' lengths.  The
documents are joined with the fences.

Defined results
* null or empty text: no words, every count 0, ``base_failed``, not kept.
* null lang or source: a group of its own.
* null doc_id and repeated rows: each row is judged by itself and returned once.
* very long texts: counted whole.  Ties do not matter, no order is used.
* other columns, whatever their names: ignored.  Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import SPACE, map_batches, project, texts_of

SYMBOLS = b"#*$%&|<>"
#: feature -> whether it has a lower fence as well.
FEATURES = {"symbol_rate": False, "word_length": True, "dup_line_rate": False, "repeat_rate": False, "shout_rate": False}
#: Quartile ranges (as ratios) between a quartile and its fence.
REACH = 2
#: Documents for which the language's sketch counts in that of a group.
PRIOR = 50

_STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shouts long"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more (its first place included)."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, n)
    if len(seen) == n:
        return 0
    if len(seen) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * np.int64(len(seen)) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1].astype(np.int64) * np.int64(len(seen)) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    if b"\n" not in text:
        return 0, int(bool(text.strip(SPACE)))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines)), len(lines)


def _stats(part: pa.RecordBatch) -> dict[str, object]:
    texts = texts_of(part.column("text"))
    chars = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_pylist()
    made: dict[str, object] = {k: part.column(k) for k in ("doc_id", "lang", "source")}
    rows = []
    for text, n_chars in zip(texts, chars, strict=True):
        words = text.split()
        dups, lines = dup_lines(text)
        spaces = len(text) - len(text.translate(None, SPACE))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        rows.append((len(words), n_chars - spaces, symbols, dups, repeat_words(words), lines, text.count(b"!!")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")
    made |= dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T, strict=True))
    return made


def document_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row of counts per document; the whole text is read once, in Arrow batches."""
    return map_batches(project(docs, doc_id=doc_id, lang=lang, source=source, text=text), _stats, _STATS)


def features() -> dict[str, Column]:
    """The judged features as whole numbers: rates per million with one more count, letters a word per thousand."""
    rate = lambda a, b: F.expr(f"({a} + 1) * 1000000 div ({b} + 1)")
    return {
        "symbol_rate": rate("n_symbols", "word_chars"),
        "word_length": F.expr("word_chars * 1000 div greatest(n_words, 1)"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "shout_rate": rate("n_shouts", "n_words"),
    }


def _width(value: Column) -> Column:
    """Width of the bin that holds a whole number: a power of two that leaves five bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(value)) - 5, F.lit(0)))


def sketch_bin(value: Column) -> Column:
    """Log-linear bin of a whole number (0 or more), by its lower end: values below 32 as they are, else the top five bits kept."""
    return (value - value % _width(value)).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, feature, bin, n): mergeable by adding n."""
    judged = stats.filter(~F.col("base_failed"))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), sketch_bin(F.col(k)).alias("bin")) for k in FEATURES))).alias("p")
    return judged.select("lang", "source", pairs).groupBy("lang", "source", "p.feature", "p.bin").agg(F.count("*").alias("n"))


def with_language(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, feature, bin, weight): each group's sketch merged with its language's at the weight of ``prior`` documents.

    Weights are exact: counts times the language's documents, plus ``prior`` times the language's counts.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    of_lang = sketch.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n_lang"))
    totals = of_lang.groupBy("lang", "feature").agg(F.sum("n_lang").alias("total"))
    same = lambda a, b: (F.col(f"{a}.feature") == F.col(f"{b}.feature")) & F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang"))
    own = sketch.alias("s").join(totals.alias("t"), same("s", "t")).select("s.lang", "s.source", "s.feature", "s.bin", (whole("n") * whole("total")).cast("decimal(38,0)").alias("weight"))
    groups = sketch.select("lang", "source", "feature").distinct()
    lent = groups.alias("g").join(of_lang.alias("l"), same("g", "l")).select("g.lang", "g.source", "g.feature", "l.bin", (F.lit(prior) * whole("n_lang")).cast("decimal(38,0)").alias("weight"))
    return own.unionByName(lent).groupBy("lang", "source", "feature", "bin").agg(F.sum("weight").cast("decimal(38,0)").alias("weight"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <feature>_low, <feature>_high ...) from merged sketches."""
    group = Window.partitionBy("lang", "source", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("weight").over(upto)).withColumn("total", F.sum("weight").over(group))
    at = lambda num: F.min(F.when(F.col("upto") * 4 >= F.col("total") * num, F.col("bin")))
    quartiles = ranked.groupBy("lang", "source", "feature").agg(F.greatest(at(1), F.lit(1)).cast("double").alias("q1"), (at(3) + _width(at(3))).cast("double").alias("q3"))
    ratio, low, high = F.col("q3") / F.col("q1"), F.col("q1"), F.col("q3")
    for _ in range(REACH):
        low, high = low / ratio, high * ratio
    quartiles = quartiles.withColumn("low", low).withColumn("high", high)
    ends = [F.max(F.when(F.col("feature") == k, F.col(end))).alias(f"{k}_{end}") for k, lower in FEATURES.items() for end in (("low", "high") if lower else ("high",))]
    return quartiles.groupBy("lang", "source").agg(*ends)


def judge(stats: DataFrame) -> DataFrame:
    """Stats with features, fences, ``base_failed`` and ``kept``.

    The fences have one row per language and source.  The join compares null keys
    as equal; its size is left to the planner, so a big table of fences is
    shuffled and a skewed source is split by adaptive execution.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns(features())
    limits = fences(with_language(sketches(stats))).withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")
    fits = ~F.col("base_failed")
    for k, lower in FEATURES.items():
        fits = fits & F.coalesce(F.col(k) <= F.col(f"{k}_high"), F.lit(False))
        if lower:
            fits = fits & F.coalesce(F.col(k) >= F.col(f"{k}_low"), F.lit(False))
    return joined.withColumn("kept", fits).drop("fence_lang", "fence_source")


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Judge every document against the base rules and its group's adaptive fences."""
    from ..session import materialize

    return judge(materialize(document_stats(docs, **columns), "quality-stats"))
