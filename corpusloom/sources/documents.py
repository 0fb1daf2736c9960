"""Sources: text files and folders, any DataFrame, pre-split tokens, analogy questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn


def read_files(spark: SparkSession, paths: str | list[str], lines: bool = True) -> DataFrame:
    """(doc_id, text): one document a line with id ``<file>_<line>`` (from 1), or one a file.

    Files are read whole, so that line numbers do not depend on how a file is cut into tasks.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    if not lines:
        return whole.select(F.col("file").alias("doc_id"), F.col("value").alias("text"))
    cut = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)
    numbered = whole.select("file", F.posexplode(cut).alias("pos", "text"))
    return numbered.select(F.concat_ws("_", "file", F.col("pos") + 1).alias("doc_id"), "text")


def read_dir(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """All files of a folder, not of folders within."""
    return read_files(spark, path, lines)


def tokens(docs: DataFrame, preprocess: Callable[[Column], Column] = lambda c: c, tokenize: Callable[[Column], Column] = fn.space_tokens, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens), lazily: ``tokenize(preprocess(text))``.  null text has no tokens.

    Any DataFrame will do: files, tables, JDBC, streams.
    """
    made = tokenize(preprocess(F.col(text)))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(made, F.array().cast("array<string>")).alias("tokens"))


def texts(docs: DataFrame, preprocess: Callable[[Column], Column] = lambda c: c, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), lazily: what ``tokens`` with ``fn.word_tokens`` is made of.  Kernels that read this form find the words in their own
    tasks (``operators/_arrays.py: words``), so that a text goes to them once and not a word at a time."""
    return docs.select(F.col(doc_id).alias("doc_id"), preprocess(F.col(text)).alias("text"))


def given_tokens(docs: DataFrame, doc_id: str = "doc_id", column: str = "tokens") -> DataFrame:
    """Documents that are split already; elements of any type become strings."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>")).alias("tokens"))


def analogy_questions(spark: SparkSession, path: str, vocabulary: DataFrame) -> DataFrame:
    """(category, question, a, b, c, d) as term ids, from a file of sections and 4-word lines.

    A line that does not have four words starts a section named by its second word.
    Questions with a word outside the vocabulary are dropped.  The order of lines matters, so a file is read whole.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.lower("value"), r"\r?\n", -1)).alias("line", "text"))
    words = rows.select("file", "line", F.split("text", " ", -1).alias("w")).filter(F.length(F.array_join("w", "")) > 0)
    named = words.withColumn("head", F.when(F.size("w") != 4, F.get("w", F.lit(1))))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("category", F.last("head", ignorenulls=True).over(upto)).filter(F.size("w") == 4)
    found = placed.select("category", F.col("line").alias("question"), *(F.get("w", F.lit(k)).alias(f"w{k}") for k in range(4)))
    for k, name in enumerate("abcd"):
        found = found.join(vocabulary.select(F.col("term").alias(f"w{k}"), F.col("term_id").alias(name)), f"w{k}")
    return found.select("category", "question", "a", "b", "c", "d")
