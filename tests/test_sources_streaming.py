from pyspark.sql import functions as F

from corpusloom.functions import text as fn
from corpusloom.operators import vocabulary
from corpusloom.sources import documents
from corpusloom.streaming import incremental


def test_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first line\nsecond\n")
    (tmp_path / "two.txt").write_text("\nlast")
    got = {r["doc_id"]: r["text"] for r in documents.read_dir(spark, str(tmp_path)).collect()}
    assert got == {"one.txt_1": "first line", "one.txt_2": "second", "two.txt_1": "", "two.txt_2": "last"}


def test_tokens_are_lazy_and_total(spark):
    df = spark.createDataFrame([(1, "A b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in documents.tokens(df, F.lower, fn.space_tokens).collect()}
    assert got == {1: ["a", "b"], 2: []}
    ints = spark.createDataFrame([(1, [1, 2])], "doc_id long, tokens array<int>")
    assert documents.given_tokens(ints).first()["tokens"] == ["1", "2"]


def test_analogy_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text(": capital\nA b c d\na b c unknown\n: other part\nd c b a\n")
    v = spark.createDataFrame([(t, i) for i, t in enumerate("abcd")], "term string, term_id int")
    got = sorted((r["category"], r["a"], r["b"], r["c"], r["d"]) for r in documents.analogy_questions(spark, str(tmp_path / "q.txt"), v).collect())
    assert got == [("capital", 0, 1, 2, 3), ("other", 3, 2, 1, 0)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i % 3} x y") for i in range(20)], "doc_id long, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.start(stream, incremental.vocabulary_counts(fn.word_tokens), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    merged = incremental.merged_vocabulary(spark, str(tmp_path / "out"))
    whole = vocabulary.create_vocabulary(documents.tokens(df, F.lower, fn.word_tokens))
    rows = lambda v: sorted(map(tuple, v.terms.collect()))
    assert rows(merged) == rows(whole) and merged.document_count == 20
