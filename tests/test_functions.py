from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hashing, numeric
from corpusloom.functions import text as fn


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


def test_word_and_char_tokens(spark):
    assert one(spark, fn.word_tokens(F.col("v")), "one, two. Three! four") == ["one", "two", "Three", "four"]
    assert one(spark, fn.word_tokens(F.col("v")), "don't 3.14 state-of u.s.a") == ["don't", "3.14", "state", "of", "u.s.a"]
    assert len(one(spark, fn.char_tokens(F.col("v")), "aaabbc!.")) == 8
    assert one(spark, fn.char_tokens(F.col("v")), "é🙂") == ["é", "🙂"]


def test_space_tokens(spark):
    assert one(spark, fn.space_tokens(F.col("v")), " a  b ") == ["", "a", "", "b", ""]
    assert one(spark, fn.space_tokens(F.col("v")), "") == [""]
    assert one(spark, fn.space_tokens(F.col("v"), "|"), "a|b") == ["a", "b"]
    assert one(spark, fn.space_tokens(F.col("v"), drop_trailing=True), "a b ") == ["a", "b"]
    assert one(spark, fn.space_tokens(F.col("v"), drop_trailing=True), "") == []
    with pytest.raises(ValueError):
        fn.space_tokens(F.col("v"), "ab")


def test_ngrams(spark):
    t = F.split("v", " ")
    assert one(spark, fn.ngrams(t, 1, 3), "a b c d") == ["a", "a_b", "a_b_c", "b", "b_c", "b_c_d", "c", "c_d", "d"]
    assert one(spark, fn.ngrams(t, 2, 2, ["b"]), "a b c") == ["a_c"]
    assert one(spark, fn.ngrams(F.filter(t, lambda x: x == "z"), 1, 2), "a b") == []
    assert one(spark, fn.ngrams(t, 2, 2), "a") == []
    assert one(spark, fn.ngram_order(F.col("v")), "a_b_c") == 3
    with pytest.raises(ValueError):
        fn.ngrams(t, 2, 1)


def test_windows_stopwords_pos(spark):
    t = F.split("v", " ")
    assert one(spark, fn.windows(t, 2), "a b c") == [["a", "b"], ["b", "c"]]
    assert one(spark, fn.windows(t, 5), "a b") == [["a", "b"]]
    assert one(spark, fn.remove_stopwords(t, ["a"]), "a b a b") == ["b", "b"]
    tags = F.array(*(F.lit(x) for x in ("NOUN", "PUNCT", "VERB")))
    assert one(spark, fn.keep_pos(t, tags), "cat . run") == ["cat", "run"]
    assert one(spark, fn.keep_pos(t, tags, ["VERB"]), "cat . run") == ["run"]
    assert one(spark, fn.keep_pos(t, tags, [], []), "cat . run") == ["cat", ".", "run"]


def test_murmur(spark):
    assert hashing.murmur3(b"hello, world", 0) == 0x149BBB7F
    assert hashing.murmur3(b"", 1) == 0x514E28B7
    assert one(spark, hashing.bucket(F.col("v"), 7), "abc") == hashing.murmur3(b"abc", hashing.BUCKET_SEED) % 7
    assert one(spark, hashing.bucket(F.col("v"), 7), None) is None
    assert one(spark, hashing.sign(F.col("v")), "abc") in (-1, 1)


def test_qnorm(spark):
    ps = [1e-12, 1e-6, 0.0005, 0.02, 0.075, 0.3, 0.5, 0.7, 0.93, 0.9995, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(numeric.qnorm(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-9, abs=1e-12)
    import duckdb

    assert duckdb.connect().execute("SELECT " + numeric.qnorm_sql("0.02")).fetchall()[0][0] == pytest.approx(NormalDist().inv_cdf(0.02))


def test_murmur_sql_and_arrow_agree():
    import random

    import duckdb
    import pyarrow as pa

    rng = random.Random(1)
    terms = pa.table({"t": ["".join(rng.choice("abcdé日🙂 ") for _ in range(rng.randint(0, 19))) for _ in range(3000)]})
    for seed in (hashing.BUCKET_SEED, hashing.SIGN_SEED):
        got = duckdb.connect().execute(f"SELECT t, {hashing.murmur3_sql('t', seed)} FROM terms").fetchall()
        made = hashing.murmur3_of(pa.array([t for t, _ in got]), seed)[0].tolist()
        assert [h for _, h in got] == made
