import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import _arrays, collocations, evaluate, glove, lda, lsa, matrix, ranking, rows, rwmd, similarity, vectorize, verbs, vocabulary, weighting

DOCS = {1: "a b c a", 2: "b c d", 3: "", 4: "a a a b b", 5: "the a b"}


def tokens_of(spark, docs=DOCS):
    return spark.createDataFrame([(k, v.split()) for k, v in docs.items()], "doc_id long, tokens array<string>")


def terms_of(v):
    return {r["term"]: (r["term_count"], r["doc_count"]) for r in v.terms.collect()}


def cells_of(m, i="doc_id", j="column"):
    return {(r[i], r[j]): r["value"] for r in m.collect()}


def random_docs(n=25, seed=1):
    rng = random.Random(seed)
    return {k: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12))) for k in range(n)}


def test_vocabulary(spark):
    v = vocabulary.create_vocabulary(tokens_of(spark))
    assert v.document_count == 5
    assert terms_of(v) == {"a": (6, 3), "b": (5, 4), "c": (2, 2), "d": (1, 1), "the": (1, 1)}
    assert [r["term"] for r in v.with_ids().orderBy("term_id").collect()] == ["d", "the", "c", "b", "a"]
    assert terms_of(vocabulary.create_vocabulary(tokens_of(spark), stopwords=["the"], ngram=(2, 2)))["a_b"] == (3, 3)
    with pytest.raises(ValueError):
        vocabulary.create_vocabulary(tokens_of(spark), sep="ab")


def test_vocabulary_windows_brute_force(spark):
    docs = random_docs()
    want, held = Counter(), Counter()
    for text in docs.values():
        t = text.split()
        for i in range(max(len(t) - 3 + 1, 1)):
            for x in set(t[i : i + 3]):
                want[x] += 1
                held[x] += 1
    v = vocabulary.create_vocabulary(tokens_of(spark, docs), window=3)
    assert terms_of(v) == {x: (want[x], held[x]) for x in want}
    assert v.document_count == sum(max(len(t.split()) - 2, 1) for t in docs.values())


def test_combine_is_whole(spark):
    docs = random_docs(40, 2)
    half = [dict(itertools.islice(docs.items(), 0, 17)), dict(itertools.islice(docs.items(), 17, None))]
    make = lambda d: vocabulary.create_vocabulary(tokens_of(spark, d), (1, 2), ["a"])
    both, whole = vocabulary.combine(*map(make, half)), make(docs)
    assert terms_of(both) == terms_of(whole) and both.document_count == whole.document_count


def test_prune_and_given(spark):
    v = vocabulary.create_vocabulary(tokens_of(spark))
    assert set(terms_of(vocabulary.prune(v, term_count_min=2, doc_proportion_max=0.7))) == {"a", "c"}
    top = vocabulary.prune(v, vocab_term_max=3)
    assert [r["term"] for r in top.with_ids().orderBy("term_id").collect()] == ["a", "b", "c"]
    given = vocabulary.vocabulary_of_terms(spark.createDataFrame([("b",), ("a",), ("a",), ("",), ("the",)], "term string"), stopwords=["the"])
    assert terms_of(given) == {"a": (None, None), "b": (None, None)}


def test_dtm_and_hash(spark):
    v = vocabulary.prune(vocabulary.create_vocabulary(tokens_of(spark)), term_count_min=2)
    m = vectorize.create_dtm(tokens_of(spark), vectorize.VocabVectorizer(v))
    assert cells_of(m)[(4, "a")] == 3 and (2, "d") not in cells_of(m)
    h = vectorize.create_dtm(tokens_of(spark), vectorize.HashVectorizer(4))
    assert sum(cells_of(h).values()) == 15
    signed = vectorize.create_dtm(tokens_of(spark, random_docs()), vectorize.HashVectorizer(2, signed=True))
    from corpusloom.functions import hashing

    want = Counter()
    for k, text in random_docs().items():
        for t in text.split():
            want[(k, hashing.murmur3(t.encode(), hashing.BUCKET_SEED) % 2)] += -1 if hashing.murmur3(t.encode(), hashing.SIGN_SEED) >> 31 else 1
    assert cells_of(signed) == dict(want)


@pytest.mark.parametrize("context", ["symmetric", "right", "left"])
@pytest.mark.parametrize("binary", [False, True])
@pytest.mark.parametrize("term_bytes", [64 << 20, 0])
def test_tcm_brute_force(spark, monkeypatch, context, binary, term_bytes):
    monkeypatch.setattr(_arrays, "TERM_BYTES", term_bytes)
    docs, window = random_docs(30, 3), 3
    known = set("abcde")
    want = Counter()
    for text in docs.values():
        t = text.split()
        for i, a in enumerate(t):
            seen = set()
            for d in range(1, window + 1):
                if i + d >= len(t) or a not in known or t[i + d] not in known or binary and t[i + d] in seen:
                    continue
                seen.add(t[i + d])
                pair = (a, t[i + d])
                want[tuple(sorted(pair)) if context == "symmetric" else pair if context == "right" else pair[::-1]] += 1 / d
    v = vocabulary.vocabulary_of_terms(spark.createDataFrame([(x,) for x in known], "term string"))
    got = cells_of(vectorize.create_tcm(tokens_of(spark, docs), vectorize.VocabVectorizer(v), window, context, binary=binary), "i", "j")
    assert got == pytest.approx(dict(want))
    with pytest.raises(ValueError):
        vectorize.create_tcm(tokens_of(spark), vectorize.VocabVectorizer(v), 3, weights=[1.0])


@pytest.mark.parametrize("signed", [False, True])
def test_hashed_tcm_brute_force(spark, signed):
    from corpusloom.functions import hashing

    docs, want = random_docs(30, 8), Counter()
    column = lambda t: hashing.murmur3(t.encode(), hashing.BUCKET_SEED) % 3
    sign = lambda t: -1 if signed and hashing.murmur3(t.encode(), hashing.SIGN_SEED) >> 31 else 1
    for text in docs.values():
        t = text.split()
        for i, a in enumerate(t):
            for d in (1, 2):
                if i + d < len(t):
                    b = t[i + d]
                    want[tuple(sorted((column(a), column(b))))] += sign(a) * sign(b) / d
    got = cells_of(vectorize.create_tcm(tokens_of(spark, docs), vectorize.HashVectorizer(3, signed=signed), 2), "i", "j")
    assert got == pytest.approx(dict(want))


def test_tcm_over_ngrams(spark):
    """Windows run over the n-grams in order of their start."""
    docs, want = random_docs(20, 12), Counter()
    for text in docs.values():
        t = text.split()
        grams = [g for i in range(len(t)) for g in ([t[i], f"{t[i]}_{t[i + 1]}"] if i + 1 < len(t) else [t[i]])]
        for i, a in enumerate(grams):
            for d in (1, 2):
                if i + d < len(grams):
                    want[(a, grams[i + d])] += 1 / d
    v = vocabulary.create_vocabulary(tokens_of(spark, docs), (1, 2))
    assert cells_of(vectorize.create_tcm(tokens_of(spark, docs), vectorize.VocabVectorizer(v), 2, "right"), "i", "j") == pytest.approx(dict(want))


def test_lda_c_and_vectors(spark):
    v = vocabulary.create_vocabulary(tokens_of(spark))
    ids = v.with_ids().select("term", "term_id")
    m = vectorize.create_dtm(tokens_of(spark), vectorize.VocabVectorizer(v))
    got = {r["doc_id"]: (r["idx"], r["cnt"]) for r in vectorize.lda_c(m, ids, tokens_of(spark)).collect()}
    assert got[3] == ([], []) and got[4] == ([3, 4], [2, 3])
    assert vectorize.as_vectors(m, ids, 5).filter("doc_id = 4").first()["features"].toArray().tolist() == [0, 0, 0, 2, 3]


def test_norms_and_weights(spark):
    m = spark.createDataFrame([(1, "a", 3.0), (1, "b", -3.0), (2, "a", 3.0), (2, "b", 4.0)], "doc_id long, column string, value double")
    assert cells_of(matrix.normalize(m, "l1"))[(1, "a")] == 0
    assert cells_of(matrix.normalize(m, "l2"))[(2, "b")] == pytest.approx(0.8)
    assert matrix.normalize(m, "none") is m
    got = cells_of(weighting.TfIdf().fit_transform(m.filter("doc_id = 2"), 3))
    assert got[(2, "a")] == pytest.approx(3 / 7 * np.log1p(3))
    with pytest.raises(ValueError):
        weighting.TfIdf().transform(m)
    y = spark.createDataFrame([(1, True), (2, False)], "doc_id long, positive boolean")
    stat = weighting.BiNormalSeparation().fit(m.filter("column = 'a'"), y, spark.createDataFrame([("a",), ("zz",)], "term string")).stat
    assert {r["term"]: r["bns"] for r in stat.collect()} == pytest.approx({"a": 0.0, "zz": 0.0})
    parts = Counter(r["part"] for r in matrix.split_into(spark.range(20), 3, "id").collect())
    assert parts == {1: 7, 2: 7, 3: 6}


def test_rank(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(0).sample(range(1000), 300)], "v int")
    assert [r["k"] for r in ranking.with_rank(df, "k", F.col("v").asc()).orderBy("v").collect()] == list(range(300))


def test_similarity(spark):
    docs = random_docs(15, 5)
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(vocabulary.create_vocabulary(tokens_of(spark, docs))))
    counts = {k: Counter(v.split()) for k, v in docs.items()}
    dot = lambda a, b: sum(a[x] * b[x] for x in a)
    for (i, j), s in cells_of(similarity.sim2(m).withColumnRenamed("sim", "value"), "x_id", "y_id").items():
        assert s == pytest.approx(dot(counts[i], counts[j]) / (dot(counts[i], counts[i]) * dot(counts[j], counts[j])) ** 0.5)
    for (i, j), s in cells_of(similarity.sim2(m, method="jaccard").withColumnRenamed("sim", "value"), "x_id", "y_id").items():
        assert s == pytest.approx(len(set(counts[i]) & set(counts[j])) / len(set(counts[i]) | set(counts[j])))
    assert all(r["sim"] == pytest.approx(1) for r in similarity.psim2(m, m).collect())
    assert all(r["sim"] == pytest.approx(1) for r in similarity.psim2(m, m, "jaccard").collect())
    x, y = np.arange(1, 16).reshape(3, 5).T.astype(float), np.arange(1, 13).reshape(3, 4).T.astype(float)
    frame = lambda a: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>")
    got = {(r["x_id"], r["y_id"]): r["value"] for r in similarity.dense(frame(x), frame(y), "euclidean", "none").collect()}
    assert got == pytest.approx({(i, j): float(np.linalg.norm(x[i] - y[j])) for i in range(5) for j in range(4)})
    with pytest.raises(ValueError):
        similarity.cosine(m, m, "l1")


def test_similarity_in_blocks(spark, monkeypatch):
    """Many blocks of queries, few pairs at a time, negative and absent values, ids of any type."""
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 60)
    monkeypatch.setattr(similarity, "MADE", 64)
    rng = random.Random(3)
    cells = {(f"d{i}", rng.choice("abcdefgh")): float(rng.choice([-2, -1, 1, 2, 5])) for i in range(30) for _ in range(5)}
    m = spark.createDataFrame([(i, c, v) for (i, c), v in cells.items()], "doc_id string, column string, value double")
    rows = {i: {c: v for (k, c), v in cells.items() if k == i} for i, _ in cells}
    norm = {i: sum(v * v for v in r.values()) ** 0.5 for i, r in rows.items()}
    shared = {(i, j) for i in rows for j in rows if rows[i].keys() & rows[j].keys()}
    want = {(i, j): sum(v * rows[j].get(c, 0) for c, v in rows[i].items()) / norm[i] / norm[j] for i, j in shared}
    assert cells_of(similarity.sim2(m).withColumnRenamed("sim", "value"), "x_id", "y_id") == pytest.approx(want)
    got = cells_of(similarity.dist2(m, complete=True).withColumnRenamed("dist", "value"), "x_id", "y_id")
    assert got == pytest.approx({(i, j): 1 - want.get((i, j), 0.0) for i in rows for j in rows})
    assert similarity.sim2(m.limit(0), m).count() == 0 and similarity.sim2(m, m.limit(0), "jaccard").count() == 0


def test_blocks_are_not_written(spark, monkeypatch):
    """Pairs of many blocks of queries go straight to the reader: only the rows are laid aside."""
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 60)
    aside = []
    monkeypatch.setattr(similarity, "materialize", lambda df, label, keep=similarity.materialize: aside.append(label) or keep(df, label))
    m = spark.createDataFrame([(i, c, 1.0) for i in range(12) for c in "ab"], "doc_id long, column string, value double")
    for method in ("cosine", "jaccard"):
        found = similarity.sim2(m, method=method)
        assert found.count() == 144 and all(r["sim"] == pytest.approx(1) for r in found.collect())
    assert aside == ["sparse-rows", "sparse-rows"]


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 200)
    monkeypatch.setattr(similarity, "MADE", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6)) + 1000.0
    x[7] = x[3]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r["x_id"], r["y_id"]): r["value"] for r in similarity.dense(rows, rows, "euclidean", "none").collect()}
    assert got == pytest.approx({(i, j): float(np.linalg.norm(x[i] - x[j])) for i in range(40) for j in range(40)}, abs=1e-9)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {(r["x_id"], r["place"]): r["y_id"] for r in similarity.nearest(rows, rows, 3).collect()}
    sims = u @ u.T
    for i in range(40):
        order = sorted((j for j in range(40) if j != i), key=lambda j: -sims[i, j])[:3]  # noqa: B023
        assert [sims[i, near[(i, k)]] for k in (1, 2, 3)] == pytest.approx([sims[i, j] for j in order])


def test_rounded_pairs_leave_in_order(spark, monkeypatch, tmp_path):
    """All pairs with the values that rounding each gives, ordered by value within a grid, so that they take half the bytes; odd values are kept."""
    from corpusloom.plans.registry import rounded

    rng = np.random.default_rng(6)
    x = 1 + 0.3 * rng.normal(size=(6000, 8))
    x[5], x[6], x[7] = -x[9], 0.0, x[9]
    frame = lambda a: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>").coalesce(1)
    size = lambda df, name: df.write.parquet(f"{tmp_path}/{name}") or sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    rows, queries = frame(x), frame(x[:300])
    plain = similarity.dense(queries, rows).withColumn("value", rounded("value"))
    made = similarity.dense(queries, rows, digits=6)
    assert size(made, "made") < 0.6 * size(plain, "plain")
    monkeypatch.setattr(similarity, "GRID", 1 << 10)
    monkeypatch.setattr(similarity, "GRID_QUERIES", 7)
    monkeypatch.setattr(similarity, "MADE", 64)
    spread = rng.normal(size=(60, 3)) * np.array([[1e-7], [1.0], [1e14]])[np.arange(60) % 3]
    spread[8] = -spread[2]
    few, bad = frame(x[:40]), frame(np.vstack([spread, np.full((1, 3), np.nan)]))
    for rows in (few, bad, frame(spread)):
        for method, norm in (("cosine", "l2"), ("cosine", "none"), ("euclidean", "none")):
            of = lambda df: {(r["x_id"], r["y_id"]): str(r["value"]) for r in df.collect()}
            want = of(similarity.dense(rows, rows, method, norm).withColumn("value", F.expr("signum(value) * if(isnan(value) or abs(value) > 1e12, abs(value), floor(abs(value) * 1e6 + 0.5) / 1e6)")))
            got = of(similarity.dense(rows, rows, method, norm, digits=6))
            near = {k for k in want if want[k] != got[k] and not abs(float(want[k]) - float(got[k])) <= 1e-9 * abs(float(want[k])) + 1.1e-6}
            assert len(got) == rows.count() ** 2 and got.keys() == want.keys() and not near


def test_top_keeps_k_rows_a_task(spark, monkeypatch):
    """However small the slices and however many rows tie, a task hands on the best k of each query."""
    monkeypatch.setattr(similarity, "MADE", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    x[20:40] = x[3]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").coalesce(1)
    for method, sign in (("cosine", -1), ("euclidean", 1)):
        whole = similarity.dense(rows, rows, method, "none").collect()
        want = {(q, r["y_id"]) for q in range(60) for r in sorted((r for r in whole if r["x_id"] == q), key=lambda r: (sign * round(r["value"], 9), r["y_id"]))[:4]}
        kept = similarity.dense(rows, rows, method, "none", top=4).collect()
        assert len(kept) == 240 and {(r["x_id"], r["y_id"]) for r in kept} == want


@pytest.mark.parametrize("vector_bytes", [128 << 20, 0])
def test_rwmd_brute_force(spark, monkeypatch, vector_bytes):
    monkeypatch.setattr(rwmd, "VECTOR_BYTES", vector_bytes)
    monkeypatch.setattr(rwmd, "MADE", 64)
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 400)
    rng = np.random.default_rng(6)
    words = {w: rng.normal(size=5) for w in "abcdefghij"}
    words["j"] = words["a"] * 2  # same direction as another word
    docs = {k: [str(x) for x in rng.choice(list(words) + ["unknown"], 6)] for k in range(15)}
    m = spark.createDataFrame([(k, w, float(n)) for k, t in docs.items() for w, n in Counter(t).items()], "doc_id long, column string, value double")
    e = spark.createDataFrame([(w, v.tolist()) for w, v in words.items()], "column string, v array<double>")
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    known = {k: [w for w in t if w in words] for k, t in docs.items()}
    want = {(q, k): sum(max(cos(words[w], words[x]) for x in known[q]) for w in known[k]) / len(known[k]) for q in docs for k in docs if known[q] and known[k]}
    got = {(r["q_id"], r["doc_id"]): r["sim"] for r in rwmd.RelaxedWordMovers(m, e).sim2(m).collect()}
    assert got == pytest.approx(want)


def test_cross_product_sums_frequent_terms_in_a_table(spark, monkeypatch):
    """The same counts whether pairs lie in the table, outside it or across, and no pair is handed on twice by a task."""
    docs = random_docs(30, 9)
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(vocabulary.create_vocabulary(tokens_of(spark, docs))))
    want = dict(Counter((a, b) for t in docs.values() for a in set(t.split()) for b in set(t.split())))
    for terms in (0, 3, 4096):
        monkeypatch.setattr(vectorize, "TABLE_TERMS", terms)
        assert cells_of(vectorize.cross_product(m), "i", "j") == want


def test_word_vector_tasks_follow_the_vocabulary(spark, monkeypatch):
    """Every task hands back all factors, so a wide vocabulary has more cells a task."""
    monkeypatch.setattr(glove, "PART_CELLS", 10)
    cells = spark.createDataFrame([(i, j, 1.0 + i) for i in range(20) for j in range(i, 20)], "i int, j int, value double")
    tasks = []
    monkeypatch.setattr(glove, "materialize", lambda df, label, keep=glove.materialize: tasks.append((label, keep(df, label))) or tasks[-1][1])
    glove.GloVe(2).fit_transform(cells, 20, 1)
    assert dict(tasks)["glove-epoch"].count() == 1  # 210 cells, 32 * 20 a task; 21 tasks at 10 cells a task


def test_pairs_leave_in_small_batches(spark, monkeypatch):
    """A task makes few pairs at a time, whatever the length of its batch; the sums are the same."""
    docs = random_docs(40, 11)
    v = vectorize.VocabVectorizer(vocabulary.create_vocabulary(tokens_of(spark, docs)))
    made = lambda binary: cells_of(vectorize.create_tcm(tokens_of(spark, docs), v, 3, binary=binary), "i", "j")
    whole = [made(b) for b in (False, True)]
    sizes = []
    monkeypatch.setattr(vectorize, "MADE", 12)
    monkeypatch.setattr(vectorize, "BATCH_ROWS", 3)
    assert [made(b) for b in (False, True)] == whole
    rows = np.repeat(np.arange(9), [3, 1, 9, 1, 1, 1, 5, 2, 2])
    for at in vectorize._arrays.row_ranges(rows, 4):
        sizes.append(at.stop - at.start)
        assert at.start == 0 or rows[at.start] != rows[at.start - 1]
    assert sizes == [4, 9, 3, 5, 4]


def test_dtm_shuffles_once(spark):
    """One row a document travels, and what goes by document stays where it is; rows of one document are summed."""
    own = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["zz"]), (1, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    v = vocabulary.vocabulary_of_terms(spark.createDataFrame([("a",), ("b",)], "term string"))
    m = vectorize.create_dtm(own, vectorize.VocabVectorizer(v))
    assert cells_of(m) == {(1, "a"): 3.0, (1, "b"): 1.0}
    normed = matrix.normalize(m, "l1")
    assert normed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert cells_of(normed) == {(1, "a"): 0.75, (1, "b"): 0.25}


def test_rwmd_best_matches_are_made_once_a_block(spark, monkeypatch):
    """One table a block of queries, bounded by BEST_BYTES, whatever the number of tasks."""
    monkeypatch.setattr(rwmd, "BEST_BYTES", 8 * 3 * 2)
    tables = []
    keep = rwmd.RelaxedWordMovers._table
    monkeypatch.setattr(rwmd.RelaxedWordMovers, "_table", staticmethod(lambda *args: tables.append(keep(*args)) or tables[-1]))
    e = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [1.0, 1.0])], "column string, v array<double>")
    m = spark.createDataFrame([(i, "xyz"[i % 3], 1.0) for i in range(5)], "doc_id long, column string, value double").repartition(4)
    got = rwmd.RelaxedWordMovers(m, e).sim2(m)
    assert got.count() == 25 and [t.shape for t in tables] == [(3, 2), (3, 2), (3, 1)]


def test_vocabulary_counts_before_the_shuffle(spark):
    """Tokens are not exploded; null and empty ones are no terms, and every row counts as a document."""
    own = spark.createDataFrame([(1, ["a", "b", "a", None, ""]), (1, ["a"]), (2, None), (3, [])], "doc_id long, tokens array<string>")
    v = vocabulary.create_vocabulary(own)
    assert "Generate" not in v.terms._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in v.terms.collect()} == {("a", 3, 2), ("b", 1, 1)} and v.document_count == 4


def test_ranges_count_absent_cells(spark):
    m = spark.createDataFrame([(1, "a", 3.0), (2, "a", 4.0), (1, "b", -3.0), (1, "c", 5.0)], "doc_id long, column string, value double")
    got = {r["column"]: (r["least"], r["most"]) for r in matrix.column_range(m, 2).collect()}
    assert got == {"a": (3.0, 4.0), "b": (-3.0, 0.0), "c": (0.0, 5.0)}
    assert {r["doc_id"]: (r["least"], r["most"]) for r in matrix.row_range(m, 3).collect()} == {1: (-3.0, 5.0), 2: (0.0, 4.0)}
    assert {r["column"]: r["least"] for r in matrix.column_range(m).collect()} == {"a": 3.0, "b": -3.0, "c": 5.0}
    assert matrix.split_ranges(20, 3) == [(1, 7), (8, 14), (15, 20)] and matrix.split_ranges(2, 3) == [(1, 1), (2, 2)]


def test_wide_rows_cross_product(spark, monkeypatch):
    monkeypatch.setattr(vectorize, "PAIR_BLOCK", 4)
    docs = random_docs(12, 15)
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(vocabulary.create_vocabulary(tokens_of(spark, docs))))
    want = Counter((a, b) for t in docs.values() for a in set(t.split()) for b in set(t.split()))
    assert cells_of(vectorize.cross_product(m), "i", "j") == dict(want)


def test_merging_on_numbers_brute_force():
    """Random phrase sets and texts: the kernel gives what the fold over strings gives."""
    import pyarrow as pa

    rng = random.Random(17)
    for _ in range(200):
        words = list("abc")
        phrases = {"_".join(rng.choice(words) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(0, 9))} | ({"___a"} if rng.random() < 0.3 else set())
        docs = [[rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(12)] + [None]
        batch = pa.record_batch([pa.array(docs, pa.list_(pa.string()))], ["tokens"])
        for part in (batch, batch.slice(3, 7)):
            got = collocations._merged(part, phrases, "_").to_pylist()
            assert got == [collocations.collapse(d or [], phrases, "_") for d in part.column("tokens").to_pylist()]


def test_neighbours_are_numbers_and_rare_pairs_stay_behind(spark, monkeypatch):
    """Pairs of known terms by brute force, whatever is summed at a time, and the same by strings; rare ones are dropped before they are written."""
    docs = {**random_docs(30, 5), 99: "x y x y x y"}
    terms = spark.createDataFrame([(t,) for t in sorted({w for t in docs.values() for w in t.split()})[1:]], "term string")
    known, want = {r["term"] for r in terms.collect()}, Counter()
    for t in docs.values():
        ws = t.split()
        want.update((w, None) for w in ws if w in known)
        want.update(p for p in zip(ws, ws[1:]) if set(p) <= known)
    want = {k: n for k, n in want.items() if n >= 3 or k[1] is None}
    found = lambda: {(r["prefix"], r["suffix"]): r["n"] for r in collocations._neighbours(tokens_of(spark, docs), terms, 3).collect()}
    assert found() == want
    monkeypatch.setattr(collocations, "PAIRS", 4)
    assert found() == want
    monkeypatch.setattr(_arrays, "TERM_BYTES", 0)
    assert found() == want


def test_psim_and_counts_by_on_numbers(spark):
    """Row-wise similarity of listed rows is that of the long form; counts by language need no join with the documents."""
    docs = random_docs(20, 6)
    v = vocabulary.create_vocabulary(tokens_of(spark, docs))
    ids = v.with_ids().select("term", "term_id")
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(v))
    own = rows.create_rows(tokens_of(spark, docs), v, ids)
    ones = rows.mapped(own, lambda sizes, at, values: np.ones(len(at)))
    got = {r["doc_id"]: r["sim"] for r in similarity.psim2(own, ones).collect()}
    assert got == pytest.approx({r["doc_id"]: r["sim"] for r in similarity.psim2(m, m.withColumn("value", F.lit(1.0))).collect()})
    spoken = tokens_of(spark, docs).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("l"), F.col("doc_id") % 3)))
    want = Counter((None if d % 3 == 0 else f"l{d % 3}", w) for d, t in docs.items() for w in t.split())
    assert {(r["doc_id"], r["term"]): r["n"] for r in vocabulary.counts_by(spoken).collect()} == want


def test_rows_meet_what_is_made_of_them_in_place(spark):
    """Similarity of listed rows and a mapping of them: that of the join, without an exchange; rows of one document are added up first."""
    docs = random_docs(30, 9)
    held = spark.createDataFrame([(k // 2, v.split()) for k, v in docs.items()], "doc_id long, tokens array<string>")
    for own in (tokens_of(spark, docs), held):
        v = vocabulary.create_vocabulary(own)
        m = rows.create_rows(own, v, v.with_ids().select("term", "term_id"))
        for method, of in (("cosine", lambda sizes, at, values: np.ones(len(at))), ("jaccard", lambda sizes, at, values: (values > 1).astype(float)), ("cosine", lambda sizes, at, values: values - 1)):
            made = similarity.psim_mapped(m, of, method)
            plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
            assert plan(made) == plan(m.select("doc_id", "at", "values"))
            want = {r["doc_id"]: r["sim"] for r in similarity.psim2(m, rows.mapped(m, of), method).collect()}
            assert {r["doc_id"]: r["sim"] for r in made.collect()} == pytest.approx(want) and len(want) > 10


def test_words_of_texts(spark, monkeypatch):
    """Kernels find the words that the JVM's tokenizer finds, and count them alike by language and for the vocabulary, in one pass."""
    from corpusloom.functions import text as fn
    from corpusloom.sources.documents import texts, tokens

    monkeypatch.setattr(_arrays, "TEXT_BYTES", 200)
    monkeypatch.setattr(_arrays, "WORDS", 40)
    rng = random.Random(8)
    alphabet = [*"ab1_.,;':·’ \n\tÉ٣ß", "̈", "文", "𝒳", "𝟙", "\0", "\ufffd", "½"]
    held = [(i, rng.choice(["de", "en", None]), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(600)] + [(600, "de", None), (601, None, "")]
    docs = spark.createDataFrame(held, "doc_id long, lang string, text string")
    want = {r["doc_id"]: r["tokens"] for r in tokens(docs, F.lower, fn.word_tokens).collect()}
    lower = {r["doc_id"]: r["text"] for r in texts(docs, F.lower).collect()}
    got = _arrays.words(pa.array([lower[i] for i in range(602)], pa.string()), fn.word_classes(spark)).to_pylist()
    assert got == [want[i] for i in range(602)]
    assert _arrays.words(pa.array([], pa.string()), fn.word_classes(spark)).to_pylist() == []
    counts = {(r["doc_id"], r["term"]): (r["n"], r["d"]) for r in vocabulary.counts_by(texts(docs, F.lower, "lang")).collect()}
    lang = {i: x for i, x, _ in held}
    n, d = Counter((lang[i], w) for i in want for w in want[i]), Counter((lang[i], w) for i in want for w in set(want[i]))
    assert counts == {k: (n[k], d[k]) for k in n}
    whole = vocabulary.create_vocabulary(tokens(docs, F.lower, fn.word_tokens))
    assert terms_of(vocabulary.vocabulary_of_counts(vocabulary.counts_by(texts(docs, F.lower, "lang")), 602)) == terms_of(whole) == terms_of(vocabulary.create_vocabulary(texts(docs, F.lower)))
    few = vocabulary.vocabulary_of_terms(whole.terms.filter("doc_count > 2").select("term"))
    assert cells_of(vectorize.create_dtm(texts(docs, F.lower), vectorize.VocabVectorizer(few))) == cells_of(vectorize.create_dtm(tokens(docs, F.lower, fn.word_tokens), vectorize.VocabVectorizer(few)))


def test_collapse():
    phrases = {"c_te", "d_ivoire", "c_te_d_ivoire"}
    for text, want in (("c te d 2 2", "c_te d 2 2"), ("c te d ivoire 2", "c_te_d_ivoire 2"), ("c te d ivoire", "c_te_d_ivoire")):
        assert collocations.collapse(text.split(), phrases, "_") == want.split()
    assert collocations.collapse([], phrases, "_") == []


def test_llr_published_rows(spark):
    # Dunning (1993), table 1: LLR, AB, A~B, ~AB, ~A~B
    rows = [(270.72, 110, 2442, 111, 29114), (263.90, 29, 13, 123, 31612), (256.84, 31, 23, 139, 31584), (167.23, 10, 0, 3, 31764), (157.21, 76, 2476, 104, 29121)]
    for llr, ab, a, b, rest in rows:
        n = ab + a + b + rest
        got = collocations.scores(spark.createDataFrame([(ab + a, ab + b, ab)], "n_i long, n_j long, n_ij long"), n, 1).first()["llr"]
        assert got == pytest.approx(llr, rel=2e-4)


def test_second_pass_drops_known_ends(spark):
    """A pair of the second pass goes if its prefix is any known prefix and its suffix any known suffix."""
    docs = {i: "a b c d x a d y" for i in range(10)}
    model = collocations.Collocations(count_min=5, pmi_min=float("-inf"), gensim_min=float("-inf"), llr_min=float("-inf")).fit(tokens_of(spark, docs), 2)
    first = {(r["prefix"], r["suffix"]) for r in model.stat.filter("iter = 1").collect()}
    second = {(r["prefix"], r["suffix"]) for r in model.stat.filter("iter = 2").collect()}
    prefixes, suffixes = {p for p, _ in first}, {s for _, s in first}
    text = collocations.collapse(docs[0].split(), {f"{p}_{s}" for p, s in first}, "_")
    pairs = set(zip(text, text[1:]))  # noqa: B905
    assert second == {(p, s) for p, s in pairs if not (p in prefixes and s in suffixes)}


def test_collocations(spark):
    docs = {i: ("new york is big " if i % 2 else "old york was new ") * 3 for i in range(40)}
    model = collocations.Collocations(count_min=20, pmi_min=0.5).fit(tokens_of(spark, docs), 2)
    phrases = {r["phrase"] for r in model.phrases().collect()}
    assert "new_york" in phrases
    out = {r["doc_id"]: r["tokens"] for r in model.transform(tokens_of(spark, docs)).collect()}
    want = {k: collocations.collapse(t.split(), phrases, "_") for k, t in docs.items()}
    assert out == want
    assert {r["doc_id"]: r["tokens"] for r in model._transform_joined(tokens_of(spark, docs), model.phrases()).collect()} == want
    assert model.prune(pmi_min=100.0).stat.count() == 0


def test_lsa(spark):
    docs = random_docs(40, 7)
    v = vocabulary.create_vocabulary(tokens_of(spark, docs))
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(v))
    ids = v.with_ids().select("term", "term_id")
    model = lsa.LatentSemanticAnalysis(7).fit(m, ids, len(docs))
    x = np.zeros((40, 7))
    at = {r["term"]: r["term_id"] for r in ids.collect()}
    for (d, t), n in cells_of(m).items():
        x[d, at[t]] = n
    assert model.singular == pytest.approx(np.linalg.svd(x, compute_uv=False))
    assert model.explained_variance_ratio().sum() == pytest.approx(1)
    assert model.transform(m).count() == sum(1 for t in docs.values() if t)


@pytest.mark.parametrize("held_bytes", [1 << 28, 0])
def test_lsa_on_listed_rows(spark, monkeypatch, held_bytes):
    """Rows listed from tokens, the decomposition by passes over them, with and without starting again; no job is made a vector."""
    monkeypatch.setattr(lsa, "HELD_BYTES", held_bytes)
    rng = np.random.default_rng(3)
    docs = {i: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 60) for i in range(80)} | {80: ""}
    v = vocabulary.create_vocabulary(tokens_of(spark, docs))
    ids = v.with_ids().select("term", "term_id")
    own = rows.create_rows(tokens_of(spark, docs), v, ids)
    m = weighting.TfIdf().fit_transform(vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(v)), len(docs))
    weighted = rows.tf_idf(own, ids.count(), len(docs))
    at = {r["term"]: r["term_id"] for r in ids.collect()}
    x = np.zeros((81, len(at)))
    for (d, t), n in cells_of(m).items():
        x[d, at[t]] = n
    got = np.zeros_like(x)
    for r in weighted.collect():
        got[r["doc_id"], r["at"]] = r["values"]
    assert got == pytest.approx(x)
    model = lsa.LatentSemanticAnalysis(4).fit(weighted, ids, len(docs))
    assert model.singular == pytest.approx(np.linalg.svd(x, compute_uv=False)[:4], rel=1e-9)
    assert model.passes < 40 and model.total_variance == pytest.approx(x.var(axis=0).sum())
    assert model.explained == pytest.approx((x @ model.loadings).var(axis=0))
    long, listed = ({r["doc_id"]: r["topics"] for r in model.transform(y).collect()} for y in (m, weighted))
    assert listed.keys() == long.keys() and all(listed[k] == pytest.approx(long[k]) for k in long)


def test_rows_of_one_document_are_added(spark, monkeypatch):
    own = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["zz"]), (1, ["a", "c"]), (3, None), (4, ["c"])], "doc_id long, tokens array<string>")
    v = vocabulary.vocabulary_of_terms(spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))
    ids = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "term string, term_id long")
    found = lambda: {r["doc_id"]: (r["at"], r["values"]) for r in rows.create_rows(own, v, ids).collect()}
    whole = found()
    assert whole == {1: ([0, 1, 2], [1.0, 1.0, 3.0]), 4: ([1], [1.0])}
    monkeypatch.setattr(_arrays, "TERM_BYTES", 0)
    assert found() == whole


def test_lda_counts_and_perplexity(spark):
    docs = {i: ("apple pear fig " if i % 2 else "bolt nut gear ") * 6 for i in range(30)}
    v = vocabulary.create_vocabulary(tokens_of(spark, docs))
    ids = v.with_ids().select("term", "term_id")
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(v))
    model = lda.LatentDirichletAllocation(2, 0.1, 0.01).fit(m, ids, n_iter=12, check_every=4, tol=-1)
    assert len(model.trace) == 3
    assert sum(sum(r["n"]) for r in model.counts.collect()) == 30 * 18
    shares = {r["doc_id"]: r["topics"] for r in model.transform(m, ids).collect()}
    assert all(sum(s) == pytest.approx(1) for s in shares.values())
    assert model.top_words(2).count() == 4
    phi = lda.topic_map(np.array([[0.5, 0.5, 0], [0.1, 0.1, 0.8], [0.2, 0.3, 0.5]]))
    assert phi.shape == (3, 2)


def test_viewer_and_verbs(spark):
    import json

    docs = {i: ("apple pear fig ", "bolt nut gear ", "sun rain wind ")[i % 3] * 4 for i in range(30)}
    v = vocabulary.create_vocabulary(tokens_of(spark, docs))
    ids = v.with_ids().select("term", "term_id")
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(v))
    model = verbs.fit(m, lda.LatentDirichletAllocation(3, 0.1, 0.01), ids, n_iter=4)
    seen = json.loads(json.dumps(model.viewer(5)))
    assert [t["topic"] for t in seen["topics"]] == [0, 1, 2] and sum(t["share"] for t in seen["topics"]) == pytest.approx(1)
    assert all(0 < t["share"] < 1 for t in seen["terms"])
    assert verbs.transform(m, model, ids).count() == 30
    assert cells_of(verbs.fit_transform(m, weighting.TfIdf(), 30)) == pytest.approx(cells_of(weighting.TfIdf().fit_transform(m, 30)))


def test_lda_does_not_depend_on_tasks(spark, monkeypatch):
    """The same model whether counts are broadcast or joined, and however documents are dealt to tasks."""
    docs = {i: ("apple pear fig " if i % 2 else "bolt nut gear ") * (1 + i % 4) for i in range(30)}
    v = vocabulary.create_vocabulary(tokens_of(spark, docs))
    ids = v.with_ids().select("term", "term_id")
    m = vectorize.create_dtm(tokens_of(spark, docs), vectorize.VocabVectorizer(v))

    def fitted(m):
        model = lda.LatentDirichletAllocation(2, 0.1, 0.01).fit(m, ids, n_iter=4, check_every=2, tol=-1)
        return {r["term_id"]: r["n"] for r in model.counts.collect()}, {r["doc_id"]: r["topics"] for r in model.transform(m, ids).collect()}

    whole = fitted(m)
    assert fitted(m.repartition(5)) == whole
    monkeypatch.setattr(lda, "COUNT_BYTES", 0)
    assert fitted(m) == whole


def test_perplexity(spark):
    m = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "doc_id long, column string, value double")
    phi = spark.createDataFrame([("a", [0.5, 0.2]), ("b", [0.5, 0.8])], "column string, phi array<double>")
    theta = spark.createDataFrame([(1, [0.25, 0.75])], "doc_id long, theta array<double>")
    pa, pb = 0.25 * 0.5 + 0.75 * 0.2, 0.25 * 0.5 + 0.75 * 0.8
    assert evaluate.perplexity(m, phi, theta).first()[0] == pytest.approx(np.exp(-(2 * np.log(pa) + np.log(pb)) / 3))


def test_coherence(spark):
    t = np.array([[40, 1, 2, 3], [1, 30, 4, 5], [2, 4, 20, 6], [3, 5, 6, 10]], float)
    tcm = spark.createDataFrame([(f"t{i}", f"t{j}", float(t[i, j])) for i in range(4) for j in range(4)], "i string, j string, value double")
    top = spark.createDataFrame([(1, k, f"t{i}") for k, i in enumerate((2, 0, 3, 1), 1)] + [(2, 1, "t0"), (2, 2, "unknown")], "topic int, place int, term string")
    got = {(r["topic"], r["metric"]): r["value"] for r in evaluate.coherence(top, tcm, n_docs=100).collect()}
    order, e = (2, 0, 3, 1), 1e-12
    pairs = [(order[i], order[j]) for i in range(4) for j in range(i + 1, 4)]
    pmi = [np.log2(t[a, b] / 100 + e) - np.log2(t[a, a] / 100) - np.log2(t[b, b] / 100) for a, b in pairs]
    assert got[(1, "mean_pmi")] == pytest.approx(np.mean(pmi))
    assert got[(1, "mean_logratio")] == pytest.approx(np.mean([np.log((t[a, b] + e) / t[a, a]) for a, b in pairs]))
    assert got[(1, "mean_difference")] == pytest.approx(np.mean([t[a, b] / t[a, a] - t[b, b] / 100 for a, b in pairs]))
    assert got[(2, "mean_pmi")] is None
    with pytest.raises(ValueError):
        evaluate.coherence(top, tcm)


def test_glove_analogy_rwmd(spark):
    rng = np.random.default_rng(0)
    cells = [(i, j, float(rng.integers(1, 30))) for i in range(12) for j in range(i, 12)]
    model = glove.GloVe(6)
    main = model.fit_transform(spark.createDataFrame(cells, "i int, j int, value double"), 12, 8, parts=2)
    assert main.shape == (12, 6) and model.loss[-1] < model.loss[0]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 1.0])], "id int, v array<double>")
    q = spark.createDataFrame([("s", 1, 0, 1, 1, 3)], "category string, question int, a int, b int, c int, d int")
    assert evaluate.analogies(q, vectors).first()["predicted"] == 3
    m = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (2, "z", 2.0)], "doc_id long, column string, value double")
    e = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [1.0, 1.0])], "column string, v array<double>")
    got = {(r["q_id"], r["doc_id"]): r["sim"] for r in rwmd.RelaxedWordMovers(m, e).sim2(m).collect()}
    assert got == pytest.approx({(1, 1): 1.0, (2, 2): 1.0, (1, 2): 0.5**0.5, (2, 1): 0.5**0.5})
