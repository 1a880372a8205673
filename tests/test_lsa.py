import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklake.operators import lsa
from ranklake.operators.retrieval import cosine_search

TEXTS = ["red oak table", "oak table with drawers", "blue cotton shirt", "cotton shirt, slim", "steel kettle", "kettle of blue steel", "wool scarf", "red wool scarf", None, " "]


def dense(spark, docs, model):
    """The TF-IDF matrix, rows by id and columns by the model's numbers."""
    out = np.zeros((docs.count(), model.axes.shape[0]))
    for r in lsa.tfidf(docs)[0].join(model.vocabulary.select("feature", "f"), "feature").collect():
        out[r.item_id, r.f] = r.w
    return out


def test_fit_equals_dense_svd(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "item_id bigint, text string")
    model = lsa.fit(docs, components=5)
    x = dense(spark, docs, model)
    _, values, axes = np.linalg.svd(x, full_matrices=False)
    assert model.components == 5 and np.allclose(model.singular_values, values[:5])
    latent = x @ axes[:5].T
    assert np.allclose(model.explained_variance_ratio, latent.var(axis=0) / x.var(axis=0).sum())
    assert model.word_features + model.char_features == x.shape[1]
    got = np.zeros((len(TEXTS), 5))
    for r in lsa.transform(model, docs).collect():
        got[r.item_id] = r.vector
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    want = np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 0)
    assert np.allclose(got @ got.T, want @ want.T) and not got[-2:].any()


def test_search(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "item_id bigint, text string")
    model = lsa.fit(docs, components=6)
    queries = spark.createDataFrame([("a", "wool"), ("b", "qqq"), ("c", None)], "query_id string, text string")
    rows = lsa.search(model, lsa.transform(model, docs), queries, 3).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {"a"} and {r.item_id for r in rows[:2]} == {6, 7} and len(rows) == 3
    with pytest.raises(ValueError):
        lsa.fit(docs, max_features=3)
    with pytest.raises(ValueError):
        lsa.term_weights(docs, 0, 0)


def test_cosine_blocks_and_ties(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (600, 4)).astype(float).tolist()
    items = spark.createDataFrame([*enumerate(vectors), (600, None), (601, [1.0]), (602, [float("nan")] * 4)], "item_id bigint, vector array<double>").withColumn("extra", F.lit(1))
    queries = items.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "vector")
    x = np.array(vectors)
    norm = np.linalg.norm(x, axis=1)
    for most in (100, 4):
        got = {(r.query_id, r["rank"]): r.item_id for r in cosine_search(items, queries, 7, most).collect()}
        for q in range(0, 600, 50):
            if norm[q] == 0:
                assert (q, 1) not in got
                continue
            score = [(-round(float(x[i] @ x[q] / norm[i] / norm[q]), 9), i) for i in range(600) if norm[i] > 0]
            assert [got[q, k] for k in range(1, 8)] == [i for _, i in sorted(score)[:7]], q
    assert cosine_search(items, queries.limit(0)).count() == 0 and cosine_search(items.limit(0), queries).count() == 0
