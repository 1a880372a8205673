import numpy as np
from pyspark.sql import functions as F

from ranklake.llm.toxicity import label_model, score, tree


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = score(docs.withColumn("toxic", F.lit(7)), labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 20 and sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.005 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "you idiots"), (1, "you idiots")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = score(docs, none).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0} and [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.predicted for r in score(docs, spark.createDataFrame([(1, 1), (1, 0), (9, 5), (None, 1)], "doc_id bigint, toxic int")).collect()} == {1}
    assert score(docs.limit(0), none).count() == 0


def test_label_model_recovers_flipped_labels():
    """Voters of known accuracy, three of them copies of one, and a fifth of the labels wrong."""
    rng = np.random.default_rng(3)
    truth = (rng.random(4000) < 0.3).astype(int)
    vote = lambda right, wrong: np.where(truth == 1, rng.random(4000) < right, rng.random(4000) < wrong).astype(float)
    first = vote(0.7, 0.2)
    votes = np.column_stack([first, first, first, *(vote(0.8, 0.05) for _ in range(6))])
    labels = np.where(rng.random(4000) < 0.2, 1 - truth, truth)
    labels[:400] = -1
    posterior = label_model(votes, labels, trust=0.8)
    assert ((posterior > 0.5) == truth).mean() > 0.97
    assert ((posterior[:400] > 0.5) == truth[:400]).mean() > 0.95
    parent = tree(votes, (1.0 - truth, 1.0 * truth))
    assert sum(parent[i] in (0, 1, 2) for i in (0, 1, 2)) == 2 and (parent[3:] < 0).all()
