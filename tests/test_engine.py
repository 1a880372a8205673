import math

import pytest
from pyspark.sql import functions as F

from ranklake.functions.text import char_ngrams, tokenize, weighted_text, word_ngrams
from ranklake.operators import checks, evaluation, personalization, retrieval
from ranklake.streaming import behaviour


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenize(spark):
    assert one(spark, tokenize(F.lit("Don't re-use X9; the X9 is NEW"))) == ["don", "t", "re", "use", "x9", "x9", "new"]
    assert one(spark, tokenize(F.lit("ｗｉｄｅ ﬁne ²³ été"))) == ["wide", "fine", "23", "t"]
    assert one(spark, tokenize(F.lit("of the"), remove_stopwords=False)) == ["of", "the"]
    assert one(spark, tokenize(F.lit("..."))) == [] == one(spark, tokenize(F.lit(None).cast("string")))


def test_ngrams(spark):
    assert one(spark, word_ngrams(F.lit("Naïve red a fox"))) == ["naïve", "red", "fox", "naïve red", "red fox"]
    assert one(spark, char_ngrams(F.lit("ab"))) == [" ab", "ab ", " ab "]
    assert one(spark, weighted_text({"t": F.lit("A"), "d": F.lit("B")}, {"t": 2, "d": 0})) == "A A"


def test_bm25_ties_and_guards(spark):
    docs = spark.createDataFrame([("item_z", ["red", "fox"]), ("item_a", ["red", "fox"]), ("other", ["cat"])], "item_id string, tokens array<string>")
    queries = spark.createDataFrame([("q", ["red", "nope"])], "query_id string, tokens array<string>")
    assert [r.item_id for r in retrieval.bm25(docs, queries).orderBy("rank").collect()] == ["item_a", "item_z"]
    with pytest.raises(ValueError):
        retrieval.bm25(docs, queries, k1=0)
    with pytest.raises(ValueError):
        retrieval.bm25(docs, queries, k=0)


def ranked(spark, *rows):
    return spark.createDataFrame([("q", item, i, float(score)) for i, (item, score) in enumerate(rows, 1)], "query_id string, item_id string, rank int, score double")


def test_fusion(spark):
    words = ranked(spark, ("p7", 8), ("p1", 6), ("p4", 4), ("p9", 3), ("p2", 2))
    meaning = ranked(spark, ("p5", 0.75), ("p4", 0.5), ("p8", float("nan")), ("p7", 0.25))
    both = retrieval.candidates(words, meaning)
    got = {r.item_id: r for r in retrieval.fuse_rrf(both, rrf_k=10).collect()}
    assert len(got) == 7 and [i for i, r in sorted(got.items(), key=lambda x: x[1].rank)][:2] == ["p7", "p4"]
    for item, places in {"p7": (1, 4), "p4": (3, 2), "p5": (1,), "p2": (5,)}.items():
        assert got[item].score == pytest.approx(sum(1 / (10 + p) for p in places), abs=1e-8)
    assert got["p4"].sources == ["bm25", "semantic"] and got["p8"].sources == ["semantic"]
    linear = {r.item_id: r for r in retrieval.fuse_linear(both, keyword_weight=3, semantic_weight=1).collect()}
    assert linear["p7"].score == pytest.approx(0.75) and linear["p5"].score == pytest.approx(0.25)
    assert linear["p4"].score == pytest.approx(0.75 * 2 / 6 + 0.25 * 0.5) and linear["p8"].score == 0 == linear["p2"].score
    with pytest.raises(ValueError):
        retrieval.fuse_linear(both, keyword_weight=-1)


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", "m", 1), ("q", "n", 3), ("q", "o", 2), ("q", "x", 2)], "query_id string, item_id string, grade int")
    results = ranked(spark, ("z", 9), ("m", 8), ("y", 7), ("n", 6))
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    got = {(r.query_id, r.k): r for r in evaluation.evaluate(queries, results, qrels, ks=(1, 4)).collect()}
    ideal = 7 + 3 / math.log2(3) + 3 / 2 + 1 / math.log2(5)
    r = got["q", 4]
    assert (r.precision, r.recall, r.mrr, r.hit_rate) == (0.5, 0.5, 0.5, 1)
    assert r.ndcg == pytest.approx((1 / math.log2(3) + 7 / math.log2(5)) / ideal)
    assert (got["q", 1].ndcg, got["q", 1].mrr) == (0, 0) and got["none", 4].ndcg == 0
    strict = {(r.query_id, r.k): r for r in evaluation.evaluate(queries, results, qrels, ks=(4,), threshold=2).collect()}["q", 4]
    assert (strict.precision, strict.mrr) == (0.25, 0.25) and strict.recall == pytest.approx(1 / 3)


def test_split_sizes(spark):
    rows = [(u, f"s{i:02}", i) for u, n in ((1, 1), (2, 5), (10, 10), (15, 15), (20, 20), (25, 25)) for i in range(n)]
    events = spark.createDataFrame(rows, "user_id int, session_id string, d int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    split = personalization.sessions_split(events)
    tests = {r.user_id: r.n for r in split.filter("split = 'test'").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert tests == {2: 1, 10: 1, 15: 2, 20: 3, 25: 4}
    assert personalization.leaks(split).count() == 0


def test_rerank(spark):
    cands = spark.createDataFrame([("r", "u", "i1", 2, 0.85), ("r", "u", "i2", 1, 0.95), ("r", "u", "i1", 3, 0.5)], "request_id string, user_id string, item_id string, rank int, score double")
    items = spark.createDataFrame([("i1", "E", "B", 500.0), ("i2", "X", "Y", 5.0)], "item_id string, category string, brand string, price double")
    prefs = spark.createDataFrame([("u", "category", "E", 1.0), ("u", "brand", "B", 1.0)], "user_id string, dim string, value string, weight double")
    weights = {"retrieval": 0.3, "category": 0.3, "brand": 0.3, "price": 0.1}
    for status, first in (("warm", "i1"), ("cold_start", "i2")):
        profile = spark.createDataFrame([("u", status, math.log(500))], "user_id string, status string, mean_log_price double")
        got = personalization.rerank(cands, items, prefs, profile, weights).orderBy("rank").collect()
        assert [r.item_id for r in got][0] == first and len(got) == 2


def test_event_chains(spark):
    rows = [(1, "u", "view", 5), (2, "u", "click", 6), (3, "u", "purchase", 6), (4, "v", "click", 1), (5, "v", "view", 1), (6, "v", "purchase", 9), (7, "w", "purchase", 2), (8, "w", "click", 1)]
    events = spark.createDataFrame(rows, "event_id int, user_id string, event_type string, ts int")
    found = checks.event_chains(events, {"view": 0, "click": 1, "purchase": 4}, {"click": "view", "purchase": "click"}, ("user_id",))
    # of equal times the view comes first
    assert sorted(r.event_id for r in found.collect()) == [8]
    assert checks.event_chains(events.limit(0), {"view": 0}, {"click": "view"}, ("user_id",)).count() == 0


def test_requests_and_coverage(spark):
    events = spark.createDataFrame([(1, "r1", "u", "a", "click", 1, 5), (2, "r1", "u", "a", "purchase", 2, 5), (3, "r2", "v", "b", "view", 1, 6), (4, "r3", "n", "c", "click", 1, 6)], "event_id int, request_id string, user_id string, item_id string, event_type string, ts int, query_id int")
    profile = spark.createDataFrame([("u", "warm")], "user_id string, status string")
    asked = personalization.build_requests(events, profile)
    assert {(r.request_id, r.query_id, r.status) for r in asked.collect()} == {("r1", 5, "warm"), ("r3", 6, "no_history")}
    grades = personalization.request_grades(events)
    assert {(r.request_id, r.item_id, r.grade) for r in grades.collect()} == {("r1", "a", 4), ("r3", "c", 1)}
    cands = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r3", "x")], "request_id string, item_id string")
    assert tuple(evaluation.candidate_coverage(asked, cands, grades).first()) == (2, 1, 0.5, 2, 0.5, 1, 1.0)


def test_streams(spark, tmp_path):
    rows = [(7, "view", "2024-01-01 10:05:00"), (7, "click", "2024-01-01 10:20:00"), (7, "view", "2024-01-01 12:00:00"), (8, "purchase", "2024-01-01 10:59:00")]
    events = spark.createDataFrame(rows, "user_id int, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, df, want in (("w", behaviour.funnel_windows(stream()), [(1, 1, 1), (1, 0, 0)]), ("s", behaviour.sessions(stream()), [(7, 2), (8, 1), (7, 1)])):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        got = [(r.n_shown, r.n_clicked, r.n_bought) if name == "w" else (r.user_id, r.n_events) for r in spark.table(name).orderBy("start", *(["user_id"] if name == "s" else [])).collect()]
        assert got == want or (name == "s" and set(got) <= set(want))
