"""Settings, simulated tables, judgement rules and report tables."""

import json

import pytest
from pyspark.sql import functions as F

from ranklake.operators import checks, judgements
from ranklake.plans.registry import TOYS
from ranklake.sources import files, reports, settings, simulate


def test_settings(tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"k1": 2, "unknown": 1, "top_k_values": [3, 7]}))
    read = settings.Keyword.read(path)
    assert (read.k1, read.b, read.max_k) == (2, 0.75, 7)
    for kind, bad, word in [
        (settings.Keyword, {"b": 1.5}, "b is"),
        (settings.Semantic, {"word_ngram_range": [2, 1]}, "word_ngram_range"),
        (settings.Fusion, {"candidate_k": 5}, "candidate_k"),
        (settings.Fusion, {"bm25_weight": 0, "semantic_weight": 0}, "both zero"),
        (settings.Personal, {"behavior_relevance": {"click": 2, "favorite": 1, "add_to_cart": 3, "purchase": 4}}, "funnel"),
        (settings.Personal, {"train_ratio": 1}, "train_ratio"),
        (settings.Simulation, {"categories": []}, "categories"),
    ]:
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match=word):
            kind.read(path)
    assert settings.Personal().mix["category"] == 0.12 and not settings.Personal().problems()


def test_simulation(spark):
    made = simulate.simulate(spark, TOYS)
    items, users, queries, events = (made[t].cache() for t in ("items", "users", "queries", "events"))
    assert items.select("item_id").distinct().count() == TOYS.num_items == items.count()
    assert {r.category: r.n for r in items.groupBy("category").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(TOYS.categories, 1000)
    price = items.filter("category = 'Garden'").agg(F.min("price").alias("a"), F.max("price").alias("b")).first()
    assert price.a >= 5 and price.b <= 90
    mean = items.agg(F.avg("popularity_score").alias("p"), F.avg("quality_score").alias("q")).first()
    assert mean.p == pytest.approx(1.5 / 6.5, abs=0.01) and mean.q == pytest.approx(0.7, abs=0.02)
    assert users.filter("is_cold_start").count() == 40 and users.filter("size(preferred_categories) not between 1 and 3").count() == 0
    assert queries.groupBy("intended_category").count().filter("count != 100").count() == 0
    assert queries.filter("query_text like '%{%' or semantic_intent like '%{%'").count() == 0
    assert events.groupBy("event_id").count().filter("count > 1").count() == 0
    for table, key in ((items, "item_id"), (users, "user_id"), (queries, "query_id")):
        assert events.join(table, key, "left_anti").count() == 0
    assert events.filter("event_type = 'purchase' and purchase_amount is null or event_type != 'click' and click_duration_ms is not null").count() == 0
    # the same numbers whatever the partitions
    again = simulate.simulate(spark, TOYS)["events"].repartition(3)
    assert reports.differing(reports.manifest({"e": events}), reports.manifest({"e": again})).count() == 0
    assert reports.differing(reports.manifest({"e": events}), reports.manifest({"e": events.limit(9)})).count() == 1
    sums = {(r.name, r.value): r.n for r in simulate.summary({"events": events, "qrels": spark.createDataFrame([("q", "i", 2)], "query_id string, item_id string, relevance_grade int")}).collect()}
    assert sums["relevance_grade", "2"] == 1 and sums["rows", "events"] == events.count() == sum(n for (k, _), n in sums.items() if k == "event_type")
    for df in (items, users, queries, events):
        df.unpersist()


def test_one_item_and_one_category(spark):
    import dataclasses

    tiny = dataclasses.replace(TOYS, num_items=1, num_users=1, num_queries=1, num_sessions=50, categories=["Only"], serp_size=1, cold_start_user_ratio=0.0)
    made = simulate.simulate(spark, tiny)
    assert made["items"].first().brand == "Generic" and made["events"].count() == 0
    two = dataclasses.replace(tiny, serp_size=4)
    assert simulate.simulate(spark, two)["events"].filter("event_type = 'impression'").select("item_id").distinct().count() == 1
    with pytest.raises(ValueError):
        simulate.simulate(spark, dataclasses.replace(tiny, seed=-1))


def brute_grades(items, queries):
    out = {}
    for q, text, want, intent in queries:
        score, shared = {}, {}
        for i, title, text_of, cat, sub, brand in items:
            shared[i] = len(set(text.lower().split()) & set(title.lower().split()))
            score[i] = (cat == want) + (sub.lower() in text.lower()) + (brand.lower() in text.lower()) + (shared[i] >= 2) + (len(set(intent.lower().split()) & set(text_of.lower().split())) >= 3)
        out |= {(q, i): min(s, 3) for i, s in score.items() if s}
        stocked = {i for i, *_, cat, _, _ in items if cat == want}
        if stocked and max(score.values()) < 2:
            free = sorted((i not in stocked, -shared[i], i) for i in score if not score[i])
            if free:
                out[q, free[0][2]] = 2
    return out


def test_judgement_rules(spark):
    items = [("i1", "Oak desk lamp", "a lamp for the desk of oak", "Office", "Lamps", "Oakly"), ("i2", "Tin rake", "rake", "Garden", "Rakes", "Fernly"), ("i3", "Steel desk", "desk", "Garden", "Pots", "Mossop"), ("i4", "Bowl", "", "Kitchen", "Bowls", "Oakly")]
    queries = [("q1", "OAKLY lamps for a desk", "Office", "a lamp of oak"), ("q2", "desk", "Kitchen", "none"), ("q3", "x", "Nowhere", "y"), ("q4", "oak desk lamp", "Garden", "")]
    got = judgements.grade(spark.createDataFrame(items, "item_id string, title string, description string, category string, subcategory string, brand string"), spark.createDataFrame(queries, "query_id string, query_text string, intended_category string, semantic_intent string"))
    rows = got.collect()
    assert {(r.query_id, r.item_id): r.grade for r in rows} == brute_grades(items, queries) and len(rows) == len(brute_grades(items, queries))
    assert {(r.query_id, r.item_id): r.grade for r in rows}["q2", "i1"] == 2
    judged = checks.judged_queries("judged", spark.createDataFrame(queries, "query_id string, t string, c string, s string"), got, 2).first()
    assert judged.n_bad == 1


def test_judgements_rate_kinds_of_items(spark, monkeypatch):
    looks = [("Oak desk lamp", "a lamp for the desk of oak", "Office", "Lamps", "Oakly"), ("Steel desk", "desk", "Garden", "Pots", "Mossop"), ("Bowl", "", "Kitchen", "Bowls", "Oakly")]
    items = [(f"i{n:03}", *looks[n % 3]) for n in range(300)]
    queries = [("q1", "OAKLY lamps for a desk", "Office", "a lamp of oak"), ("q2", "desk", "Kitchen", "none"), ("q3", "bowl", "Garden", "")]
    rated, pairs = [], judgements.pairs
    monkeypatch.setattr(judgements, "pairs", lambda i, q, most: rated.append(i.count()) or pairs(i, q, most))
    schema = "item_id string, title string, description string, category string, subcategory string, brand string"
    few = spark.createDataFrame(queries, "query_id string, query_text string, intended_category string, semantic_intent string")
    rows = judgements.grade(spark.createDataFrame(items, schema), few).collect()
    assert rated == [3]
    assert {(r.query_id, r.item_id): r.grade for r in rows} == brute_grades(items, queries) and len(rows) == len(brute_grades(items, queries))
    # null ids, repeated rows, nulls in what is looked at: a row each; a query takes a named item first
    odd = [(None, *looks[0]), ("i1", *looks[0]), ("i1", *looks[0]), (None, None, None, "Kitchen", None, None), ("i2", None, None, "Kitchen", None, None), (None, *looks[1])]
    got = sorted((r.query_id, r.item_id or "", r.grade) for r in judgements.grade(spark.createDataFrame(odd, schema), few.filter("query_id != 'q3'")).collect())
    assert got == [("q1", "", 3), ("q1", "i1", 3), ("q1", "i1", 3), ("q2", "", 1), ("q2", "i1", 2), ("q2", "i2", 1)]


def test_reports(spark, tmp_path):
    profile = spark.createDataFrame([("u", "warm"), ("v", "cold_start")], "user_id string, status string")
    prefs = spark.createDataFrame([("u", "brand", "b", 0.25), ("u", "brand", "a", 0.25), ("u", "brand", "c", 0.5)], "user_id string, dim string, value string, weight double")
    rows = {r.user_id: r for r in reports.profile_rows(profile, prefs, top=2).collect()}
    assert rows["u"].top_brand == '["c","a"]' and json.loads(rows["u"].brand_weights) == {"a": 0.25, "b": 0.25, "c": 0.5}
    assert rows["v"].top_category == "[]" and rows["v"].category_weights == "{}"
    metrics = spark.createDataFrame([("q", 5, 0.5, 1.0, 0.25, 0.125), ("r", 5, 0.0, 0.0, 0.0, 0.0)], "query_id string, k int, precision double, recall double, mrr double, ndcg double")
    record = reports.macro_record(metrics, (5,), algorithm="BM25")
    assert record.first().precision_at_5 == 0.25 and record.first().query_count == 2
    folder = str(tmp_path / "out")
    reports.write_report(folder, record, query_metrics=reports.wide_metrics(metrics, (5,)))
    assert spark.read.json(f"{folder}/metrics.json").first().algorithm == "BM25"
    assert spark.read.option("header", True).csv(f"{folder}/query_metrics.csv").filter("query_id = 'q'").first().ndcg_at_5 == "0.125"
    with pytest.raises(Exception, match="already exists"):
        reports.write_report(folder, record)
    base = spark.createDataFrame([(5, 0.25, 1.0, 0.0, 0.0)], "k int, precision double, recall double, mrr double, ndcg double")
    ours = base.unionByName(base.withColumn("k", F.lit(10)))
    made = {(r.k, r.metric): r.delta for r in reports.deltas(ours, base).collect()}
    assert made[5, "recall"] == 0 and made[10, "recall"] is None


def test_tables_on_disk(spark, tmp_path):
    made = simulate.simulate(spark, TOYS)
    files.write_tables({t: made[t].limit(20) for t in ("items", "users", "queries")}, str(tmp_path))
    read = files.read_tables(spark, str(tmp_path))
    assert read["items"].count() == 20 and read["events"].count() == 0 and read["qrels"].columns == ["query_id", "item_id", "relevance_grade"]
    assert read["users"].filter("size(preferred_categories) = 0 or preferred_categories is null").count() == 0
    twice = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "item_id string, n int").coalesce(1)
    assert {r.item_id: r.n for r in files.last_rows(twice, "item_id").collect()} == {"a": 3, "b": 2}
