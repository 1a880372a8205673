import numpy as np
from pyspark.sql import functions as F

from ranklake.llm import quality_classifier
from ranklake.llm.quality_classifier import FOLDS, classify, keep_good, thresholds, with_ids


def test_threshold_is_the_held_out_quantile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = classify(docs, labels, quantile=0.9).collect()
    trusted = {r.doc_id for r in labels.filter("quality = 1").collect()}
    held = {r.doc_id for r in docs.filter((F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0) & F.col("text").isNotNull()).collect()} & trusted
    assert 0 < len(held) < len(trusted)
    for lang in {r.lang for r in got}:
        rows = [r for r in got if r.lang == lang]
        own = sorted(r.perplexity for r in rows if r.doc_id in held)
        if own:
            assert {r.threshold for r in rows} == {own[int(np.ceil(0.9 * len(own))) - 1]}, lang
        assert all(r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) for r in rows)


def test_join_form_equals_broadcast_form(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").limit(60)
    docs = docs.union(spark.createDataFrame([(-1, "en", None), (-2, "en", " "), (-3, None, "a b")], docs.schema))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    broadcast, joined = ({r.doc_id: r for r in classify(docs, labels, max_table=most).collect()} for most in (4_000_000, 0))
    assert broadcast.keys() == joined.keys() and len(joined) == 63
    for key, want in broadcast.items():
        got = joined[key]
        assert (got.perplexity is None) == (want.perplexity is None) and (got.perplexity is None or np.isclose(got.perplexity, want.perplexity)), key
        assert np.isclose(got.threshold, want.threshold), key


def test_unseen_trusted_texts_are_kept(spark):
    """Trained on half of the trusted texts: the other half passes, most of the bad ones do not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r.kept for r in classify(docs, labels.filter("quality = 1 and crc32(cast(doc_id as string)) % 2 = 0")).collect()}
    unseen = [got[r.doc_id] for r in labels.filter("quality = 1 and crc32(cast(doc_id as string)) % 2 = 1").collect()]
    bad = [got[r.doc_id] for r in labels.filter("quality = 0").collect()]
    assert len(unseen) > 1000 and sum(unseen) >= 0.98 * len(unseen) and sum(bad) <= 0.3 * len(bad)


def test_rows_keep_their_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    extra = spark.createDataFrame([(None, "x", None, None, 1), (None, None, "en", "s", None), (1, "", "en", "s", 0)], docs.schema)
    docs = docs.union(extra).withColumns({"g": F.lit(1), "perplexity": F.lit("p"), "held": F.lit(True)})
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept, verdicts = keep_good(docs, labels), classify(docs, labels)
    assert kept.columns == docs.columns and kept.count() == verdicts.filter("kept").count()
    assert keep_good(docs, labels.limit(0)).count() == docs.filter("trim(coalesce(text, '')) != ''").count()
    assert keep_good(docs.limit(0), labels).count() == 0


def test_every_trusted_text_counts(spark):
    """Among more than 100,000 trusted ids, the held-out text of each language sets its threshold; none is left out."""
    docs = spark.range(60).selectExpr("id doc_id", "concat('l', id) lang", "concat('text number ', id) text")
    held = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).collect()}
    labels = spark.range(150_000).selectExpr("id doc_id", "1 quality")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == 60 and len(held) > 10
    assert [i for i in sorted(held) if got[i].threshold != got[i].perplexity] == []


def test_trusted_rows_by_broadcast_and_by_join(spark):
    rows = spark.createDataFrame([(1, "en", "a"), (1, "de", "b"), (None, "en", "c"), (0, "en", "d"), (7, None, None), (-5, "en", "e")], "__id bigint, __lang string, __text string")
    for ids in ([1, 7, -5, None], [0], [None], []):
        listed = spark.createDataFrame([(i,) for i in ids], "__id bigint")
        want = sorted(((r[1] or "", r[2] or "") for r in rows.collect() if r[0] is not None and r[0] in ids))
        for most in (100, 0):
            assert sorted((r[0] or "", r[1] or "") for r in with_ids(rows, listed, most).collect()) == want, (ids, most)


def test_thresholds_are_exact(spark):
    """Of many perplexities, too: the value of that very rank, for each language, for none and for all."""
    limits = spark.range(300_000).selectExpr("case when id % 3 = 0 then 'a' when id % 3 = 1 then null else concat('l', id % 40) end __lang", "abs(xxhash64(id)) / 1e12 __perplexity")
    rows = [(r[0], r[1]) for r in limits.collect()]
    got = {(r["__all"], r["__of"]): r["__limit"] for r in thresholds(limits, 0.99).collect()}
    keys = {(False, lang) for lang, _ in rows} | {(True, None)}
    assert got.keys() == keys
    for every, lang in keys:
        own = sorted(p for x, p in rows if every or x == lang)
        assert got[every, lang] == own[int(np.ceil(0.99 * len(own))) - 1], lang


def test_a_task_holds_one_python_worker(spark, monkeypatch):
    """What goes into a Python step comes from files: two steps in one task would hold two workers, which stay with their memory."""
    plans = []
    for name in ("counted", "perplexities"):

        def seen(rows, *more, step=getattr(quality_classifier, name)):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return step(rows, *more)

        monkeypatch.setattr(quality_classifier, name, seen)
    docs = spark.range(60).selectExpr("id doc_id", "concat('l', id % 3) lang", "concat('text number ', id) text")
    assert keep_good(docs, spark.range(30).selectExpr("id doc_id", "1 quality")).count() > 0
    assert len(plans) == 4 and [p for p in plans if "MapInArrow" in p] == []
