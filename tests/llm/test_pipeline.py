from pyspark.sql import functions as F

import corpus_pipeline
from ranklake.llm import quality_classifier


def five_word_links(texts):
    sets = {}
    for key, text in texts.items():
        words = text.lower().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_near_duplicates_takes_five_words(spark):
    words = [f"w{i}" for i in range(80)]
    changed = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))
    # two changes: 0.82 at four words, 0.77 at five; one change: 0.87 at five
    texts = {1: changed(), 2: changed(20, 50), 3: " ".join(f"z{i}" for i in range(90)), 4: changed(20)}
    texts |= {5: texts[3].replace("z30", "y"), 6: " ".join(f"v{i}" for i in range(80)), 7: " ".join(f"u{i}" if i in (20, 50) else f"v{i}" for i in range(80))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    component = {k: k for k in texts}
    for a, b in sorted(five_word_links(texts)) * len(texts):
        component[a] = component[b] = min(component[a], component[b])
    want = {k for k, c in component.items() if k == c}
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == want and {6, 7} <= got


def test_quality_stage_takes_every_trusted_text(spark, tmp_path):
    """A language whose only trusted text is among more than 100,000 ids, and like no other text, keeps it."""
    held = F.pmod(F.xxhash64("text"), F.lit(quality_classifier.FOLDS)) == 0
    odd = spark.range(50).selectExpr("concat('щюя', id) text").filter(held).first().text
    docs = spark.range(60).selectExpr("id doc_id", "concat('l', id) lang", f"if(id = 3, '{odd}', concat('text number ', id)) text")
    spark.range(150_000).selectExpr("id doc_id", "1 quality").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).filter("doc_id = 3").count() == 1
