import re

from pyspark.sql import functions as F

from ranklake.llm.decontamination import find, remove

LONG = " ".join(f"k{i}" for i in range(3000))
ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs far away from here today"), (2, "Two words"), (3, None), (4, ""), (5, "!!"), (6, LONG), (7, "two WORDS."), (None, "one lonely null item with some words in it")]


def brute_force(docs, items):
    words = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    out = []
    for key, text in docs:
        w = words(text)
        for item, other in items:
            v = words(other)
            if not v:
                continue
            k = min(5, len(v))
            own = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            hit = len(own & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
            if hit * 10 >= len(own) * 8:
                out.append((key, item, len(own), hit))
    return sorted(out, key=str)


def test_both_forms_equal_brute_force(spark):
    fox = ITEMS[0][1]
    docs = [(1, "well, " + fox.upper() + "! " + "x " * 50), (1, "another text of id one"), (1, fox), (3, fox), (3, fox), (None, "null " + fox), (None, "two words"), (4, None), (5, ""), (6, LONG)]
    docs += [(7, " ".join(LONG.split()[:2500])), (8, " ".join(LONG.split()[:2000])), (9, fox.replace("lazy", "idle")), (10, fox.replace("today", "now")), (11, "one lonely null item with some words in it")]
    docs += [(20 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = ITEMS + [(20 + r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item": F.lit(1), "probe": F.lit(2), "t": F.lit(3)})
    listed = spark.createDataFrame(items, "item_id bigint, text string").withColumn("width", F.lit("clash"))
    want = brute_force(docs, items)
    assert any(r[1] == 6 for r in want) and any(r[0] is None for r in want)
    for options in ({}, {"max_probes": 0}, {"max_item_probes": 10_000}):
        got = sorted((tuple(r)[:4] for r in find(rows, listed, **options).collect()), key=str)
        assert got == want, options
        left = remove(rows, listed, **options)
        found = {(k, t) for k, t in docs if any(r[0] == k for r in brute_force([(k, t)], items))}
        assert left.columns == rows.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((d for d in docs if d not in found), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for options in ({}, {"max_probes": 0}):
        assert find(docs, items.limit(0), **options).count() == 0 and find(docs.limit(0), items, **options).count() == 0
        assert remove(docs, items.limit(0), **options).count() == 1
