import re

from pyspark.sql import functions as F

from ranklake.llm.near_dedup import keep_one, near_duplicates


def brute_force(rows):
    sets = {}
    for key, text in rows:
        words = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[key] = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {(k, len(sets[k]), root(k), root(k) == k) for k in keys}


def test_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    base = ("one two three four five six seven eight nine ten " * 2).split() + [f"w{i}" for i in range(80)]
    for i in range(40):
        rows.append((10_000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])))
    rows += [(20_000, None), (20_001, ""), (20_002, "Ab c"), (20_003, "aB  c"), (20_004, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("clash"))
    got = {tuple(r) for r in near_duplicates(docs, width=4).collect()}
    assert got == brute_force(rows)
    assert near_duplicates(docs.limit(0), width=4).count() == 0


def test_repeated_and_null_ids(spark):
    """Each row is a document of its own: as many rows come out as go in."""
    words = [f"w{i}" for i in range(100)]
    near = " ".join(["x", *words[1:]])
    rows = [(1, " ".join(words)), (1, "quite another text of the same id"), (2, near), (None, near + " y"), (None, "alone and without an id"), (3, None), (None, None), (2, near)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("t", "n", "keys", "component_id")})
    got = sorted((tuple(r) for r in near_duplicates(docs, width=4).collect()), key=str)
    assert got == sorted([(1, 97, 1, True), (1, 4, 1, True), (2, 97, 1, False), (2, 97, 1, False), (None, 98, 1, False), (None, 2, None, True), (3, 0, 3, True), (None, 0, None, True)], key=str)
    kept = keep_one(docs, width=4)
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[5], rows[6]], key=str)


def test_large_group_of_near_copies(spark):
    """Each of 600 copies has its own changes, some too many to be linked with any other."""
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(f"c{i}" if (i * 7 + j * 13) % 150 < 4 * (i % 6 == 0) + (i % 4) else w for j, w in enumerate(base))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in near_duplicates(docs, width=4, deviations=None).collect()} == brute_force(rows)
