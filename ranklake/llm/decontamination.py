"""Benchmark decontamination: size-partitioned MinHash containment search (native).

A document is contaminated by an item if it contains ``threshold`` of the item's distinct word
shingles.  Items are partitioned by the size of their shingle set, in powers of two.  Each
partition has a sketch depth: the item's ``k`` smallest hashes (a bottom-k MinHash), with ``k`` taken
from the largest member, so that fewer than ``k`` shingles may be missing and a document that
reaches the threshold must hold one of the ``k`` — the search loses nothing, however long the
document.  Candidates are verified by exact containment on the shingles' words.

The sketches of items of up to ``max_item_probes`` hashes are a literal, probed inside each row, while
all of them together stay within a checked size: texts are then never shuffled, and each pair is verified
once, in the row that holds the text.  Longer items, and all of a larger benchmark, take a
shuffled join of shingle hashes instead, pre-filtered by the sketches' largest hash.  Both give the same rows.

An item of fewer than five words is one shingle, its whole word sequence.

Defined results: words are compared in lower case without punctuation; null, empty and wordless
texts and items match nothing; equal items are matched each; every row is a document of its own, also
where ids repeat or are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, computed

WIDTH = 5
#: Words: runs of letters and digits of any script.
LETTERS = r"[\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0))


def shingles(words: str, width: int) -> Column:
    """Distinct shingles as strings of words."""
    n = f"size({words})"
    return F.expr(f"case when {n} >= {width} then array_distinct(transform(sequence(0, {n} - {width}), i -> concat_ws(' ', slice({words}, i + 1, {width})))) else cast(array() as array<string>) end")


def hashes(words: str, width: int) -> Column:
    """Hashes of all shingles; equal shingles may repeat."""
    n, parts = f"size({words})", ", ".join(f"get({words}, i + {j})" for j in range(width))
    return F.expr(f"case when {n} >= {width} then transform(sequence(0, {n} - {width}), i -> xxhash64({parts}, {width})) else cast(array() as array<bigint>) end")


def sketch_items(items: DataFrame, item_id: str, item_text: str, threshold: float) -> DataFrame:
    """``(item, width, grams, need, probes)``: distinct shingles, how many must be found, the k smallest hashes."""
    df = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t"))
    df = computed(df, "w", words_of(F.col("t"))).filter(F.size("w") > 0)
    df = df.withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    grams = hashed = None
    for width in range(1, WIDTH + 1):
        grams = F.when(F.col("width") == width, shingles("w", width)) if grams is None else grams.when(F.col("width") == width, shingles("w", width))
        keys = F.array_distinct(hashes("w", width))
        hashed = F.when(F.col("width") == width, keys) if hashed is None else hashed.when(F.col("width") == width, keys)
    df = df.withColumn("grams", grams).withColumn("keys", hashed).withColumn("n", F.size("grams"))
    df = df.withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    # the partition's depth: its largest member may miss the most
    top = F.least(F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1) - 1, F.lit(2**30))
    depth = F.least(F.col("n"), (top - F.ceil(top * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))
    return df.withColumn("probes", F.slice(F.sort_array("keys"), F.lit(1), depth)).select("item", "width", "grams", "n", "need", "probes")


def found_in(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, threshold: float, max_probes: int, max_bytes: int, max_item_probes: int
) -> DataFrame:
    """``(id, t, item, n_shingles, n_found)``; ``t`` is the hash of the row's text."""
    # items are numbered, as their ids may repeat or be null
    sketched = checkpoint(sketch_items(items, item_id, item_text, threshold).withColumn("no", F.monotonically_increasing_id())).withColumn("short", F.size("probes") <= max_item_probes)
    size = {
        r.short: r
        for r in sketched.groupBy("short")
        .agg(F.sum(F.size("probes")).alias("probes"), F.sum(F.length(F.array_join("grams", " "))).alias("bytes"), F.array_sort(F.collect_set("width")).alias("widths"))
        .collect()
    }
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    small = True not in size or (size[True].probes <= max_probes and size[True].bytes <= max_bytes)
    short, long = (sketched.filter("short"), sketched.filter("not short")) if small else (sketched.limit(0), sketched)
    pairs = in_rows(rows, short, list(size[True].widths) if small and True in size else [])
    if not small or False in size:
        pairs = pairs.unionByName(by_join(rows, long, sorted({w for r in size.values() for w in r.widths})))
    return pairs


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
    max_probes: int = 50_000,
    max_bytes: int = 16 << 20,
    max_item_probes: int = 256,
) -> DataFrame:
    """``(id, item, n_shingles, n_found, containment)`` for every row and item that it contains.

    ``max_probes`` sketch hashes and ``max_bytes`` of shingles are the checked size up to which the
    benchmark is a literal and a broadcast.
    """
    pairs = found_in(docs, items, id_col, text_col, item_id, item_text, threshold, max_probes, max_bytes, max_item_probes)
    return pairs.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def remove(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
    max_probes: int = 50_000,
    max_bytes: int = 16 << 20,
    max_item_probes: int = 256,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    pairs = found_in(docs, items, id_col, text_col, item_id, item_text, threshold, max_probes, max_bytes, max_item_probes)
    gone = checkpoint(pairs.select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct())
    same = (F.xxhash64(docs[text_col].cast("string")) == F.col("__t")) & docs[id_col].eqNullSafe(F.col("__id"))
    return docs.join(gone, same, "left_anti")


def verified(df: DataFrame) -> DataFrame:
    """Exact containment of ``grams`` in the row's words ``w``, for rows of one pair each."""
    own = None
    for width in range(1, WIDTH + 1):
        own = F.when(F.col("width") == width, shingles("w", width)) if own is None else own.when(F.col("width") == width, shingles("w", width))
    df = computed(df, "n_found", F.size(F.array_intersect("grams", own)))
    return df.filter(F.col("n_found") >= F.col("need")).select("id", "t", "item", F.col("n").cast("bigint").alias("n_shingles"), F.col("n_found").cast("bigint"))


def in_rows(rows: DataFrame, sketched: DataFrame, widths: list[int]) -> DataFrame:
    """Probes as a literal; a pair is verified at the first probe that its document holds.

    ``(probe, item)`` and the items are broadcast on their own, each of the size that was checked.
    """
    df, parts = computed(rows, "w", words_of(F.col("text"))).drop("text"), [F.expr("cast(array() as array<bigint>)")]
    for width in widths:
        probes = [r.p for r in sketched.filter(F.col("width") == width).select(F.explode("probes").alias("p")).distinct().collect()]
        df = df.withColumn(f"keys_{width}", hashes("w", width))
        parts.append(F.expr(f"filter(keys_{width}, h -> h in ({', '.join(f'{p}L' for p in probes)}))" if probes else "cast(array() as array<bigint>)"))
    df = computed(df, "hits", F.array_distinct(F.concat(*parts))).filter(F.size("hits") > 0).select("id", "t", "w", "hits", F.explode("hits").alias("probe"))
    df = df.join(F.broadcast(sketched.select("no", F.explode("probes").alias("probe"))), "probe")
    df = df.join(F.broadcast(sketched.select("no", "item", "width", "grams", "n", "need", "probes")), "no")
    return verified(df.filter(F.get(F.array_intersect("probes", "hits"), F.lit(0)) == F.col("probe")))


def by_join(rows: DataFrame, sketched: DataFrame, widths: list[int]) -> DataFrame:
    """For items beyond a literal's size: join shingle hashes, then verify the candidates' texts.

    Hashes above their width's largest probe are dropped before the shuffle.
    """
    table = sketched.select("no", F.explode("probes").alias("probe"))
    top = {r.width: r.top for r in sketched.select("width", F.element_at("probes", -1).alias("p")).groupBy("width").agg(F.max("p").alias("top")).collect()}
    words = computed(rows, "w", words_of(F.col("text"))).drop("text")
    below = [F.filter(F.array_distinct(hashes("w", width)), lambda h, t=top[width]: h <= F.lit(t)) for width in widths if width in top]
    keys = F.concat(F.expr("cast(array() as array<bigint>)"), *below)
    pairs = words.select("id", "t", F.explode(keys).alias("probe")).join(table, "probe").select(F.col("id").alias("id2"), F.col("t").alias("t2"), "no").distinct()
    return verified(words.join(pairs, (F.col("t") == F.col("t2")) & F.col("id").eqNullSafe(F.col("id2"))).join(sketched.drop("probes", "short"), "no"))
