r"""MinHash near-duplicate detection with odd sketches.

1. One pass makes each text's set of word shingles (hashed to 64 bits), a 128-bit digest of the whole
   set, ``bands`` band keys of MinHash samples, and an odd sketch: the samples folded into a parity
   bitmap, where the population count of the XOR of two bitmaps estimates how many samples differ.
   Texts with equal sets are one node from here on; a task emits the keys of a set once.
2. Nodes that share a bucket with another node get their full sets written; nobody else's text moves.
3. One round of stars: each node is compared with one lead, the member most often met in other
   buckets, of the bucket leads the one it shares most buckets with.  A pair whose sketches are too far apart is
   dropped; the others are confirmed on their full sets.  A group of copies needs as many comparisons
   as it has members.  Links point to nodes of a higher order, so components come by pointer jumping.
4. Nodes of buckets that still hold several components go on by their rarest shingles, under an exact
   prefix and position filter: members outside a shingle's commonest component meet the others of it.
   In a group of near copies, what is too far from its centre has its own changes first and meets nobody.

The filters of step 4 lose no pair that shares a bucket.  Bands of 4 at similarity 0.8 miss a pair
with probability 5e-8.  Sketches drop a pair at the limit with probability 1e-6 (``deviations`` of the
binomial law); ``deviations=None`` leaves them out, and then no pair that the bands see is lost.
Nothing about single documents reaches the driver.

Defined results: every row is a document of its own, linked by its text alone, also where ids repeat;
a text without words (null, empty) has an empty set and is linked with nothing; fewer words than the
width are one shingle; a component is named by its smallest id, null if it has none; rows of that id
in it are kept, so repeated rows stay repeated; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, checkpoint, lower_words

SKETCH_BITS = 512


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes; word hashes are kept, up to a bound."""

    def __init__(self, width: int, max_words: int = 200_000):
        self.width, self.max_words, self.known = width, max_words, {}
        self.weights = np.random.default_rng(97).integers(1, 1 << 63, width + 1, dtype=np.uint64) | np.uint64(1)

    def hashes(self, text: str | None) -> np.ndarray:
        words = lower_words(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))
        mixed = np.full(len(ids) - k + 1, k, np.uint64) * self.weights[-1]
        for j in range(k):
            mixed = (mixed ^ (ids[j : len(ids) - k + 1 + j] * self.weights[j])) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def samples(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of each random linear map of the hashes' upper halves, in blocks that stay in the cache."""
    short, best = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 512):
        mapped = a[:, None] * short[None, i : i + 512]
        mapped += b[:, None]
        np.minimum(best, mapped.min(axis=1), out=best)
    return best.astype(np.uint64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One hash of each row, different for equal rows of different bands."""
    mixed = np.arange(1, len(mins) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for column in mins.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """The parity bitmap as longs."""
    mixed = (mins ^ (np.arange(1, len(mins) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.bincount((mixed >> np.uint64(55)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def features(rows: DataFrame, width: int, bands: int, samples_per_band: int, max_seen: int = 200_000) -> DataFrame:
    """``(doc_id, t, n, digest, h, keys, sketch)`` of ``rows(doc_id, t, text)``.

    ``h`` is half of the digest.  Keys and sketch are null for an empty set, and for a set that the
    task has just emitted: copies are gathered before they are shuffled.
    """
    schema = "doc_id bigint, t bigint, n bigint, digest binary, h bigint, keys array<bigint>, sketch array<bigint>"
    longs = pa.list_(pa.int64())

    def run(batches):
        shingler, rng, seen = Shingler(width), np.random.default_rng(31), set()
        a = rng.integers(0, 1 << 31, bands * samples_per_band, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, bands * samples_per_band, dtype=np.uint32)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, digests, halves, keys, sketches = [], [], [], [], []
                for text in part.column(2):
                    hashes = shingler.hashes(text.as_py())
                    n.append(len(hashes))
                    digest = xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None
                    digests.append(digest)
                    halves.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                    if digest is None or digest in seen:
                        keys.append(None)
                        sketches.append(None)
                        continue
                    if len(seen) >= max_seen:
                        seen.clear()
                    seen.add(digest)
                    mins = samples(hashes, a, b)
                    keys.append(band_keys(mins.reshape(bands, samples_per_band)))
                    sketches.append(odd_sketch(mins))
                made = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(halves, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "t", "n", "digest", "h", "keys", "sketch"])

    return rows.mapInArrow(run, schema)


def full_sets(wanted: DataFrame, width: int) -> DataFrame:
    """``(digest, n, keys, sketch, hashes)``: the whole shingle set of each of ``wanted(digest, n, keys, sketch, text)``."""

    def run(batches):
        shingler, last = Shingler(width), None
        for batch in batches:
            for i, digest in enumerate(batch.column(0).to_pylist()):
                if digest != last:  # repeated rows are neighbours
                    last, row = digest, batch.slice(i, 1)
                    hashes = shingler.hashes(row.column(4)[0].as_py()).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([hashes], pa.list_(pa.int64()))], names=["digest", "n", "keys", "sketch", "hashes"])

    return wanted.select("digest", "n", "keys", "sketch", "text").mapInArrow(run, "digest binary, n bigint, keys array<bigint>, sketch array<bigint>, hashes array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, limit: int | None) -> DataFrame:
    """The pairs ``(a, b)`` whose sketches differ in at most ``limit`` bits and whose full sets reach ``percent`` of their union.

    A node with many partners is the ``b`` of its pairs: its set meets them in as many tasks as Spark splits them into.
    """
    left, right = (sets.select(F.col("sid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "hashes"))) for x in ("a", "b"))
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    if limit is not None:
        bits = [F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(SKETCH_BITS // 64)]
        close = close & (sum(bits[1:], bits[0]) <= limit)
    both = pairs.join(left, "a").join(right, (pairs["b"] == right["b"]) & close).drop(right["b"])
    same = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.filter(100 * same >= percent * (F.col("n_a") + F.col("n_b") - same)).select(*pairs.columns)


def star_pairs(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The members ``(key, sid)`` of shared buckets, and ``(a, b)``: each node and its lead.

    Nodes are ordered by the sizes of their buckets together, then by number; a lead is the highest of
    a bucket, and a node takes the one that it shares most buckets with.
    """
    spread = sets.select("sid", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = scratch.keep(spread.join(shared, "key"))
    score = members.groupBy("sid").agg(F.sum("m").alias("score"))
    top = members.join(score, "sid").groupBy("key").agg(F.max(F.struct("score", "sid")).alias("top"))
    votes = members.join(top, "key").filter("top.sid != sid").groupBy("sid", "top").agg(F.count("*").alias("c"))
    best = votes.groupBy("sid").agg(F.max(F.struct("c", "top")).alias("best"))
    return members.select("key", "sid"), best.select(F.col("sid").alias("a"), F.col("best.top.sid").alias("b"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(sid, root)`` from ``links(a, b)``, at most one from each node and without circles: pointers are doubled until none moves."""
    at = scratch.keep(links.select(F.col("a").alias("sid"), F.col("b").alias("root")))
    while True:
        moved = Observation()
        up = at.select(F.col("sid").alias("via"), F.col("root").alias("further"))
        new = at.join(up, F.col("root") == F.col("via"), "left").observe(moved, F.count("further").alias("n"))
        at = scratch.keep(new.select("sid", F.coalesce("further", "root").alias("root")))
        if not moved.get["n"]:
            return at


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)``: the smallest id reachable from each end of ``edges(a, b)``."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        changed = Observation()
        heard = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("heard"))
        new = labels.join(heard, labels.id == heard.a).select("id", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("id").alias("via"), F.col("component").alias("further"))
        new = new.join(jump, F.col("component") == F.col("via")).select("id", F.least("component", "further").alias("component"), "old")
        labels = scratch.keep(new.observe(changed, F.count(F.expr("case when component != old then 1 end")).alias("n"))).select("id", "component")
        if not changed.get["n"]:
            return labels


def prefixes(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``(key, sid, comp, n, at)``: the rarest shingles of each of ``sets(sid, comp, n, hashes)``, with their places.

    In one order of all shingles, rare ones first, two sets of the wanted similarity share one of
    their first ``n - ceil(n * percent / 100) + 1``.  A set's own shingles come first and are only counted.
    """
    rows = sets.select("sid", "comp", "n", F.explode("hashes").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = rows.join(counts, "key").groupBy("sid", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("m", "key"))).alias("all"))
    own = F.col("n") - F.size("all")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own).cast("int")
    first = shared.filter(length > 0).select("sid", "comp", "n", own.alias("own"), F.posexplode(F.slice("all", F.lit(1), length)).alias("place", "s"))
    return scratch.keep(first.select(F.col("s.key").alias("key"), "sid", "comp", "n", (F.col("own") + F.col("place")).alias("at")))


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of different components that may reach ``percent``, by what the first shared shingle leaves of both sets."""
    of_key = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", F.xxhash64("sid")).alias("common")).filter("lo != hi")
    few = rows.join(of_key.select("key", "common"), "key").filter("comp != common").drop("common")
    other = rows.select("key", *(F.col(c).alias(f"{c}2") for c in ("sid", "comp", "n", "at")))
    enough = F.expr(f"comp != comp2 and {100 + percent} * least(n - at, n2 - at2) >= {percent} * (n + n2)")
    pairs = few.join(other, (few["key"] == other["key"]) & enough)
    return pairs.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()


def with_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, t, text)``: ``t`` tells texts of one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, samples_per_band: int, deviations: float | None) -> DataFrame:
    """``(doc_id, t, n, component_id)`` of every row."""
    source, scratch = with_hash(docs, id_col, text_col), Scratch(docs.sparkSession)
    made = scratch.keep(features(source, width, bands, samples_per_band))
    once = made.filter("keys is not null")
    spread = once.select("h", F.explode("keys").alias("key"))
    open_keys = spread.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("key")
    open_nodes = spread.join(open_keys, "key", "left_semi").select("h").distinct()
    wanted = once.join(open_nodes, "h", "left_semi").dropDuplicates(["digest"]).withColumnsRenamed({"doc_id": "id2", "t": "t2"})
    texts = source.join(wanted, (F.col("t") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("id2")))
    sets = scratch.keep(full_sets(texts, width).withColumn("sid", F.monotonically_increasing_id()))

    # samples that differ at the threshold, with some deviations on top, change two bits each at most
    n, far = bands * samples_per_band, 1 - percent / 100
    limit = None if deviations is None else int(2 * (n * far + deviations * (n * far * (1 - far)) ** 0.5))
    members, pairs = star_pairs(sets, scratch)
    root = roots(confirmed(pairs, sets, percent, limit), scratch)
    of_sid = members.join(root, "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("comp"))
    undecided = of_sid.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    left = of_sid.join(undecided, "key", "left_semi").select("sid", "comp").distinct()
    rest = scratch.keep(sets.join(left, "sid").select("sid", "comp", "n", "hashes"))
    late = confirmed(prefix_pairs(prefixes(rest, percent, scratch), percent), sets, percent, limit)
    comp = rest.select("sid", "comp")
    edges = late.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(edges, scratch)

    nodes = sets.select("digest", "sid").join(root, "sid", "left").select("digest", F.coalesce("root", "sid").alias("id"))
    # rows that repeat in id and text may have given a set twice; equal sets are linked
    nodes = nodes.join(merged, "id", "left").groupBy("digest").agg(F.min(F.coalesce("component", "id")).alias("comp"))
    ids = made.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    firsts = ids.join(nodes, "digest")
    names = firsts.groupBy("comp").agg(F.min("first").alias("name"))
    named = ids.join(firsts.join(names, "comp").select("digest", "name", F.lit(True).alias("met")), "digest", "left")
    # written, so that the join below is a plain one, whose hot digests Spark can split
    named = scratch.keep(named.select("digest", F.expr("if(met, name, first)").alias("name"), F.lit(True).alias("known")))
    out = made.select("doc_id", "t", "n", "digest").join(named, "digest", "left")
    out = checkpoint(out.select("doc_id", "t", "n", F.expr("if(known, name, doc_id)").alias("component_id")))
    scratch.drop()
    return out


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, samples_per_band: int = 4, deviations: float | None = 5.0
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row."""
    out = labelled(docs, id_col, text_col, width, percent, bands, samples_per_band, deviations)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept().alias("kept"))


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, samples_per_band: int = 4, deviations: float | None = 5.0
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    gone = labelled(docs, id_col, text_col, width, percent, bands, samples_per_band, deviations).filter(~kept()).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    same = (F.xxhash64(docs[text_col].cast("string")) == F.col("__t")) & docs[id_col].cast("bigint").eqNullSafe(F.col("__id"))
    return docs.join(gone, same, "left_anti")
