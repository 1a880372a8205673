"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected positions are kept: word positions whose ``gram``-word hash is the
smallest of some ``window`` neighbours.  Any stretch of ``length`` words holds such a position among
its first ``window``, its anchor, and every copy of the stretch has the same anchor.  So each stretch
belongs to one suffix, which starts at most ``window - 1`` words into it, and copies of a stretch share the
first ``length - window + 1`` words of their suffixes.

1. One pass gives the suffixes' digests of that many words; those found once are dropped.
2. What is left gets its words: those before the anchor that its stretches need, and the next ``length``.
   These are sorted, over ranges of digests, by their words; a passage that many texts hold spans several ranges.
3. In the sorted order each suffix is compared with its neighbour, word by word.  Where the common
   words end decides how far matches reach to the right; suffixes with enough common words are then
   matched to the left.  Matches of ``length`` words or more come out as runs of the text, marked where
   they are the first of their kind.  Runs of suffixes at a partition's ends wait for the neighbouring
   partitions: only the first of each kind in a partition is passed on, and counted again.

Texts that are equal as a whole are one text in all of this: their rows get its runs, and all but the
first row are repeats throughout.  The first occurrence of a stretch, by id, text and place, stays;
others can be cut.  The result is the union of all stretches of ``length`` words that occur twice,
and nothing else.

Defined results: null, empty and short texts have no repeats; words are compared in lower case (A-Z);
every row is a document of its own, also where ids repeat; of equal texts the first has the smallest
id (null last), and rows that share it stay alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, checkpoint, lower_words

MIX = np.uint64(0x9E3779B97F4A7C15)
FIND = re.compile(WORD)
#: Places take so many bits beside a gram's hash; longer than any text.
PLACE_BITS = 30
#: Sorted suffixes that one task holds.
SUFFIXES_PER_TASK = 20_000
#: Words are joined by a byte that sorts before all of theirs, so that suffixes with common words are neighbours.
END, CONTROLS = b"\x00", re.compile(rb"[\x00-\x08]")
SHIFTED = bytes(range(1, 10)) + bytes(range(9, 256))


def sortable_words(text: str | None) -> list[bytes]:
    """Words in which the byte 0 does not occur; 0 to 8 become 1 to 9, of which 9 is free, being white space."""
    words = lower_words(text)
    return [w.translate(SHIFTED) for w in words] if CONTROLS.search((text or "").encode()) else words


def word_hashes(words: list[bytes], known: dict, max_words: int = 200_000) -> np.ndarray:
    if len(known) > max_words:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def stretches(ids: np.ndarray, n: int) -> np.ndarray:
    """Digests of all stretches of ``n`` words: halves are doubled up, so the cost is logarithmic in ``n``."""
    if len(ids) < n:
        return np.empty(0, np.uint64)

    def mixed(a, b):
        x = (a ^ (b * MIX + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    power, size = ids, 1
    while size * 2 <= n:
        power = mixed(power[: len(power) - size], power[size:])
        size *= 2
    return mixed(power[: len(ids) - n + 1], power[n - size : n - size + len(ids) - n + 1])


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` neighbours, by doubling."""
    size = 1
    out = values
    while size * 2 <= n:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    m = len(values) - n + 1
    return np.minimum(out[:m], out[n - size : n - size + m])


def anchors(ids: np.ndarray, length: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, and how many words before each its first and its last stretch start."""
    if len(ids) < length:
        return (np.empty(0, np.int64),) * 3
    grams = stretches(ids, gram)
    places = np.arange(len(grams), dtype=np.uint64)
    # the leftmost of the smallest hashes; its place comes with it
    keys = (grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | places
    at = (sliding_min(keys, window)[: len(ids) - length + 1] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return at[first], at[first] - first, at[first] - last


def suffix_digests(texts: DataFrame, length: int, window: int, gram: int, max_seen: int = 200_000) -> DataFrame:
    """``(d, u, at, far, near, n_words)`` of ``texts(u, text)``; a text without suffixes has one row, with its word count only.

    ``n_words`` is on a text's first row.  A task gives the rows of equal texts once, as far as it remembers them.
    """
    names = ["d", "u", "at", "far", "near", "n_words"]
    seed = length - window + 1

    def run(batches):
        known: dict = {}
        seen: set = set()
        for batch in batches:
            held, size = [], 0
            for u, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if u in seen:
                    continue
                if len(seen) >= max_seen:
                    seen.clear()
                seen.add(u)
                ids = word_hashes(lower_words(text.as_py()), known)
                at, far, near = anchors(ids, length, window, gram)
                n = max(1, len(at))
                count = np.zeros(n, np.int64)
                count[0] = len(ids)
                digests = stretches(ids, seed)[at].view(np.int64) if len(at) else np.zeros(1, np.int64)
                at, far, near = (x if len(x) else np.full(1, -1) for x in (at, far, near))
                held.append((digests, np.full(n, u), at, far, near, count))
                size += n
                if size >= 20_000:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    def packed(held):
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        types = (np.int64, np.int64, np.int32, np.int16, np.int16, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, types, strict=True)], names=names)

    return texts.mapInArrow(run, "d bigint, u bigint, at int, far smallint, near smallint, n_words bigint")


def with_words(seeds: DataFrame, length: int, window: int) -> DataFrame:
    """``(d, right, before, u, o, at, far, near)`` of ``seeds(u, o, text, places)``: a suffix's next words and those before it, nearest first."""

    def run(batches):
        for batch in batches:
            for u, o, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words, places = sortable_words(text.as_py()), places.as_py()
                for i in range(0, len(places), 4096):
                    part = places[i : i + 4096]
                    at = [p["at"] for p in part]
                    right = [END.join(words[a : a + length]) for a in at]
                    before = [END.join(words[a - p["far"] : a][::-1]) for a, p in zip(at, part, strict=True)]
                    columns = [pa.array([p["d"] for p in part], pa.int64()), pa.array(right, pa.binary()), pa.array(before, pa.binary()), pa.array([u] * len(at), pa.int64()), pa.array([o] * len(at), pa.int64())]
                    columns += [pa.array(at, pa.int32()), *(pa.array([p[c] for p in part], pa.int16()) for c in ("far", "near"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["d", "right", "before", "u", "o", "at", "far", "near"])

    return seeds.mapInArrow(run, "d bigint, right binary, before binary, u bigint, o bigint, at int, far smallint, near smallint")


def common_words(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Suffix:
    """A sorted suffix: who it is, its words, and the common words with the suffix before it."""

    __slots__ = ("at", "before", "common", "d", "far", "near", "o", "right", "u")

    def __init__(self, d, right, before, u, o, at, far, near):
        self.d, self.right, self.before = d, right.split(END), before.split(END) if before else []
        self.u, self.o, self.at, self.far, self.near, self.common = u, o, at, far, near, 0

    @property
    def place(self) -> tuple[int, int, int]:
        return (self.o, self.u, self.at)


def matched(interval: list[Suffix], length: int, border: bool) -> Iterator[tuple]:
    """Rows ``(u, start, stop, kind, digest, o, n)`` from suffixes that share their first words, in order.

    Kinds: ``repeat`` and ``first`` are runs of stretch starts, half-open; at a partition's border,
    the first of each kind of stretch is ``open``, one row per stretch.
    """
    if len(interval) == 1 and not border:
        return
    state: dict[int, list] = {}  # by suffix: it and its matched starts
    for back in range(max(s.far for s in interval), min(s.near for s in interval) - 1, -1):
        group: dict[bytes, list[Suffix]] = {}

        def close(group=group, back=back):
            for members in group.values():
                if len(members) < 2 and not border:
                    continue
                lead = min(members, key=lambda s: s.place)
                for s in members:
                    if s is lead and border:
                        digest = xxhash.xxh3_128_digest(END.join([*s.before[:back][::-1], *s.right[: length - back]]))
                        yield s.u, s.at - back, s.at - back + 1, "open", digest, s.o, len(members)
                    else:
                        state.setdefault(id(s), [s, []])[1].append((s.at - back, "first" if s is lead else "repeat"))
            group.clear()

        for s in interval:
            # further suffixes have fewer words in common than the stretch has to the right of the anchor
            if s.common < length - back and group:
                yield from close()
            if s.near <= back <= s.far:
                group.setdefault(END.join(s.before[:back]), []).append(s)
        yield from close()
    for s, starts in state.values():
        run = None
        for start, kind in starts:  # ascending: the furthest back comes first
            if run and run[1] == start and run[2] == kind:
                run[1] = start + 1
            else:
                if run:
                    yield s.u, run[0], run[1], run[2], None, s.o, 0
                run = [start, start + 1, kind]
        yield s.u, run[0], run[1], run[2], None, s.o, 0


def neighbour_runs(ordered: DataFrame, length: int, window: int) -> DataFrame:
    """Compares neighbours of each partition of the sorted suffixes."""
    seed = length - window + 1
    names = ["u", "start", "stop", "kind", "digest", "o", "n"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        out: list[tuple] = []
        interval: list[Suffix] = []
        edge = None  # the first digest of the partition, whose suffixes may go on in others

        def flush():
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Suffix(*row)
                if interval and interval[-1].place == s.place:  # from repeated rows
                    continue
                if interval:
                    s.common = common_words(interval[-1].right, s.right)
                    if s.common < seed or s.d != interval[-1].d:
                        out.extend(matched(interval, length, border=interval[0].d == edge))
                        interval = []
                        if len(out) >= 20_000:
                            yield flush()
                elif edge is None:
                    edge = s.d
                interval.append(s)
        if interval:
            out.extend(matched(interval, length, border=True))
        for i in range(0, len(out), 20_000):
            held, out = out, out[i : i + 20_000]
            yield flush()
            out = held

    return ordered.mapInArrow(run, "u bigint, start int, stop int, kind string, digest binary, o bigint, n bigint")


def repeats(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, length: int, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``(u, first_id, m, n_words)`` of each different text, and its ``(u, runs, cut_runs)`` where there are any.

    ``u`` is the text's hash, ``first_id`` the smallest id of its ``m`` rows; runs are half-open ranges of
    places where repeated stretches start, ``cut_runs`` those that are not the first of their kind.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(text).alias("u"), F.col(id_col).cast("bigint").alias("id"), text.alias("text")).filter("text is not null")
    units = scratch.keep(rows.groupBy("u").agg(F.min("id").alias("first_id"), F.count("*").alias("m")))
    suffixes = scratch.keep(suffix_digests(rows.select("u", "text"), length, window, gram))
    whole = suffixes.filter("at >= 0").select("d", "u", "at", "far", "near")
    # in several texts, or at several places of one
    found = whole.groupBy("d").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("u", "at")))
    # written, so that the join below is a plain one, whose hot digests Spark can split
    twice = scratch.keep(found.filter("min_u != max_u or min_at != max_at").select("d"))
    places = whole.join(twice, "d", "left_semi").groupBy("u").agg(F.sort_array(F.collect_set(F.struct("at", "far", "near", "d"))).alias("places"))
    order = F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("o")
    places = scratch.keep(places.join(units.select("u", order), "u"))
    # one row of each text
    texts = rows.select(F.col("u").alias("u2"), F.col("id").alias("id2"), "text")
    same = (F.col("u") == F.col("u2")) & (F.col("o") == F.coalesce("id2", F.lit((1 << 63) - 1)))
    seeds = scratch.keep(with_words(places.join(texts, same).select("u", "o", "text", "places"), length, window))
    tasks = max(1, -(-seeds.count() // SUFFIXES_PER_TASK))
    # ranges are cut by two longs, of which Spark samples a bounded number; a hot digest is cut by its places
    ordered = seeds.repartitionByRange(tasks, "d", F.xxhash64("u", "at")).sortWithinPartitions("d", "right", "before", "o", "u", "at")
    found = scratch.keep(neighbour_runs(ordered, length, window))
    waiting = found.filter("kind = 'open'")
    place = F.struct("o", "u", "start")
    kinds = waiting.groupBy("digest").agg(F.sum("n").alias("all"), F.min(place).alias("lead")).filter("all > 1")
    settled = waiting.select("u", "start", "stop", "digest", "o").join(kinds, "digest")
    late = settled.select("u", "start", "stop", F.when(F.col("lead") == place, "first").otherwise("repeat").alias("kind"))
    runs = found.filter("kind != 'open'").select("u", "start", "stop", "kind").unionByName(late)
    run = F.struct("start", "stop")
    runs = runs.groupBy("u").agg(F.collect_list(run).alias("runs"), F.collect_list(F.when(F.col("kind") == "repeat", run)).alias("cut_runs"))
    counts = suffixes.groupBy("u").agg(F.max("n_words").alias("n_words"))
    return units.join(counts, "u"), runs


def spans(runs: list, length: int) -> list[tuple[int, int]]:
    """The union of the stretches that start in half-open ranges, as half-open spans of words."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop - 1 + length))
        else:
            out.append((start, stop - 1 + length))
    return out


def passages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, window: int = 24, gram: int = 8
) -> DataFrame:
    """``(id, t, n_words, repeat_spans, cut_spans)`` of every row; ``t`` is the text's hash, spans are half-open ranges of words."""
    scratch = Scratch(docs.sparkSession)
    units, runs = repeats(docs, scratch, id_col=id_col, text_col=text_col, length=length, window=window, gram=gram)
    made = "struct<repeats: array<struct<start: bigint, stop: bigint>>, cuts: array<struct<start: bigint, stop: bigint>>>"

    @F.pandas_udf(made)
    def united(every, cuts):
        import pandas as pd

        rows = [tuple([{"start": s, "stop": e} for s, e in spans(x if x is not None else [], length)] for x in pair) for pair in zip(every, cuts, strict=True)]
        return pd.DataFrame(rows, columns=["repeats", "cuts"])

    merged = scratch.keep(runs.select("u", united("runs", "cut_runs").alias("r")))
    of_text = scratch.keep(units.join(merged, "u", "left").select(F.col("u").alias("t2"), "n_words", "first_id", "m", "r"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).isNull().alias("none"))
    rows = rows.join(of_text, (F.col("t") == F.col("t2")) & ~F.col("none"), "left")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("stop")))
    nothing = F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")
    long = F.col("n_words") >= length
    copy = long & (F.col("m") > 1)
    later = long & ~F.col("id").cast("bigint").eqNullSafe(F.col("first_id"))
    out = rows.select(
        F.col("id").alias(id_col),
        "t",
        F.coalesce("n_words", F.lit(0).cast("bigint")).alias("n_words"),
        F.when(copy, whole).otherwise(F.coalesce("r.repeats", nothing)).alias("repeat_spans"),
        F.when(later, whole).otherwise(F.coalesce("r.cuts", nothing)).alias("cut_spans"),
    )
    out = checkpoint(out)
    scratch.drop()
    return out


def words_in(spans_col: str):
    return F.expr(f"aggregate({spans_col}, 0L, (n, s) -> n + s.stop - s.start)")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: ``(id, n_words, n_repeat_words, n_cut_words, cut_spans)``."""
    found = passages(docs, id_col=id_col, text_col=text_col, **options)
    return found.select(id_col, "n_words", words_in("repeat_spans").alias("n_repeat_words"), words_in("cut_spans").alias("n_cut_words"), "cut_spans")


def cut_text(text: str, cuts: list) -> str:
    """``text`` without these spans of words; what stands between stays as it is."""
    places = [m.span() for m in FIND.finditer(text)]
    clean, at = [], 0
    for span in cuts:
        clean.append(text[at : places[span["start"]][0]])
        at = places[span["stop"] - 1][1]
    clean.append(text[at:])
    return "".join(clean)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """The rows and columns of ``docs`` with cleaned texts; ``length_col`` names a column that holds the text's length."""
    found = passages(docs, id_col=id_col, text_col=text_col, **options).filter("size(cut_spans) > 0")
    found = found.select(F.col(id_col).cast("bigint").alias("__id"), F.col("t").alias("__t"), F.col("cut_spans").alias("__cuts")).dropDuplicates(["__id", "__t"])
    same = (F.xxhash64(docs[text_col].cast("string")) == F.col("__t")) & docs[id_col].cast("bigint").eqNullSafe(F.col("__id"))

    @F.pandas_udf("string")
    def cleaned(text, cuts):
        import pandas as pd

        return pd.Series([None if t is None else cut_text(t, c) for t, c in zip(text, cuts, strict=True)], dtype=object)

    joined = docs.join(found, same, "left").withColumn("__clean", cleaned(F.when(F.col("__t").isNotNull(), docs[text_col].cast("string")), F.col("__cuts")))
    new = {text_col: F.col("__clean"), length_col: F.coalesce(F.length("__clean"), F.lit(0)).cast("bigint")}
    return joined.select(*(F.when(F.col("__t").isNotNull(), new[c]).otherwise(docs[c]).alias(c) if c in new else docs[c] for c in docs.columns))
