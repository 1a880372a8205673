"""URL filter: exact rule membership by a cascade of Bloom filters (native).

The listed keys are ``host + path`` rules.  Level 1 encodes them.  The keys of the corpus that pass
level 1 without being listed are encoded by level 2, the listed keys that pass level 2 by level 3,
and so on until a level lets nothing wrong through.  Over the corpus's complete key universe the
answer "number of the first level that rejects is even" is then exact, and a scan of the corpus
needs no join: the filters are literals of a proven size.

A URL's keys are its host's last ``k`` labels followed by the first ``l`` characters of its path,
for every shape ``(k, l)`` that some rule has; no other key can match, however long a URL is.

Defined results: a null URL, or one without ``://``, has empty host and path and gets the default
verdict; repeated rows stay repeated; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, constant_longs

#: Bits per listed key and hash functions of level 1; the other levels use one hash at half density.
FIRST_BITS, FIRST_HASHES, NEXT_BITS = 14, 8, 1.5


@dataclass(frozen=True)
class Rule:
    """A rule for ``host`` and all its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int]


@dataclass
class BloomCascade:
    """Exact membership for the keys of the universe that it was built over."""

    levels: list[Level] = field(default_factory=list)

    @property
    def size_in_bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(~passes(level, key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + j)), F.lit(bits).cast("bigint")) for j in range(hashes)]


def passes(level: Level, key: Column) -> Column:
    words, found = constant_longs(level.words), F.lit(True)
    for at in positions(key, level.bits, level.hashes, level.seed):
        found = found & (F.bit_get(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
    return found


def encode(keys: DataFrame, n: int, seed: int, first: bool) -> Level:
    """The filter of ``n`` keys; its words reach the driver, and there are as many as the caller has checked."""
    hashes = FIRST_HASHES if first else 1
    bits = 64 * max(1, math.ceil(n * (FIRST_BITS if first else NEXT_BITS) / 64))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    got = at.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("v")).collect()
    words = [0] * (bits // 64)
    for row in got:
        words[row.w] = row.v
    return Level(bits, hashes, seed, words)


def build_cascade(listed: DataFrame, universe: DataFrame, max_keys: int = 4_000_000) -> BloomCascade | None:
    """A cascade for ``listed(key)`` over ``universe(key)``; None if a level would hold over ``max_keys`` keys.

    The universe is scanned once: only what passes level 1 by mistake is kept, deduplicated, and goes on.
    """
    cascade, inside = BloomCascade(), listed.select("key").distinct()
    outside, first = universe.select("key"), True
    n = inside.count()
    while n:
        if n > max_keys:
            return None
        level = encode(inside, n, len(cascade.levels), first)
        cascade.levels.append(level)
        wrong = outside.filter(passes(level, F.col("key")))
        if first:
            wrong = checkpoint(wrong.distinct().join(listed.select("key"), "key", "left_anti"))
        inside, outside, first = wrong, inside, False
        n = inside.count()
    return cascade


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(shapes: list[tuple[int, int]]) -> Column:
    """The keys of a row's ``host`` and ``path`` for these shapes, longest first; null where there is none."""
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    return F.array(
        *(
            F.when(
                (F.col("host") != "") & (labels >= k) & (F.length("path") >= n),
                F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)),
            )
            for k, n in shapes
        )
    )


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_keys: int = 4_000_000,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row; the longest rule that fits wins.

    ``default`` is the verdict where no rule fits.  Above ``max_keys`` the filters would be too
    large for literals; rules are then looked up by a shuffled join, with the same result.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    by_key = {r.key: r for r in rules}
    shapes = sorted({r.shape for r in rules}, key=lambda s: (-s[0] - s[1], s))
    keyed = rows.withColumn("keys", F.array_compact(candidate_keys(shapes)))
    listed = spark.createDataFrame([(r.key, r.verdict) for r in by_key.values()], "key string, rule_verdict string")
    universe = keyed.select(F.explode("keys").alias("key"))
    cascade = build_cascade(listed, universe, max_keys)
    if cascade is None:
        return filter_by_join(keyed, listed, id_col, default)
    verdicts = {}
    for verdict in sorted({r.verdict for r in rules})[1:]:
        verdicts[verdict] = build_cascade(listed.filter(F.col("rule_verdict") == verdict), listed, max_keys)
    hits = F.filter("keys", cascade.contains) if len(shapes) > 8 else F.array_compact(
        F.array(*(F.when(F.get("keys", F.lit(i)).isNotNull() & cascade.contains(F.get("keys", F.lit(i))), F.get("keys", F.lit(i))) for i in range(len(shapes))))
    )
    found = keyed.withColumn("hits", hits)
    # the longest hit: keys of one URL are suffix-and-prefix nested, so the longest string wins
    best = F.get(F.array_sort(F.transform("hits", lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))), F.lit(0))["key"]
    found = found.withColumn("rule", best)
    verdict = F.lit(min(r.verdict for r in rules))
    for name, sub in verdicts.items():
        verdict = F.when(sub.contains(F.col("rule")), F.lit(name)).otherwise(verdict)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).otherwise(verdict)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def filter_by_join(keyed: DataFrame, listed: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same by a join of keys, for rule lists beyond the size of a literal.

    Keys reduce to the longest listed one for each distinct ``(host, path)`` first.
    """
    urls = keyed.select("host", "path", "keys").distinct()
    best = (
        urls.select("host", "path", F.explode("keys").alias("key"))
        .join(listed, "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("key", "rule_verdict"), F.struct(F.length("key"), "key")).alias("best"))
    )
    return keyed.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
