"""Sharding: proportional stratified interleaving (native).

Rows of each source are shuffled by a seeded hash and ranked; the fractional rank ``(2r - 1) / 2n``
spreads every source evenly over (0, 1), so each stretch of the order by fractional rank has the
mixture of the whole.  The order is cut into shards whose row counts differ by one at most.

No window ever holds a source: ranks are taken in small groups (a source's hash prefix; a stretch
of fractional ranks) and shifted by prefix counts.  Only narrow rows (id, size, checksum, hash)
are shuffled, never texts.  Integer arithmetic keeps the cuts exact at any size.

Equal texts are rows like others: each has its own slot, and where a text goes depends on its row's
id alone.  Shards hold the mixture, whatever the texts.

Defined results: a null source is a source of its own; a null text has size 8 and checksum 0;
repeated rows each get a slot; ties in the hash go by id, size and checksum, so only rows that agree
in all of them can swap; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


def digits(n: int, rows_per_group: int) -> int:
    """Hex digits of the hash prefix at which groups hold about ``rows_per_group`` rows."""
    return min(7, max(1, math.ceil(math.log(max(1, n / rows_per_group), 16))))


def shuffled(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    n_shards: int = 24,
    seed: int = 17,
    rows_per_group: int = 2000,
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` of every row, plus its ``source``.

    ``law`` is ``rows``: shard counts are at most one apart.  ``slot`` is the place in the shard,
    gapless from 0; reading shards slot by slot keeps the mixture.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text).alias("crc"),
            shuffled(F.col(id_col), seed).alias("h"),
        )
    )
    total = rows.count()
    k = digits(total, rows_per_group)
    n_groups = 16**k
    rows = rows.withColumn("g", F.substring("h", 1, k))

    # rank within the source: rows of smaller hash prefixes, and the rank within the prefix
    sizes = rows.groupBy("source", "g").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("source")
    before = sizes.select(
        F.col("source").alias("s2"),
        F.col("g").alias("g2"),
        (F.sum("m").over(whole.orderBy("g")) - F.col("m")).alias("before"),
        F.sum("m").over(whole).alias("n"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("h", "id", "size", "crc")]
    ranked = rows.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("g") == F.col("g2"))).withColumn(
        "r", F.row_number().over(Window.partitionBy("source", "g").orderBy(*order)) + F.col("before")
    )

    # place in the order by fractional rank, group by group in the same way; a group's first place
    # follows from the sources' counts alone: ranks r of a source with (2r - 1) * groups < 2n * g
    ranked = checkpoint(ranked.select("id", "source", "size", "crc", "h", "r", "n", F.expr(f"cast((cast(2 * r - 1 as decimal(20, 0)) * {n_groups}) div (2 * n) as bigint)").alias("f")))
    stretch = ranked.groupBy("f").agg(F.count("*").alias("m"))
    coarse = stretch.withColumn("c", F.expr("f div 256"))
    tops = coarse.groupBy("c").agg(F.sum("m").alias("cm"))
    tops = tops.select(F.col("c").alias("c2"), (F.sum("cm").over(Window.orderBy("c")) - F.col("cm")).alias("top"))
    starts = coarse.join(tops, F.col("c") == F.col("c2")).select(
        F.col("f").alias("f2"), (F.col("top") + F.sum("m").over(Window.partitionBy("c").orderBy("f")) - F.col("m")).alias("start")
    )
    fraction = (F.lit(2) * F.col("r") - 1) / (F.lit(2.0) * F.col("n"))
    within = Window.partitionBy("f").orderBy(fraction, F.col("source").asc_nulls_first(), *order)
    placed = ranked.join(starts, F.col("f") == F.col("f2")).withColumn("place", F.row_number().over(within) - 1 + F.col("start"))

    small, extra = divmod(total, n_shards)  # the first ``extra`` shards hold one row more
    edge = (small + 1) * extra
    n = F.when(F.col("place") < edge, F.expr(f"place div {small + 1}")).otherwise(F.expr(f"{extra} + (place - {edge}) div {max(1, small)}"))
    first = F.when(F.col("shard") < extra, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - extra) * small)
    return placed.withColumn("shard", n.cast("int")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("source").alias(source_col),
    )
