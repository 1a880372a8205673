"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of character 4-grams (16 bits each, so a 4-gram is one long), trained on two thirds of
the trusted texts (by a hash of the text, so equal texts stay together).  Counts, continuation counts, discounts, back-off weights and probabilities are tables sharded
by n-gram and joined; the corpus's distinct 4-grams are gathered over all texts, joined with the
model, and give one table of log probabilities.  Its size is checked: up to ``max_table`` rows it is
broadcast and texts never move; beyond, per-document 4-gram counts are joined with it.  Every trusted
text is either trained on or sets the thresholds; none is left out.  They are written once.  Up to ``max_ids`` trusted ids are
broadcast, at 8 bytes each; beyond, texts are joined with them, with the same result.

A document is rejected if its perplexity is above its language's threshold, the exact ``quantile`` of
the language's trusted documents that the model was not trained on (of those of all languages for a
language without any; where no text is held out, of the trained ones).

Defined results: null and empty texts have null perplexity and are rejected; without trusted texts
all others are kept; white space is one blank; code points above 0xFFFF share 2,048 symbols; repeated
rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, checkpoint

ORDER = 4
#: One of so many parts of the trusted texts is held out of training and sets the thresholds.
FOLDS = 3
#: The thresholds of so many languages are broadcast; those of more are joined by a shuffle.
MAX_LANGUAGES = 10_000


def codes(text: str | None) -> np.ndarray:
    """16-bit symbols of a text after three start symbols (0)."""
    text = " ".join((text or "").split())
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if points.max() > 0xFFFF:  # into the surrogates' range, which no text holds
        points = np.where(points > 0xFFFF, 0xD800 + points % 2048, points)
    return np.concatenate([np.zeros(ORDER - 1, np.uint64), np.maximum(points, 1).astype(np.uint64)])


def grams(text: str | None) -> np.ndarray:
    c = codes(text)
    if not len(c):
        return np.empty(0, np.int64)
    n = len(c) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for j in range(ORDER):
        out = (out << np.uint64(16)) | c[j : j + n]
    return out.view(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """``(g, c)``: 4-gram counts of all texts, summed in each task in blocks before the shuffle."""

    def run(batches):
        held, size = [], 0

        def flush():
            g, c = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return g, np.bincount(c, weights=np.concatenate([h[1] for h in held]), minlength=len(g))

        for batch in batches:
            for text in batch.column(0):
                g, c = np.unique(grams(text.as_py()), return_counts=True)
                held.append((g, c))
                size += len(g)
                if size > 600_000:
                    held = [flush()]
                    size = len(held[0][0])
                    if size > 300_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1].astype(np.int64))], names=["g", "c"])
                        held, size = [], 0
        if held:
            g, c = flush()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int64))], names=["g", "c"])

    return docs.mapInArrow(run, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def suffix(k: int) -> str:
    return f"g & {(1 << 16 * (k - 1)) - 1}L"


def train(texts: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """Per order 1..4: ``(g, p)`` of seen n-grams and ``(h, gamma)`` of their contexts."""
    counts = {ORDER: scratch.keep(counted(texts))}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = scratch.keep(counts[k + 1].groupBy(F.expr(suffix(k + 1)).alias("g")).agg(F.count("*").alias("c")))
    symbols = counts[1].count()
    model, below = [], None
    for k in range(1, ORDER + 1):
        table = counts[k]
        n = table.agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 and n.n2 else 0.5
        d = [max(0.0, min(i, i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0))) for i in (1, 2, 3)]
        d = [x if x > 0 else 0.5 * (i + 1) for i, x in enumerate(d)]
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        table = table.withColumn("h", F.expr("shiftrightunsigned(g, 16)")).withColumn("d", F.least(discount, F.col("c")))
        context = scratch.keep(table.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")))
        seen = table.join(context, "h").withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if below is None:
            seen = seen.select("g", (F.col("own") + F.col("gamma") / (symbols + 1)).alias("p"))
        else:
            lower = below.select(F.col("g").alias("s"), F.col("p").alias("lower"))
            seen = seen.withColumn("s", F.expr(suffix(k))).join(lower, "s").select("g", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
        below = scratch.keep(seen)
        model.append((below, context.select("h", "gamma")))
    return model


def log_probabilities(universe: DataFrame, model: list[tuple[DataFrame, DataFrame]], symbols: int) -> DataFrame:
    """``(g, lp)`` of each 4-gram of ``universe(g)``: the longest seen order, times the back-off weights above it."""
    df = universe.select("g")
    value = None
    for k in range(1, ORDER + 1):
        mask = (1 << 16 * k) - 1
        own = F.col("g") if k == ORDER else F.expr(f"g & {mask}L")
        p, gamma = model[k - 1]
        df = df.withColumn("x", own).join(p.select(F.col("g").alias("x"), F.col("p").alias(f"p{k}")), "x", "left").drop("x")
        df = df.withColumn("x", F.expr("shiftrightunsigned(g, 16)") if k == ORDER else F.expr(f"shiftrightunsigned(g & {mask}L, 16)"))
        df = df.join(gamma.select(F.col("h").alias("x"), F.col("gamma").alias(f"b{k}")), "x", "left").drop("x")
        back = F.coalesce(F.col(f"b{k}"), F.lit(1.0)) * (value if value is not None else F.lit(1.0 / (symbols + 1)))
        value = F.coalesce(F.col(f"p{k}"), back)
    return df.select("g", F.log(value).alias("lp"))


def perplexities(rows: DataFrame, table: DataFrame, shared: Broadcast | None, scratch: Scratch) -> DataFrame:
    """``rows`` with their columns, less ``__text``, plus ``__perplexity``, by the broadcast table or else by a join."""
    columns = [f for f in rows.schema.fields if f.name != "__text"]
    if shared is not None:

        def run(batches):
            keys, values = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part, out = batch.slice(start, 512), []
                    for text in part.column("__text"):
                        g = grams(text.as_py())
                        out.append(float(np.exp(-values[np.searchsorted(keys, g)].mean())) if len(g) else None)
                    kept = part.drop_columns(["__text"])
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.float64())], names=[*kept.schema.names, "__perplexity"])

        return rows.mapInArrow(run, StructType([*columns, StructField("__perplexity", DoubleType())]))

    def per_document(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g, c = np.unique(grams(text.as_py()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(g), pa.int64()), pa.array(g), pa.array(c)], names=["__row", "g", "c"])

    numbered = scratch.keep(rows.withColumn("__row", F.monotonically_increasing_id()))
    each = numbered.select("__row", "__text").mapInArrow(per_document, "__row bigint, g bigint, c bigint")
    sums = each.join(table, "g").groupBy("__row").agg(F.exp(-F.sum(F.col("c") * F.col("lp")) / F.sum("c")).alias("__perplexity"))
    return numbered.join(sums, "__row", "left").select(*(f.name for f in columns), "__perplexity")


def with_ids(rows: DataFrame, ids: DataFrame, max_ids: int) -> DataFrame:
    """The ``rows(__id, ...)`` whose id is one of the distinct ``ids(__id)``, without the id; texts stay where they are up to ``max_ids``."""
    ids = ids.filter("__id is not null")
    if ids.count() > max_ids:
        return rows.join(ids, "__id", "left_semi").drop("__id")

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], names=["ids"])

    parts = [np.frombuffer(r.ids, np.int64) for r in ids.mapInArrow(packed, "ids binary").collect()]
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(np.concatenate([np.empty(0, np.int64), *parts])))

    def listed(batches):
        known = shared.value
        for batch in batches:
            given = batch.column("__id")
            value = given.fill_null(0).to_numpy()
            at = np.searchsorted(known, value)
            found = np.zeros(len(value), bool)
            inside = at < len(known)
            found[inside] = known[at[inside]] == value[inside]
            yield batch.drop_columns(["__id"]).filter(pa.array(found & given.is_valid().to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(listed, rows.drop("__id").schema)


def thresholds(limits: DataFrame, quantile: float) -> DataFrame:
    """``(__all, __of, __limit)``: the perplexity of rank ``quantile`` for each language of ``limits(__lang, __perplexity)``, and for all together."""
    groups = F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("of")), F.struct(F.lit(False).alias("all"), F.col("__lang").cast("string").alias("of")))
    each = limits.select(F.explode(groups).alias("x"), "__perplexity")
    sizes = each.groupBy("x").agg(F.greatest(F.lit(1), F.ceil(F.lit(quantile) * F.count("*"))).alias("rank"))
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("__perplexity")).cast("bigint"))
    found = ranked.join(sizes, "x").filter("n = rank")
    return found.select(F.col("x.all").alias("__all"), F.col("x.of").alias("__of"), F.col("__perplexity").alias("__limit"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, max_table: int, max_ids: int) -> DataFrame:
    """``docs`` with ``__perplexity`` and ``__threshold``."""
    scratch = Scratch(docs.sparkSession)
    ids = scratch.keep(labels.filter("quality = 1").select(F.col(id_col).cast("bigint").alias("__id")).distinct())
    rows = docs.withColumn("__text", F.col(text_col).cast("string"))
    # written: read again by two Python steps, which would hold a worker more in each task beside this one's
    trusted = scratch.keep(with_ids(rows.select(F.col(id_col).cast("bigint").alias("__id"), F.col(lang_col).alias("__lang"), "__text"), ids, max_ids))
    # decided by the text alone: an equal text is never on both sides
    held = F.pmod(F.xxhash64("__text"), F.lit(FOLDS)) == 0
    model = train(trusted.filter(F.col("__text").isNotNull() & ~held).select("__text"), scratch)
    symbols = model[0][0].count()
    table = scratch.keep(log_probabilities(counted(rows.select("__text")), model, symbols))
    shared = None
    if table.count() <= max_table:
        pairs = table.toPandas().sort_values("g")
        shared = docs.sparkSession.sparkContext.broadcast((pairs["g"].to_numpy(np.int64), pairs["lp"].to_numpy(np.float64)))
    limits = scratch.keep(perplexities(trusted.withColumn("__held", held), table, shared, scratch)).filter("__perplexity is not null")
    if not limits.filter("__held").isEmpty():
        limits = limits.filter("__held")
    limit = checkpoint(thresholds(limits, quantile))
    whole = limit.filter("__all").first()
    own = limit.filter("not __all").select("__of", "__limit")
    own = F.broadcast(own) if own.count() <= MAX_LANGUAGES else own
    scored = perplexities(rows, table, shared, scratch)
    out = scored.join(own, F.col(lang_col).cast("string").eqNullSafe(F.col("__of")), "left")
    threshold = F.coalesce(F.col("__limit"), F.lit(whole["__limit"] if whole else float("inf")).cast("double"))
    out = out.withColumn("__threshold", threshold)
    if shared is not None:  # the join form reads the written tables later
        scratch.drop()
    return out


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, max_table: int = 4_000_000, max_ids: int = 16_000_000
) -> DataFrame:
    """``(id, lang, perplexity, threshold, kept)`` of every row; ``labels(id, quality)`` name trusted texts by 1."""
    few = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(lang_col), F.col(text_col))
    out = judged(few, labels, id_col, text_col, lang_col, quantile, max_table, max_ids)
    return out.select(id_col, lang_col, F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"), passed().alias("kept"))


def passed():
    return F.coalesce(F.col("__perplexity") <= F.col("__threshold"), F.lit(False))


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, max_table: int = 4_000_000, max_ids: int = 16_000_000
) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; texts stay where they are."""
    return judged(docs, labels, id_col, text_col, lang_col, quantile, max_table, max_ids).filter(passed()).select(*docs.columns)
