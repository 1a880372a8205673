"""Latent-semantic retrieval: TF-IDF of word and character n-grams, a truncated SVD, cosine search.

The SVD is a subspace iteration: each step multiplies the feature-by-feature Gram matrix with a thin
block of vectors in one pass over the rows, without ever building it, and sums the partitions' parts
by feature.  The driver and every worker hold that block, features x (components + 10) doubles; its
size is checked against ``max_features`` before anything is collected.  A larger vocabulary is an
error: raise ``min_df``, or fit on a sample and ``transform`` all rows, which needs no such sums.

Defined results: null and empty texts, and texts without a known feature, have the zero vector, which
matches nothing; features of other texts than the fitted ones are ignored; the texts of
one id count as one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import char_ngrams, word_ngrams
from .retrieval import cosine_search

#: More vectors than components in the iteration, for accuracy.
OVERSAMPLING = 10


@dataclass
class Semantic:
    """A fitted projection: ``vocabulary(feature, f, df, idf)`` and ``axes``, one row per feature ``f``."""

    vocabulary: DataFrame
    axes: np.ndarray
    singular_values: np.ndarray
    explained_variance_ratio: np.ndarray
    word_features: int
    char_features: int
    weights: tuple[float, float]

    @property
    def components(self) -> int:
        return self.axes.shape[1]


def term_weights(docs: DataFrame, word_weight: float = 1.0, char_weight: float = 0.5) -> DataFrame:
    """``(item_id, feature, w)`` of ``docs(item_id, text)``: block weight x (1 + ln tf); ``w:`` and ``c:`` mark words and characters."""
    if min(word_weight, char_weight) < 0 or word_weight + char_weight == 0:
        raise ValueError("weights must not be negative, nor both zero")
    blocks = []
    for mark, grams, weight in (("w:", word_ngrams, word_weight), ("c:", char_ngrams, char_weight)):
        if weight > 0:
            each = docs.select("item_id", F.explode(grams(F.col("text"))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("tf"))
            blocks.append(each.select("item_id", F.concat(F.lit(mark), "gram").alias("feature"), (weight * (1 + F.log("tf"))).alias("w")))
    return reduce(DataFrame.unionByName, blocks)


def tfidf(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, word_weight: float = 1.0, char_weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``(item_id, feature, w)`` with inverse document frequencies, and ``(feature, df, idf)`` of the features kept."""
    terms, n = term_weights(docs, word_weight, char_weight), docs.count()
    df = terms.groupBy("feature").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    vocabulary = df.withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    return terms.join(vocabulary, "feature").select("item_id", "feature", (F.col("w") * F.col("idf")).alias("w")), vocabulary


def sparse_rows(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(item_id, f, w)``: a row's feature numbers and weights as arrays; as large as its text."""
    cells = terms.join(vocabulary, "feature").groupBy("item_id").agg(F.collect_list(F.struct("f", (F.col("w") * F.col("idf")).alias("w"))).alias("cells"))
    return cells.select("item_id", F.col("cells.f").alias("f"), F.col("cells.w").alias("w"))


def row_blocks(batch: pa.RecordBatch, most: int = 100_000):
    """Parts of a batch of sparse rows as (first, last, f, w, starts), each of about ``most`` cells or one row."""
    f, w = batch.column("f"), batch.column("w")
    ends = np.cumsum(np.diff(f.offsets.to_numpy()))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        part = f.slice(start, stop - start)
        starts = np.concatenate([[0], ends[start : stop - 1] - base]).astype(np.int64)
        yield start, stop, part.flatten().to_numpy(), w.slice(start, stop - start).flatten().to_numpy(), starts
        start = stop


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The rows' Gram matrix times ``block``: projected and spread back in one pass, summed by feature."""
    size, width = block.shape
    shared = rows.sparkSession.sparkContext.broadcast(block)
    names = [f"z{j}" for j in range(width)]

    def run(batches):
        q, z, seen = shared.value, None, None
        for batch in batches:
            if z is None:
                z, seen = np.zeros((size, width)), np.zeros(size, bool)
            for _, _, f, w, starts in row_blocks(batch):
                y = np.add.reduceat(q[f] * w[:, None], starts)
                owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
                order = np.argsort(f, kind="stable")
                known, first = np.unique(f[order], return_index=True)
                z[known] += np.add.reduceat(y[owner[order]] * w[order, None], first)
                seen[known] = True
        if z is not None:
            at = np.flatnonzero(seen)
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(c) for c in z[part].T)], names=["f", *names])

    parts = rows.select("f", "w").mapInArrow(run, ", ".join(["f int", *(f"{c} double" for c in names)]))
    total = parts.groupBy("f").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    out = np.zeros((size, width))
    out[total["f"].to_numpy()] = total[names].to_numpy()
    shared.destroy()
    return out


def fit(
    docs: DataFrame, components: int = 64, *, word_weight: float = 1.0, char_weight: float = 0.5, min_df: int = 1, max_df: float = 1.0, seed: int = 20260614, iterations: int = 8, max_features: int = 400_000
) -> Semantic:
    """Fits on ``docs(item_id, text)``; ``components`` are cut to one less than features and rows, but are 2 at least."""
    weights = word_weight, char_weight
    terms = term_weights(docs, *weights).persist()
    try:
        n = docs.count()
        df = terms.groupBy("feature").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).persist()
        size = df.count()
        if size < 2:
            raise ValueError("an index needs two features at least")
        if size > max_features:
            raise ValueError(f"{size} features, more than max_features={max_features}: raise min_df or fit on a sample")
        # up to max_features rows, numbered by name: the same numbers whenever they are computed again
        numbered = df.withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).withColumn("f", F.expr("cast(row_number() over (order by feature) - 1 as int)"))
        vocabulary = numbered.persist()
        words = vocabulary.filter("feature like 'w:%'").count()
        rows = sparse_rows(terms, vocabulary).persist()
        k = max(2, min(components, size - 1, n - 1))
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(k + OVERSAMPLING, size))))[0]
        for _ in range(iterations):
            basis = np.linalg.qr(gram_times(rows, basis))[0]
        inner = basis.T @ gram_times(rows, basis)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        best = np.argsort(-values)[:k]
        axes, values = basis @ vectors[:, best], np.maximum(values[best], 0.0)
        sums = rows.select(F.explode(F.arrays_zip("f", "w")).alias("c")).groupBy("c.f").agg(F.sum("c.w").alias("a"), F.sum(F.col("c.w") * F.col("c.w")).alias("b")).toPandas()
        mean = np.zeros(size)
        mean[sums["f"].to_numpy()] = sums["a"].to_numpy() / n
        whole = sums["b"].sum() / n - (mean**2).sum()
        ratio = (values / n - (mean @ axes) ** 2) / whole if whole > 0 else np.zeros(k)
        rows.unpersist()
        df.unpersist()
        return Semantic(vocabulary, axes, np.sqrt(values), ratio, words, size - words, weights)
    finally:
        terms.unpersist()


def transform(model: Semantic, docs: DataFrame) -> DataFrame:
    """``(item_id, vector)`` of ``docs(item_id, text)``, of length 1 or 0."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model.axes), docs.select("item_id").schema
    rows = sparse_rows(term_weights(docs, *model.weights), model.vocabulary)

    def run(batches):
        axes = shared.value
        for batch in batches:
            for start, stop, f, w, starts in row_blocks(batch):
                y = np.add.reduceat(axes[f] * w[:, None], starts)
                norm = np.linalg.norm(y, axis=1, keepdims=True)
                unit = np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)
                ids = batch.column("item_id").slice(start, stop - start)
                flat = pa.ListArray.from_arrays(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([ids, flat], names=["item_id", "vector"])

    known = rows.mapInArrow(run, schema.add("vector", ArrayType(DoubleType())))
    return docs.select("item_id").distinct().join(known, "item_id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), model.components)))


def search(model: Semantic, items: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, item_id, score, rank)`` by cosine of ``items(item_id, vector)`` and ``queries(query_id, text)``."""
    vectors = transform(model, queries.select(F.col("query_id").alias("item_id"), "text"))
    return cosine_search(items, vectors.withColumnRenamed("item_id", "query_id"), k)
