"""Keyword retrieval (BM25), exact vector search and fusion of ranked lists, for all queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def top_k(df: DataFrame, k: int, by: str = "query_id", score: str = "score", item: str = "item_id") -> DataFrame:
    """``rank`` by descending score, ties by item, up to ``k``: a window group limit cuts before the shuffle."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, item_id, score, rank)`` for ``docs(item_id, tokens)`` and ``queries(query_id, tokens)``.

    A repeated query token counts each time; unknown tokens match nothing.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    wanted = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("tokens")), F.lit(1.0)).alias("avgdl"))
    # only tokens that some query has are counted and shuffled
    hits = docs.select("item_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    hits = hits.groupBy("token", "item_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    scored = hits.join(df, "token").crossJoin(F.broadcast(stats)).join(wanted, "token")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    scores = scored.groupBy("query_id", "item_id").agg(F.sum(F.col("qtf") * idf * part).alias("score"))
    return top_k(scores.withColumn("score", F.round("score", 9)), k)


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of ``width`` numbers as rows of length 1; a null or near-zero one, or one of another width, is all NaN."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    numbers = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.linalg.norm(numbers, axis=1, keepdims=True)
    out = np.full((len(vectors), width), np.nan)
    out[fits.to_numpy(zero_copy_only=False)] = numbers / np.where(norm > 1e-8, norm, np.nan)
    return out


def cosine_search(items: DataFrame, queries: DataFrame, k: int = 20, max_queries: int = 100_000) -> DataFrame:
    """Exact cosine search of ``items(item_id, vector)`` for ``queries(query_id, vector)``.

    Items are read once for each ``max_queries`` queries, which are broadcast as a matrix; blocks of
    items times blocks of queries are matrix products, of which each keeps its best ``k`` a query
    and what ties with them.  Zero vectors, vectors of another width than the widest query's and
    scores that are not finite give no rows.
    """
    if k < 1:
        raise ValueError("top_k must be at least 1")
    left = items.select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    right = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    width, blocks = max(1, size.width), max(1, -(-size.n // max_queries))
    schema = StructType([right.schema["query_id"], left.schema["item_id"], StructField("score", DoubleType())])
    out = None
    for i in range(blocks):
        part = right.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else right
        held = part.toArrow().combine_chunks()
        ids, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in held.columns)
        shared = items.sparkSession.sparkContext.broadcast((ids, unit_rows(vectors, width)))
        best = top_k(left.mapInArrow(_best_of(shared, width, k), schema).withColumn("score", F.round("score", 9)), k)
        out = best if out is None else out.unionByName(best)
    return out


def _best_of(shared, width: int, k: int):
    def run(batches):
        ids, matrix = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                rows = unit_rows(part.column("vector"), width)
                for first in range(0, len(matrix), 1000):
                    scores = rows @ matrix[first : first + 1000].T
                    scores[~np.isfinite(scores)] = -np.inf
                    cut = np.partition(scores, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else -np.inf
                    # scores are compared after rounding, so near ties stay
                    item, query = np.nonzero((scores > -np.inf) & (scores >= cut - 1e-8))
                    columns = [ids.take(pa.array(query + first)), part.column("item_id").take(pa.array(item)), pa.array(scores[item, query])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "item_id", "score"])

    return run


def candidates(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """The union of two ranked lists, with ranks, scores and where each candidate comes from."""
    a = keyword.select("query_id", "item_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = semantic.select("query_id", "item_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    both = a.join(b, ["query_id", "item_id"], "full_outer")
    sources = F.array_compact(F.array(F.when(F.col("bm25_rank").isNotNull(), F.lit("bm25")), F.when(F.col("semantic_rank").isNotNull(), F.lit("semantic"))))
    return both.withColumn("sources", sources)


def fuse_rrf(cands: DataFrame, k: int = 20, rrf_k: int = 60) -> DataFrame:
    if rrf_k < 1:
        raise ValueError("rrf_k must be at least 1")
    parts = [F.coalesce(F.lit(1.0) / (rrf_k + F.col(c)), F.lit(0.0)) for c in ("bm25_rank", "semantic_rank")]
    return top_k(cands.withColumn("score", F.round(parts[0] + parts[1], 9)), k)


def min_max(value: Column, by: list[str]) -> Column:
    """Scaled to 0..1 in each group; equal values become 1, null stays null, values that are not finite become 0."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    group = Window.partitionBy(*by)
    low, high = F.min(finite).over(group), F.max(finite).over(group)
    return F.when(value.isNull(), None).when(finite.isNull(), 0.0).when(high == low, 1.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def fuse_linear(cands: DataFrame, k: int = 20, keyword_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    total = keyword_weight + semantic_weight
    if keyword_weight < 0 or semantic_weight < 0 or total == 0:
        raise ValueError("weights must not be negative, nor both zero")
    df = cands.withColumn("bm25_norm", min_max(F.col("bm25_score"), ["query_id"])).withColumn("semantic_norm", min_max(F.col("semantic_score"), ["query_id"]))
    score = F.coalesce("bm25_norm", F.lit(0.0)) * (keyword_weight / total) + F.coalesce("semantic_norm", F.lit(0.0)) * (semantic_weight / total)
    return top_k(df.withColumn("score", F.round(score, 9)), k)


def diagnostics(queries: DataFrame, keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """One row: mean candidates per channel, their overlap, and queries without results."""
    per = candidates(keyword, semantic).groupBy("query_id").agg(
        F.count("bm25_rank").alias("a"), F.count("semantic_rank").alias("b"), F.count("*").alias("u"), F.count(F.when(F.size("sources") == 2, 1)).alias("both")
    )
    rows = queries.select("query_id").join(per, "query_id", "left").fillna(0)
    return rows.agg(
        F.round(F.avg("a"), 2).alias("avg_bm25"),
        F.round(F.avg("b"), 2).alias("avg_semantic"),
        F.round(F.avg("u"), 2).alias("avg_union"),
        F.round(F.avg("both"), 2).alias("avg_both"),
        F.round(F.avg(F.when(F.col("u") > 0, F.col("both") / F.col("u")).otherwise(0.0)), 4).alias("mean_jaccard"),
        F.count(F.when(F.col("a") == 0, 1)).alias("empty_bm25"),
        F.count(F.when(F.col("b") == 0, 1)).alias("empty_semantic"),
        F.count(F.when((F.col("a") == 0) & (F.col("b") > 0), 1)).alias("rescued_by_semantic"),
    )
