"""Ranking metrics at several cut-offs, for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(queries: DataFrame, results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20), threshold: int = 1) -> DataFrame:
    """``(query_id, k, precision, recall, mrr, ndcg, hit_rate)``; a query without results scores 0.

    Precision divides by k, recall by all relevant items, NDCG by the ideal order of all grades.
    """
    judged = results.select("query_id", "item_id", "rank").filter(F.col("rank") <= max(ks)).join(qrels, ["query_id", "item_id"], "left")
    judged = judged.withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    aggregates = []
    for k in ks:
        top, hit = F.col("rank") <= k, (F.col("rank") <= k) & (F.col("grade") >= threshold)
        aggregates += [F.count(F.when(hit, 1)).alias(f"hits_{k}"), F.min(F.when(hit, F.col("rank"))).alias(f"first_{k}"), F.sum(F.when(top, gain)).alias(f"dcg_{k}")]
    found = judged.groupBy("query_id").agg(*aggregates)
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item_id")
    ideal = qrels.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= max(ks)) | (F.col("grade") >= threshold))
    totals = ideal.groupBy("query_id").agg(
        F.count(F.when(F.col("grade") >= threshold, 1)).alias("relevant"), *(F.sum(F.when(F.col("rank") <= k, gain)).alias(f"idcg_{k}") for k in ks)
    )
    wide = queries.select("query_id").join(found, "query_id", "left").join(totals, "query_id", "left")

    def share(a, b):
        return F.when(F.coalesce(b, F.lit(0)) > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0)

    rows = F.array(
        *(
            F.struct(
                F.lit(k).alias("k"),
                (F.coalesce(f"hits_{k}", F.lit(0)) / float(k)).alias("precision"),
                share(F.col(f"hits_{k}"), F.col("relevant")).alias("recall"),
                F.coalesce(1.0 / F.col(f"first_{k}"), F.lit(0.0)).alias("mrr"),
                share(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")).alias("ndcg"),
                F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
            )
            for k in ks
        )
    )
    return wide.select("query_id", F.explode(rows).alias("m")).select("query_id", "m.*")


def macro_average(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("k").agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg", "hit_rate")))


def compare(ours: DataFrame, base: DataFrame, k: int = 10, metric: str = "ndcg", tolerance: float = 0.0) -> DataFrame:
    """One row: at how many queries ``ours`` is better, equal or worse; better is strictly greater unless there is a tolerance."""
    both = ours.filter(F.col("k") == k).select("query_id", F.col(metric).alias("x")).join(base.filter(F.col("k") == k).select("query_id", F.col(metric).alias("y")), "query_id")
    d = F.col("x") - F.col("y")
    return both.agg(F.count(F.when(d > tolerance, 1)).alias("better"), F.count(F.when(F.abs(d) <= tolerance, 1)).alias("equal"), F.count(F.when(d < -tolerance, 1)).alias("worse"))


def behaviour_metrics(requests: DataFrame, ranked: DataFrame, grades: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """``evaluate`` keyed on requests: grades are those of the request's own events, recall is over all its positive items."""
    asked, found, judged = (df.select(F.col("request_id").alias("query_id"), *columns) for df, columns in ((requests, []), (ranked, ["item_id", "rank"]), (grades, ["item_id", "grade"])))
    return evaluate(asked, found, judged, ks=ks).withColumnRenamed("query_id", "request_id")


def candidate_coverage(requests: DataFrame, candidates: DataFrame, grades: DataFrame) -> DataFrame:
    """One row: requests and positive items that the candidates cover, in all and for warm users.

    ``requests(request_id, status)`` are the eligible ones; a status of null counts as other.
    """
    positive = grades.filter("grade > 0").select("request_id", "item_id").distinct()
    have = candidates.select("request_id", "item_id").distinct().withColumn("covered", F.lit(1))
    per = positive.join(have, ["request_id", "item_id"], "left").groupBy("request_id").agg(F.count("*").alias("n"), F.count("covered").alias("hit"))
    df = requests.join(per, "request_id", "left").fillna(0, ["n", "hit"])
    warm = F.coalesce(F.col("status") == "warm", F.lit(False))

    def share(a, b):
        return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)

    hit = F.count(F.when(F.col("hit") > 0, 1))
    warm_hit, warm_all = F.count(F.when(warm & (F.col("hit") > 0), 1)), F.count(F.when(warm, 1))
    return df.agg(
        F.count("*").alias("n_requests"),
        hit.alias("n_covered"),
        share(hit, F.count("*")).alias("request_coverage"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_positives"),
        share(F.coalesce(F.sum("hit"), F.lit(0)), F.sum("n")).alias("item_coverage"),
        warm_all.alias("n_warm"),
        share(warm_hit, warm_all).alias("warm_coverage"),
    )


def query_coverage(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row: how many queries there are, how many have no result, and the share that has one."""
    have = results.select("query_id").distinct().withColumn("found", F.lit(1))
    df = queries.select("query_id").join(have, "query_id", "left")
    return df.agg(
        F.count("*").alias("n_queries"), F.count(F.when(F.col("found").isNull(), 1)).alias("n_empty"), F.round(F.coalesce(F.avg(F.coalesce("found", F.lit(0)).cast("double")), F.lit(0.0)), 6).alias("coverage")
    )
