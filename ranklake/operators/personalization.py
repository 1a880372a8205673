"""Chronological split, time-decayed profiles and personalised re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import min_max

#: What a behaviour is worth.
GRADES = {"click": 1, "favorite": 2, "add_to_cart": 3, "purchase": 4}


def sessions_split(events: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """``(user_id, session_id, start, split)``: each user's last sessions are ``test``, whole sessions only.

    ``max(1, int(n * (1 - ratio)))`` sessions in double arithmetic; a single session is ``train``.
    """
    starts = events.groupBy("user_id", "session_id").agg(F.min("ts").alias("start"))
    user = Window.partitionBy("user_id")
    ranked = starts.withColumn("i", F.row_number().over(user.orderBy("start", "session_id"))).withColumn("n", F.count("*").over(user))
    tests = F.when(F.col("n") >= 2, F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(1.0 - train_ratio)))).otherwise(0)
    return ranked.select("user_id", "session_id", "start", F.when(F.col("i") > F.col("n") - tests, "test").otherwise("train").alias("split"))


def leaks(split: DataFrame) -> DataFrame:
    """Users whose last train session does not start before their first test session."""
    by = split.groupBy("user_id").agg(F.max(F.when(F.col("split") == "train", F.col("start"))).alias("a"), F.min(F.when(F.col("split") == "test", F.col("start"))).alias("b"))
    return by.filter(F.col("a") >= F.col("b")).select("user_id")


def effective(events: DataFrame, weights: dict[str, float], half_life_days: float) -> DataFrame:
    """Positive events with ``eff``: the type's weight, halved every ``half_life_days`` before the last event of all."""
    weight = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(float(w))) for t, w in weights.items()))
    last = events.agg(F.max("ts").alias("last"))
    days = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    return events.withColumn("w", weight).filter("w > 0").crossJoin(F.broadcast(last)).withColumn("eff", F.col("w") * F.pow(F.lit(0.5), days / half_life_days)).drop("last")


def affinities(positive: DataFrame, items: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """``(user_id, dim, value, weight)``: shares of decayed weight per dimension, in one shuffle for all dimensions."""
    rows = positive.join(items, "item_id").select("user_id", "eff", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))).alias("x"))
    sums = rows.filter("x.value != ''").groupBy("user_id", "x.dim", "x.value").agg(F.sum("eff").alias("s"))
    return sums.select("user_id", "dim", "value", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("user_id", "dim")), 9).alias("weight"))


def profiles(events: DataFrame, positive: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """``(user_id, n_events, n_positive, mean_log_price, status)`` of users in either table.

    Status: warm with a positive event, else cold_start if flagged, no_positive with events, no_history.
    """
    seen = events.groupBy("user_id").agg(F.count("*").alias("n_events"))
    # a price that is missing or no number counts as 1; one that is not positive is left out
    number = F.coalesce(F.nanvl(F.col("price").try_cast("double"), F.lit(1.0)), F.lit(1.0))
    price = F.when(number > 0, F.log(number))
    liked = positive.join(items.select("item_id", "price"), "item_id").groupBy("user_id").agg(
        F.count("*").alias("n_positive"), (F.sum(price * F.col("eff")) / F.sum(F.when(price.isNotNull(), F.col("eff")))).alias("m")
    )
    df = users.select("user_id", "is_cold_start").join(seen, "user_id", "full_outer").join(liked, "user_id", "left").fillna(0, ["n_events", "n_positive"])
    status = F.when(F.col("n_positive") > 0, "warm").when(F.coalesce("is_cold_start", F.lit(False)), "cold_start").when(F.col("n_events") > 0, "no_positive").otherwise("no_history")
    return df.select("user_id", "n_events", "n_positive", F.round("m", 6).alias("mean_log_price"), status.alias("status"))


def rerank(cands: DataFrame, items: DataFrame, prefs: DataFrame, profile: DataFrame, weights: dict[str, float], k: int = 20, price_spread: float = 0.5) -> DataFrame:
    """Re-ranks ``cands(request_id, user_id, item_id, rank, score)`` with the user's affinities.

    A repeated item counts at its best rank.  Users that are not warm keep the order of retrieval.
    """
    total = sum(weights.values())
    w = {name: x / total for name, x in weights.items()}
    best = Window.partitionBy("request_id", "item_id").orderBy("rank")
    df = cands.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    df = df.withColumn("norm", min_max(F.col("score"), ["request_id"])).join(items, "item_id", "left").join(profile.select("user_id", "status", "mean_log_price"), "user_id", "left")
    score = F.col("norm") * w["retrieval"]
    for dim in [d for d in weights if d not in ("retrieval", "price")]:
        own = prefs.filter(F.col("dim") == dim).select("user_id", F.col("value").alias(dim), F.col("weight").alias(f"{dim}_affinity"))
        df = df.join(own, ["user_id", dim], "left")
        score = score + F.coalesce(f"{dim}_affinity", F.lit(0.0)) * w[dim]
    price = F.exp(-F.abs(F.log(F.when(F.col("price") > 0, F.col("price"))) - F.col("mean_log_price")) / max(price_spread, 0.1))
    score = F.when(F.col("status") == "warm", score + F.coalesce(price, F.lit(0.0)) * w["price"]).otherwise(F.col("norm"))
    df = df.withColumn("final_score", F.round(score, 9)).withColumn("original_rank", F.col("rank"))
    order = Window.partitionBy("request_id").orderBy(F.col("final_score").desc(), "original_rank", "item_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("request_id", "user_id", "item_id", "original_rank", "rank", "final_score")


def request_grades(events: DataFrame) -> DataFrame:
    """``(request_id, item_id, grade)``: the largest grade of each item that a request's events touch."""
    grade = F.coalesce(*(F.when(F.col("event_type") == t, g) for t, g in GRADES.items()))
    return events.withColumn("grade", grade).filter("grade is not null").groupBy("request_id", "item_id").agg(F.max("grade").alias("grade"))


def build_requests(events: DataFrame, profile: DataFrame) -> DataFrame:
    """``(request_id, user_id, query_id, status)`` of requests with a positive event; the first event gives user and query.

    A user without profile has the status ``no_history``.
    """
    positive = request_grades(events).select("request_id").distinct()
    first = events.groupBy("request_id").agg(F.min_by(F.struct("user_id", "query_id"), F.struct("ts", "event_id")).alias("f")).select("request_id", "f.*")
    return first.join(positive, "request_id", "left_semi").join(profile.select("user_id", "status"), "user_id", "left").select(
        "request_id", "user_id", "query_id", F.coalesce("status", F.lit("no_history")).alias("status")
    )


def personalize(requests: DataFrame, results: DataFrame, items: DataFrame, prefs: DataFrame, profile: DataFrame, weights: dict[str, float], k: int = 20) -> DataFrame:
    """Re-ranks each request's candidates, the ``results(query_id, item_id, rank, score)`` of its query; requests without any are left out."""
    cands = requests.select("request_id", "user_id", "query_id").join(results, "query_id").select("request_id", "user_id", "item_id", "rank", "score")
    return rerank(cands, items, prefs, profile, weights, k=k)


def fallback_statistics(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per status: requests, users, and the share of requests whose order is that of retrieval."""
    same = ranked.groupBy("request_id").agg(F.min((F.col("rank") == F.col("original_rank")).cast("int")).alias("same"))
    rows = requests.join(same, "request_id", "left")
    return rows.groupBy("status").agg(
        F.count("*").alias("n_requests"), F.count_distinct("user_id").alias("n_users"), F.round(F.coalesce(F.avg("same"), F.lit(1.0)), 6).alias("same_order")
    )
