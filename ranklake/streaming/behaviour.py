"""Event counts and sessions over a stream of behaviour events ``(user_id, event_type, ts)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def funnel_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", shown: str = "view", clicked: str = "click", bought: str = "purchase") -> DataFrame:
    """Counts per tumbling window; events later than ``late`` are dropped by the watermark, and state goes with its window."""
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(n(shown).alias("n_shown"), n(clicked).alias("n_clicked"), n(bought).alias("n_bought"))
    return counts.select(F.col("w.start").alias("start"), "n_shown", "n_clicked", "n_bought")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per user and session: events closer than ``gap`` belong together."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return by.agg(F.count("*").alias("n_events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n_events")
