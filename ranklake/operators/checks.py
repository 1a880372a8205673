"""Data-quality checks: each gives one row ``(name, n_bad)``; a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("name"), "n_bad")


def unique(name: str, df: DataFrame, *keys: str) -> DataFrame:
    return check(name, df.groupBy(*keys).agg(F.count("*").alias("m")).filter("m > 1"))


def references(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys without a parent; blank keys are ignored."""
    keys = child.select(F.col(key).alias("k")).filter("k is not null").distinct()
    return check(name, keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti"))


def members(name: str, df: DataFrame, column: str, values: list) -> DataFrame:
    return check(name, df.filter(F.col(column).isNull() | ~F.col(column).isin(values)))


def between(name: str, df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    value = F.col(column).try_cast("double")
    bad = value.isNull() | F.isnan(value)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return check(name, df.filter(bad))


def required(name: str, df: DataFrame, column: str) -> DataFrame:
    return check(name, df.filter(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""))


def utc(name: str, df: DataFrame, column: str) -> DataFrame:
    """Timestamps in text that do not parse, or have no UTC offset; blanks are skipped."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    return check(name, df.filter((text != "") & (F.try_to_timestamp(text).isNull() | ~text.rlike(r"(Z|[+-]00:?00)$"))))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).withColumn("passed", F.col("n_bad") == 0)


def funnel(events: DataFrame, shown: str, clicked: str, bought: str) -> DataFrame:
    """One row of counts and ratios; 0 where the denominator is 0."""

    def n(t: str) -> Column:
        return F.count(F.when(F.col("event_type") == t, 1))

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)

    return events.agg(n(shown).alias("n_shown"), n(clicked).alias("n_clicked"), n(bought).alias("n_bought"), ratio(n(clicked), n(shown)).alias("ctr"), ratio(n(bought), n(clicked)).alias("conversion"))


def row_count(name: str, df: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """One bad row if there are fewer rows than ``low`` or more than ``high``."""
    wrong = (F.col("m") < low) | (F.lit(False) if high is None else F.col("m") > high)
    return check(name, df.agg(F.count("*").alias("m")).filter(wrong))


def bounded_where(name: str, df: DataFrame, column: str, where: Column, low: float) -> DataFrame:
    """Values under ``low`` or no number, where the column applies; blanks are skipped."""
    text, value = F.trim(F.col(column).cast("string")), F.col(column).try_cast("double")
    return check(name, df.filter(where & (F.coalesce(text, F.lit("")) != "") & (value.isNull() | F.isnan(value) | (value < low))))


def event_chains(events: DataFrame, order: dict[str, int], needs: dict[str, str], key: tuple[str, ...]) -> DataFrame:
    """Events that lack what they need before them: ``needs`` maps a type to the type that must come earlier in its ``key``.

    Ties in time go by ``order``, then by id.
    """
    ordinal = F.coalesce(*(F.when(F.col("event_type") == t, n) for t, n in order.items()), F.lit(99))
    before = Window.partitionBy(*key).orderBy("ts", ordinal, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    df = events
    for i, first in enumerate(sorted(set(needs.values()))):
        df = df.withColumn(f"__seen_{i}", F.coalesce(F.max((F.col("event_type") == first).cast("int")).over(before), F.lit(0)))
    lacks = F.lit(False)
    for kind, first in needs.items():
        lacks = lacks | ((F.col("event_type") == kind) & (F.col(f"__seen_{sorted(set(needs.values())).index(first)}") == 0))
    return df.filter(lacks).select(*events.columns)


def click_rate(events: DataFrame, by: Column, shown: str = "view", clicked: str = "click") -> DataFrame:
    """``(bucket, n_shown, n_clicked, ctr)``; rows whose bucket is null are left out."""
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    rate = F.round(F.coalesce(F.try_divide(n(clicked).cast("double"), n(shown).cast("double")), F.lit(0.0)), 6)
    return events.withColumn("bucket", by).filter("bucket is not null").groupBy("bucket").agg(n(shown).alias("n_shown"), n(clicked).alias("n_clicked"), rate.alias("ctr"))


def levelled(results: DataFrame, warnings: list[str]) -> DataFrame:
    """``report`` rows with a level: a failed check is an error, or a warning if it is among ``warnings``."""
    return results.withColumn("level", F.when(F.col("passed"), "pass").when(F.col("name").isin(warnings), "warning").otherwise("error"))


def preference_rate(events: DataFrame, items: DataFrame, users: DataFrame, shown: str = "view", clicked: str = "click") -> DataFrame:
    """``click_rate`` of items in a category that the user prefers and of all others; unknown items and users count as others."""
    rows = events.join(items.select("item_id", "category"), "item_id", "left").join(users.select("user_id", "preferred_categories"), "user_id", "left")
    liked = F.coalesce(F.array_contains("preferred_categories", F.coalesce("category", F.lit(""))), F.lit(False))
    return click_rate(rows, F.when(liked, "preferred").otherwise("other"), shown, clicked)


def quality_conversion(events: DataFrame, items: DataFrame, high: float = 0.7, low: float = 0.4, clicked: str = "click", bought: str = "purchase") -> DataFrame:
    """``(bucket, n_clicked, n_bought, conversion)`` of items of high (from ``high``) and low (under ``low``) quality."""
    value = F.col("quality_score")
    rows = events.join(items.select("item_id", F.when(value >= high, "high").when(value < low, "low").alias("bucket")).filter("bucket is not null"), "item_id")
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    rate = F.round(F.coalesce(F.try_divide(n(bought).cast("double"), n(clicked).cast("double")), F.lit(0.0)), 6)
    return rows.groupBy("bucket").agg(n(clicked).alias("n_clicked"), n(bought).alias("n_bought"), rate.alias("conversion"))


# The ranges, both ends included, of a funnel's statistics: percentages, but clicks a session.
BANDS = {
    "ctr": (8.0, 20.0),
    "avg_clicks": (1.0, 3.0),
    "fav_click": (5.0, 15.0),
    "atc_click": (4.0, 12.0),
    "pur_click": (1.0, 5.0),
    "pur_atc": (15.0, 40.0),
}


def funnel_statistics(events: DataFrame) -> DataFrame:
    """One row with the statistics that ``BANDS`` names; 0 where there is nothing to divide by."""
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1)).cast("double")
    share = lambda a, b, unit=100.0: F.coalesce(F.try_divide(a * unit, b), F.lit(0.0))
    click, cart = n("click"), n("add_to_cart")
    return events.agg(
        share(click, n("impression")).alias("ctr"),
        share(click, F.count_distinct("session_id").cast("double"), 1.0).alias("avg_clicks"),
        share(n("favorite"), click).alias("fav_click"),
        share(cart, click).alias("atc_click"),
        share(n("purchase"), click).alias("pur_click"),
        share(n("purchase"), cart).alias("pur_atc"),
    )


def within_bands(statistics: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """A check per band of a one-row table, all from one pass."""
    rows = [F.struct(F.lit(f"band.{name}").alias("name"), F.when(F.col(name).between(*ends), 0).otherwise(1).cast("bigint").alias("n_bad")) for name, ends in bands.items()]
    return statistics.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def business_rules(events: DataFrame, items: DataFrame, users: DataFrame, max_clicks: int = 3, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """``report`` over impressions, clicks and what follows: the funnel narrows, chains hold, no request has more than
    ``max_clicks`` clicks or two queries, preferred and high places are clicked more often."""
    kinds = {r: i for i, r in enumerate(("impression", "click", "favorite", "add_to_cart", "purchase"))}
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    counts = events.agg(*(n(t).alias(t) for t in kinds))
    chains = event_chains(events.withColumnRenamed("timestamp", "ts"), kinds, {"click": "impression", "favorite": "click", "add_to_cart": "click", "purchase": "add_to_cart"}, ("request_id", "item_id"))
    place = F.when(F.col("position") <= 5, "a").when(F.col("position").between(15, 20), "b")
    liked = preference_rate(events, items, users, "impression", "click").withColumn("bucket", F.when(F.col("bucket") == "preferred", "a").otherwise("b"))

    def falls(rates: DataFrame) -> DataFrame:
        """One row if bucket a is not clicked more often than b, both being shown."""
        side = rates.agg(*(F.max(F.when((F.col("bucket") == x) & (F.col("n_shown") > 0), F.col("n_clicked") / F.col("n_shown"))).alias(x) for x in "ab"))
        return side.filter("a <= b")

    clicks = events.filter("event_type = 'click'").groupBy("request_id").agg(F.count("*").alias("m"))
    rows = [
        check("funnel.clicks", counts.filter("impression <= click")),
        *(check(f"funnel.{t}", counts.filter(F.col("click") <= F.col(t))) for t in ("favorite", "add_to_cart", "purchase")),
        check("chains", chains),
        check("clicks_per_request", clicks.filter(F.col("m") > max_clicks)),
        check("one_query_per_request", events.groupBy("request_id").agg(F.count_distinct("query_id").alias("m")).filter("m > 1")),
        check("preference", falls(liked)),
        check("position", falls(click_rate(events, place, "impression", "click"))),
        within_bands(funnel_statistics(events), bands),
    ]
    return report(rows)


def judged_queries(name: str, queries: DataFrame, qrels: DataFrame, least: int = 1) -> DataFrame:
    """Queries without a judgement of ``least`` or more."""
    good = qrels.filter(F.col("grade") >= least).select("query_id").distinct()
    return check(name, queries.join(good, "query_id", "left_anti"))
