"""Judgements from what items and queries say, whatever users did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Distinct lower-cased runs without white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def holds(text: Column, part: Column) -> Column:
    """Whether ``part`` stands in ``text``, whatever the case; a null does not."""
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


#: What a judgement may look at in an item.
LOOKS = ["category", "subcategory", "brand", "title", "description"]


def prepared(kinds: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words are taken once a row, before pairs are made."""
    k = kinds.select("kind", "first", *(F.col("kind")[c].alias(c) for c in LOOKS[:3]), words(F.col("kind.title")).alias("title_words"), words(F.col("kind.description")).alias("description_words"))
    q = queries.select("query_id", "query_text", "intended_category", words(F.col("query_text")).alias("query_words"), words(F.col("semantic_intent")).alias("intent_words"))
    return k, q


def pairs(items: DataFrame, queries: DataFrame, max_queries: int) -> DataFrame:
    """Every pair is rated, and all items of a query's category are judged, so the result itself grows with both sides.

    The queries are broadcast up to ``max_queries`` rows; more are dealt as blocks against the items.
    """
    few = queries.limit(max_queries + 1).count() <= max_queries
    return items.crossJoin(F.broadcast(queries) if few else queries)


def rate(kinds: DataFrame, queries: DataFrame, max_queries: int) -> DataFrame:
    """``(query_id, kind, first, same, shared, score)`` of every pair.

    What is costly passes through a one-element ``explode``, so that no later filter or aggregate computes it again.
    """
    k, q = prepared(kinds, queries)
    texts = (
        holds(F.col("query_text"), F.col("subcategory")),
        holds(F.col("query_text"), F.col("brand")),
        F.size(F.array_intersect("intent_words", "description_words")) >= 3,
    )
    points = F.struct(
        F.coalesce(F.col("category") == F.col("intended_category"), F.lit(False)).alias("same"),
        F.size(F.array_intersect("query_words", "title_words")).alias("shared"),
        sum((F.coalesce(p, F.lit(False)).cast("int") for p in texts), F.lit(0)).alias("texts"),
    )
    rated = pairs(k, q, max_queries).select("query_id", "kind", "first", F.explode(F.array(points)).alias("p"))
    score = F.col("p.same").cast("int") + F.col("p.texts") + (F.col("p.shared") >= 2).cast("int")
    return rated.select("query_id", "kind", "first", "p.same", "p.shared", score.alias("score"))


def grade(items: DataFrame, queries: DataFrame, max_queries: int = 20_000) -> DataFrame:
    """``(query_id, item_id, grade)``: a point each for the category, the subcategory and the brand in the query, two words
    shared with the title, three shared by intent and description; three points or more give 3, none gives no row.

    A query without a grade of 2 gets one: the item, not judged yet, of its category or else of any that shares most
    title words, ties by item, null ids last.  A query whose category has no items gets none.

    Items that agree in all that is looked at are one kind: kinds are rated, and items take the grades of theirs.
    """
    given = items.select("item_id", F.struct(*LOOKS).alias("kind"))
    # a fixed number of tasks: few bytes of kinds make many pairs
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = given.groupBy("kind").agg(F.min("item_id").alias("first")).repartition(tasks)
    rated = rate(kinds, queries, max_queries)
    found = given.join(rated.filter("score > 0").select("query_id", "kind", F.least("score", F.lit(3)).alias("grade")), "kind").select("query_id", "item_id", "grade")
    # rows without points and the best grade of a query come from one more pass, not from a join of all pairs
    missing = F.struct((~F.col("same")).cast("int").alias("other"), (-F.col("shared")).alias("shared"), F.col("first").isNull().alias("unnamed"), F.col("first").alias("item_id"))
    best = rated.groupBy("query_id").agg(F.max("score").alias("top"), F.max(F.col("same").cast("int")).alias("stocked"), F.min(F.when(F.col("score") == 0, missing)).alias("pick"))
    added = best.filter("top < 2 and stocked = 1 and pick is not null").select("query_id", "pick.item_id", F.lit(2).alias("grade"))
    return found.unionByName(added)


def relevance(item_category: Column, subcategory: Column, brand: Column, category: Column, text: Column) -> Column:
    """0 to 1: 0.6 for the category, 0.3 for the subcategory and 0.1 for the brand in the query's text."""
    same = F.coalesce(item_category == category, F.lit(False))
    return F.least(F.lit(1.0), same.cast("double") * 0.6 + holds(text, subcategory).cast("double") * 0.3 + holds(text, brand).cast("double") * 0.1)
