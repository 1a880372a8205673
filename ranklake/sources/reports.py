"""Tables as reports show them, and their writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "mrr", "ndcg")


def six(value: Column) -> Column:
    return F.format_string("%.6f", F.round(value.cast("double"), 6))


def wide_metrics(metrics: DataFrame, ks: tuple[int, ...] = (5, 10, 20), names: tuple[str, ...] = METRICS, by: str = "query_id") -> DataFrame:
    """One row per query: ``precision_at_5`` and so on, of rows per query and cut-off."""
    return metrics.groupBy(by).agg(*(F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for k in ks for m in names))


def macro_record(metrics: DataFrame, ks: tuple[int, ...] = (5, 10, 20), names: tuple[str, ...] = METRICS, **constants) -> DataFrame:
    """One row: constants, the number of queries and ``<metric>_at_<k>`` means to six places; 0 without queries."""
    mean = lambda m, k: F.round(F.coalesce(F.avg(F.when(F.col("k") == k, F.col(m))), F.lit(0.0)), 6).alias(f"{m}_at_{k}")
    row = metrics.agg(F.count_distinct("query_id").alias("query_count"), *(mean(m, k) for m in names for k in ks))
    return row.select(*(F.lit(v).alias(k) for k, v in constants.items()), "*")


def shown_results(results: DataFrame, queries: DataFrame, qrels: DataFrame, score: str = "bm25_score") -> DataFrame:
    """``(query_id, query_text, rank, item_id, <score>, relevance_grade)``: scores as text with six places, grade 0 if not judged."""
    rows = results.join(queries.select("query_id", "query_text"), "query_id").join(qrels.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left")
    return rows.select("query_id", "query_text", "rank", "item_id", six(F.col("score")).alias(score), F.coalesce("grade", F.lit(0)).alias("relevance_grade"))


def deltas(ours: DataFrame, base: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """``(k, metric, ours, base, delta)`` of two macro averages; base and delta are null where the base has no such cut-off."""
    def long(df, name):
        return df.select("k", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in names))).alias("x")).select("k", "x.*")

    return long(ours, "ours").join(long(base, "base"), ["k", "metric"], "left").withColumn("delta", F.round(F.col("ours") - F.col("base"), 6))


def profile_rows(profile: DataFrame, prefs: DataFrame, top: int = 5) -> DataFrame:
    """Profiles with ``top_<dim>`` lists (largest weight first, ties by name) and ``<dim>_weights`` as JSON objects."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("value").alias("value"))))
    lists = prefs.groupBy("user_id", "dim").agg(order.alias("xs"))
    names = F.slice(F.transform("xs", lambda x: x.value), 1, top)
    weights = F.to_json(F.map_from_entries(F.transform("xs", lambda x: F.struct(x.value, -x.w))))
    packed = lists.select("user_id", F.struct("dim", names.alias("names"), weights.alias("weights")).alias("d")).groupBy("user_id").agg(F.collect_list("d").alias("ds"))

    def of(dim: str, part: str, empty: str) -> Column:
        return F.coalesce(F.get(F.transform(F.filter("ds", lambda d: d.dim == dim), lambda d: d[part]), F.lit(0)), F.expr(empty))

    made = []
    for dim in ("category", "subcategory", "brand"):
        made += [F.to_json(of(dim, "names", "cast(array() as array<string>)")).alias(f"top_{dim}"), of(dim, "weights", "'{}'").alias(f"{dim}_weights")]
    return profile.join(packed, "user_id", "left").select(*profile.columns, *made)


def request_rows(requests: DataFrame, ours: DataFrame, base: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per request: NDCG before and after re-ranking and the difference, as text with six places; 0 where there is none."""
    a, b = (wide_metrics(df, ks, ("ndcg",), "request_id").select("request_id", *(F.col(f"ndcg_at_{k}").alias(f"{name}_{k}") for k in ks)) for df, name in ((ours, "a"), (base, "b")))
    rows = requests.join(a, "request_id", "left").join(b, "request_id", "left")
    value = lambda c: F.coalesce(c, F.lit(0.0))
    made = [c for k in ks for c in (six(value(F.col(f"b_{k}"))).alias(f"baseline_behavior_ndcg_at_{k}"), six(value(F.col(f"a_{k}"))).alias(f"personalized_behavior_ndcg_at_{k}"), six(value(F.col(f"a_{k}")) - value(F.col(f"b_{k}"))).alias(f"behavior_ndcg_at_{k}_delta"))]
    return rows.select(*requests.columns, *made)


def write_report(folder: str, record: DataFrame, force: bool = False, **tables: DataFrame) -> None:
    """``metrics.json`` with the one row of ``record``, and a CSV folder with a header per table; fails on existing folders unless ``force``."""
    mode = "overwrite" if force else "errorifexists"
    record.coalesce(1).write.mode(mode).json(f"{folder}/metrics.json")
    for name, df in tables.items():
        df.write.mode(mode).option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, columns, n_rows, checksum)``: the checksum does not depend on the order of rows."""
    def row(name, df):
        sums = df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias("checksum"))
        return sums.select(F.lit(name).alias("name"), F.array(*map(F.lit, df.columns)).alias("columns"), "n_rows", "checksum")

    return reduce(DataFrame.unionByName, (row(n, df) for n, df in tables.items()))


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Names of two manifests whose content is not the same, or that only one has."""
    pair = ours.alias("a").join(theirs.alias("b"), F.col("a.name") == F.col("b.name"), "full_outer")
    same = F.col("a.columns").eqNullSafe(F.col("b.columns")) & F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")) & F.col("a.checksum").eqNullSafe(F.col("b.checksum"))
    return pair.filter(~same | F.col("a.name").isNull() | F.col("b.name").isNull()).select(F.coalesce("a.name", "b.name").alias("name"))
