"""Readers and writers of the five base tables and of Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns at rest; everything is text in CSV and typed on load.
SCHEMAS = {
    "items": "item_id string, title string, description string, category string, subcategory string, brand string, price double, quality_score double, popularity_score double, is_cold_start boolean, created_at timestamp",
    "users": "user_id string, preferred_categories array<string>, preferred_brands array<string>, price_preference string, activity_level string, is_cold_start boolean, created_at timestamp",
    "queries": "query_id string, query_text string, intended_category string, semantic_intent string, created_at timestamp",
    "events": "event_id string, event_type string, request_id string, session_id string, user_id string, query_id string, query_text string, item_id string, position int, timestamp timestamp, click_duration_ms int, add_to_cart_quantity int, purchase_amount double",
    "qrels": "query_id string, item_id string, relevance_grade int",
}


def columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in SCHEMAS[name].split(", ")]


def read_csv(spark: SparkSession, folder: str, name: str, typed: bool = True) -> DataFrame:
    """A base table; typed columns that do not parse are null."""
    text = ", ".join(f"{c} string" for c, _ in columns(name))
    df = spark.read.schema(text).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/{name}.csv")
    if not typed:
        return df
    return df.select(*((F.from_json(c, t) if t.startswith("array") else F.trim(c).try_cast(t)).alias(c) for c, t in columns(name)))


def write_csv(df: DataFrame, folder: str, name: str, force: bool = False) -> None:
    """Columns in their fixed order, arrays as JSON; fails on an existing folder unless ``force``."""
    made = [(F.to_json(c) if t.startswith("array") else F.col(c).cast("string")).alias(c) for c, t in columns(name)]
    df.select(*made).write.mode("overwrite" if force else "errorifexists").option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")


def read_tables(spark: SparkSession, folder: str, typed: bool = True) -> dict[str, DataFrame]:
    """All base tables; one whose file is not there is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    made = {}
    for name in SCHEMAS:
        there = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{name}.csv"))
        made[name] = read_csv(spark, folder, name, typed) if there else spark.createDataFrame([], SCHEMAS[name] if typed else ", ".join(f"{c} string" for c, _ in columns(name)))
    return made


def write_tables(tables: dict[str, DataFrame], folder: str, force: bool = False) -> None:
    for name, df in tables.items():
        write_csv(df, folder, name, force)


def last_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: the last one in the order of the files."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.withColumn("__place", F.monotonically_increasing_id())
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__place").alias("__last")).select(*keys, "__last.*").select(*df.columns)


def load_qrels(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, item_id, grade)``; fails on grades other than 1 to 3 and on repeated pairs."""
    rows = read_csv(spark, folder, "qrels", typed=False).select(F.trim("query_id").alias("query_id"), F.trim("item_id").alias("item_id"), F.trim("relevance_grade").try_cast("int").alias("grade"))
    if rows.filter("grade is null or grade not in (1, 2, 3)").limit(1).count():
        raise ValueError("relevance_grade must be 1, 2 or 3")
    if rows.groupBy("query_id", "item_id").count().filter("count > 1").limit(1).count():
        raise ValueError("repeated (query_id, item_id)")
    return rows


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of the content."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("checksum"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
