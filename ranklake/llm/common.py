"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rule of the contracts sees it.
SPACE = r"\x20\x09-\x0D"
#: A word: a longest run of other characters.
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of an input folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; executors and the driver all see it.

    Where the session names none, a local master gets a temporary one (tests, notebooks); on a
    cluster that would be lost with its machine, so it is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder: survives the loss of executors.

    The files go when Spark collects the data frame, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written to the shared folder, for one call of an operator; ``drop`` removes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again: lineage is cut, and its size is known to the planner."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete_folder(self.spark, self.folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased: on bytes, ``lower`` and ``split`` know ASCII letters and white space only."""
    return (text or "").encode().lower().split()


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose value is computed once per row.

    The value passes through a one-element ``explode``: the optimizer cannot copy it into later
    filters and lambdas, where a costly expression would run again for every element.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def constant_longs(values: list[int]) -> Column:
    """A constant array; the optimizer folds it into one literal, whatever its length."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def arrow_map(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` under one name, so that every free-style operator looks alike."""
    return df.mapInArrow(function, schema)


def text_blocks(texts: list, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` characters at most; a longer row is a range of its own.

    Bounds the scratch memory of vectorised code, whatever the size of an Arrow batch.
    """
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
