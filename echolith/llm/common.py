"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (space, tab, line feed, vertical tab, form feed, return).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; an empty array for a null or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir. Only a local session may lack one; it gets a temporary folder, for as long as it lives."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder; a lost executor costs no more than the reading of it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch, a few rows at a time: a task then holds few texts as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: Copy numbers are made in two steps, so that no array is longer than this, or than their number divided by it.
_STEP = 1 << 16


def times(rows: DataFrame, n: str, name: str) -> DataFrame:
    """rows, each as often as its column n says, numbered from 1 in a column of the given name."""
    chunks = rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / _STEP))))
    chunks = chunks.filter(F.col(n) > 0)
    chunks = chunks.withColumn(name, F.explode(F.sequence(F.col(name) * _STEP + 1, F.least(F.col(n).cast("long"), (F.col(name) + 1) * _STEP))))
    return chunks.withColumn(name, F.col(name).cast("int"))


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a number from 1 on among those of equal keys. These are counted within each partition first, so many equal rows are no large group.

    rows must come out alike when they are read again, as those of a table do.
    """
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33))
    parts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    parts = parts.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__part").alias("__of"), "__before")
    same = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__row"))
    joined = rows.withColumn("__within", within).join(parts, same)
    return joined.withColumn(name, (F.col("__within") + F.col("__before")).cast("int")).drop("__row", "__part", "__of", "__before", "__within", *[f"__{i}" for i in range(len(keys))])
