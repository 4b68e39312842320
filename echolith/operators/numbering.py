"""Numbers for the rows of a table, in an order, without a sort of everything in one task: ranges are sorted by themselves, and each begins after the rows of the ranges before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.sources.shared import kept


def numbered(rows: DataFrame, name: str, per: list[str], order: list[str]) -> DataFrame:
    """rows with a long column of the given name: 0, 1, ... among the rows with equal values of per (no names: of all), by order. Rows equal in order are numbered one way or another; nulls come first, and null is a value of per.

    Only the number of rows of each range (and value of per) is summed up over ranges; a value that holds most rows is spread over many ranges. Columns __range and __n are taken.
    """
    return _numbered(kept(rows.repartitionByRange(*per, *order).withColumn("__range", F.spark_partition_id())), name, per, order)


def numbered_as_read(rows: DataFrame, name: str) -> DataFrame:
    """rows numbered 0, 1, ... in the order in which their partitions hold them."""
    marked = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33).cast("int"))
    return _numbered(kept(marked), name, [], ["__at"]).drop("__at")


def _numbered(ranges: DataFrame, name: str, per: list[str], order: list[str]) -> DataFrame:
    sizes = ranges.groupBy(*per, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*per).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(per)], F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    same = F.col("__range") == F.col("__of")
    for i, c in enumerate(per):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    within = F.row_number().over(Window.partitionBy(*per, "__range").orderBy(*order))
    placed = ranges.withColumn(name, within).join(sizes, same).withColumn(name, F.col(name) - 1 + F.col("__n"))
    return placed.drop("__range", "__of", "__n", *[f"__{i}" for i in range(len(per))])
