"""Rows in the order of a key, and dense numbers, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import written


def in_ranges(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt out by ranges of the keys, in as many parts as there are tasks: adds _part, the range, in order, and
    _at, the place in it. Written, so that both stay as they are."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return written(ranged, "ranges").withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_at", F.expr("_at & 8589934591L"))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a column of 0, 1, 2, ... by the keys, which must be unique. A row's number is its place in its
    range and the rows of those before: only their counts are put in order."""
    fixed = in_ranges(df, *keys)
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # One row for each partition: as many as there are tasks.
    return fixed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
