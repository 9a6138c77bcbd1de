"""Exact medians and modes per key from counts, with hash aggregates only.

A key's values are first counted (``groupBy(key, value)``, combined before the shuffle, so
a key that holds a third of all rows costs one row per distinct value and task), then the
median is where the running count passes the middle. No state grows with a key's rows, and
no aggregate holds values in objects, however many keys there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def medians(df: DataFrame, keys: list, value: str, rows: str = "rows", median: str = "median") -> DataFrame:
    """Per key the number of rows and the median of the non-null values (the mean of the middle
    two of an even number; null if there are none). ``keys`` is not empty."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    valid = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(F.lit(0))
    by = Window.partitionBy(*keys)
    upto = F.sum(valid).over(by.orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*keys, value, "_n", upto.alias("_upto")).withColumn("_all", F.max("_upto").over(by))
    lower, upper = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    middle = [F.min(F.when(F.col("_upto") >= at, F.col(value))).alias(c) for at, c in ((lower, "_lo"), (upper, "_hi"))]
    found = counts.groupBy(*keys).agg(F.sum("_n").alias(rows), *middle)
    return found.select(*keys, rows, ((F.col("_lo") + F.col("_hi")) / F.lit(2.0)).alias(median))


def modes(df: DataFrame, key: str, value: str, order: str, mode: str = "mode") -> DataFrame:
    """Per key the most frequent value; among equally frequent ones that of the row that comes
    first by ``order``, which is looked up for the tied values only."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(key)
    top = counts.withColumn("_most", F.max("_n").over(by)).where("_n = _most").withColumn("_ties", F.count(F.lit(1)).over(by))
    clear = top.where("_ties = 1").select(key, F.col(value).alias(mode))
    tied = df.select(key, value, order).join(top.where("_ties > 1").select(key, value), [key, value])
    first = tied.withColumn("_r", F.row_number().over(by.orderBy(order))).where("_r = 1")
    return clear.unionByName(first.select(key, F.col(value).alias(mode)))
