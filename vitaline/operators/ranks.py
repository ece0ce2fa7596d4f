"""Ranks and carried values within groups that may hold a large part of all rows.

A plain window sorts a whole group in one task. Here a bucket that rises with the order (a date, a whole number, the
leading key) splits every group: rows are ordered within (group, bucket) by as many tasks as there are buckets, and
what lies before a bucket is known from one aggregated row per bucket. Only those rows, bounded by the number of
distinct buckets and not by the data, are ordered per group.

Defined results: null group keys form groups of their own; a null bucket comes first; ties are broken by the order
given, which should end in a unique key; an empty table gives an empty table; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(rows: DataFrame, per_bucket: DataFrame, keys: Sequence[str], new: Sequence[str]) -> DataFrame:
    other = per_bucket.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *new)
    on = [F.col(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(keys)]
    return rows.join(other, on, "inner").drop(*[f"__j{i}" for i in range(len(keys))])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], bucket: Column, out: str = "rank") -> DataFrame:
    """Append out: 1, 2, ... within each group in the given order; bucket must never fall along that order."""
    b = df.withColumn("__b", bucket)
    keys = [*by, "__b"]
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy(F.col("__b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    within = b.withColumn("__w", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return _joined(within, offsets, keys, ["__o"]).withColumn(out, (F.col("__o") + F.col("__w")).cast("int" if out.endswith("seq") else "long")).drop("__b", "__o", "__w")


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Append out: the last value of the group up to the row that is not null; order names columns, bucket as in ranked."""
    b = df.withColumn("__b", bucket)
    keys = [*by, "__b"]
    last = b.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__l"))
    before = Window.partitionBy(*by).orderBy(F.col("__b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = last.withColumn("__e", F.last("__l", ignorenulls=True).over(before))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(b.withColumn("__v", own), earlier, keys, ["__e"]).withColumn(out, F.coalesce("__v", "__e")).drop("__b", "__v", "__e")
