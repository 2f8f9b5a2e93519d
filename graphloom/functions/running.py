"""Orders over whole tables without a task that gets all rows: chunks, and a small table of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per chunk of a running sum.
CHUNK = 1 << 16


def running_sums(rows: DataFrame, key: str, sums: dict[str, Column], group: tuple[str, ...] = (), then: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """rows with a column for each of sums: its total over the rows of the group up to this one, by key and then.

    A window orders chunk keys at a time; the table of chunks, ordered as a whole within a group, has a row per chunk.
    """
    names = rows.columns
    marked = rows.withColumns({"_chunk": F.floor(F.col(key) / chunk), **{f"_{name}": x for name, x in sums.items()}})
    every = [*group, "_chunk"]
    totals = marked.groupBy(*every).agg(*(F.sum(f"_{name}").alias(f"_all_{name}") for name in sums))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*every, *(F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}") for name in sums))
    inside = Window.partitionBy(*every).orderBy(key, *then).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumns({f"_{name}": F.sum(f"_{name}").over(inside) for name in sums}).join(bases, every)
    return summed.select(*names, *((F.col(f"_base_{name}") + F.col(f"_{name}")).alias(name) for name in sums))


def with_next(rows: DataFrame, order: tuple[str, ...], bucket: Column, value: str, name: str) -> DataFrame:
    """rows with the value of the row that follows in the order; null on the last.

    bucket must not decrease in that order. Each is sorted by itself; a bucket's last row takes the first value
    of the next bucket, from a table of one row per bucket.
    """
    names = rows.columns
    marked = rows.withColumn("_bucket", bucket)
    inside = Window.partitionBy("_bucket").orderBy(*order)
    heads = marked.groupBy("_bucket").agg(F.min(F.struct(*order, F.col(value).alias("_value")))["_value"].alias("_head"))
    heads = heads.select("_bucket", F.lead("_head").over(Window.orderBy("_bucket")).alias("_head"))
    ahead = marked.withColumns({"_next": F.lead(value).over(inside), "_last": F.row_number().over(Window.partitionBy("_bucket").orderBy(*(F.desc(c) for c in order))) == 1})
    return ahead.join(heads, "_bucket").select(*names, F.when(F.col("_last"), F.col("_head")).otherwise(F.col("_next")).alias(name))
