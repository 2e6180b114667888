"""Distributed prefix sums: range partitions, a sum for each, and running sums within."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernal.llm.scratch import Scratch


def before(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, str], scratch: Scratch, name: str) -> DataFrame:
    """rows with a column for each of ``sums``: that expression summed over all rows before in the order, 0 for the first.

    The order must tell all rows apart.  No task holds more than a range of the rows; what is put together in one place
    is one row for each range.
    """
    parted = rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range_no"))
    parted = scratch.table(parted, name)  # from here on the ranges are fixed
    totals = parted.groupBy("range_no").agg(*[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])
    ranges = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("range_no").alias("of_range"), *[F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(f"offset_{c}") for c in sums])
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parted.select("*", *[F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)).alias(c) for c, e in sums.items()])
    out = own.join(F.broadcast(offsets), F.col("range_no") == F.col("of_range"))
    return out.select(*rows.columns, *[(F.col(c) + F.col(f"offset_{c}")).alias(c) for c in sums])
