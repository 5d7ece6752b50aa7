"""Dense ids and running sums in a global order without a one-partition window.

The frame is range-partitioned and sorted on a total order; each row gets a
partition-local position (``monotonically_increasing_id`` keeps the partition
index in its upper bits and the row position in the lower 33 bits).  Per-
partition counts and sums form a table with one row per partition, whose
running offsets are broadcast back.  Results depend only on the order, not on
how many partitions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.session import cut_lineage

_LOW_BITS = 33


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted frame with (_pid, _pos), written once to the shared folder: both uses must see one sort."""
    with_mid = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    low = (1 << _LOW_BITS) - 1
    return cut_lineage(with_mid
                       .withColumn("_pid", F.shiftright("_mid", _LOW_BITS))
                       .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(low)))
                       .drop("_mid"))


def dense_index(df: DataFrame, order: list[Column], start: int = 0, id_col: str = "id",
                value_col: str | None = None) -> DataFrame:
    """Adds ``id_col`` = start + rank in ``order`` (must be a total order).
    With ``value_col``, also adds ``cum_<value_col>`` (running sum including
    the row) and ``total_<value_col>``."""
    ordered = _ordered(df, order)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value_col:
        aggs.append(F.sum(value_col).alias("_s"))
    parts = ordered.groupBy("_pid").agg(*aggs)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if value_col:
        cols += [F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_soff"),
                 F.sum("_s").over(Window.partitionBy()).alias(f"total_{value_col}")]
    # One row per partition of the sorted frame: a proven size bound.
    offsets = F.broadcast(parts.select("_pid", *cols))
    out = ordered.join(offsets, "_pid").withColumn(id_col, (F.col("_off") + F.col("_pos") + start).cast("bigint"))
    drop = ["_pid", "_pos", "_off"]
    if value_col:
        w = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"cum_{value_col}", F.col("_soff") + F.sum(value_col).over(w))
        drop.append("_soff")
    return out.drop(*drop)
