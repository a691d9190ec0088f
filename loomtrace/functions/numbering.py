"""Row numbers over whole tables without a task that sorts them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with ``name``, the place of each row in an order, counted from ``start``.

    Rows are dealt over ranges of the order and sorted in each; a range's rows are numbered on from those of the ranges
    before. The order should tell rows apart: those equal in it are numbered in any way.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, total = [], start
    for p, n in sorted(placed.groupBy(part).count().collect()):  # a row for each range
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, place).drop("__part", "__before", "__at")
