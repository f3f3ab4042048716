"""Dense numbers over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import checkpointed


def dense_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with ``name`` (long, from 0) in the order given.

    Rows are numbered within ranges of the order: one sort by range, a count per
    range, and a window over those counts alone. The ranges are kept by a
    checkpoint, as both the counts and the rows read them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged)
    # Within a partition that number begins at 0 in its lower 33 bits.
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row per range.
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + low).drop("_part", "_at", "_before")
