"""Places of rows in their groups, without a window that gathers a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialize

#: Rows of the table of counts by partition and group that may be broadcast (some 100 bytes a row); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order of ``order`` within ``group`` (null is a group of its own); ties in any order.

    The rows are range partitioned by group and order and written; a row's place is its place in its partition and what the partitions
    before it hold of its group. A group of any size is spread over as many tasks as its share of the rows.
    """
    spread = rows.withColumn("__twin", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*group, *order, "__twin").sortWithinPartitions(*group, *order, "__twin")
    stored = materialize(spread.drop("__twin").withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "places")
    counts = stored.groupBy("__part", *group).agg(F.min("__row").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")).withColumnRenamed("__part", "__p")
    starts = materialize(starts, "starts")
    few = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & stored[g].eqNullSafe(F.col(f"__g{i}"))
    return stored.join(few, same).select(*rows.columns, (F.col("__row") - F.col("__first") + F.col("__before")).alias("place"))
