"""Dense running row numbers without a single-task window.

``row_number() OVER (PARTITION BY g ORDER BY k)`` puts a whole group into one
task.  Here the rows are range-partitioned and sorted on (g, k) across the
cluster; each row records its partition id and its position in the partition
(``monotonically_increasing_id`` keeps the position in its low 33 bits).  The
table is written once so those values are stable, then a small aggregate per
(group, partition) — count and first position — gives, through a running sum
over partitions, the offset of every (group, partition) slice.  The index is
offset + position - first position.  Only the (group x partition) table is
ranked; it has at most (groups x partitions) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.session import cut_lineage

LOW_BITS = (1 << 33) - 1


def dense_index(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_index",
                partitions: int | None = None) -> DataFrame:
    """``df`` plus ``name`` = 0-based position of the row in its group by
    ``order`` (which must be unique within a group)."""
    group, order = list(group), list(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = (df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_BITS))))
    keyed = cut_lineage(keyed)
    slices = keyed.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = keyed.join(F.broadcast(slices.drop("_n")) if _small(slices) else slices.drop("_n"), [*group, "_pid"])
    return out.withColumn(name, F.col("_off") + F.col("_pos") - F.col("_first")).drop("_pid", "_pos", "_first", "_off")


def _small(slices: DataFrame, limit: int = 2_000_000) -> bool:
    return slices.count() <= limit
