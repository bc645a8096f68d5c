"""Running sums over an order of all rows, without one task per group.

Rows are range-partitioned by (groups, order) and written once with their partition number, so that a
later pass sees the same partitions. Sums per partition and group are small (partitions x groups);
their running totals are added to the running sums inside each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemflow.session import cores_of, materialise, scratch_path

#: Rows of starts that are sent to all executors.
BROADCAST_ROWS = 500_000


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same groups that come before this row in ``order``.

    Null groups are groups of their own, null values count as zero, and rows equal in ``order`` come in a
    fixed but arbitrary order, so give an order without ties where that matters. Empty input stays empty.
    A group that holds most rows spreads over many partitions; only the partition totals are shared.
    """
    spark = df.sparkSession
    parts = partitions or cores_of(spark)
    path = scratch_path(spark, "ordered")
    keys = [*groups, *order]
    df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    amount = F.coalesce(F.col(value).cast("long"), F.lit(0))
    totals = materialise(stored.groupBy("_part", *groups).agg(F.sum(amount).alias("_total")), "totals")
    before = Window.partitionBy(*[F.col(g) for g in groups]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_start")
    inside = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # partitions x groups that meet in a partition; with very many groups a plain join
    joined = local.join(F.broadcast(starts) if totals.count() <= BROADCAST_ROWS else starts, same)
    return joined.withColumn(out, F.col("_inside") + F.col("_start")).select(*df.columns, out)
