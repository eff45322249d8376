"""Running totals within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seamline.session import Stage


def running_totals(df: DataFrame, group: list[str], order: list, size: str, stage: Stage | None = None) -> DataFrame:
    """`df` with `before`: the sum of `size` over the rows of its group that come before it in `order`.

    Rows are range-partitioned by (group, order), so a group that holds a third of all rows is spread over a third of the
    partitions. Each partition sums its own rows; the totals of (group, partition) pairs, at most the number of groups
    plus the number of partitions, are shifted in a window over them and joined back. The sorted rows are written once, so
    that a lost executor can't change which partition a row is in. Null sizes count as 0. `order` must be total within a group.
    """
    stage = stage or Stage(df.sparkSession, "prefix")
    amount = F.coalesce(F.col(size), F.lit(0))
    placed = stage.write(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    pieces = placed.groupBy(*group, "_part").agg(F.sum(amount).alias("_sum"))
    shift = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(shift), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        placed.withColumn("_own", F.sum(amount).over(within) - amount)
        .join(starts, same)
        .withColumn("before", F.col("_start") + F.col("_own"))
        .drop("_part", "_p", "_start", "_own", *[f"_g{i}" for i in range(len(group))])
    )


def row_numbers(df: DataFrame, group: list[str], order: list, name: str = "rank", stage: Stage | None = None) -> DataFrame:
    """`df` with `name`: 1, 2, 3, ... along `order`, which must be total, within each group of any size."""
    return running_totals(df.withColumn("_one", F.lit(1)), group, order, "_one", stage).withColumn(name, (F.col("before") + 1).cast("bigint")).drop("_one", "before")
