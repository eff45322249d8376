"""Dense positions of sorted rows without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.session import Stage


def sorted_positions(df: DataFrame, order: list, name: str = "pos", stage: Stage | None = None) -> DataFrame:
    """`df` with column `name`: 0, 1, 2, ... along `order` over all rows.

    Rows are range-partitioned and sorted, written once (so that a lost executor cannot change their order), and each
    partition's rows are shifted by the number of rows before it. Only one count per partition is gathered.
    Rows that tie in `order` get their positions in an order that is fixed once written.
    """
    stage = stage or Stage(df.sparkSession, "positions")
    placed = stage.write(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    counts = sorted(placed.groupBy("_part").agg(F.max("_row").alias("n")).collect())  # one row per partition
    before, starts = 0, []
    for part, last in counts:
        starts.append((part, before))
        before += last + 1
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
