"""Sets of sequence numbers kept as disjoint intervals.

A set is a table (scope, lo, hi) of closed intervals, cut at the borders of blocks of `block` numbers, so that every
operation works within one (scope, block): no scope, however large, is gathered in one task. A block of b numbers holds
at most b/2 intervals, usually one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 16


def _block(col: Column, block: int) -> Column:
    return F.floor(col / F.lit(block)).cast("long")


def from_numbers(df: DataFrame, scope: str, seq: str, block: int = BLOCK) -> DataFrame:
    """Intervals of the numbers in column `seq`; nulls are left out, repeats count once."""
    rows = (
        df.select(F.col(scope).alias("scope"), F.col(seq).cast("long").alias("seq"))
        .filter(F.col("seq").isNotNull())
        .distinct()
        .withColumn("blk", _block(F.col("seq"), block))
    )
    run = Window.partitionBy("scope", "blk").orderBy("seq")
    return (
        rows.withColumn("isle", F.col("seq") - F.row_number().over(run))
        .groupBy("scope", "blk", "isle")
        .agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .select("scope", "lo", "hi")
    )


def cut(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """The intervals cut at block borders; null or reversed ones are left out."""
    return (
        df.filter(F.col("lo") <= F.col("hi"))
        .withColumn("blk", F.explode(F.sequence(_block(F.col("lo"), block), _block(F.col("hi"), block))))
        .select(
            "scope",
            "blk",
            F.greatest("lo", F.col("blk") * block).alias("lo"),
            F.least("hi", F.col("blk") * block + (block - 1)).alias("hi"),
        )
    )


def _swept(sides: DataFrame, keep: Column) -> DataFrame:
    """Sweep over interval ends within a block; `keep` is a condition on n0 and n1, the open intervals of each side."""
    ends = sides.select("scope", "blk", F.col("lo").alias("x"), F.when(F.col("side") == 0, 1).otherwise(0).alias("d0"), F.when(F.col("side") == 1, 1).otherwise(0).alias("d1")).unionAll(
        sides.select("scope", "blk", F.col("hi") + 1, -F.when(F.col("side") == 0, 1).otherwise(0), -F.when(F.col("side") == 1, 1).otherwise(0))
    )
    order = Window.partitionBy("scope", "blk").orderBy("x")
    pieces = (
        ends.groupBy("scope", "blk", "x")
        .agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
        .withColumn("n0", F.sum("d0").over(order))
        .withColumn("n1", F.sum("d1").over(order))
        .withColumn("next", F.lead("x").over(order))
        .filter(keep & F.col("next").isNotNull())
        .withColumn("before", F.lag("next").over(order))
        .withColumn("first", F.when(F.col("before") == F.col("x"), 0).otherwise(1))
        .withColumn("run", F.sum("first").over(order))
    )
    return pieces.groupBy("scope", "blk", "run").agg(F.min("x").alias("lo"), (F.max("next") - 1).alias("hi")).select("scope", "lo", "hi")


def subtract(available: DataFrame, processed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The gaps: what is in `available` and not in `processed`."""
    sides = cut(available, block).withColumn("side", F.lit(0)).unionByName(cut(processed, block).withColumn("side", F.lit(1)))
    return _swept(sides, (F.col("n0") > 0) & (F.col("n1") == 0))


def intersect(one: DataFrame, other: DataFrame, block: int = BLOCK) -> DataFrame:
    """What is in both sets."""
    sides = cut(one, block).withColumn("side", F.lit(0)).unionByName(cut(other, block).withColumn("side", F.lit(1)))
    return _swept(sides, (F.col("n0") > 0) & (F.col("n1") > 0))


def merge(one: DataFrame, other: DataFrame, block: int = BLOCK) -> DataFrame:
    """The union of two sets, again disjoint."""
    sides = cut(one.unionByName(other), block).withColumn("side", F.lit(0))
    return _swept(sides, F.col("n0") > 0)


def members(df: DataFrame, scope: str, seq: str, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `df` whose number lies in an interval of their scope: a join on scope and block, then the bounds."""
    parts = cut(intervals, block).select(F.col("scope").alias("_scope"), F.col("blk").alias("_blk"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return (
        df.withColumn("_b", _block(F.col(seq), block))
        .join(parts, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_b") == F.col("_blk")) & F.col(seq).between(F.col("_lo"), F.col("_hi")))
        .drop("_b", "_scope", "_blk", "_lo", "_hi")
    )
