"""One ranking from several scores on unlike scales, by reciprocal rank fusion.

Each score only counts through its rank: an item gets the sum over the scores of 1 / (k + rank). Ranks
are found without gathering a group in one task: the distinct score values of all groups are sorted
once by range, a value's rank is the number of items before it in its group, taken from distributed prefix
sums, and the top of each group is cut before the shuffle as well as after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seamline.operators.prefix import running_totals

K = 60


def latest_scores(df: DataFrame, group: str, item: str, scores: list[str], at: str) -> DataFrame:
    """One row per group and item: the one with the latest time; on equal times the greatest scores.

    Null and NaN scores both become null. Rows without a group or item are left out; a null time comes first.
    """
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in scores]
    return (
        df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(at).alias("at"), *clean)
        .filter(F.col("grp").isNotNull() & F.col("item").isNotNull())
        .groupBy("grp", "item")
        .agg(F.max(F.struct("at", *scores)).alias("m"))
        .select("grp", "item", *[F.col(f"m.{c}").alias(c) for c in scores])
    )


def fused(rows: DataFrame, scores: list[str], k: int = K) -> DataFrame:
    """(grp, item, rrf) of rows (grp, item, scores...) with one row per group and item.

    Higher is better. Items that tie share the best rank of the tie. A null score ranks last in its list: it shares
    the rank after all items that have one.
    """
    long = rows.select("grp", "item", F.posexplode(F.array(*scores)).alias("list", "score"))
    values = long.groupBy("grp", "list", "score").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(values, ["grp", "list"], [F.col("score").desc_nulls_last()], "n").select(
        "grp", "list", "score", (F.col("before") + 1).alias("rank")
    )
    a, b = long.alias("a"), ranked.alias("b")
    return (
        a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.list") == F.col("b.list")) & F.col("a.score").eqNullSafe(F.col("b.score")))
        .groupBy(F.col("a.grp").alias("grp"), F.col("a.item").alias("item"))
        .agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("b.rank"))).alias("rrf"))
    )


def top(ranking: DataFrame, n: int) -> DataFrame:
    """The n best items of each group by (rrf, item), with place_no. The cut is made before the shuffle too."""
    order = Window.partitionBy("grp").orderBy(F.round("rrf", 12).desc(), "item")
    return ranking.withColumn("place_no", F.row_number().over(order)).filter(F.col("place_no") <= n)
