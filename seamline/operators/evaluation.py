"""Measures of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def recall_and_mrr(ranked: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(n_queries, mrr, recall_at_...): over the queries of `truth` (query_id, id), where in `ranked` (query_id, id, rank) their right answer stands."""
    place = truth.join(ranked, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return place.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 9).alias("mrr"),
        *[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 9).alias(f"recall_at_{k}") for k in at],
    )


def corpus_totals(chunks: DataFrame) -> DataFrame:
    """(cwd, n_files, n_chunks, n_lines) of chunks (id, cwd, file_path, content); repeated rows count once, a null content has no lines."""
    rows = chunks.select("id", "cwd", "file_path", F.when(F.col("content").isNotNull(), F.size(F.split("content", "\n", -1))).alias("n"), F.xxhash64("content").alias("h")).distinct()
    return rows.groupBy("cwd").agg(F.countDistinct("file_path").alias("n_files"), F.countDistinct("id").alias("n_chunks"), F.sum("n").cast("bigint").alias("n_lines"))
