"""Mixing sources to target shares of the total size in tokens.

Every document gets a hash-random key. Sorted by it within their source, documents get distributed
prefix sums of their sizes, and a source's budget is met by whole passes over it plus the documents whose running
total stays within what is left. No source is gathered in one task, whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamline.llm.tokenizer import VOCABULARIES, encode_corpus
from seamline.operators.prefix import running_totals


def source_key(col: Column) -> Column:
    """Source names compare without white space around them and without letter case."""
    return F.lower(F.regexp_replace(col, r"^[\s ]+|[\s ]+$", ""))


def sized_documents(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents, repeated rows once; a null or blank source stays null; rows without an id are left out."""
    sized = encode_corpus(docs.filter(F.col("doc_id").isNotNull()).withColumn("_id", F.struct("doc_id", F.nullif(source_key(F.col("source")), F.lit("")).alias("source"))), "_id", "text", name, folder, counts_only=True)
    return sized.groupBy("_id").agg(F.max("n_tokens").alias("n_tokens")).select("_id.doc_id", "_id.source", "n_tokens")


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats): shares of a source named twice add up; repeats below 0 or null count as 0."""
    return (
        targets.withColumn("source", source_key(F.col("source")))
        .filter((F.col("source") != "") & (F.col("target_share") > 0))
        .distinct()
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    )


def budgets(sums: DataFrame, targets: DataFrame, total_tokens: int | None = None, fit: str = "total") -> DataFrame:
    """(source, have, target_share, max_repeats, wanted_share, budget) of every source with a target and of none besides; `sums` has (source, have).

    fit="total": shares of `total_tokens` (default: all tokens of the sources that have a target), whether or not a source can reach its own.
    fit="shares": shares of the largest total, at most `total_tokens`, of which every source that has documents can reach its share. Sources
    without documents, or that may not be used, can give nothing: the others' shares are taken of what is left, in the same proportions.
    """
    if fit not in ("total", "shares"):
        raise ValueError("fit must be total or shares")
    joined = clean_targets(targets).join(sums, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    most = F.col("have") * F.col("max_repeats")
    usable = most > 0
    one = joined.agg(F.sum("have").alias("all_tokens"), F.sum(F.when(usable, F.col("target_share"))).alias("present"), F.min(F.when(usable, most / F.col("target_share"))).alias("reach"))
    wide = joined.crossJoin(F.broadcast(one))  # one row, not a product of rows
    total = F.lit(total_tokens) if total_tokens is not None else F.col("all_tokens")
    share = F.col("target_share")
    if fit == "shares":
        reach = F.col("reach") * F.col("present")
        total = F.coalesce(F.least(reach, F.lit(total_tokens)) if total_tokens is not None else reach, F.lit(0))
        share = F.when(usable, F.col("target_share") / F.col("present")).otherwise(F.lit(0.0))
    return wide.select("source", "have", "target_share", "max_repeats", share.alias("wanted_share"), F.floor(share * total).cast("long").alias("budget"))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, fit: str = "total") -> DataFrame:
    """(doc_id, source, n_tokens, n_uses): how often each document is used, 0 for unused ones.

    A source's budget (see `budgets` for the total it is a share of) is met
    by as many whole passes as fit and max_repeats allows, then by the documents in the order of their random key as
    long as the running total stays within the rest, so it is never exceeded and missed by less than one document
    unless the source is exhausted. Sources without a target, null sources and documents without tokens are not used.
    """
    sums = sized.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("have"))
    planned = budgets(sums, targets, total_tokens, fit).select(F.col("source").alias("_s"), "have", "max_repeats", "budget")
    planned = planned.withColumn("passes", F.least(F.floor(F.col("budget") / F.greatest("have", F.lit(1))), F.col("max_repeats")).cast("long"))
    keyed = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    placed = running_totals(keyed.filter(F.col("n_tokens") > 0), ["source"], [F.col("key"), F.col("doc_id")], "n_tokens")
    rest = F.col("budget") - F.col("passes") * F.col("have")
    one_more = (F.col("passes") < F.col("max_repeats")) & (F.col("before") + F.col("n_tokens") <= rest)
    used = placed.join(planned, F.col("source") == F.col("_s"), "left").select(
        "doc_id", "source", "n_tokens", F.coalesce(F.col("passes") + F.when(one_more, 1).otherwise(0), F.lit(0)).cast("int").alias("n_uses")
    )
    return used.unionByName(sized.filter(F.col("n_tokens") <= 0).withColumn("n_uses", F.lit(0)))


def shares(mixed: DataFrame, targets: DataFrame, total_tokens: int | None = None, fit: str = "total") -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_used, used_tokens, actual_share, share_of_budget, state) per source with a target or documents.

    actual_share is of the tokens used, share_of_budget of the sum of all budgets: they part where some source can't reach its budget.
    state: `met` if the tokens used are the target share (with fit="shares": the share among the sources present) of all tokens used, but for at most the
    source's largest document; `short` below that, where the source is exhausted, `under` where it isn't; `over` above it, as others are short; `absent`
    without documents; `no target` for sources not asked for.
    """
    have = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.when(F.col("n_uses") > 0, 1).otherwise(0)).alias("n_used"),
        F.sum(F.col("n_uses") * F.col("n_tokens")).alias("used_tokens"),
        F.sum("n_tokens").alias("have"),
        F.max("n_tokens").alias("largest"),
    )
    planned = budgets(have.filter(F.col("source").isNotNull()).select("source", "have"), targets, total_tokens, fit).select(F.col("source").alias("_s"), "target_share", "max_repeats", "wanted_share", "budget")
    sources = have.join(planned, F.col("source") == F.col("_s"), "full").withColumn("source", F.coalesce("source", "_s")).withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    joined = sources.crossJoin(F.broadcast(sources.agg(F.sum("used_tokens").alias("all_used"), F.sum("budget").alias("all_wanted"))))  # one row
    off = F.col("used_tokens") - F.col("wanted_share") * F.col("all_used")
    exhausted = F.col("used_tokens") >= F.col("max_repeats") * F.col("have")
    state = (
        F.when(F.col("target_share").isNull(), "no target")
        .when(F.col("n_docs").isNull(), "absent")
        .when(F.abs(off) <= F.col("largest"), "met")
        .when(off > 0, "over")
        .when(exhausted, "short")
        .otherwise("under")
    )
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_used", F.lit(0)).alias("n_used"),
        "used_tokens",
        F.round(F.col("used_tokens") / F.nullif(F.col("all_used"), F.lit(0)), 6).alias("actual_share"),
        F.round(F.col("used_tokens") / F.nullif(F.col("all_wanted"), F.lit(0)), 6).alias("share_of_budget"),
        state.alias("state"),
    )
