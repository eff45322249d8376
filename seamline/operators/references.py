"""References to records that do not exist, are deleted, or arrive only later.

Parent and child keys are brought into one long table of tagged rows and grouped by key. Grouping
pre-aggregates on the map side, so a key that holds a third of all references costs no more than
one row per map task. Groups that settle all their references drop out before the references are
read again for their row-level answer.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

STATES = ("missing", "deleted", "late")


def trimmed(col: Column) -> Column:
    """The text without white space at either end (blanks, tabs, line ends, no-break space)."""
    return F.regexp_replace(col, r"^[\s ]+|[\s ]+$", "")


def suffixes_of_lengths(name: Column, lengths: Column, dotted: bool = True) -> Column:
    """The suffixes of a name that have one of the given lengths; with `dotted` only the whole name and what follows a dot."""
    size = F.length(name)
    fits = F.filter(lengths, lambda n: (n > 0) & (n <= size))
    if dotted:
        fits = F.filter(fits, lambda n: (n == size) | (F.substring(name, -(n + 1), F.lit(1)) == "."))
    return F.transform(fits, lambda n: F.substring(name, -n, n))


def lengths_of(col: str, df: DataFrame) -> DataFrame:
    """One row: `_lengths`, the distinct lengths of a column."""
    return F.broadcast(df.select(F.length(col).alias("n")).distinct().agg(F.collect_set("n").alias("_lengths")))


def parent_keys(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(scope, key, alive_from, alive) of each name, suffixes included, under which a node can be referred to.

    alive_from is null where a node that is not deleted has no time of its own: it was there always.
    """
    named = nodes.filter(F.col("cwd").isNotNull() & F.col("symbol_name").isNotNull())
    always = F.lit("0001-01-01 00:00:00").cast(nodes.schema["indexed_at"].dataType)
    parents = (
        named.select("cwd", "symbol_name", "indexed_at", F.col("deleted_at").isNull().alias("alive"))
        .groupBy("cwd", "symbol_name")
        .agg(F.max("alive").alias("alive"), F.min(F.when(F.col("alive"), F.coalesce("indexed_at", always))).alias("alive_from"))
    )
    cut = parents.crossJoin(lengths_of("key", refs))  # one row
    keys = cut.withColumn("key", F.explode(suffixes_of_lengths(F.col("symbol_name"), F.col("_lengths"))))
    return keys.select(F.col("cwd").alias("scope"), "key", "alive", "alive_from").filter(F.col("key") != "")


def orphan_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, key, known, alive, alive_from): the referred keys of which at least one reference may not resolve.

    `edges` has scope, key and at. Kept are the keys without a parent, with deleted parents only, and those whose
    first living parent came after the earliest reference with a time.
    """
    tagged = parent_keys(nodes, edges).select(
        "scope", "key", F.lit(True).alias("is_parent"), "alive", "alive_from", F.lit(None).cast(edges.schema["at"].dataType).alias("at")
    )
    tagged = tagged.unionByName(
        edges.select(
            "scope",
            "key",
            F.lit(False).alias("is_parent"),
            F.lit(False).alias("alive"),
            F.lit(None).cast(nodes.schema["indexed_at"].dataType).alias("alive_from"),
            "at",
        )
    )
    return (
        tagged.groupBy("scope", "key")
        .agg(
            F.max("is_parent").alias("known"),
            F.min("is_parent").alias("only_parent"),
            F.max("alive").alias("alive"),
            F.min("alive_from").alias("alive_from"),
            F.min("at").alias("first_at"),
        )
        .filter(~F.col("only_parent") & (~F.col("alive") | (F.col("alive_from") > F.col("first_at"))))
        .select("scope", "key", "known", "alive", "alive_from")
    )


def unresolved_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, ref_state, at, loaded_at) of each reference row whose callee does not resolve.

    A callee, without white space around it, matches the nodes of its `cwd` whose symbol_name equals it or ends in "."
    followed by it. `missing`: no such node; `deleted`: such nodes, all with deleted_at; `late`: of those not
    deleted, all have an indexed_at after the edge's (never for an edge without time; a node without time is never late).
    Null, empty and blank callees are no references. An edge without `cwd` finds no node: `missing`. Repeated edge rows
    count once. Empty tables are allowed; other columns are ignored.
    """
    refs = edges.select(
        "edge_id",
        F.coalesce("cwd", F.lit("\u0000")).alias("scope"),
        trimmed(F.col("callee")).alias("key"),
        F.col("indexed_at").alias("at"),
        "loaded_at",
    ).filter(F.col("key") != "")
    groups = orphan_groups(nodes, refs)
    state = (
        F.when(~F.col("known"), "missing")
        .when(~F.col("alive"), "deleted")
        .when(F.col("alive_from") > F.col("at"), "late")
    )
    return (
        refs.join(groups, ["scope", "key"])
        .withColumn("ref_state", state)
        .filter(F.col("ref_state").isNotNull())
        .groupBy("edge_id", "ref_state")
        .agg(F.min("at").alias("at"), F.min("loaded_at").alias("loaded_at"))
    )


def orphan_report(unresolved: DataFrame, child: str = "call_edges", parent: str = "call_nodes") -> DataFrame:
    """Counts of unresolved references per child table, parent table, state and month of the reference.

    The month is that of the reference's own time, else of its loading; null where it has neither.
    """
    return (
        unresolved.withColumn("month", F.date_format(F.coalesce("at", "loaded_at"), "yyyy-MM"))
        .groupBy("month", "ref_state")
        .agg(F.count(F.lit(1)).alias("n_refs"))
        .select(F.lit(child).alias("child_table"), F.lit(parent).alias("parent_table"), "month", "ref_state", "n_refs")
    )


class Relation(NamedTuple):
    """Rows of table `child` that refer by column `key` to table `parent`, at the time in column `at`."""

    child: str
    rows: DataFrame
    key: str
    parent: str
    at: str | None = None


def dangling_references(parents: dict[str, tuple[DataFrame, str]], relations: list[Relation]) -> DataFrame:
    """(child_table, parent_table, month, n_refs, n_keys) of references to keys that the parent table (rows, key column) doesn't hold, for any set of tables.

    Parent and child keys form one long table of tagged rows. It is grouped by parent table, key, child table and month, so a key that a third of all rows
    refer to is one row per map task; groups of a parent table and key without a parent's flag are kept and their counts summed up by period. Keys are compared
    as text; null and empty ones are no references; a reference without a time has a null month. Every row counts: repeated rows are to be left out before.
    """
    none = F.lit(None).cast("string")
    parts = [
        rows.select(F.lit(name).alias("parent_table"), F.col(key).cast("string").alias("key"), none.alias("child_table"), none.alias("month"), F.lit(0).cast("bigint").alias("n")) for name, (rows, key) in parents.items()
    ]
    parts += [
        r.rows.select(F.lit(r.parent).alias("parent_table"), F.col(r.key).cast("string").alias("key"), F.lit(r.child).alias("child_table"), (F.date_format(r.at, "yyyy-MM") if r.at else none).alias("month"), F.lit(1).cast("bigint").alias("n"))
        for r in relations
    ]
    tagged = parts[0]
    for part in parts[1:]:
        tagged = tagged.unionByName(part)
    counted = tagged.filter(F.col("key") != "").groupBy("parent_table", "key", "child_table", "month").agg(F.sum("n").alias("n"))
    lone = counted.groupBy("parent_table", "key").agg(F.max(F.col("child_table").isNull()).alias("known")).filter(~F.col("known")).select("parent_table", "key")
    return counted.join(lone, ["parent_table", "key"], "left_semi").groupBy("child_table", "parent_table", "month").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
