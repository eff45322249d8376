"""Parent-child links resolved to whole hierarchies by pointer doubling.

Each node keeps a pointer to an ancestor and the distance to it. One round joins the pointers
to themselves, which doubles the distance, so a tree of depth d needs about log2(d) rounds,
whatever its number of nodes. A round that brings no further node to its root proves that all
nodes left are on a loop or below one: a deeper node would have an ancestor at every smaller depth.

Subtree sizes ride along: if size_k(v) counts the nodes less than 2^k below v (v included), then
size_{k+1}(v) = size_k(v) + sum of size_k(u) over the open nodes u, whose pointers are their 2^k-th ancestors v. The sums are
grouped ones, so a parent that holds a third of all rows is pre-aggregated before the shuffle.

A node that has reached its root is carried on only while open nodes point to it: once none does, none ever will, as pointers
move to where pointers of open nodes are. So the rows of a round shrink with the nodes of that depth, and each node is written a last time with its final size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.session import Stage

SEPARATOR = " > "


def parent_links(
    df: DataFrame,
    node_id: str = "node_id",
    scope: str = "cwd",
    name: str = "callee",
    parent: str = "caller",
    children: str | None = "children",
) -> DataFrame:
    """One row per node id: (id, name, parent_id), parent_id null for roots.

    A link may be told by the child (`parent` column), by the parent (`children` array) or by both. Names are
    resolved within `scope`; a name carried by several ids stands for the smallest of them. Rows without an id are
    no nodes and are left out; null or empty names link to nothing; a parent without a row makes a root; should
    links contradict, the smallest parent id holds. Repeated rows count once. Other columns are ignored.
    """
    rows = df.select(
        F.col(node_id).alias("id"),
        F.col(scope).alias("scope"),
        F.col(name).alias("name"),
        F.col(parent).alias("parent_name"),
        (F.col(children) if children else F.lit(None).cast("array<string>")).alias("kids"),
    ).filter(F.col("id").isNotNull())
    keys = (
        rows.filter((F.col("name") != "") & F.col("scope").isNotNull())
        .groupBy("scope", "name")
        .agg(F.min("id").alias("key_id"))
    )
    told_by_child = (
        rows.filter((F.col("parent_name") != "") & F.col("scope").isNotNull())
        .select("id", "scope", "parent_name")
        .distinct()
        .join(keys.withColumnRenamed("name", "parent_name"), ["scope", "parent_name"])
        .select("id", F.col("key_id").alias("parent_id"))
    )
    told_by_parent = (
        rows.filter(F.size("kids") > 0)
        .select(F.col("id").alias("parent_id"), "scope", F.explode(F.array_distinct("kids")).alias("name"))
        .filter(F.col("name") != "")
        .join(keys, ["scope", "name"])
        .select(F.col("key_id").alias("id"), "parent_id")
    )
    return (
        rows.select("id", "name", F.lit(None).cast(df.schema[node_id].dataType).alias("parent_id"))
        .unionByName(told_by_child.select("id", F.lit(None).cast("string").alias("name"), "parent_id"))
        .unionByName(told_by_parent.select("id", F.lit(None).cast("string").alias("name"), "parent_id"))
        .groupBy("id")
        .agg(F.min("name").alias("name"), F.min("parent_id").alias("parent_id"))
    )


def resolve_hierarchy(links: DataFrame, with_paths: bool = False, max_rounds: int = 64) -> DataFrame:
    """(id, name, root_id, depth_no, n_below[, path, path_ids]) of each row of `parent_links`.

    Nodes on a loop or below one have -1 in root_id, depth_no and n_below and null paths. The empty table gives the
    empty table. A path runs from the root to the node, joined with " > ".
    """
    stage = Stage(links.sparkSession, "hierarchy")
    is_root = F.col("parent_id").isNull()
    segs = ["seg", "seg_ids"] if with_paths else []
    state = stage.write(
        links.select(
            "id",
            "name",
            F.coalesce("parent_id", "id").alias("anc"),
            F.when(is_root, 0).otherwise(1).cast("long").alias("dist"),
            is_root.alias("done"),
            F.lit(1).cast("long").alias("size"),
            *([F.array(F.coalesce("name", F.lit(""))).alias("seg"), F.array("id").alias("seg_ids")] if with_paths else []),
            F.lit(False).alias("final"),
        )
    )
    columns = state.columns
    parts: list[DataFrame] = []
    n_open = state.filter("NOT done").count()
    for _ in range(max_rounds):
        if not n_open:
            break
        # Each row with what open nodes that point to it add to its size; null where none does.
        more = state.filter("NOT done").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))
        marked = state.join(more, "id", "left").withColumn("final", F.col("more").isNull() & F.col("done")).withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
        ahead = marked.filter("more IS NOT NULL").select(F.col("id").alias("to"), *[F.col(c).alias(c + "2") for c in ("anc", "dist", "done", *segs)])
        moved = marked.join(ahead, F.when(F.col("done"), F.col("id")).otherwise(F.col("anc")) == F.col("to"), "left")
        is_open = ~F.col("done")
        state = stage.write(
            moved.select(
                "id",
                "name",
                F.when(is_open, F.col("anc2")).otherwise(F.col("anc")).alias("anc"),
                (F.col("dist") + F.when(is_open, F.col("dist2")).otherwise(0)).alias("dist"),
                F.when(is_open, F.col("done2")).otherwise(True).alias("done"),
                "size",
                *[F.when(is_open, F.concat(c + "2", c)).otherwise(F.col(c)).alias(c) for c in segs],
                "final",
            ).select(*columns)
        )
        parts.append(state.filter("final"))
        state = state.filter("NOT final")
        left = state.filter("NOT done").count()
        if left == n_open:
            break
        n_open = left
    rows = state
    for part in parts:
        rows = rows.unionByName(part)
    done = F.col("done")
    return rows.select(
        "id",
        "name",
        F.when(done, F.col("anc")).otherwise(F.lit(-1)).alias("root_id"),
        F.when(done, F.col("dist")).otherwise(-1).cast("int").alias("depth_no"),
        F.when(done, F.col("size") - 1).otherwise(-1).cast("int").alias("n_below"),
        *([F.when(done, F.array_join("seg", SEPARATOR)).alias("path"), F.when(done, F.col("seg_ids")).alias("path_ids")] if with_paths else []),
    )


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(ancestor_id, id, levels) of every node and each of its ancestors, from `resolve_hierarchy(with_paths=True)`."""
    return (
        hierarchy.filter(F.col("path_ids").isNotNull())
        .select("id", "depth_no", F.posexplode("path_ids").alias("pos", "ancestor_id"))
        .filter(F.col("ancestor_id") != F.col("id"))
        .select("ancestor_id", "id", (F.col("depth_no") - F.col("pos")).alias("levels"))
    )
