"""Content hashes of files and folders, and the difference of two snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seamline.functions.text import base_name, parent
from seamline.session import Stage

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of ""


def chunk_hash(text: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Hash of a chunk's text; with its lines given, of these too, so that a chunk that only moved counts as changed."""
    body = F.coalesce(text, F.lit(""))
    if start is not None and end is not None:
        body = F.concat_ws("\u001f", start.cast("string"), end.cast("string"), body)
    return F.sha2(body, 256)


def _joined_hashes(df: DataFrame, group: str, order: list[str], piece: str, out: str) -> DataFrame:
    """(group, out): the hash of each group's pieces joined in order. Sorted rows stream through one running hash, so a folder
    or file of any size takes no more memory than a batch; a group is one task's work, as its hash is a chain."""
    names = [group, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, ([], [])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or key != now:
                    if state is not None:
                        done[0].append(now)
                        done[1].append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                state.update(text.encode())
            if len(done[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], names=names)
                done = ([], [])
        if state is not None:
            done[0].append(now)
            done[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], names=names)

    return df.repartition(F.col(group)).sortWithinPartitions(group, *order).select(group, piece).mapInArrow(run, f"{group} string, {out} string")


def file_hashes(chunks: DataFrame, path: str, order: list[str], hash_col: str) -> DataFrame:
    """(path, file_hash): the hash of a file's chunk hashes in order."""
    return _joined_hashes(chunks.filter(F.col(path).isNotNull()).select(path, *order, hash_col), path, order, hash_col, "file_hash")


def _tops(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """`nodes` (node_path, ...) at or below a root, with `top`: the level of the highest one. Every folder above a file's folder is looked up, so it is an equi-join."""
    parts = F.split("folder", "/")
    folders = nodes.select(parent(F.col("node_path")).alias("folder")).filter(F.col("folder").isNotNull()).distinct()
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("root")))).alias("a"))
    tops = above.select("folder", "a.level", "a.root").join(roots.select("root").distinct(), "root").groupBy("folder").agg(F.min("level").alias("top"))
    return nodes.join(tops, parent(F.col("node_path")) == F.col("folder")).drop("folder")


def folder_hashes(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node_path, node_hash) of every folder above the files (node_path, node_hash): the hash of its children's names and hashes by name.

    Folders are hashed from the deepest level up, one grouped pass per level; levels are written, so that none is computed twice. With
    `roots` (root) given, only folders at or below a root are made.
    """
    stage = Stage(files.sparkSession, "folders")
    nodes = files.select("node_path", "node_hash", F.size(F.split("node_path", "/")).alias("level")).distinct()
    nodes = stage.write(nodes.withColumn("top", F.lit(1)) if roots is None else _tops(nodes, roots))
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return files.select("node_path", "node_hash").limit(0)
    below = nodes.filter(F.col("level") == deepest).select("node_path", "node_hash", "top")
    made = None
    for level in range(deepest - 1, 1, -1):
        named = below.filter(F.col("top") <= level).select(parent(F.col("node_path")).alias("node_path"), base_name(F.col("node_path")).alias("name"), "node_hash", "top").filter(F.col("node_path").isNotNull())
        named = named.withColumn("key", F.concat_ws("\u0000", F.col("top").cast("string"), "node_path"))  # all children of a folder have one top
        hashed = _joined_hashes(named.withColumn("piece", F.concat("name", "node_hash")), "key", ["name"], "piece", "node_hash")
        cut = F.split("key", "\u0000", 2)
        folders = stage.write(hashed.select(cut[1].alias("node_path"), "node_hash", cut[0].cast("int").alias("top")))
        made = folders if made is None else made.unionByName(folders)
        below = folders.unionByName(nodes.filter(F.col("level") == level).select("node_path", "node_hash", "top"))
    return (made if made is not None else nodes.limit(0)).select("node_path", "node_hash")


def diff(prev: DataFrame, now: DataFrame, key: list[str], hash_col: str) -> DataFrame:
    """(key..., change_kind): added, modified or deleted keys between two snapshots, by one full outer join."""
    a = prev.select(*key, F.col(hash_col).alias("_before"), F.lit(True).alias("_in_before"))
    b = now.select(*key, F.col(hash_col).alias("_after"), F.lit(True).alias("_in_after"))
    kind = F.when(F.col("_in_before").isNull(), "added").when(F.col("_in_after").isNull(), "deleted").when(~F.col("_before").eqNullSafe(F.col("_after")), "modified")
    return a.join(b, key, "full").withColumn("change_kind", kind).filter("change_kind IS NOT NULL").select(*key, "change_kind")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_kind").agg(F.count(F.lit(1)).alias("n_files"))


def by_update(trees: DataFrame, codebase: str = "cwd", at: str = "updated_at") -> DataFrame:
    """(codebase, updated_at): each codebase with its latest update, the latest first, those without a time last."""
    return trees.groupBy(codebase).agg(F.max(at).alias(at)).orderBy(F.col(at).desc_nulls_last(), codebase)
