"""Hybrid retrieval: vector and line search fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seamline.functions.regex import route
from seamline.functions.text import within
from seamline.operators.lines import grep, hits_to_chunks
from seamline.operators.vectors import top_k

#: Constant of the fusion, least similarity of a semantic hit, and the most candidates either side may give.
RRF_K, LEAST_SIMILARITY, MOST_CANDIDATES = 60, 0.10, 100


def reciprocal_ranks(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, rrf) of lists (id, rank), rank from 1: the sum of 1 / (k + rank) over the lists an id is in."""
    union = lists[0].select("id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("id", "rank"))
    return union.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"))


def scope_root(codebases: DataFrame, cwd: str) -> str:
    """The longest registered codebase that is, or lies above, a folder; the folder itself if there is none."""
    best = codebases.filter(F.lit(cwd) == F.col("cwd")).unionByName(codebases.filter(F.startswith(F.lit(cwd), F.concat("cwd", F.lit("/"))))).orderBy(F.length("cwd").desc()).limit(1).collect()
    return best[0].cwd if best else cwd


def scope_roots(codebases: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, codebase): the longest registered codebase (cwd) that is, or lies above, each path; paths below none are left out.

    Every folder above a path is looked up, so it is an equi-join.
    """
    parts = F.split("path", "/")
    known = codebases.select(F.col("cwd").alias("above")).distinct()
    above = paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above"))
    return above.join(known, "above").groupBy("path").agg(F.max(F.struct(F.length("above"), "above"))["above"].alias("codebase"))


def semantic(memories: DataFrame, query, limit: int, exclude_low: bool = True) -> DataFrame:
    """(id, similarity, rank) of the most similar memories. Similarities below LEAST_SIMILARITY are dropped, after the cut, unless the query is all zero.

    Vectors that hold NaN are similar to nothing.
    """
    usable = memories.filter(~F.exists("embedding", F.isnan))
    best = top_k(usable, query, min(MOST_CANDIDATES, 3 * limit))
    if exclude_low and any(query):
        best = best.filter(F.col("similarity") >= LEAST_SIMILARITY)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")))  # at most MOST_CANDIDATES rows


def lexical(files: DataFrame, memories: DataFrame, query: str, limit: int, path: str = "path", text: str = "text", first_line: str | None = None) -> DataFrame | None:
    """(id, rank) of the chunks around matching lines, by path and line; None for a blank query.

    Texts that are parts of files have the line on which they begin in column `first_line`; null there counts as 1.
    """
    option = route(query)
    if option is None:
        return None
    before = F.coalesce(F.col(first_line), F.lit(1)) - 1 if first_line else F.lit(0)
    hits = grep(files, [path, *([first_line] if first_line else [])], option, text, path=path).select(F.col(path).alias("path"), (F.col("line_no") + before).alias("line_no"))
    chunks = hits_to_chunks(hits, memories.select("id", "path", "line_start", "line_end"))
    first = chunks.orderBy("path", "line_start", "line_end", "id").limit(min(MOST_CANDIDATES, 3 * limit))
    return first.withColumn("rank", F.row_number().over(Window.orderBy("path", "line_start", "line_end", "id")))  # at most MOST_CANDIDATES rows


def search(memories: DataFrame, files: DataFrame, query: str, vector, limit: int = 10, cwd: str | None = None, first_line: str | None = None) -> DataFrame:
    """(id, rrf, symbol_name, path, line_start, line_end) of the best memories for a text and its vector, in order of rrf, then id.

    `memories` has id, symbol_name, path, line_start, line_end, embedding; `files` has path, text and, if the texts are parts of files,
    `first_line`. The scope is applied before any cut.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if cwd:
        inside = within(F.col("path"), F.lit(cwd))
        memories, files = memories.filter(inside), files.filter(inside)
    lists = [semantic(memories, vector, limit)]
    words = lexical(files, memories, query, limit, first_line=first_line)
    fused = reciprocal_ranks(*lists, *([words] if words is not None else []))
    best = fused.orderBy(F.round("rrf", 12).desc(), "id").limit(limit)
    return best.join(memories.select("id", "symbol_name", "path", "line_start", "line_end").dropDuplicates(["id"]), "id").orderBy(F.round("rrf", 12).desc(), "id")
