"""Source trees: listing with ignore rules, reading in parallel, sinks."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.functions.regex import INDEXED
from seamline.session import Stage

#: Folders that are never entered.
SKIPPED = (".git", "node_modules", "dist", "bin", "vendor", ".gemini")


def read_ignores(folder: str) -> list[str]:
    """Patterns of the folder's own .gitignore, slashes at either end off; .git always."""
    out = [".git"]
    try:
        with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            out += [p for p in (line.strip().strip("/") for line in f) if p and p[0] != "#"]
    except OSError:
        pass
    return out


def ignored(relative: str, patterns: list[str]) -> bool:
    """Whether a path, relative to the folder the patterns belong to, falls under one: as a part of it or as a shell pattern of its name or all of it."""
    name, framed = relative.rpartition("/")[2], f"/{relative}/"
    return any(f"/{p}/" in framed or fnmatch.fnmatchcase(name, p) or fnmatch.fnmatchcase(relative, p) for p in patterns)


def _wanted(extensions: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(("." + e.lstrip(".")).lower() for e in extensions)


def expand(folder: str, wanted: tuple[str, ...], gitignore: bool, skipped: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """The files and folders directly in a folder that no rule leaves out; nothing of a folder that can't be read."""
    patterns = read_ignores(folder) if gitignore else [".git"]
    files, folders = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return files, folders
    for e in entries:
        if ignored(e.name, patterns):
            continue
        if e.is_dir():
            if e.name not in skipped:
                folders.append(e.path)
        elif e.is_file() and (not wanted or e.name.lower().endswith(wanted)):
            files.append(e.path)
    return files, folders


def walk(root: str, extensions: tuple[str, ...] = INDEXED, gitignore: bool = True, skipped: tuple[str, ...] = SKIPPED) -> Iterator[str]:
    """Paths of the files below a root (or the root, if a file), links followed once; folders that can't be read are skipped."""
    root, wanted = os.path.realpath(root), _wanted(extensions)
    if os.path.isfile(root):
        if not wanted or root.lower().endswith(wanted):
            yield root
        return
    todo, seen = [root], set()
    while todo:
        folder = todo.pop()
        if (real := os.path.realpath(folder)) not in seen:
            seen.add(real)
            files, folders = expand(folder, wanted, gitignore, skipped)
            yield from files
            todo += folders


def list_tree(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = INDEXED, gitignore: bool = True, spread: int = 256) -> DataFrame:
    """(root, path) of the files below folders that all executors can read, each file once whatever links lead to it.

    The driver looks into the topmost folders only until it knows `spread` of them; the executors walk what lies below these.
    """
    begun: list[tuple[str, str]] = []
    todo = [(os.path.realpath(r), os.path.realpath(r)) for r in roots]
    wanted, seen = _wanted(extensions), set()
    while todo and len(todo) < spread:
        root, path = todo.pop(0)
        if os.path.isfile(path):
            begun += [(root, p) for p in walk(path, extensions, gitignore)]
        elif (root, os.path.realpath(path)) not in seen:
            seen.add((root, os.path.realpath(path)))
            files, folders = expand(path, wanted, gitignore, SKIPPED)
            begun += [(root, p) for p in files]
            todo += [(root, p) for p in folders]

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root, path in zip(pdf["root"], pdf["path"]):
                found: list[str] = []
                for p in walk(path, extensions, gitignore):
                    # walk() gives true paths: put back the way that led here
                    found.append(path + p[len(os.path.realpath(path)) :])
                    if len(found) == 10_000:
                        yield pd.DataFrame({"root": root, "path": found, "real": [os.path.realpath(f) for f in found]})
                        found = []
                if found:
                    yield pd.DataFrame({"root": root, "path": found, "real": [os.path.realpath(f) for f in found]})

    schema = "root string, path string, real string"
    listed = spark.createDataFrame([(r, p, os.path.realpath(p)) for r, p in begun], schema)
    if todo:
        folders = spark.createDataFrame(todo, "root string, path string").repartition(len(todo))
        listed = listed.unionByName(folders.mapInPandas(below, schema))
    first = F.min(F.struct(F.col("path") != F.col("real"), F.length("path"), "path"))["path"]
    return listed.groupBy("root", "real").agg(first.alias("path")).select("root", "path")


def scan_tree(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = INDEXED, gitignore: bool = True, per_task: int = 256) -> DataFrame:
    """(root, path, text) of the text files below folders that all executors can read.

    Paths are listed where `list_tree` says, filtered by ending and ignore rules before anything is read, and read `per_task` to a task.
    Empty files and files with a NUL among their first 8000 bytes are left out; bytes that are no UTF-8 become U+FFFD.
    """
    paths = Stage(spark, "listing").write(list_tree(spark, roots, extensions, gitignore))
    paths = paths.repartition(max(1, paths.count() // per_task))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root, path in zip(pdf["root"], pdf["path"]):
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                if data and b"\0" not in data[:8000]:
                    yield pd.DataFrame({"root": [root], "path": [path], "text": [data.decode("utf-8", "replace")]})

    return paths.mapInPandas(read, "root string, path string, text string")


def text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text) of the files Spark lists under a path or pattern of any file system it knows; whole files, NULs excluded."""
    data = spark.read.format("binaryFile").load(pattern)
    text = F.decode("content", "UTF-8")
    return data.filter((F.col("length") > 0) & (F.instr(F.decode(F.substring("content", 1, 8000), "ISO-8859-1"), "\u0000") == 0)).select(F.regexp_replace("path", "^file:", "").alias("path"), text.alias("text"))


def write_lines(df: DataFrame, path: str) -> None:
    """Write a (value) table as lines of text."""
    df.select("value").write.mode("overwrite").text(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
