"""Column expressions over text, paths and hashes; all stay inside code generation."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(col: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(col, UPPER, LOWER)


def contains_fold(col: Column, needle: Column) -> Column:
    """Whether `needle` occurs without regard to ASCII case; an empty needle always does."""
    return F.contains(fold_ascii(col), fold_ascii(needle))


def extension(path: Column) -> Column:
    """Lower-case ending with its dot, "" without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def has_extension(path: Column, extensions: tuple[str, ...] | list[str]) -> Column:
    """Whether a path ends in one of them (leading dot optional, case ignored); no extensions means all paths."""
    if not extensions:
        return F.lit(True)
    return extension(path).isin([("." + e.lstrip(".")).lower() for e in extensions])


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def parent(path: Column) -> Column:
    """The folder of a path; null at the root."""
    return F.nullif(F.regexp_replace(path, r"/[^/]*/*$", ""), F.lit(""))


def relative_to(path: Column, root: Column) -> Column:
    """The path below a folder, or the path itself if it isn't below it."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.lit(1 << 30))).otherwise(path)


def within(path: Column, root: Column) -> Column:
    """Whether a path is a folder or below it; /a/b2 is not within /a/b."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines `start` to `end` of a text, from 1 and both included, without the newline that ends the last.

    A start past the last line gives ""; an end past it gives the rest with a final newline, if there is one. Null stays null.
    """
    parts = F.split(text, "\n", -1)
    first = F.greatest(start, F.lit(1))
    count = F.greatest(F.least(end, F.size(parts)) - first + 1, F.lit(0))
    return F.when(text.isNull(), None).otherwise(F.array_join(F.slice(parts, first, count), "\n"))


def chunk_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    """A chunk's id, the same whenever the same chunk is indexed again."""
    return F.sha2(F.concat_ws("\u001f", path, start.cast("string"), end.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256)), 256)


def embedding_text(path: Column, start: Column, end: Column, text: Column) -> Column:
    """What is embedded of a chunk: its place, then its text."""
    return F.format_string("File: %s (Lines: %d-%d)\nContent:\n%s", path, start, end, text)


def line_numbers(text: str) -> Callable[[int], int]:
    """A function that gives the line, from 1, of an offset of the text."""
    starts = [0]
    while (at := text.find("\n", starts[-1])) >= 0:
        starts.append(at + 1)
    return lambda offset: bisect_right(starts, offset)
