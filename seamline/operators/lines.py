"""Line search over texts: literal, regular expression, context, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamline.functions.regex import SearchOption, required_literal, to_java
from seamline.functions.text import has_extension


def lines(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., line_no, line): the lines of each text from 1, without their line ends (LF or CRLF).

    A newline that ends the text begins no further line; null and empty texts have no lines.
    """
    parts = F.split(text, "\n", -1)
    body = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return (
        df.filter(F.length(text) > 0)
        .select(*key, F.posexplode(body).alias("_pos", "_line"))
        .select(*key, (F.col("_pos") + 1).cast("bigint").alias("line_no"), F.regexp_replace("_line", "\r$", "").alias("line"))
    )


def is_text(content: Column) -> Column:
    """Whether bytes are text: no NUL among the first 8000."""
    return F.instr(F.decode(F.substring(content, 1, 8000), "ISO-8859-1"), "\u0000") == 0


def matches(option: SearchOption, line: Column) -> Column:
    """Whether a line matches."""
    return line.rlike(to_java(option.text)) if option.regex else F.contains(line, F.lit(option.text))


def grep(df: DataFrame, key: list[str], option: SearchOption, text: str = "text", path: str | None = None, invert: bool = False) -> DataFrame:
    """(key..., line_no, line) of the lines that match, one row per line; with `invert` of those that don't.

    A literal must not be empty. Texts that don't hold the literal, or the one a regular expression must begin with, are not split into lines.
    """
    if not option.regex and not option.text:
        raise ValueError("an empty literal matches nothing in particular")
    if path and option.extensions:
        df = df.filter(has_extension(F.col(path), option.extensions))
    sure = required_literal(option.text) if option.regex else option.text
    if sure and not invert:
        df = df.filter(F.contains(F.col(text), F.lit(sure)))
    hit = matches(option, F.col("line"))
    return lines(df, key, text).filter(~hit if invert else hit)


def count_matches(hits: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n_lines): matching lines per text."""
    return hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n_lines"))


def files_with_match(hits: DataFrame, key: list[str]) -> DataFrame:
    return hits.select(*key).distinct()


def with_context(df: DataFrame, key: list[str], option: SearchOption, before: int = 0, after: int = 0, text: str = "text") -> DataFrame:
    """(key..., line_no, line, is_match): matching lines and so many lines before and after each, every line once.

    Matches mark the lines around them in a window over the text's own lines; no text is joined with itself.
    """
    from pyspark.sql import Window

    near = Window.partitionBy(*key).orderBy("line_no").rangeBetween(-after, before)
    holders = df if option.regex else df.filter(F.contains(F.col(text), F.lit(option.text)))
    marked = lines(holders, key, text).withColumn("is_match", matches(option, F.col("line")))
    return marked.withColumn("_near", F.max("is_match").over(near)).filter("_near").drop("_near")


def grep_output(hits: DataFrame, path: str, names: bool = True, numbers: bool = True) -> DataFrame:
    """(value): path:line:text of every hit; without `names` or `numbers` that part is left out."""
    parts = [F.col(path)] * names + [F.col("line_no").cast("string")] * numbers + [F.col("line")]
    return hits.select(F.concat_ws(":", *parts).alias("value"))


def first_hits(hits: DataFrame, path: str, limit: int) -> DataFrame:
    """The first `limit` hits by path and line: each task keeps no more than that."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return hits.orderBy(path, "line_no").limit(limit)


def hits_to_chunks(hits: DataFrame, chunks: DataFrame, path: str = "path", start: str = "line_start", end: str = "line_end", block: int = 256) -> DataFrame:
    """The chunks (all columns of `chunks`) that enclose a hit, each once per distinct row; hits outside all chunks vanish.

    Hits (path, line_no) and chunks meet on path and block of lines, then by range: a file of any length, with any number of
    chunks, is spread over its blocks. Chunks without lines enclose nothing.
    """
    found = hits.select(F.col(path).alias("_path"), F.col("line_no").alias("_line")).distinct().withColumn("_block", F.floor(F.col("_line") / block))
    spread = chunks.filter(F.col(start) <= F.col(end)).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor(F.col(end) / block)))
    )
    inside = (F.col(path) == F.col("_path")) & F.col("_line").between(F.col(start), F.col(end))
    joined = spread.join(found.withColumnRenamed("_block", "_b"), inside & (F.col("_block") == F.col("_b")), "left_semi")
    return joined.drop("_block").distinct()
