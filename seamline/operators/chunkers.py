"""Files to chunks along their structure: Go, Python, Terraform, YAML; other files whole.

Every chunker turns a text into (start_line, end_line, symbol, content) pieces; one pass over Arrow batches applies them.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.functions import hcl
from seamline.functions.golang import GoError, GoFile
from seamline.functions.text import line_numbers

#: Chunks of more bytes than this are split at line ends.
MAX_BYTES = 20_000
#: Words a Terraform block can begin with.
TERRAFORM_BLOCKS = ("resource", "data", "variable", "output", "provider", "module", "locals", "terraform")


class Piece(NamedTuple):
    start: int
    end: int
    symbol: str
    content: str


def whole(text: str) -> list[Piece]:
    return [Piece(1, text.count("\n") + 1, "", text)]


def chunk_go(text: str) -> list[Piece]:
    """One piece per function (from its doc comment), per type (from its name or, in a group, its doc) and per const or var declaration."""
    try:
        source = GoFile(text)
    except (GoError, IndexError):
        return whole(text)
    out = []
    for d in source.declarations:
        first = d.doc if d.kind == "func" else d.start
        out.append(Piece(source.line(first), source.line(max(d.start, d.end - 1)), d.name, text[d.doc if d.kind != "value" else d.start : d.end]))
    return out or whole(text)


def _python_statements(text: str) -> list[tuple[int, int, str | None]]:
    """(first row, last row, name or None) of the top-level statements and comments. A text with syntax errors is read by its indentation."""
    rows: list[tuple[int, int, str | None]] = []
    try:
        for node in ast.parse(text).body:
            named = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
            rows.append((first, node.end_lineno or node.lineno, node.name if named else None))
        inside = [r[:2] for r in rows]
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT and t.start[1] == 0 and not any(a <= t.start[0] <= b for a, b in inside):
                rows.append((t.start[0], t.start[0], None))
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        rows = []
        for n, line in enumerate(text.split("\n"), 1):
            if not line.strip():
                continue
            head = re.match(r"(?:async\s+)?(?:def|class)\s+([^\W\d]\w*)", line)
            decorated = bool(rows) and rows[-1][2] == "@"
            if line[0] in " \t)]}" and rows:
                rows[-1] = (rows[-1][0], n, rows[-1][2])
            elif decorated and (head or line[0] == "@"):
                rows[-1] = (rows[-1][0], n, head.group(1) if head else "@")
            else:
                rows.append((n, n, head.group(1) if head else "@" if line[0] == "@" else None))
        rows = [(a, b, None if name == "@" else name) for a, b, name in rows]
    return sorted(rows, key=lambda r: r[:2])


def chunk_python(text: str) -> list[Piece]:
    """One named piece per top-level class or function, decorators included; what lies between them in unnamed pieces, where
    lines equal to the one before are left out. No piece for an empty file."""
    lines = text.split("\n")
    out: list[Piece] = []
    group: list[str] = []
    since = 1
    for first, last, name in _python_statements(text):
        if name is None:
            for line in lines[first - 1 : last]:
                if not group or group[-1] != line:
                    group.append(line)
            continue
        if group:
            out.append(Piece(since, first - 1, "", "\n".join(group)))
            group = []
        out.append(Piece(first, last, name, "\n".join(lines[first - 1 : last]).rstrip("\r")))
        since = last + 1
    if group:
        out.append(Piece(since, len(lines), "", "\n".join(group)))
    return out


def chunk_terraform(text: str) -> list[Piece]:
    """One piece per closed top-level block whose type begins with a block word, in whole lines. What lies outside is dropped."""
    line, rows = line_numbers(text), text.split("\n")
    spans = [(line(b.start), line(b.end - 1)) for b in hcl.blocks(text) if b.closed and b.kind.startswith(TERRAFORM_BLOCKS)]
    return [Piece(first, last, "", "\n".join(rows[first - 1 : last])) for first, last in spans] or whole(text)


def chunk_yaml(text: str, compat: bool = False) -> list[Piece]:
    """One piece per document. `compat` counts two lines for every separator, as older indexes did; else line numbers are true."""
    end = "\r\n" if "\r\n---\r\n" in text else "\n"
    out, line = [], 1
    for doc in text.split(f"{end}---{end}"):
        height = doc.count("\n") + 1
        if doc.strip():
            out.append(Piece(line, line + height - 1, "", doc.strip()))
        line += height + (2 if compat else 1)
    return out or whole(text)


def refine(pieces: list[Piece], most: int = MAX_BYTES) -> list[Piece]:
    """Pieces over `most` bytes cut into runs of whole lines that fit; a longer line stands alone. Parts have no symbol."""
    out = []
    for p in pieces:
        if len(p.content.encode()) <= most:
            out.append(p)
            continue
        lines = p.content.split("\n")
        part: list[str] = []
        size, since = 0, p.start
        for n, line in enumerate([*lines, None]):
            width = 0 if line is None else len(line.encode()) + (n < len(lines) - 1)
            if part and (line is None or size + width > most):
                body = "\n".join(part).strip()
                if body or line is not None:
                    out.append(Piece(since, since + len(part) - 1, "", body))
                part, size, since = [], 0, p.start + n
            if line is not None:
                part.append(line)
                size += width
    return out


def split_text(path: str, text: str, most: int = MAX_BYTES, compat: bool = False) -> list[Piece]:
    """The pieces of one file, by the ending of its path."""
    ending = re.search(r"(\.[^./]*)?$", path).group().lower()
    if ending == ".go":
        made = chunk_go(text)
    elif ending == ".py":
        made = chunk_python(text)
    elif ending == ".tf":
        made = chunk_terraform(text)
    elif ending in (".yml", ".yaml"):
        made = chunk_yaml(text, compat)
    else:
        made = whole(text)
    return refine(made, most)


def chunk_files(df: DataFrame, path: str = "path", text: str = "text", most: int = MAX_BYTES, compat: bool = False) -> DataFrame:
    """(path, ord, symbol, start_line, end_line, content) of every file (path, text), in Arrow batches without a shuffle.

    Null texts have no chunks; rows without a path are left out; other columns are ignored.
    """
    names = ["path", "ord", "symbol", "start_line", "end_line", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (body := t.as_py()) is not None:
                    made = split_text(p, body, most, compat)
                    cols = [[p] * len(made), list(range(len(made))), [m.symbol for m in made], [m.start for m in made], [m.end for m in made], [m.content for m in made]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (1, 3, 4) else pa.string()) for k, c in enumerate(cols)], names=names)

    source = df.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "path string, ord int, symbol string, start_line int, end_line int, content string")
