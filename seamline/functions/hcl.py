"""A scanner of HCL (Terraform): top-level blocks with their labels, places and the references in their bodies.

Strings with interpolations, here-documents and comments are told apart from code by a stack of modes, so that braces in
them neither open nor close a block and only what is evaluated counts as a reference.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_CODE = re.compile(
    r"""(?P<skip>\#[^\n]*+|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))|<<[-~]?[ \t]*"?(?P<tag>\w+)"?[^\n]*+\n|(?P<quote>")|(?P<open>\{)|(?P<close>\})|(?P<line>\n)|(?P<equals>=(?!=))
    |(?P<path>[^\W\d][\w-]*+(?:(?:\[[^\]\n"{}]*+\])?\.(?:[\w-]++|\*))*+)|(?P<number>\d[\w.]*+)""",
    re.X,
)
_STRING = re.compile(r"""\\.|\$\$\{|%%\{|(?P<hole>[$%]\{)|(?P<end>"|\n)""", re.S)


@dataclass
class Block:
    """A top-level block: its type and labels, its first and last offset, whether it was closed, and the dotted references in its body."""

    kind: str
    labels: list[str]
    start: int
    end: int = 0
    closed: bool = False
    references: list[tuple[str, ...]] = field(default_factory=list)


def blocks(text: str) -> list[Block]:
    """All top-level blocks in order; one that is never closed reaches to the end of the text."""
    out: list[Block] = []
    head: list[tuple[str, int]] = []  # words and strings of the statement so far, where no block is open
    modes: list[str] = []  # "{" code in braces, '"' string, else the tag of a here-document
    block: Block | None = None
    label, at, n = 0, 0, len(text)

    def opened() -> None:
        nonlocal block
        if block is None and head and not any(word == "=" for word, _ in head):
            block = Block(head[0][0], [word for word, _ in head[1:]], head[0][1])
            out.append(block)
        head.clear()

    while at < n:
        mode = modes[-1] if modes else "{"
        if mode == '"':
            m = _STRING.search(text, at)
            at = m.end() if m else n
            if m and m["hole"]:
                modes.append("{")
            elif m and m["end"]:
                modes.pop()
                if not modes and block is None:
                    head.append((text[label : m.start()], label))
            continue
        if mode != "{":
            m = re.compile(rf"[$%]\{{|^[ \t]*{mode}[ \t]*\r?$", re.M).search(text, at)
            at = m.end() if m else n
            if m and m.group()[0] in "$%":
                if text[m.start() - 1 : m.start()] != m.group()[0]:
                    modes.append("{")
            else:
                modes.pop()
            continue
        m = _CODE.search(text, at)
        if not m:
            break
        at = m.end()
        if m["tag"]:
            modes.append(m["tag"])
        elif m["quote"]:
            label = at
            modes.append('"')
        elif m["open"]:
            if not modes:
                opened()
            modes.append("{")
        elif m["close"]:
            if modes:
                modes.pop()
            if not modes:
                if block:
                    block.end, block.closed, block = at, True, None
                head.clear()
        elif m["line"]:
            if not modes:
                head.clear()
        elif m["equals"]:
            head.append(("=", m.start()))
        elif m["path"]:
            if not modes:
                head.append((m["path"], m.start()))
            elif block and "." in m["path"]:
                block.references.append(tuple(re.sub(r"\[[^\]]*\]", "", m["path"]).split(".")))
    if block:
        block.end = n
    return out
