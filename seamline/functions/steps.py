"""Steps of YAML pipelines: the names they go by and what they need, read by key and indentation.

Values may be plain or quoted, flow lists or block lists; flow mappings on one line count like blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Keys that name a step, and keys that refer to others.
NAMES, LINKS = ("name", "id"), ("needs", "uses", "run_task")

_SCALAR = r"""'(?:[^'\n]|'')*+'|"(?:[^"\\\n]|\\.)*+\""""
_PAIR = re.compile(rf"""(?P<key>[\w.-]++|{_SCALAR})[ \t]*+:(?=[ \t\r]|$)[ \t]*+(?P<value>\[[^\]\n]*+\]?|{_SCALAR}|(?:[^#\n\r,{{}}]|(?<=\S)\#)*+)(?P<more>[^\n]*)""")
_ITEM = re.compile(rf"""(?P<indent>[ \t]*+)(?P<dash>(?:-[ \t]++)*+)(?P<rest>.*)""")
_PLAIN = re.compile(rf"""{_SCALAR}|[^,\[\]\s'"](?:[^,\[\]]*[^,\[\]\s])?""")


def _bare(value: str) -> str:
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        value = value[1:-1]
    return value.strip()


def _values(value: str) -> list[str]:
    """The items of a flow list, or the value alone; none for an empty one."""
    if value.startswith("["):
        return [v for v in (_bare(m.group()) for m in _PLAIN.finditer(value)) if v]
    return [v] if (v := _bare(value)) else []


def entries(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """(line, key, values) of every NAMES or LINKS key, in order; items of a block list below a key have their own line."""
    waiting: tuple[str, int] | None = None  # a key without a value and its indentation: a block list may follow
    for n, line in enumerate(text.split("\n"), 1):
        m = _ITEM.match(line.rstrip("\r"))
        body = m["rest"]
        if not body or body.startswith("#"):
            continue
        column = len(m["indent"])
        pair = _PAIR.match(body.lstrip("{ ") if body.startswith("{") else body)
        if waiting and not pair and m["dash"] and column >= waiting[1]:
            yield n, waiting[0], [v for v in [_bare(re.sub(r"\s#.*", "", body))] if v]
            continue
        waiting = None
        flow = body.startswith("{")
        while pair:
            key, value = _bare(pair["key"]), pair["value"] if flow or pair["value"][:1] in "['\"" else pair["value"] + re.sub(r"\s#.*", "", pair["more"])
            if key in NAMES or key in LINKS:
                yield n, key, _values(value.strip())
                if not value.strip():
                    waiting = key, column + len(m["dash"])
            pair = _PAIR.match(pair["more"].lstrip(", ")) if flow else None
