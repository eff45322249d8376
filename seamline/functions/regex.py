"""Line-oriented regular expressions in RE2 syntax, translated for the JVM's regex engine.

Only whether a line matches is asked, so groups need not capture. Constructs RE2 lacks (lookaround,
back references, possessive and atomic groups) are refused before planning, so that a pattern means the same everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Named classes of RE2 and their JVM counterparts.
CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r ", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
_WORD = "[0-9A-Za-z_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_EDGE = rf"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_GENERAL = {"L", "M", "N", "P", "S", "Z", "C"}


class RegexError(ValueError):
    """A pattern outside the dialect."""


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def more(self) -> bool:
        return self.at < len(self.text)

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        self.at += n
        return got

    def match(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m


def _property(r: _Reader, negated: bool) -> str:
    m = r.match(r"\{(\^?)(\w+)\}|([A-Z])")
    if not m:
        raise RegexError("bad character property")
    name = m.group(2) or m.group(3)
    upper = negated != bool(m.group(1))
    kind = name if name[0] in _GENERAL and len(name) <= 2 else f"Is{name}"
    return rf"\{'P' if upper else 'p'}{{{kind}}}"


def _escape(r: _Reader, in_class: bool) -> str:
    """One escape, after its backslash."""
    if not r.more():
        raise RegexError("trailing backslash")
    c = r.take()
    if c in "pP":
        return _property(r, c == "P")
    if c == "x":
        m = r.match(r"\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2})")
        if not m:
            raise RegexError("bad hexadecimal escape")
        return rf"\x{{{m.group(1) or m.group(2)}}}"
    if c == "0" or c in "1234567" and re.match(r"[0-7]{2}", r.peek(2)):
        m = r.match(r"[0-7]{0,2}")
        return rf"\x{{{int(c + (m.group() if m else ''), 8):x}}}"
    if c.isdigit():
        raise RegexError("back references are not in the dialect")
    plain = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B", "d": r"\d", "D": r"\D", "w": r"\w", "W": r"\W"}
    if c in plain:
        return plain[c]
    if c == "s":
        return r"\t\n\f\r " if in_class else r"[\t\n\f\r ]"
    if c == "S":
        return r"\S\x0B" if in_class else r"[^\t\n\f\r ]"
    if not in_class and c in "bBAzC":
        return {"b": _EDGE, "B": _NO_EDGE, "A": r"\A", "z": r"\z", "C": "(?s:.)"}[c]
    if c.isalnum():
        raise RegexError(f"unknown escape \\{c}")
    return "\\" + c if ord(c) < 128 else c


def _klass(r: _Reader) -> str:
    """A bracketed class, after its opening bracket."""
    out = "["
    if r.peek() == "^":
        out += r.take()
    first = True
    while True:
        if not r.more():
            raise RegexError("missing closing bracket")
        c = r.take()
        if c == "]" and not first:
            return out + "]"
        first = False
        if c == "[" and (m := r.match(r":(\^?)(\w+):\]")):
            if m.group(2) not in CLASSES:
                raise RegexError(f"unknown class {m.group(2)}")
            body = CLASSES[m.group(2)]
            if m.group(1):
                body = body.replace(r"\p", r"\P", 1) if body.startswith(r"\p") else {r"\w": r"\W"}.get(body, r"\S")
            out += body
        elif c == "\\":
            out += _escape(r, True)
        elif c in "[&]~":
            out += "\\" + c
        else:
            out += c


def to_java(pattern: str) -> str:
    """The JVM pattern that matches the same lines. RegexError for patterns outside the dialect."""
    r, out, depth, repeatable = _Reader(pattern), "(?d)", 0, False
    while r.more():
        c = r.take()
        was, repeatable = repeatable, True
        if c == "\\":
            if r.peek() == "Q":
                r.take()
                end = r.text.find(r"\E", r.at)
                literal = r.text[r.at :] if end < 0 else r.text[r.at : end]
                r.at = len(r.text) if end < 0 else end + 2
                out += "".join(quote_meta(x) for x in literal)
            else:
                out += _escape(r, False)
        elif c == "[":
            out += _klass(r)
        elif c == "(":
            repeatable = False
            if r.peek() != "?":
                out += "(?:"
                depth += 1
            elif r.match(r"\?P?<[A-Za-z_]\w*>"):
                out += "(?:"
                depth += 1
            elif m := r.match(r"\?([imsU]*)(?:-([imsU]+))?([:)])"):
                on, off = m.group(1).replace("U", "").replace("i", "iu"), (m.group(2) or "").replace("U", "")
                flags = on + ("-" + off if off else "")
                if m.group(3) == ":":
                    out += f"(?{flags}:"
                    depth += 1
                elif flags:
                    out += f"(?{flags})"
            else:
                raise RegexError("lookaround, atomic groups and unknown flags are not in the dialect")
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise RegexError("unexpected closing parenthesis")
            out += c
        elif c in "*+?" or c == "{" and re.match(r"\d+(?:,\d*)?\}", r.text[r.at :]):
            if c == "{":
                m = r.match(r"(\d+)(?:,(\d*))?\}")
                if max(int(x or 0) for x in m.groups()) > 1000:
                    raise RegexError("repeat count over 1000")
                c += m.group()
            if not was:
                raise RegexError("nothing to repeat")
            out += c + (r.take() if r.peek() == "?" else "")
            repeatable = False
        elif c in "|^":
            out += c
            repeatable = c == "^"
        else:
            out += "\\" + c if c in "{}]" else c
    if depth:
        raise RegexError("missing closing parenthesis")
    return out


def required_literal(pattern: str) -> str:
    """Text that every matching line must begin its match with, "" if none is sure: the plain characters before the first special one.

    Alternatives and case folding make none sure; a character that may be repeated or left out doesn't count.
    """
    if re.search(r"\(\?[^:)]*i", pattern) or "|" in pattern:
        return ""
    out, r = "", _Reader(pattern)
    while r.more():
        c = r.take()
        if c == "\\" and r.more() and not r.peek().isalnum() and ord(r.peek()) < 128:
            c = r.take()
        elif not (c.isalnum() or c in " _-/:;,=<>'\"!@#%&~`"):
            return out[:-1] if c in "*?{" else out
        out += c
    return out


def quote_meta(text: str) -> str:
    """The text with RE2's special characters escaped."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)


@dataclass(frozen=True)
class SearchOption:
    """What to look for: a literal, or a regular expression where `regex` is set. `extensions` limit the files; none means all."""

    text: str
    regex: bool = False
    extensions: tuple[str, ...] = ()


#: Endings of the files that are indexed.
INDEXED = (".go", ".py", ".tf", ".yml", ".yaml")


def route(query: str) -> SearchOption | None:
    """How a search text is looked for: as a regular expression if it has a special character and compiles, as one of its words
    if it has several, else as it is. None for a blank one. A dot or backslash alone makes no regular expression."""
    text = query.strip()
    if not text:
        return None
    if re.search(r"[|()*+?\[\]^$]", text):
        try:
            to_java(text)
            return SearchOption(text, True, INDEXED)
        except RegexError:
            pass
    words = text.split()
    if len(words) > 1:
        return SearchOption("|".join(map(quote_meta, words)), True, INDEXED)
    return SearchOption(text, False, INDEXED)
