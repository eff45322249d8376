"""A small lexer of Go sources: enough to find top-level declarations, their extent and the calls in functions."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')"
    r"|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<word>[^\W\d]\w*)|(?P<op>\.\.\.|<-|:=|\+\+|--|&&|\|\||&\^=?|<<=?|>>=?|[-+*/%&|^<>=!]=?|[(){}\[\],;.:~])",
    re.S,
)
#: The language's keywords.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


class GoError(ValueError):
    """Text that is no Go source."""


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Declaration(NamedTuple):
    """A top-level declaration: `func`, `type` or `value`, its span, its name, and where its doc comment begins (or its start)."""

    kind: str
    name: str
    receiver: str
    start: int
    end: int
    doc: int
    body: tuple[int, int]  # token numbers of a function's body


class GoFile:
    """Tokens and declarations of one source. GoError if it can't be one."""

    def __init__(self, text: str):
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens: list[Token] = []
        self.comments: list[Token] = []
        self._lex()
        self.declarations = list(self._declarations())

    def line(self, at: int) -> int:
        """Line of an offset, from 1."""
        return bisect_right(self.breaks, at - 1) + 1

    def _lex(self) -> None:
        at, stack, last = 0, [], ""
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise GoError(f"unexpected character at {at}")
            kind, word, at = m.lastgroup, m.group(), m.end()
            if kind == "comment":
                self.comments.append(Token(kind, word, m.start(), at))
                kind = "newline" if "\n" in word else "space"
            if kind == "newline":
                # A line end closes a statement after a name, a literal, a closing bracket or a jump.
                if last and (last[-1] in ")]}\"'`" or last in ("++", "--", "break", "continue", "fallthrough", "return") or (last[0].isalnum() or last[0] == "_") and last not in KEYWORDS):
                    self.tokens.append(Token("end", "\n", m.start(), m.start()))
                    last = ""
                continue
            if kind == "space":
                continue
            if word in "([{" and kind == "op":
                stack.append(word)
            elif word in _CLOSES and kind == "op" and (not stack or stack.pop() != _CLOSES[word]):
                raise GoError("unbalanced brackets")
            self.tokens.append(Token(kind, word, m.start(), at))
            last = word
        if stack:
            raise GoError("unbalanced brackets")
        self.tokens.append(Token("end", "\n", at, at))

    def _skip(self, k: int) -> int:
        """The token after the bracket that closes token k."""
        depth = 0
        while k < len(self.tokens):
            if self.tokens[k].kind == "op":
                depth += (self.tokens[k].text in "([{") - (self.tokens[k].text in ")]}")
            k += 1
            if not depth:
                return k
        raise GoError("unbalanced brackets")

    def _statement(self, k: int, stop: str = "") -> int:
        """The token that ends the statement beginning at k: a line end or semicolon outside brackets, or `stop`."""
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "end" or t.text == ";" or t.text == stop:
                return k
            k = self._skip(k) if t.kind == "op" and t.text in "([{" else k + 1
        return len(self.tokens) - 1

    def _doc(self, at: int) -> int:
        """Where the comment group directly above an offset begins; the offset itself without one."""
        best, line = at, self.line(at)
        for c in reversed([c for c in self.comments if c.end <= at]):
            bottom = self.line(max(c.start, c.end - 1))
            gap = self.text[c.end : best]
            if bottom != line - 1 or gap.strip() or (before := self.text[self.text.rfind("\n", 0, c.start) + 1 : c.start]).strip() and before.strip()[:2] not in ("//", "/*"):
                break
            best, line = c.start, self.line(c.start)
        return best

    def _declarations(self):
        tokens, k = self.tokens, 0
        while k < len(tokens) and tokens[k].kind == "end":
            k += 1
        if k >= len(tokens) or tokens[k].text != "package":
            raise GoError("no package clause")
        while k < len(tokens):
            word = tokens[k].text
            if word == "func":
                made, k = self._func(k)
                yield made
            elif word in ("const", "var", "type"):
                stop = self._statement(k)
                grouped = k + 1 < len(tokens) and tokens[k + 1].text == "("
                if word == "type":
                    yield from self._types(k + 2 if grouped else k + 1, stop, grouped)
                else:
                    yield Declaration("value", "", "", tokens[k].start, tokens[stop - 1].end, tokens[k].start, (0, 0))
                k = stop
            elif tokens[k].kind == "end" or word == ";":
                k += 1
            elif word in ("package", "import"):
                k = self._statement(k)
            else:
                raise GoError(f"unexpected {word!r} between declarations")

    def _types(self, k: int, stop: int, grouped: bool):
        tokens = self.tokens
        while k < stop:
            if tokens[k].kind == "end" or tokens[k].text in ";)":
                k += 1
                continue
            end = self._statement(k, ")" if grouped else "")
            start = tokens[k].start
            yield Declaration("type", tokens[k].text, "", start, tokens[end - 1].end, self._doc(start) if grouped else start, (0, 0))
            k = end

    def _func(self, k: int) -> tuple[Declaration, int]:
        tokens, first, receiver = self.tokens, k, ""
        k += 1
        if tokens[k].text == "(":
            after = self._skip(k)
            inner = [t.text for t in tokens[k + 1 : after - 1] if t.kind in ("word", "op")]
            if inner and "[" not in inner and inner[-1] not in ("*",):
                receiver = ("*" if len(inner) > 1 and inner[-2] == "*" else "") + inner[-1]
            k = after
        name = tokens[k].text
        if tokens[k].kind != "word":
            raise GoError("function without a name")
        k += 1
        body = (0, 0)
        while k < len(tokens) and tokens[k].kind != "end" and tokens[k].text != ";":
            if tokens[k].text == "{" and tokens[k - 1].text not in ("interface", "struct"):
                after = self._skip(k)
                body = (k + 1, after - 1)
                k = after
                break
            k = self._skip(k) if tokens[k].kind == "op" and tokens[k].text in "([{" else k + 1
        start = tokens[first].start
        return Declaration("func", name, receiver, start, tokens[k - 1].end, self._doc(start), body), k

    def calls(self, d: Declaration):
        """Names called in a function's body, in order: f of f(...) and of x.f(...). Calls of anything else have no name."""
        for k in range(*d.body):
            t, after, before = self.tokens[k], self.tokens[k + 1], self.tokens[k - 1]
            if t.kind == "word" and after.text == "(" and t.text not in KEYWORDS and before.text not in ("]", "func"):
                yield t.text
