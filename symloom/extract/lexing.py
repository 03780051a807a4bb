"""Comments, strings and brackets of a source text.

A text is handled as Latin-1, so that a character is a byte and offsets are
byte offsets whatever the encoding.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

# Comment and string syntax of the families of languages.
FAMILIES = {
    "slash": (r"/\*.*?(?:\*/|\Z)|//[^\n]*", r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\[^\n]{1,8})\''),
    "script": (r"/\*.*?(?:\*/|\Z)|//[^\n]*", r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'),
    "c": (r"/\*.*?(?:\*/|\Z)|//[^\n]*", r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]{1,8})\''),
    "rust": (r"/\*.*?(?:\*/|\Z)|//[^\n]*", r'r(#*)".*?"\1|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]{1,8})\''),
    "hash": (r"\#[^\n]*", r'"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''),
}


@lru_cache
def _lexer(family: str) -> re.Pattern:
    comment, string = FAMILIES[family]
    return re.compile(rf"(?P<comment>{comment})|(?P<string>{string})", re.S)


class Source:
    """A text with its comments and strings blanked out in ``code``."""

    def __init__(self, data: bytes, family: str) -> None:
        self.text = data.decode("latin-1")
        self.comments: list[tuple[int, int]] = []
        pieces, last = [], 0
        for m in _lexer(family).finditer(self.text):
            a, b = m.span()
            blank = re.sub(r"[^\n]", " ", m.group())
            if m["comment"] is not None:
                self.comments.append((a, b))
            elif b - a >= 2:
                blank = m.group()[0] + blank[1:-1] + m.group()[-1]
            pieces += [self.text[last:a], blank]
            last = b
        self.code = "".join([*pieces, self.text[last:]])
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.pairs: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m.group() in "([{":
                stack.append(m.start())
            elif stack:
                self.pairs[stack.pop()] = m.end()

    def line(self, at: int) -> int:
        """Zero-based line of an offset."""
        return bisect_right(self.lines, at) - 1

    def raw(self, a: int, b: int) -> str:
        return self.text[a:b].encode("latin-1").decode("utf-8", "replace")

    def close(self, at: int) -> int:
        """The end of the bracket that opens at ``at``; the text's end if none."""
        return self.pairs.get(at, len(self.code))

    def end_of(self, at: int, how: str) -> int:
        """Where a definition that begins before ``at`` ends: ``body`` (its
        braces or else its semicolon), ``statement`` (a semicolon or the line's
        end outside brackets), ``line`` (with continuation lines)."""
        i, code = at, self.code
        if how == "line":
            m = re.compile(r"(?:[^\n\\]|\\.|\\\n)*", re.S).match(code, at)
            return m.end()
        while i < len(code):
            c = code[i]
            if c in "([{":
                i = self.close(i)
                if c == "{" and how == "body":
                    tail = re.compile(r"[ \t]*;").match(code, i)
                    return i if not tail else i
                continue
            if c == ";":
                return i + 1
            if c in ")]}":
                return i
            if c == "\n" and how == "statement" and not re.compile(r"\s*[.?:|&+=]").match(code, i) and not re.search(r"[=,+|&(]\s*$", code[at:i]):
                return i
            i += 1
        return len(code)

    def items(self, a: int, b: int, separators: str = ",;\n") -> list[tuple[int, int]]:
        """The parts between two offsets, cut outside brackets."""
        out, start, i = [], a, a
        while i < b:
            c = self.code[i]
            if c in "([{":
                i = min(self.close(i), b)
                if c == "{" and "\n" in separators:  # a body ends an item
                    out.append((start, i))
                    start = i
                continue
            if c in separators:
                out.append((start, i))
                start = i + 1
            i += 1
        out.append((start, b))
        return [(x + len(self.code[x:y]) - len(self.code[x:y].lstrip()), y) for x, y in out if self.code[x:y].strip()]

    def comments_before(self, at: int) -> list[str]:
        """The comments that follow each other directly before an offset."""
        k, out = bisect_right(self.comments, (at, at)) - 1, []
        while k >= 0 and self.comments[k][1] <= at and not self.text[self.comments[k][1] : at].strip():
            a, b = self.comments[k]
            line = self.text.rfind("\n", 0, a) + 1
            if self.text[line:a].strip():
                break
            out.append(self.raw(a, b))
            at, k = a, k - 1
        return out[::-1]
