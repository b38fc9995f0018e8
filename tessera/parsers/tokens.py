"""A token stream with a cursor, for statement languages."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

WORD, NAME, STRING, NUMBER, SIGN = "word", "name", "string", "number", "sign"
#: Types that take others in angle brackets.
GENERIC = ("MAP", "LIST", "SET", "ARRAY", "STRUCT", "FROZEN", "TUPLE", "ROW", "VECTOR", "NESTED")
PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == WORD else ""


class Lines:
    """Offsets to zero-based lines; a lone carriage return ends a line too."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]

    def at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset) - 1


class Cursor:
    """Reads a slice of tokens from the left."""

    def __init__(self, text: str, tokens: list[Token], start: int = 0, end: int | None = None):
        self.text, self.tokens = text, tokens
        self.at, self.end = start, len(tokens) if end is None else end

    def peek(self, ahead: int = 0) -> Token | None:
        i = self.at + ahead
        return self.tokens[i] if i < self.end else None

    def take(self) -> Token | None:
        token = self.peek()
        if token:
            self.at += 1
        return token

    def word(self, ahead: int = 0) -> str:
        token = self.peek(ahead)
        return token.up if token else ""

    def keywords(self, *words: str) -> bool:
        """Pass these words if they come next."""
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def any(self, *words: str) -> str:
        """Pass one of these words; which it was, or nothing."""
        if (w := self.word()) and w in words:
            self.at += 1
            return w
        return ""

    def sign(self, text: str) -> bool:
        token = self.peek()
        if token and token.kind == SIGN and token.text == text:
            self.at += 1
            return True
        return False

    def group(self) -> Cursor | None:
        """The inside of brackets that open here; what never closes ends with the slice."""
        token = self.peek()
        if not token or token.kind != SIGN or token.text not in PAIRS:
            return None
        depth, i = 0, self.at
        while i < self.end:
            t = self.tokens[i]
            if t.kind == SIGN:
                depth += (t.text in PAIRS) - (t.text in PAIRS.values())
                if depth == 0:
                    break
            i += 1
        inside = Cursor(self.text, self.tokens, self.at + 1, min(i, self.end))
        self.at = min(i + 1, self.end)
        return inside

    def split(self, sign: str = ",") -> list[Cursor]:
        """Parts between signs outside all brackets, those of generic types too; empty ones are left out."""
        parts, depth, angles, begin = [], 0, 0, self.at
        for i in range(self.at, self.end):
            t = self.tokens[i]
            if t.kind == SIGN:
                depth += (t.text in PAIRS) - (t.text in PAIRS.values())
                if t.text == "<" and (angles or i and self.tokens[i - 1].up in GENERIC):
                    angles, depth = angles + 1, depth + 1
                elif t.text == ">" and angles:
                    angles, depth = angles - 1, depth - 1
                if depth == 0 and t.text == sign:
                    parts.append(Cursor(self.text, self.tokens, begin, i))
                    begin = i + 1
        parts.append(Cursor(self.text, self.tokens, begin, self.end))
        return [p for p in parts if p.at < p.end]

    def since(self, start: int) -> str:
        """Source text of the tokens from number ``start`` up to here, blanks collapsed."""
        if start >= self.at:
            return ""
        return re.sub(r"\s+", " ", self.text[self.tokens[start].start : self.tokens[self.at - 1].end]).strip()

    def done(self) -> bool:
        return self.at >= self.end


def scan(text: str, pattern: str) -> list[Token]:
    """Tokens by the named groups of a pattern; ``skip`` is left out."""
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in re.finditer(pattern, text, re.S) if m.lastgroup != "skip"]


def unescaped(text: str) -> str:
    """The inside of a quoted string, its escapes read."""
    for quote in ("'''", '"""'):
        if text.startswith(quote):
            inside = text[3:-3] if len(text) >= 6 and text.endswith(quote) else text[3:]
            return inside.strip("\n")
    inside = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), inside, flags=re.S)
