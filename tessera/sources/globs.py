"""Glob patterns as one regular expression for Spark's ``rlike``."""

from __future__ import annotations

import re


def expand_braces(pattern: str) -> list[str]:
    """All patterns that nested ``{a,b}`` stand for; a backslash keeps the next character."""
    depth, start, cuts, i = 0, -1, [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "{":
            if depth == 0:
                start, cuts = i, [i]
            depth += 1
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                cuts.append(i)
                parts = [pattern[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
                if len(parts) == 1:
                    break
                return [x for p in parts for x in expand_braces(pattern[:start] + p + pattern[i + 1 :])]
        i += 1
    return [pattern]


def _segment(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            negated = inner[:1] in "!^"
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", inner[1:] if negated else inner)
            out.append(f"[{'^/' if negated else ''}{body}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c).replace("\\/", "/"))
        i += 1
    return "".join(out)


def glob_regex(patterns: list[str]) -> str:
    """Anchored and without regard to case; no pattern at all matches nothing."""
    parts = list(dict.fromkeys(_segment(x) for p in patterns for x in expand_braces(p.strip()) if x))
    return f"(?i)^(?:{'|'.join(parts)})$" if parts else r"(?!)"
