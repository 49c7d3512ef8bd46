"""Shell patterns as regular expressions that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEVER = "(?!)"


def glob_regex(pattern: str) -> str:
    """The expression of a pattern: ``*`` and ``?`` don't cross ``/``, ``[...]`` and ``\\`` as in a shell; a bad pattern matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return _NEVER
            out.append(f"\\x{{{ord(pattern[i]):x}}}")
        elif c == "[":
            i += 1
            negated = i < len(pattern) and pattern[i] == "^"
            i += negated
            items, first = [], True
            while i < len(pattern) and (pattern[i] != "]" or first):
                first = False
                ends = []
                for k in range(2):
                    if i < len(pattern) and pattern[i] == "\\":
                        i += 1
                    if i >= len(pattern):
                        return _NEVER
                    ends.append(f"\\x{{{ord(pattern[i]):x}}}")
                    i += 1
                    if k or not (i + 1 < len(pattern) and pattern[i] == "-" and pattern[i + 1] != "]"):
                        break
                    i += 1
                items.append("-".join(ends))
            if i == len(pattern) or not items:
                return _NEVER
            out.append(f"[{'^' if negated else ''}{''.join(items)}]" if not negated else f"(?!/)[^{''.join(items)}]")
        else:
            out.append(f"\\x{{{ord(c):x}}}")
        i += 1
    return f"^(?s:{''.join(out)})$"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))


def excluded(path: Column, name: Column, patterns: list[str]) -> Column:
    """Whether a base name or root-relative path matches one of the patterns (a directory with or without its slash)."""
    hit = F.lit(False)
    for p in patterns:
        own = p.rstrip("/")
        hit = hit | glob(F.regexp_replace(name, "/$", ""), own) | glob(F.regexp_replace(path, "/$", ""), own)
    return hit
