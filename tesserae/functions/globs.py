"""Shell patterns on one path element: ``*``, ``?``, ``[a-z]``, ``[^a]``, ``\\`` as escape; case counts."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1024)
def to_regex(pattern: str) -> str:
    """A whole-match regular expression that Python and Java read alike; a malformed pattern matches nothing."""
    out, i = [], 0
    never = r"(?!)"
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return never
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = i + 1
            body = ""
            if pattern[end : end + 1] == "^":
                body, end = "^", end + 1
            first = True
            while end < len(pattern) and (pattern[end] != "]" or first):
                x = pattern[end]
                if x == "\\":
                    end += 1
                    x = pattern[end : end + 1]
                    if not x:
                        return never
                    body += re.escape(x)
                elif x == "-" and not first and pattern[end + 1 : end + 2] not in ("", "]"):
                    body += "-"
                elif x in "-]":
                    return never
                else:
                    body += re.escape(x)
                first = False
                end += 1
            if end >= len(pattern):
                return never
            out.append(f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def matches(pattern: str, name: str) -> bool:
    return re.fullmatch(to_regex(pattern), name, re.S) is not None


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def any_match(path: Column, patterns: list[str]) -> Column:
    """Whether the base name of a path matches one of the patterns."""
    if not patterns:
        return F.lit(False)
    return base_name(path).rlike("^(?:" + "|".join(f"(?s:{to_regex(p)})" for p in patterns) + ")$")
