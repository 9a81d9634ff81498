"""Glob patterns over keys.

``*`` is any run of characters, ``?`` one byte, ``[abc]``, ``[a-z]`` and
``[^a]`` / ``[!a]`` are classes; ``]`` directly after the opening is an
ordinary member, an unclosed ``[`` is an ordinary character, and there is no
escape.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = "*?["


def literal_prefix(pattern: str) -> str:
    """The characters before the first special one."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def to_regex(pattern: str) -> str:
    """An anchored regular expression over the key's bytes, one character each."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := _class_end(pattern, i)) > 0:
            inner = pattern[i + 1 : end]
            negated = inner[0] in "^!"
            out.append(f"[{'^' if negated else ''}{_members(inner[negated:])}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}\\z"


def _class_end(pattern: str, at: int) -> int:
    """Position of the bracket that closes the class, or -1."""
    first = at + 1
    if pattern[first : first + 1] in ("^", "!"):
        first += 1
    return pattern.find("]", first + 1) if first < len(pattern) else -1


def _members(inner: str) -> str:
    out, i = [], 0
    quote = lambda c: "\\" + c if c in r"\]^-[&" else c
    while i < len(inner):
        if inner[i + 1 : i + 2] == "-" and i + 2 < len(inner):
            low, high = inner[i], inner[i + 2]
            if low <= high:
                out.append(f"{quote(low)}-{quote(high)}")
            i += 3
        else:
            out.append(quote(inner[i]))
            i += 1
    return "".join(out) or "&&[^\\x00-\\xff]"


def matches(key: Column, pattern: str) -> Column:
    """Whether a key matches; equality and ``prefix*`` stay pushable, others get their prefix as a pushable condition."""
    prefix = literal_prefix(pattern)
    if prefix == pattern:
        return key == pattern
    if pattern == prefix + "*":
        return key.startswith(prefix) if prefix else key.isNotNull()
    hit = F.decode(F.encode(key, "UTF-8"), "ISO-8859-1").rlike(to_regex(pattern.encode().decode("latin-1")))
    return key.startswith(prefix) & hit if prefix else hit
