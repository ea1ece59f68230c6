"""Extended search queries compiled to a boolean Column over an array of values.

`|` parts groups, white space within a group means AND on the same value, quotes hold blanks. Tokens: fuzzy (plain), =equal, 'contains,
!without, ^starts, !^not-starts, ends$, !not-ends$. A fuzzy token of m letters allows floor(threshold*m) edits of a substring.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'([!^=\']*)"([^"]*)"(\$?)|(\S+)')
CHUNK = 32


def _fuzzy(v: Column, token: str, threshold: float) -> Column:
    if len(token) > CHUNK:
        parts = [_fuzzy(v, token[i : i + CHUNK], threshold) for i in range(0, len(token), CHUNK)]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out
    k = math.floor(threshold * len(token) + 1e-9)
    if k == 0:
        return v.contains(token)
    near = F.exists(
        F.sequence(F.lit(1), F.length(v)),
        lambda i: F.exists(F.sequence(F.lit(max(1, len(token) - k)), F.lit(len(token) + k)), lambda n: F.levenshtein(F.substr(v, i, n), F.lit(token)) <= k),
    )
    return v.contains(token) | ((F.length(v) > 0) & near)


def _token(v: Column, raw: str, threshold: float) -> Column:
    m = _TOKEN.fullmatch(raw)
    text = (m.group(1) + m.group(2) + m.group(3)) if m and m.group(2) is not None else raw
    for mark, test in (
        ("!^", lambda t: ~v.startswith(t)), ("^", lambda t: v.startswith(t)), ("=", lambda t: v == t), ("'", lambda t: v.contains(t)),
    ):
        if text.startswith(mark) and len(text) > len(mark):
            return test(text[len(mark) :])
    if text.endswith("$") and len(text) > 1:
        return ~v.endswith(text[1:-1]) if text.startswith("!") and len(text) > 2 else v.endswith(text[:-1])
    if text.startswith("!") and len(text) > 1:
        return ~v.contains(text[1:])
    return _fuzzy(v, text, threshold)


def compile_search(query: str, values: Column, threshold: float = 0.1) -> Column:
    """True where some value matches all tokens of some group. values: array<string>; an empty query matches all."""
    if query == "":
        return F.lit(True)
    groups = [[m.group(0) for m in _TOKEN.finditer(g)] for g in query.lower().split("|")]
    groups = [g for g in groups if g]
    if not groups:
        return F.lit(False)

    def match(v: Column) -> Column:
        low, out = F.lower(v), None
        for g in groups:
            both = None
            for t in g:
                c = _token(low, t, threshold)
                both = c if both is None else both & c
            out = both if out is None else out | both
        return out & (F.trim(v) != "")

    return F.coalesce(F.exists(F.coalesce(values, F.array().cast("array<string>")), match), F.lit(False))
