"""Line diffs: the shortest edit script by divide and conquer over linear space, and unified diffs of it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("line", T.StringType())]))


def split_lines(text: str | None) -> list[str]:
    return re.split(r"\r?\n", text or "")


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A snake in the middle of a shortest path: (x, y, u, v), found from both ends at once."""
    n, m = len(a), len(b)
    delta, limit = n - m, (n + m + 1) // 2
    ahead, back = {1: 0}, {1: 0}
    for d in range(limit + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1) else ahead[k - 1] + 1
            y = x - k
            u, v = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + back.get(delta - k, -1) >= n:
                return u, v, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back.get(k - 1, -1) < back.get(k + 1, -1) else back[k - 1] + 1
            y = x - k
            u, v = x, y
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if delta % 2 == 0 and abs(delta - k) <= d and x + ahead.get(delta - k, -1) >= n:
                return n - x, m - y, n - u, m - v
    raise AssertionError("two texts always have a path")


def line_diff(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(op, line): keep, delete or add; as few deletes and adds as possible, deletes first where they meet."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (old, new))
    kept: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            kept.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            kept.append((j, m))
        if i < j and k < m:
            x, y, u, v = _middle(a[i:j], b[k:m])
            kept += ((i + x + t, k + y + t) for t in range(u - x))
            stack += [(i, i + x, k, k + y), (i + u, j, k + v, m)]
    out, i, k = [], 0, 0
    for x, y in [*sorted(kept), (len(a), len(b))]:
        out += [("delete", line) for line in old[i:x]] + [("add", line) for line in new[k:y]]
        if x < len(a):
            out.append(("keep", old[x]))
        i, k = x + 1, y + 1
    return out


def unified(ops: list[tuple[str, str]], old_label: str, new_label: str, context: int = 3) -> str:
    """Hunks with context lines under labels; empty if nothing changed."""
    changed = [k for k, (op, _) in enumerate(ops) if op != "keep"]
    if not changed:
        return ""
    spans: list[list[int]] = []
    for k in changed:
        lo, hi = max(0, k - context), min(len(ops), k + context + 1)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    before = {"old": [0], "new": [0]}
    for op, _ in ops:
        before["old"].append(before["old"][-1] + (op != "add"))
        before["new"].append(before["new"][-1] + (op != "delete"))
    out = [f"--- {old_label}", f"+++ {new_label}"]
    for lo, hi in spans:
        n, m = (before[s][hi] - before[s][lo] for s in ("old", "new"))
        out.append(f"@@ -{before['old'][lo] + 1},{n} +{before['new'][lo] + 1},{m} @@")
        out += [{"keep": " ", "add": "+", "delete": "-"}[op] + line for op, line in ops[lo:hi]]
    return "\n".join(out)


@F.pandas_udf(OPS)
def diff_ops(old: pd.Series, new: pd.Series) -> pd.Series:

    return pd.Series([[{"op": o, "line": x} for o, x in line_diff(split_lines(a), split_lines(b))] for a, b in zip(old, new)])


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series, old_label: pd.Series, new_label: pd.Series) -> pd.Series:

    return pd.Series([unified(line_diff(split_lines(a), split_lines(b)), x, y) for a, b, x, y in zip(old, new, old_label, new_label)])
