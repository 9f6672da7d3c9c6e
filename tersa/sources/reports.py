"""Reports of a few rows, formatted on the driver: diffs for terminals, an HTML page, tables, JSON lines."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RED, GREEN, GREY, PLAIN = "\x1b[31m", "\x1b[32m", "\x1b[90m", "\x1b[0m"


def unified_terminal(diff: str, color: bool = True) -> str:
    """A unified diff with deletes red, adds green and headers grey."""
    if not color:
        return diff
    shade = {"-": RED, "+": GREEN, "@": GREY}
    return "\n".join(f"{shade[x[0]]}{x}{PLAIN}" if x[:1] in shade else x for x in diff.split("\n"))


def side_by_side(ops: list[tuple[str, str]], width: int = 45) -> str:
    """Two columns; a run of deletes stands beside the adds that follow it."""
    rows, gone, come = [], [], []

    def flush():
        for k in range(max(len(gone), len(come))):
            rows.append((gone[k] if k < len(gone) else "", "|" if k < min(len(gone), len(come)) else "<" if k < len(gone) else ">", come[k] if k < len(come) else ""))
        gone.clear()
        come.clear()

    for op, line in ops:
        if op == "keep":
            flush()
            rows.append((line, " ", line))
        else:
            (gone if op == "delete" else come).append(line)
    flush()
    return "\n".join(f"{a[:width]:<{width}} {m} {b[:width]}" for a, m, b in rows)


def gauge(name: str, value: float, high: float, medium: float | None = None) -> str:
    level = "HIGH" if value > high else "MEDIUM" if medium is not None and value >= medium else "LOW"
    return f'<div class="gauge {level.lower()}"><b>{html.escape(name)}</b> {value:.2f} {level}</div>'


def html_report(title: str, debt: float, drift: float, ops: list[tuple[str, str]]) -> str:
    """A page with gauges of debt (over 75 high, from 50 medium) and drift (over 0.4 high) and the diff as a table."""
    rows = "".join(f'<tr class="{op}"><td>{op}</td><td>{html.escape(line)}</td></tr>' for op, line in ops)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{gauge('debt', debt, 75, 50)}{gauge('drift', drift, 0.4)}<table>{rows}</table></body></html>"


def table(rows: DataFrame, limit: int = 200) -> str:
    """Aligned text of at most `limit` rows, which is the report's feature; numbers to four places."""
    head = rows.columns
    lines = [[f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows.limit(limit).collect()]
    wide = [max(map(len, c)) for c in zip(head, *lines)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in [head, *lines])


def json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def pretty(record: dict) -> str:
    return json.dumps(record, indent=2, ensure_ascii=False, sort_keys=True, default=str)
