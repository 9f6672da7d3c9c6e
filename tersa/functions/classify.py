"""Content types by extension, then by probes of the text, in one CASE chain of built-in expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersa.functions.text import CODE_EXTENSIONS, ascii_bounds, extension, strip

#: What the probes look for.
HTML_DOCTYPE, HTML_CLOSING, HTML_OPENING = r"(?i)<!doctype\s+html", r"(?i)</([a-z][a-z0-9-]*)\s*>", r"(?i)<([a-z][a-z0-9-]*)(?:\s[^<>]*)?/?>"
LOG_CLOCK = r"(?<![\d:.])\d{1,2}:\d{2}:\d{2}(?!\d)"
LOG_LEVEL = r"(?:^|[\s\[(<|])(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|NOTICE)(?:\z|[\s\])>:,|])"
LOG_STAMP = r"^\s*\[?(?:\d{4}[-/]\d{2}[-/]\d{2}[T ])?\d{1,2}:\d{2}:\d{2}"
MD_FENCE, MD_LIST, MD_LINK = r"(?s)```.*```", r"(?:^|\n)(?:-|\*|\d+\.)\s+\S", r"\[[^\]]+\]\([^)]+\)"
YAML_MAPPING = r"""^\s*(?:-\s+)?(?:[\w.\-/]+|"[^"]+"|'[^']+')\s*:(?:\s+\S.*|\s*)\z"""
YAML_MARKER, YAML_NEUTRAL, YAML_BLOCK = r"^(?:---|\.\.\.)\s*\z", r"^\s*(?:#|-(?:\s+\S.*)?\z)", r":\s*[|>][-+]?\d*\s*\z"
PY_DEFINITION = r"^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+[A-Za-z_]\w*[ \t]*[(:]"
PY_IMPORT = (
    r"^[ \t]*(?:import[ \t]+[A-Za-z_][\w.]*(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[A-Za-z_][\w.]*(?:[ \t]+as[ \t]+\w+)?)*[ \t]*\z|from[ \t]+[.A-Za-z_][\w.]*[ \t]+import[ \t]+\S)"
)
PY_DECORATOR = r"^[ \t]*@[A-Za-z_][\w.]*(?:\([^)]*\))?[ \t]*\z"
PY_STRONG = "|".join((PY_DEFINITION, PY_IMPORT, PY_DECORATOR))
PY_WEAK = r"^[ \t]*(?:if|elif|else|for|while|try|except|finally|with|match|case)\b[^:]*:[ \t]*(?:#.*)?\z|^[ \t]*(?:return|raise|pass|yield|assert|global|nonlocal|del|continue|break)\b"
PY_NOT = r"[;{][ \t]*\z|=>|\bfunction\b[ \t]*\w*[ \t]*\(|\b(?:const|let|var)[ \t]+\w+[ \t]*[:=]"


def lines_with_text(text: Column) -> Column:
    return F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"\S"))


@F.pandas_udf(T.BooleanType())
def parses_as_json(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON value and nothing else; NaN and Infinity are none. Null for null."""

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON")

    def parses(text: str) -> bool:
        try:
            json.loads(text, parse_constant=refuse)
        except (ValueError, RecursionError):
            return False
        return True

    return pd.Series([None if t is None else parses(t) for t in texts], dtype="object")


def looks_like_json(text: Column) -> Column:
    """An object or array that parses whole. Only texts that begin and end like one reach the parser, in Python behind Arrow.

    The built-in parser forgives text after the value, refuses repeated keys, and so cannot tell.
    """
    probe = text.rlike(r"^[\[{]") & text.rlike(r"[\]}]\z")
    return F.coalesce(parses_as_json(F.when(probe, text)), F.lit(False))


def looks_like_html(text: Column) -> Column:
    """A doctype, or an opening tag whose name is closed somewhere."""
    closing = F.transform(F.regexp_extract_all(text, F.lit(HTML_CLOSING), F.lit(1)), F.lower)
    opening = F.transform(F.regexp_extract_all(text, F.lit(HTML_OPENING), F.lit(1)), F.lower)
    return text.rlike(HTML_DOCTYPE) | F.arrays_overlap(closing, opening)


def looks_like_logs(text: Column) -> Column:
    """Half of the lines carry a clock and a level or start with a time stamp."""
    lines = lines_with_text(text)
    logged = F.filter(lines, lambda x: x.rlike(LOG_CLOCK) & (x.rlike(LOG_LEVEL) | x.rlike(LOG_STAMP)))
    return F.when(text.rlike(LOG_CLOCK), (F.size(lines) > 0) & (F.size(logged) * 2 >= F.size(lines))).otherwise(F.lit(False))


def looks_like_markdown(text: Column) -> Column:
    """A fenced block, a list item or a link; headings alone are comments elsewhere."""
    return text.rlike(MD_FENCE) | text.rlike(MD_LIST) | text.rlike(MD_LINK)


def looks_like_yaml(text: Column) -> Column:
    """Mappings (two, or one and a document marker) make up three quarters of the decisive lines; block scalars are skipped.

    A fold over the lines keeps the indentation of an open block scalar, -1 for none.
    """
    zero = F.struct(F.lit(0).alias("decisive"), F.lit(0).alias("mappings"), F.lit(0).alias("markers"), F.lit(-1).alias("block"))

    def step(acc: Column, line: Column) -> Column:
        indent = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
        inside = (acc["block"] >= 0) & (indent > acc["block"])
        mapping = line.rlike(YAML_MAPPING)
        marker = ~mapping & line.rlike(YAML_MARKER)
        neutral = ~mapping & ~marker & line.rlike(YAML_NEUTRAL)
        return F.when(inside, acc).otherwise(
            F.struct(
                (acc["decisive"] + F.when(neutral, 0).otherwise(1)).alias("decisive"),
                (acc["mappings"] + mapping.cast("int")).alias("mappings"),
                (acc["markers"] + marker.cast("int")).alias("markers"),
                F.when(mapping & line.rlike(YAML_BLOCK), indent).otherwise(F.lit(-1)).alias("block"),
            )
        )

    def verdict(acc: Column) -> Column:
        enough = (acc["mappings"] >= 2) | ((acc["markers"] >= 1) & (acc["mappings"] >= 1))
        return enough & ((acc["mappings"] + acc["markers"]) * 4 >= acc["decisive"] * 3)

    # most texts have no line of the kind, and no fold is run over them
    return F.when(text.rlike(r"(?m)^\s*(?:-\s+)?\S[^:\n]*:"), F.aggregate(lines_with_text(text), zero, step, verdict)).otherwise(F.lit(False))


def python_counts(text: Column) -> Column:
    """struct(counted, strong, weak, barred): lines of the Python probe, comments aside."""
    lines = F.filter(lines_with_text(text), lambda x: ~x.rlike(r"^[ \t]*#"))
    barred = F.filter(lines, lambda x: x.rlike(ascii_bounds(PY_NOT)))
    others = F.filter(lines, lambda x: ~x.rlike(ascii_bounds(PY_NOT)))
    strong = F.filter(others, lambda x: x.rlike(PY_STRONG))
    weak = F.filter(others, lambda x: ~x.rlike(PY_STRONG) & x.rlike(ascii_bounds(PY_WEAK)))
    return F.struct(F.size(lines).alias("counted"), F.size(strong).alias("strong"), F.size(weak).alias("weak"), F.size(barred).alias("barred"))


def may_be_python(text: Column) -> Column:
    """The line counts of the Python probe; a balance check of the text must confirm it."""
    c = python_counts(text)
    shape = (c["strong"] >= 2) & ((c["strong"] + c["weak"]) * 100 >= c["counted"] * 15) & (c["barred"] * 10 < c["counted"])
    return F.when(text.rlike(r"(?m)^[ \t]*(?:async[ \t]|def[ \t]|class[ \t]|import[ \t]|from[ \t]|@)"), shape).otherwise(F.lit(False))


def content_type(text: Column, path: Column | None = None, python: Column | None = None) -> Column:
    """json, yaml, html, logs, code, markdown, text or unknown. python: a confirmed verdict instead of the probe's counts."""
    ext = extension(path) if path is not None else F.lit("")
    body = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(ext == "json", "json")
        .when(ext.isin("yml", "yaml"), "yaml")
        .when(ext.isin("html", "htm"), "html")
        .when(ext == "log", "logs")
        .when(ext.isin("md", "markdown"), "markdown")
        .when(ext.isin(*CODE_EXTENSIONS), "code")
        .when(looks_like_json(body), "json")
        .when(looks_like_yaml(body), "yaml")
        .when(looks_like_html(body), "html")
        .when(looks_like_logs(body), "logs")
        .when(python if python is not None else may_be_python(body), "code")
        .when(looks_like_markdown(body), "markdown")
        .when(body != "", "text")
        .otherwise("unknown")
    )
