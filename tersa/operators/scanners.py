"""Lexical scanners that expressions cannot state: balance checks, function bodies, statements. Python behind Arrow, a text a call.

One regular expression cuts a text into tokens that matter (strings, comments, brackets, line ends); checks are folds over them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGION_LEAST = 104
PAIRS = {")": "(", "]": "[", "}": "{"}
#: Tokens of brace languages. A slash starts a regular expression where no value stands before it.
SCRIPT = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<open_comment>/\*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<open_string>["'])|(?P<tick>`)"""
    r"""|(?P<slash>/)|(?P<bracket>[()\[\]{}])|(?P<word>[\w$]+)|(?P<other>[^\s])|(?P<space>\s+)""",
    re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}
HEADER, CONTROL = re.compile(r"(?:\)\s*(?::\s*[^{;=]+)?|=>\s*)\Z"), re.compile(r"\b(?:if|for|while|switch|catch|do|else|with)\s*\(")
PYTHON = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<string>[rbfuRBFU]{0,2}(?:\"{3}.*?(?<!\\)(?:\\\\)*\"{3}|'{3}.*?(?<!\\)(?:\\\\)*'{3}))|(?P<open_triple>\"{3}|'{3})"""
    r"""|(?P<short>[rbfuRBFU]{0,2}(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|(?P<open_string>["'])|(?P<bracket>[()\[\]{}])|(?P<join>\\\n)|(?P<line>\n)|(?P<word>[^\s()\[\]{}"'\#\\]+)|(?P<other>\\)|(?P<space>[^\S\n]+)""",
    re.S,
)
DEF = re.compile(r"[ \t]*def\s.*:\s*\Z")


def script_tokens(text: str):
    """(kind, start, end) of a script's tokens; of templates, the texts are strings and the code within them is tokens."""
    at, value, ticks = 0, False, []  # ticks: bracket depths at which a template's code ends
    depth = 0

    def template(at: int):
        """From inside a template to its end or its next code: (end, whether it was closed, whether code follows)."""
        m = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*", re.S).match(text, at)
        end = m.end()
        return (end + 1, True, False) if text[end : end + 1] == "`" else (end + 2, False, True) if text.startswith("${", end) else (len(text), False, False)

    while at < len(text):
        m = SCRIPT.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "slash" and not value and (r := REGEX.match(text, at)):
            kind, end = "string", r.end()
        if kind == "tick" or kind == "bracket" and m[0] == "}" and ticks and ticks[-1] == depth:
            if kind == "bracket":
                ticks.pop()
            end, closed, code = template(at + 1)
            kind = "string" if closed or code else "open_template"
            if code:
                ticks.append(depth)
        elif kind == "bracket":
            depth += 1 if m[0] in "([{" else -1
        yield kind, at, end
        if kind == "word":
            value = m[0] not in BEFORE_REGEX
        elif kind not in ("space", "comment"):
            value = kind == "string" or m[0] in ")]}"
        at = end


class Places:
    """Line and column, from 1, of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


def _bracket(stack: list, char: str, at: int, place, issues: list) -> None:
    if char in "([{":
        stack.append((char, at))
    elif not stack:
        issues.append((*place(at), "AST_UNBALANCED_BRACKET", f"closing '{char}' without an opening one"))
    elif stack[-1][0] != PAIRS[char]:
        issues.append((*place(at), "AST_UNBALANCED_BRACKET", f"closing '{char}' meets '{stack[-1][0]}'"))
        stack.pop()
    else:
        stack.pop()


def script_issues(text: str) -> list[tuple[int, int, str, str]]:
    place, issues, stack = Places(text), [], []
    for kind, start, end in script_tokens(text):
        if kind == "bracket":
            _bracket(stack, text[start], start, place, issues)
        elif kind in ("open_string", "open_template"):
            issues.append((*place(start), "AST_UNTERMINATED_STRING", "a string does not end"))
        elif kind == "open_comment":
            issues.append((*place(start), "AST_UNTERMINATED_COMMENT", "a comment does not end"))
            break
    return issues + [(*place(at), "AST_UNBALANCED_BRACKET", f"'{c}' is not closed") for c, at in stack]


def _indent(space: str) -> int:
    n = 0
    for c in space:
        n = n + 4 if c == "\t" else n + 1
    return n


def python_issues(text: str) -> list[tuple[int, int, str, str]]:
    place, issues, stack = Places(text), [], []
    levels, fresh, opened, last = [0], True, 0, ""
    lead = ""
    for m in PYTHON.finditer(text):
        kind, at = m.lastgroup, m.start()
        if kind == "line":
            if not fresh and not stack:
                opened = place(at)[0] if last == ":" else 0
                fresh, lead, last = True, "", ""
            elif fresh:
                lead = ""
            continue
        if kind == "space":
            lead = m[0] if fresh else lead
            continue
        if kind in ("comment", "join"):
            continue
        if fresh and not stack:
            fresh, depth = False, _indent(lead)
            if opened:
                if depth <= levels[-1]:
                    issues.append((*place(at), "AST_INDENTATION_ERROR", f"line {opened} opens a block, which is not indented"))
                else:
                    levels.append(depth)
            elif depth > levels[-1]:
                issues.append((*place(at), "AST_INDENTATION_ERROR", "indented without a block"))
                levels.append(depth)
            while depth < levels[-1]:
                levels.pop()
            if depth != levels[-1]:
                issues.append((*place(at), "AST_INDENTATION_ERROR", "goes back to no outer level"))
                levels.append(depth)
            opened = 0
        if kind == "bracket":
            _bracket(stack, m[0], at, place, issues)
        elif kind in ("open_string", "open_triple"):
            issues.append((*place(at), "AST_UNTERMINATED_STRING", "a string does not end"))
            if kind == "open_triple":
                return issues
        last = m[0][-1]
    if opened or (not fresh and last == ":" and not stack):
        issues.append((*place(len(text)), "AST_COLON_MISMATCH", "a block is missing at the end"))
    return issues + [(*place(at), "AST_UNBALANCED_BRACKET", f"'{c}' is not closed") for c, at in stack]


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def json_issues(text: str) -> list[tuple[int, int, str, str]]:
    if not text.strip():
        return [(1, 1, "JSON_SYNTAX_ERROR", "empty")]
    try:
        json.loads(text, parse_constant=_refuse)
    except ValueError as e:
        return [(getattr(e, "lineno", 1), getattr(e, "colno", 1), "JSON_SYNTAX_ERROR", getattr(e, "msg", str(e)))]
    except RecursionError:
        return [(1, 1, "JSON_SYNTAX_ERROR", "nested too deep")]
    return []


CHECKS = {"script": script_issues, "python": python_issues, "json": json_issues}
ISSUES = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("message", T.StringType())]))


def validator(language: Column, path: Column, content_type: Column) -> Column:
    """Which check fits: by language, then extension, then JSON by type; null for none."""
    from tersa.functions.text import extension, normalize_language

    named = F.coalesce(normalize_language(language), normalize_language(extension(path)))
    return F.when(named.isin("typescript", "javascript"), "script").when(named == "python", "python").when((named == "json") | (named.isNull() & (content_type == "json")), "json")


@F.pandas_udf(ISSUES)
def balance_issues(texts: pd.Series, checks: pd.Series) -> pd.Series:
    """Issues of each text by the named check; none for a null check. A check that fails itself reports that as an issue."""

    def run(text, check):
        if check is None or text is None:
            return []
        try:
            found = CHECKS[check](text)
        except Exception as e:  # a row must not fail the job
            found = [(1, 1, "AST_CHECK_FAILED", repr(e)[:200])]
        return [{"line": a, "col": b, "code": c, "message": d} for a, b, c, d in found]

    return pd.Series([run(t, c) for t, c in zip(texts, checks)])


def script_bodies(text: str) -> list[tuple[int, int]]:
    """Insides of the braces of functions, methods and arrows."""
    found, stack, line_start = [], [], 0
    for kind, start, end in script_tokens(text):
        if kind != "bracket" or text[start] not in "{}":
            continue
        if text[start] == "{":
            before = text[max(line_start, max(text.rfind(c, 0, start) for c in ";{}") + 1, start - 2000) : start].rstrip()
            stack.append((start, bool(HEADER.search(before)) and not CONTROL.search(before)))
        elif stack:
            at, is_function = stack.pop()
            if is_function:
                found.append((at + 1, start))
    return found


def python_bodies(text: str, keep_docstrings: bool = False) -> list[tuple[int, int]]:
    """From the first character of a def's body to the end of its last line; the documentation string aside if it is to stay."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    ends = [s - 1 for s in starts[1:]] + [len(text)]
    lines = [text[s:e].rstrip("\r") for s, e in zip(starts, ends)]
    indents = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    found = []
    for k, line in enumerate(lines):
        if not DEF.match(line):
            continue
        inside = []
        for j in range(k + 1, len(lines)):
            if indents[j] is None:
                continue
            if indents[j] <= indents[k]:
                break
            inside.append(j)
        if inside and keep_docstrings:
            m = re.match(r"""\s*(\"{3}.*?\"{3}|'{3}.*?'{3}|"[^"\n]*"|'[^'\n]*')\s*?(?=\n|\Z)""", text[starts[inside[0]] : ends[inside[-1]]], re.S)
            inside = [j for j in inside if not m or starts[j] >= starts[inside[0]] + m.end()]
        if inside:
            found.append((starts[inside[0]] + indents[inside[0]], ends[inside[-1]]))
    return found


def without_overlaps(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """By start, the longer first; those that start inside one kept before are dropped."""
    kept, end = [], 0
    for s in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


def bare(text: str, language: str) -> str:
    """The text without comments and strings."""
    if language == "python":
        return "".join(m[0] for m in PYTHON.finditer(text) if m.lastgroup not in ("comment", "string", "short"))
    return "".join(text[s:e] for k, s, e in script_tokens(text) if k not in ("comment", "string"))


def regions(text: str, language: str | None, keep_docstrings: bool = False, least: int = REGION_LEAST) -> list[tuple[int, int]]:
    """Function bodies worth eliding: long enough, and not only comments and strings."""
    if language == "python":
        spans = python_bodies(text, keep_docstrings)
    elif language in ("typescript", "javascript"):
        spans = script_bodies(text)
    else:
        return []
    return [(s, e) for s, e in without_overlaps(spans) if e - s >= least and bare(text[s:e], language).strip()]


def statements(text: str, start: int, end: int, language: str) -> list[tuple[int, int]]:
    """A body's statements at its own depth; none unless they cover three quarters of its text."""
    body, cuts = text[start:end], []
    if language == "python":
        first = None
        depth = start - (text.rfind("\n", 0, start) + 1)
        pos = start
        for line in body.splitlines(keepends=True):
            lead = len(line) - len(line.lstrip())
            at_depth = pos == start or lead == depth
            if line.strip() and at_depth:
                if first is not None:
                    cuts.append((first, pos))
                first = pos if pos == start else pos + lead
            pos += len(line)
        if first is not None:
            cuts.append((first, end))
        cuts = [(s, s + len(text[s:e].rstrip())) for s, e in cuts]
    else:
        depth, first = 0, None
        for kind, s, e in script_tokens(body):
            if kind in ("space", "comment"):
                continue
            first = s if first is None else first
            if kind == "bracket":
                depth += 1 if body[s] in "([{" else -1
            if depth == 0 and (body[s:e] == ";" or body[s] == "}"):
                cuts.append((start + first, start + e))
                first = None
    size = sum(e - s for s, e in cuts)
    return cuts if len(cuts) > 1 and size * 4 >= len("".join(body.split())) * 3 else []
