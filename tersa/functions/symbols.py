"""Symbols, structural markers, imports and exports of a text, as arrays of tagged strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions.directives import prose_regions
from tersa.functions.text import BRAND, ascii_bounds, strip

#: Patterns of what counts as a symbol, and names that are no methods.
JS_FUNCTION, PY_FUNCTION = r"(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)", r"def\s+([A-Za-z_][A-Za-z0-9_]*)"
TYPE = r"(?:export\s+)?(?:class|interface|type|enum|struct)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
VARIABLE = r"(?m)^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*="
JS_IMPORT = r"""import\s+(?:[\w$*{}min\s,]+from\s+)?['"]([^'"]+)['"]"""
PY_IMPORT = r"(?:^|\n)\s*(?:import\s+([A-Za-z0-9_.]+)|from\s+([A-Za-z0-9_.]+)\s+import)"
METHOD = r"(?:public|private|protected|async|static|get|set)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
NO_METHOD = "if while for switch catch function constructor return import export class interface type enum def typeof instanceof".split()
JSON_KEY = r'"([^"\\]+)":'
PRESERVE = BRAND.upper() + r"_PRESERVE:[^\s>\n]+"
HEADING, FENCE, SECTION = r"^#{1,6}\s+", r"^```", r"(?i)^(?:---|===|System:|User:|Assistant:|\[Context\]|\[Instructions\])"
JS_FROM, JS_CALL = r"""\b(?:import|export)\s+(?:[\s\S]*?\s+from\s+)?['"]([^'"]+)['"]""", r"""\b(?:require|import)\s*\(\s*['"]([^'"]+)['"]\s*\)"""


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), F.lit(group))


def tagged(tag: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(tag + ":"), n))


def symbols(text: Column, content_type: Column) -> Column:
    """Distinct symbols: fn:, type:, var:, import:, method: and, of JSON, jsonkey:. Missing texts have none."""
    text = F.coalesce(text, F.lit(""))
    functions = F.concat(every(text, JS_FUNCTION), every(text, PY_FUNCTION))
    py_imports = F.filter(F.concat(every(text, PY_IMPORT, 1), every(text, PY_IMPORT, 2)), lambda x: x != "")
    methods = F.filter(every(text, METHOD), lambda m: ~m.isin(*NO_METHOD) & ~F.array_contains(functions, m))
    keys = F.when(content_type == "json", tagged("jsonkey", every(text, JSON_KEY))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        tagged("fn", functions),
        tagged("type", every(text, TYPE)),
        tagged("var", every(text, VARIABLE)),
        tagged("import", F.concat(every(text, JS_IMPORT), py_imports)),
        tagged("method", methods),
        keys,
    )
    return F.array_distinct(found)


def content_markers(text: Column, content_type: Column) -> Column:
    """Distinct structural markers: headings, fences and sections of Markdown, and preservation tags (in code, of its comments)."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    of = lambda tag, pattern: tagged(tag, F.filter(lines, lambda x: x.rlike(pattern)))
    structure = F.when(content_type == "markdown", F.concat(of("heading", HEADING), of("fence", FENCE), of("section", SECTION))).otherwise(F.array().cast("array<string>"))
    source = F.when(content_type == "code", prose_regions(text, content_type)).otherwise(text)
    kept = F.when(text.contains("_PRESERVE:"), tagged("directive", every(source, f"({PRESERVE})"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(structure, kept))


def markers(text: Column, content_type: Column, path: Column, directives: Column) -> Column:
    """content_markers() with the item's path and recorded directives."""
    named = F.when(path.isNotNull(), F.array(F.concat(F.lit("filepath:"), path))).otherwise(F.array().cast("array<string>"))
    recorded = tagged("directive", F.coalesce(directives, F.array().cast("array<string>")))
    return F.array_distinct(F.concat(named, content_markers(text, content_type), recorded))


def retention(before: Column, after: Column) -> Column:
    """Share of a set that another still has; 1 for the empty set."""
    return F.when(F.size(before) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(before, after)) / F.size(before))


def python_imports(text: Column) -> Column:
    """struct(dots, module) per import of a module, in order of lines; dots is the number of leading dots."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda x: x.rlike(r"(?i)^(?:from|import)\s"))

    def of(line: Column) -> Column:
        dots = F.length(F.regexp_extract(line, r"(?i)^from\s+(\.*)", 1))
        from_ = F.regexp_extract(line, r"(?i)^from\s+\.*([a-zA-Z0-9_.]*)\s+import\s+", 1)
        names = F.split(F.regexp_extract(line, r"(?i)^import\s+([a-zA-Z0-9_.,\s]+)", 1), ",")
        plain = F.filter(F.transform(names, lambda n: strip(F.element_at(F.split(strip(n), r"\s+as\s+"), 1))), lambda n: n != "")
        single = F.array(F.struct(dots.alias("dots"), from_.alias("module")))
        many = F.transform(plain, lambda n: F.struct(F.lit(0).alias("dots"), n.alias("module")))
        return F.when(line.rlike(r"(?i)^from\s+\.*[a-zA-Z0-9_.]*\s+import\s+"), single).otherwise(many)

    return F.filter(F.flatten(F.transform(lines, of)), lambda m: (m["dots"] > 0) | (m["module"] != ""))


def script_imports(text: Column) -> Column:
    """Distinct specifiers of import, export from, require and dynamic import."""
    return F.array_distinct(F.concat(every(text, JS_FROM), every(text, JS_CALL)))


def exports(text: Column, language: Column) -> Column:
    """Distinct exported names: of scripts by declaration, list (by its alias) and default; of Python public definitions and __all__."""
    declared = every(text, r"\bexport\s+(?:async\s+)?(?:const|let|var|function|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)")
    lists = F.flatten(F.transform(every(text, r"\bexport\s*\{([^}]*)\}"), lambda x: F.split(x, ",")))
    named = F.filter(F.transform(lists, lambda x: F.element_at(F.split(strip(x), r"\s+as\s+"), -1)), lambda x: x != "")
    default = F.when(text.rlike(ascii_bounds(r"\bexport\s+default\b")), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    public = F.filter(every(text, r"(?m)^(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"), lambda x: ~x.startswith("_"))
    listed = every(F.regexp_extract(text, r"(?s)__all__\s*=\s*[\[(](.*?)[\])]", 1), r"['\"]([^'\"]+)['\"]")
    return F.array_distinct(F.when(language == "python", F.concat(public, listed)).otherwise(F.concat(declared, named, default)))
