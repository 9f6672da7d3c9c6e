"""Small text functions: white space, hashes, previews, paths, escapes, languages, markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BRAND = "tersa"
MARKER = r"\[" + BRAND + r": (\d+) ([a-z-]+) lines? elided, (\d+) bytes, sha256:([0-9a-f]{12,64})\]"
SESSION_MARKER = r"\[" + BRAND + r" Elided: ref=([0-9a-f]{12}) bytes=(\d+) kind=([a-z_]+)\]"
#: The older form of a reference, which is still read: a hash, or its beginning, on its own.
BLOCK_MARKER = r"<BLOCK_HASH:([0-9a-f]{12,64})>"
JSON_KEY = "__" + BRAND + "_block__"

#: Spellings of a language and its canonical name; kinds of content that are not code.
ALIASES = {
    "typescript": ["ts", "tsx", "typescript"],
    "javascript": ["js", "jsx", "cjs", "mjs", "javascript"],
    "python": ["py", "python", "python3"],
    "go": ["go", "golang"],
    "rust": ["rs", "rust"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "c++", "cc", "hpp"],
    "shell": ["sh", "bash", "zsh", "shell"],
    "powershell": ["ps1", "powershell"],
    "css": ["css"],
    "scss": ["scss"],
    "sql": ["sql"],
    "json": ["json"],
    "yaml": ["yml", "yaml"],
    "html": ["htm", "html"],
    "markdown": ["md", "markdown"],
    "logs": ["log", "logs"],
    "text": ["txt", "text", "plaintext"],
}
PLAIN_LANGUAGES = ("json", "yaml", "html", "markdown", "logs", "text")
CODE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "cjs", "mjs", "py", "go", "rs", "java", "c", "cpp", "h", "hpp", "sh", "ps1", "css", "scss", "sql")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with \b between ASCII word characters and others only, as patterns here mean it; Java's own looks at all letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() knows spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def role_hash(role: Column, text: Column) -> Column:
    """Key of a message by role and content."""
    return F.sha2(F.concat_ws("\x01", F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))), 256)


def preview(text: Column, n: int = 80) -> Column:
    return F.substring(text, 1, n)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot; the whole path if it has none; empty for null."""
    return F.lower(F.element_at(F.split(F.coalesce(path, F.lit("")), r"\."), -1))


def normalize_language(language: Column) -> Column:
    """Canonical name of a declared language, null if unknown."""
    spelled = F.create_map(*(F.lit(x) for name, names in ALIASES.items() for alias in names for x in (alias, name)))
    return F.try_element_at(spelled, F.lower(strip(language)))


def language_content_type(language: Column) -> Column:
    """What kind of content a canonical language is."""
    return F.when(language.isin(*PLAIN_LANGUAGES), language).when(language.isNotNull(), "code")


def normalize_path(path: Column) -> Column:
    """Slashes forward, no leading ./ ."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def resolve_path(base: Column, relative: Column) -> Column:
    """A relative path from the folder of base, with . and .. folded."""
    parts = F.filter(F.concat(F.slice(F.split(base, "/"), 1, F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0))), F.split(relative, "/")), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done),
    )
    return F.array_join(folded, "/")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


#: What an elided item of a content type is called.
NOUNS = {"code": "code", "json": "json", "yaml": "yaml", "html": "html", "logs": "log", "markdown": "markdown", "text": "text"}
BODY_NOUN = "function-body"


def noun(content_type: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in NOUNS.items() for x in pair))
    return F.coalesce(F.try_element_at(named, content_type), F.lit("content"))


def elision_marker(text: Column, noun_: Column) -> Column:
    """What stands for an elided text: its lines, characters and the start of its hash."""
    n = line_count(text)
    lines = F.when(n == 1, " line elided, ").otherwise(" lines elided, ")
    return F.concat(F.lit(f"[{BRAND}: "), n.cast("string"), F.lit(" "), noun_, lines, F.length(text).cast("string"), F.lit(" bytes, sha256:"), F.substring(content_hash(text), 1, 12), F.lit("]"))


def session_marker(text: Column, kind: Column) -> Column:
    return F.concat(F.lit(f"[{BRAND} Elided: ref="), F.substring(content_hash(text), 1, 12), F.lit(" bytes="), F.length(text).cast("string"), F.lit(" kind="), kind, F.lit("]"))


def wrap_json_marker(marker: Column) -> Column:
    return F.to_json(F.struct(marker.alias(JSON_KEY)))


def unwrap_json_marker(text: Column) -> Column:
    """The marker of a wrapped JSON item, null for other texts."""
    return F.get_json_object(text, f"$.{JSON_KEY}")


def has_marker(text: Column) -> Column:
    return (text.contains(f"[{BRAND}") & (text.rlike(MARKER) | text.rlike(SESSION_MARKER))) | text.rlike(BLOCK_MARKER)


def marker_refs(text: Column) -> Column:
    """References of all markers in a text, in order of kinds."""
    every = (F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p, group in ((MARKER, 4), (SESSION_MARKER, 1), (BLOCK_MARKER, 1)))
    return F.concat(*every)


def marker_texts(text: Column) -> Column:
    """All markers in a text as they stand there, in order of kinds."""
    return F.concat(*(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in (MARKER, SESSION_MARKER, BLOCK_MARKER)))


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two word sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Words that are no identifiers of a prompt's own, in any case.
RESERVED = (
    "def", "class", "import", "from", "return", "function", "export", "const", "let", "var", "if", "else", "for", "while", "in", "and", "or", "not",
    "true", "false", "none", "null", "undefined", "type", "interface", "public", "private", "protected", "async", "await", "str", "int", "float",
    "bool", "list", "dict", "set", "tuple", "any", "string", "number", "boolean", "void",
)


def key_symbols(text: Column) -> Column:
    """Distinct identifiers of two characters or more that are not reserved."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_bounds(r"\b([A-Za-z_]\w+)")), F.lit(1)))
    return F.filter(found, lambda w: ~F.lower(w).isin(*RESERVED))


def symbol_preservation(before: Column, after: Column) -> Column:
    """Share of the prompt's identifiers that the output still has as words; 1 if there are none."""
    keys = key_symbols(before)
    words = F.array_distinct(F.regexp_extract_all(after, F.lit(r"(\w+)"), F.lit(1)))
    return F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(keys, words)) / F.size(keys))
