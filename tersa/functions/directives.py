"""Imperative directives: the sentences of a text that instruct, and the keywords they instruct with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions.text import ascii_bounds, strip

#: Keywords of instruction; the two of them that may narrate; irregular past forms.
KEYWORD = r"(?i)\b(must(?:\s+not)?|never|always|only\s+if|do\s+not|required|except\s+when|make\s+sure\s+to|critical)\b"
MAY_NARRATE = r"(?:never|always)"
PAST = (
    "did", "was", "were", "had", "got", "made", "took", "ran", "read", "said", "meant", "came", "went", "saw", "knew", "found", "left", "felt",
    "kept", "held", "told", "became", "began", "broke", "brought", "built", "chose", "drew", "drove", "fell", "flew", "gave", "grew", "hit", "lay",
    "led", "lost", "met", "paid", "put", "sent", "set", "shot", "shut", "sold", "spent", "stood", "struck", "swore", "threw", "understood",
    "withdrew", "wrote", "worked", "wanted", "needed", "existed", "reached", "shipped", "fired", "failed", "passed", "stopped", "started", "used",
)
NARRATIVE = rf"(?i)\b(?:have|has|had)\s+(?:\w+\s+){{0,2}}{MAY_NARRATE}\b|\b{MAY_NARRATE}\s+(?:have|has|had)\b|\b{MAY_NARRATE}\s+(?:\w+ed|{'|'.join(PAST)})\b"
PROSE_TYPES = ("text", "markdown", "logs", "unknown")
SEGMENT = r"([^.!?;]+[.!?;]?)"
_KEYWORD, _NARRATIVE = ascii_bounds(KEYWORD), ascii_bounds(NARRATIVE)


def prose_regions(text: Column, content_type: Column) -> Column:
    """The lines that speak to a reader: all of prose; of other content comments and documentation strings.

    A fold over the lines keeps what is open ('' for nothing, '*' for a block comment, or the quotes of a documentation string).
    """
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        keep = F.concat(acc["out"], F.array(line))
        state = lambda out, open_: F.struct(out.alias("out"), open_.alias("open"))
        quotes = F.substring(bare, 1, 3)
        one_line = (F.length(bare) >= 6) & F.contains(F.substring(bare, 4, 1 << 30), quotes)
        return (
            F.when(acc["open"] == "*", state(keep, F.when(bare.contains("*/"), "").otherwise("*")))
            .when(acc["open"] != "", state(keep, F.when(F.contains(bare, acc["open"]), F.lit("")).otherwise(acc["open"])))
            .when(quotes.isin('"""', "'''"), state(keep, F.when(one_line, F.lit("")).otherwise(quotes)))
            .when(bare.startswith("/*"), state(keep, F.when(bare.contains("*/"), "").otherwise("*")))
            .when(bare.rlike(r"^(?://|#|--|\*)"), state(keep, F.lit("")))
            .otherwise(acc)
        )

    folded = F.aggregate(F.split(text, "\r?\n"), zero, step, lambda acc: F.array_join(acc["out"], "\n"))
    return F.when(content_type.isin(*PROSE_TYPES), text).otherwise(folded)


def keyword_hits(segment: Column) -> Column:
    return F.regexp_extract_all(segment, F.lit(_KEYWORD), F.lit(1))


def is_directive(segment: Column) -> Column:
    """A segment with a keyword, unless all its keywords may narrate and it is told in the past."""
    only_narrative = F.forall(keyword_hits(segment), lambda k: k.rlike(rf"(?i)^{MAY_NARRATE}\z"))
    return segment.rlike(_KEYWORD) & ~(only_narrative & segment.rlike(_NARRATIVE))


def directives(text: Column) -> Column:
    """Instructing segments in order, repeated ones as often as they occur."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: x.rlike(_KEYWORD))

    def segments(line: Column) -> Column:
        bare = strip(line)
        found = F.regexp_extract_all(bare, F.lit(SEGMENT), F.lit(1))
        return F.filter(F.transform(F.when(F.size(found) == 0, F.array(bare)).otherwise(found), strip), lambda s: (s != "") & is_directive(s))

    return F.flatten(F.transform(lines, segments))


def keywords(found: Column) -> Column:
    """Distinct keywords of directives, white space as single blanks; 'must not' adds 'must' in the case of its first letter."""

    def named(hit: Column) -> Column:
        plain = F.regexp_replace(hit, r"\s+", " ")
        return F.when(F.upper(plain).startswith("MUST "), F.array(plain, F.when(plain.rlike("^[A-Z]"), "MUST").otherwise("must"))).otherwise(F.array(plain))

    return F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(found, keyword_hits)), named)))


def has_keyword(text: Column) -> Column:
    """Any keyword anywhere, whatever it is used for."""
    return text.rlike(_KEYWORD)
