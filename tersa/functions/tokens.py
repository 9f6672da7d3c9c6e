"""Token estimates from counts of four character classes.

The estimate of several texts joined by newlines is computed from the sums of their counts, so a bundle's tokens are a plain
sum with partial aggregation; texts are never concatenated to be counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sized

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions.text import let

#: Weight per character of a class, and the classes as regular expressions of what to drop to count the rest.
WEIGHTS = {"word": 0.22, "punct": 0.55, "space": 0.35, "wide": 1.1}
SPACE, PUNCT, WIDE = r"[^ \t\n\r]", r"[^!-/:-@\[-`{-~]", r"[\x00-\x7F]"


def class_counts(text: Column) -> Column:
    """struct(word, punct, space, wide): code points of each class; zeros for null. Each is counted once, whoever reads the fields.

    What is not of a class is dropped by runs, so the work is a match a run and not one a character; a text has characters
    beyond ASCII only if it has more bytes than characters.
    """

    def of(t: Column) -> Column:
        count = lambda drop: F.length(F.regexp_replace(t, drop + "+", "")).cast("long")
        wide = F.when(F.octet_length(t) == F.length(t), F.lit(0).cast("long")).otherwise(count(WIDE))
        return F.struct(F.length(t).cast("long").alias("all"), count(PUNCT).alias("punct"), count(SPACE).alias("space"), wide.alias("wide"))

    named = lambda c: F.struct((c["all"] - c["space"] - c["punct"] - c["wide"]).alias("word"), c["punct"].alias("punct"), c["space"].alias("space"), c["wide"].alias("wide"))
    return let(of(F.coalesce(text, F.lit(""))), named)


def tokens_of_counts(word: Column, punct: Column, space: Column, wide: Column) -> Column:
    """Tokens from summed class counts: at least 1 for any character, 0 for none."""
    raw = word * F.lit(WEIGHTS["word"]) + punct * F.lit(WEIGHTS["punct"]) + space * F.lit(WEIGHTS["space"]) + wide * F.lit(WEIGHTS["wide"])
    return F.when(word + punct + space + wide == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1), F.ceil(raw)).cast("long"))


def token_estimate(text: Column, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of a text: by ``tokenizer``, a function of columns such as counted_by() makes, or by the classes of its characters."""
    if tokenizer is not None:
        return tokenizer(F.coalesce(text, F.lit(""))).cast("long")
    return let(class_counts(text), lambda c: tokens_of_counts(*(c[k] for k in ("word", "punct", "space", "wide"))))


def counted_by(encode: Callable[[str], Sized]) -> Callable[[Column], Column]:
    """A hook for an exact tokenizer: ``encode`` gives a text's tokens, in Python behind Arrow; only their number comes back."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)))

    return count


def joined_tokens(counts: Column) -> Column:
    """Aggregate: the estimate of the group's texts joined by newlines, from a column of class_counts()."""
    sums = [F.sum(counts[k]) for k in ("word", "punct", "space", "wide")]
    return tokens_of_counts(sums[0], sums[1], sums[2] + F.count("*") - 1, sums[3])
