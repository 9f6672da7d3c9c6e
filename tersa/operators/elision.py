"""Which items may be elided, what whole items become, session dedup and ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersa.functions import symbols as S
from tersa.functions import text as T
from tersa.functions.tokens import class_counts, token_estimate, tokens_of_counts

SHORTEST, REGION_LEAST = 40, 104
#: Content that came as blocks: the JSON text of an array of objects.
STRUCTURED = r"^\s*\[\s*\{"


def eligibility(items: DataFrame, preserve: tuple[str, ...] = (), shortest: int = SHORTEST) -> DataFrame:
    """items with marker, preserved, is_system, already, structured, too_short, saves, reducible and eligible, all without a shuffle.

    already: the item holds a marker from before. structured: its content came as an array of blocks, as the column of that
    name says where items have one, else the content itself.
    """
    kept = F.coalesce(F.col("kind").isin(*preserve), F.lit(False)) if preserve else F.lit(False)
    blocks = F.col("structured") if "structured" in items.columns else F.col("content").rlike(STRUCTURED)
    return (
        items.withColumn("marker", T.elision_marker(F.col("content"), T.noun(F.col("content_type"))))
        .withColumn("preserved", kept)
        .withColumn("is_system", F.coalesce(F.col("role") == "system", F.lit(False)))
        .withColumn("already", F.coalesce(T.has_marker(F.col("content")), F.lit(False)))
        .withColumn("structured", F.coalesce(blocks, F.lit(False)))
        .withColumn("too_short", F.length("content") < shortest)
        .withColumn("saves", F.length("marker") < F.length("content"))
        .withColumn("reducible", F.coalesce(F.col("language").isin("python", "typescript"), F.lit(False)))
        .withColumn("eligible", ~F.col("preserved") & ~F.col("is_system") & ~F.col("already") & ~F.col("structured") & ~F.col("too_short") & F.col("saves"))
    )


def has_symbols(content: Column, content_type: Column) -> Column:
    """Whole items with symbols are not elided: nothing would witness what they held."""
    return F.size(S.symbols(content, content_type)) > 0


def token_ceiling(tokens: Column, most: Column, ratio: Column) -> Column:
    """The lesser of a token limit and the share a reduction leaves; null if neither is set."""
    by_ratio = F.when(ratio > 0, F.floor(tokens * (F.lit(1.0) - ratio)).cast("long"))
    return F.least(F.when(most > 0, most), by_ratio)


def elide_to_ceiling(items: DataFrame, ratio: float, preserve: tuple[str, ...] = ()) -> DataFrame:
    """Replace eligible whole items by markers, in order, until their bundle's tokens are within its ceiling.

    An item is elided while the bundle, after the ones elided before it, is still above the ceiling: a running sum of what
    eligible items before it save. Adds original_content, tokens, saved, elided; content is the marker where elided.
    """
    e = eligibility(items, preserve)
    e = e.withColumn("tokens", token_estimate(F.col("content"))).withColumn("can", F.col("eligible") & ~has_symbols(F.col("content"), F.col("content_type")))
    e = e.withColumn("saved", F.when(F.col("can"), F.col("tokens") - token_estimate(F.col("marker"))).otherwise(F.lit(0).cast("long")))
    order, bundle = Window.partitionBy("bundle_id").orderBy("ord"), Window.partitionBy("bundle_id")
    before = F.coalesce(F.sum("saved").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("tokens").over(bundle)
    ceiling = token_ceiling(total, F.lit(None).cast("long"), F.lit(ratio))
    elided = F.col("can") & (F.col("saved") > 0) & (total - before > ceiling)
    return e.withColumn("elided", F.coalesce(elided, F.lit(False))).withColumn("original_content", F.col("content")).withColumn("content", F.when(F.col("elided"), F.col("marker")).otherwise(F.col("content")))


def seen_before(turns: DataFrame) -> DataFrame:
    """turns with content_hash and seen: whether an earlier turn of the session had the content."""
    h = turns.withColumn("content_hash", T.content_hash(F.col("content")))
    return h.withColumn("seen", F.min("turn").over(Window.partitionBy("session_id", "content_hash")) < F.col("turn"))


def session_dedup(turns: DataFrame) -> DataFrame:
    """seen_before() with copies, nth and decision: keep, referent, recoverable or lossy.

    Of seen content a turn's first copy is the referent of the later ones, which can be recovered from it; a sole copy is lossy.
    """
    within = Window.partitionBy("session_id", "turn", "content_hash")
    d = seen_before(turns).withColumn("copies", F.count("*").over(within)).withColumn("nth", F.row_number().over(within.orderBy("ord")))
    decision = F.when(~F.col("seen"), "keep").when(F.col("nth") > 1, "recoverable").when(F.col("copies") == 1, "lossy").otherwise("referent")
    return d.withColumn("decision", decision)


def prefix_locked(items: DataFrame, horizon: int = 1024, preserve: tuple[str, ...] = ()) -> DataFrame:
    """items with tokens, prefix_locked and pinned: a bundle's first items, up to the one that crosses the horizon, stay where caches find them."""
    order = Window.partitionBy("bundle_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    weighed = items.withColumn("tokens", token_estimate(F.col("content"))).withColumn("prefix_locked", F.coalesce(F.sum("tokens").over(order), F.lit(0)) < horizon)
    from tersa.functions.directives import directives

    has_constraint = F.size(directives(F.when(F.col("content_type") != "code", F.col("content")))) > 0
    kept = F.col("kind").isin(*preserve) if preserve else F.lit(False)
    return weighed.withColumn("has_constraint", has_constraint).withColumn("pinned", F.col("prefix_locked") | F.coalesce(F.col("role") == "system", F.lit(False)) | kept | F.col("has_constraint"))


def newest(rows: DataFrame, keys: list[str], touched: str, cap: int) -> DataFrame:
    """The `cap` rows of each group that were touched last; ties go by the row's hash."""
    order = Window.partitionBy(*keys).orderBy(F.desc(touched), F.xxhash64(*rows.columns))
    return rows.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= cap).drop("_nth")


def bundle_tokens(items: DataFrame, content: str = "content") -> DataFrame:
    """bundle_id, n_tokens of the contents joined by newlines."""
    c = items.select("bundle_id", class_counts(F.col(content)).alias("c"))
    sums = c.groupBy("bundle_id").agg(*(F.sum(f"c.{k}").alias(k) for k in ("word", "punct", "space", "wide")), F.count("*").alias("n"))
    return sums.select("bundle_id", tokens_of_counts(F.col("word"), F.col("punct"), F.col("space") + F.col("n") - 1, F.col("wide")).alias("n_tokens"))
