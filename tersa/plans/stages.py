"""Stages that are compositions: recorded constraints, pruning on the import graph, deltas against base versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.functions import directives as D
from tersa.functions import text as T
from tersa.functions.tokens import token_estimate
from tersa.operators import diffs, graph, lookups, selection
from tersa.operators.elision import prefix_locked, token_ceiling


def preserve_constraints(items: DataFrame) -> DataFrame:
    """items with directives, keywords and has_constraint, read from the prose of each."""
    found = items.withColumn("directives", D.directives(D.prose_regions(F.col("content"), F.col("content_type"))))
    return found.withColumn("keywords", D.keywords(F.col("directives"))).withColumn("has_constraint", F.size("directives") > 0)


def prune(items: DataFrame, changed: DataFrame, status: DataFrame, ratio: float, horizon: int = 1024, preserve: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """items with distance, score, pinned, strategy and selected, under 1 - ratio of each bundle's tokens and ``most`` of them.

    changed (bundle_id, path) are the sources of distances; status (path, state) adds to scores. Pinned items always stay.
    """
    reached = graph.distances(graph.edges(items), changed)
    locked = prefix_locked(items, horizon, preserve)
    scored = graph.scores(locked, reached, status)
    total = F.sum("tokens").over(Window.partitionBy("bundle_id"))
    weighed = scored.withColumn("weight", F.col("tokens")).withColumn("value", F.col("score")).withColumn("budget", token_ceiling(total, F.lit(most).cast("long"), F.lit(ratio)))
    return selection.select(weighed)


def mean_distance(pruned: DataFrame) -> DataFrame:
    """bundle_id, n_selected, mean_distance of what was selected, over what was reached; 0 if nothing was."""
    kept = pruned.filter("selected")
    return kept.groupBy("bundle_id").agg(F.count("*").alias("n_selected"), F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean_distance"))


def delta(now: DataFrame, base: DataFrame) -> DataFrame:
    """item_id, content, delta: a header and the unified diff against the base version, where that is shorter than the content; else null."""
    found = lookups.base_versions(now, base)
    both = now.select("item_id", "path", "content").join(found.select("item_id", F.col("base")), "item_id", "left")
    old, new = T.content_hash(F.col("base")), T.content_hash(F.col("content"))
    label = F.coalesce(F.col("path"), F.lit(""))
    differs = both.filter(F.col("base").isNotNull() & (F.col("base") != F.col("content")))
    text = F.concat(F.lit(f"[{T.BRAND} Delta: path="), label, F.lit(" baseHash="), F.substring(old, 1, 12), F.lit("]\n"), diffs.unified_diff("base", "content", F.concat(F.lit("base:"), F.substring(old, 1, 8)), F.concat(F.lit("current:"), F.substring(new, 1, 8))))
    made = differs.select("item_id", text.alias("delta")).filter("delta IS NOT NULL")
    joined = both.select("item_id", "content").join(made, "item_id", "left")
    return joined.withColumn("delta", F.when(F.length("delta") < F.length("content"), F.col("delta")))


def skip_reasons(items: DataFrame) -> DataFrame:
    """bundle_id and how many items cannot be elided for want of savings, for being structured, or for symbols without a witness."""
    from tersa.operators.elision import eligibility, has_symbols

    e = eligibility(items)
    structured = F.col("structured")
    return e.groupBy("bundle_id").agg(
        F.count_if(~F.col("saves")).alias("no_savings"),
        F.count_if(structured).alias("structured_content"),
        F.count_if(F.col("saves") & ~structured & has_symbols(F.col("content"), F.col("content_type"))).alias("has_symbols"),
        F.sum(F.when(F.col("saves"), token_estimate(F.col("content")) - token_estimate(F.col("marker"))).otherwise(0)).alias("tokens_at_stake"),
    )
