"""Bundle statistics, ledger confidence, debt, drift, and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("prompt", "file", "diff", "conversation", "note")
CONTENT_TYPES = ("text", "markdown", "code", "html", "json", "yaml", "logs", "unknown")
#: Decay a turn, gain a reference and its cap; weights of the debt; drift's terms and gate.
DECAY, GAIN, MOST_GAIN = 0.9, 0.15, 0.3
DEBT_CONFIDENCE, DEBT_RATIO, DEBT_AGE, DEBT_LIMIT = 50.0, 35.0, 1.5, 75.0
DRIFT_SYMBOLS, DRIFT_MARKERS, DRIFT_LIMIT, CONFIDENCE_LIMIT = 0.6, 0.4, 0.4, 0.7


def bundle_statistics(items: DataFrame) -> DataFrame:
    """bundle_id, n_items, total_chars and a zero-filled count per kind and content type: one pass, no pivot pass to find values."""
    counts = [F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in KINDS] + [F.count_if(F.col("content_type") == c).alias(f"type_{c}") for c in CONTENT_TYPES]
    return items.groupBy("bundle_id").agg(F.count("*").alias("n_items"), F.sum(F.length("content").cast("long")).alias("total_chars"), *counts)


def confidence(initial: Column, age: Column, references: Column) -> Column:
    """Trust in an elision: it decays by turns and gains by references; within 0 and 1."""
    raw = initial * F.pow(F.lit(DECAY), age) + F.least(F.lit(MOST_GAIN), (references - 1) * F.lit(GAIN))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def ledger(events: DataFrame, now: Column | None = None) -> DataFrame:
    """session_id, item_id, first_turn, last_turn, references, confidence from events (session_id, item_id, turn): the first elides, later ones access."""
    seen = events.groupBy("session_id", "item_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("references"))
    last = events.groupBy("session_id").agg(F.max("turn").alias("now"))
    joined = seen.join(last, "session_id")
    return joined.withColumn("confidence", confidence(F.lit(1.0), (now if now is not None else F.col("now")) - F.col("last_turn"), F.col("references"))).drop("now")


def overall_confidence(confidences: Column) -> Column:
    """Aggregate: the least of a session; 1 for none."""
    return F.coalesce(F.min(confidences), F.lit(1.0))


def debt(confidence_: Column, elided: Column, total: Column, age: Column) -> Column:
    """Context debt, 0 to 100; above DEBT_LIMIT a bundle is rehydrated."""
    ratio = F.when(total > 0, elided / total).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(DEBT_CONFIDENCE) * (1 - confidence_) + F.lit(DEBT_RATIO) * ratio + F.lit(DEBT_AGE) * F.coalesce(age, F.lit(0))))


def drift(symbols: Column, markers: Column, has_symbols: Column, has_markers: Column) -> Column:
    """1 - weighted retention; a term alone takes all weight, none means no drift."""
    weight = F.when(has_symbols, F.lit(DRIFT_SYMBOLS)).otherwise(F.lit(0.0)) + F.when(has_markers, F.lit(DRIFT_MARKERS)).otherwise(F.lit(0.0))
    kept = F.when(has_symbols, F.lit(DRIFT_SYMBOLS) * symbols).otherwise(F.lit(0.0)) + F.when(has_markers, F.lit(DRIFT_MARKERS) * markers).otherwise(F.lit(0.0))
    return F.when(weight == 0, F.lit(0.0)).otherwise(1 - kept / weight)


def set_retention(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """bundle_id, n, kept: distinct tags of before (bundle_id, tag) and how many of them after has.

    Tags are rows, so that a bundle's sets never have to fit into one; two partial aggregations and a join on (bundle, tag).
    """
    b = before.distinct()
    hit = b.join(after.distinct().withColumn("hit", F.lit(1)), ["bundle_id", "tag"], "left")
    return hit.groupBy("bundle_id").agg(F.count("*").alias(f"n_{name}"), F.count("hit").alias(f"kept_{name}"))


def bundle_drift(pairs: DataFrame) -> DataFrame:
    """bundle_id, symbol_retention, marker_retention, drift, refused from pairs (bundle_id, symbols_before, symbols_after, markers_before, markers_after)."""
    tags = lambda c: pairs.select("bundle_id", F.explode(c).alias("tag"))
    s = set_retention(tags("symbols_before"), tags("symbols_after"), "symbols")
    m = set_retention(tags("markers_before"), tags("markers_after"), "markers")
    every = pairs.select("bundle_id").distinct().join(s, "bundle_id", "left").join(m, "bundle_id", "left")
    rate = lambda n: F.when(F.coalesce(F.col(f"n_{n}"), F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col(f"kept_{n}") / F.col(f"n_{n}"))
    out = every.withColumn("symbol_retention", rate("symbols")).withColumn("marker_retention", rate("markers"))
    d = drift(F.col("symbol_retention"), F.col("marker_retention"), F.coalesce(F.col("n_symbols"), F.lit(0)) > 0, F.coalesce(F.col("n_markers"), F.lit(0)) > 0)
    return out.withColumn("drift", d).withColumn("refused", F.col("drift") > DRIFT_LIMIT).select("bundle_id", "symbol_retention", "marker_retention", "drift", "refused")


def p95(runs: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """groups (null in roll-ups), level and the value at floor(0.95 n) of the sorted ones, the last at most; exact.

    Values are counted by group first; a window sums up the counts, so a group costs as many rows as it has different values.
    """
    per = runs.groupBy(*groups, value).agg(F.count("*").alias("n"))
    out = None
    for k in range(len(groups) + 1):
        keys = groups[:k]
        counted = per.groupBy(*keys, value).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys).orderBy(value)
        total, upto = F.sum("n").over(Window.partitionBy(*keys)), F.sum("n").over(w)
        at = F.least(total - 1, F.floor(total * F.lit(0.95)))
        one = counted.withColumn("hit", (upto > at) & (upto - F.col("n") <= at)).filter("hit")
        one = one.select(*keys, *(F.lit(None).cast(runs.schema[g].dataType).alias(g) for g in groups[k:]), F.lit((1 << (len(groups) - k)) - 1).cast("long").alias("level"), F.col(value).alias(f"{value}_p95"))
        out = one if out is None else out.unionByName(one)
    return out


def bench_summary(runs: DataFrame, *groups: str) -> DataFrame:
    """Means of reduction, fallback, latency, syntax and pass rates, the sum of issues and p95 of the latency, by groups and over all (rollup)."""
    means = runs.rollup(*groups).agg(
        F.count("*").alias("n"),
        F.avg("reduction").alias("reduction"),
        F.avg(F.col("fallback").cast("double")).alias("fallback_rate"),
        F.avg("latency").alias("latency"),
        F.avg(F.col("syntax_ok").cast("double")).alias("syntax_rate"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.sum("issues").alias("issues"),
        F.grouping_id().cast("long").alias("level"),
    )
    late = p95(runs, "latency", list(groups)).select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("level").alias("_level"), "latency_p95")
    same = F.col("level") == F.col("_level")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return means.join(late, same, "left").drop("level", "_level", *(f"_{g}" for g in groups))


def check_coverage(items: DataFrame) -> DataFrame:
    """bundle_id, checked, unchecked, unchecked_types, languages, reducible: what the balance checks and region selectors can speak for."""
    from tersa.operators.scanners import validator

    c = items.withColumn("check", validator(F.col("language"), F.col("path"), F.col("content_type")))
    return c.groupBy("bundle_id").agg(
        F.count("check").alias("checked"),
        F.count_if(F.col("check").isNull()).alias("unchecked"),
        F.sort_array(F.collect_set(F.when(F.col("check").isNull(), F.col("content_type")))).alias("unchecked_types"),
        F.sort_array(F.collect_set("language")).alias("languages"),
        F.bool_or(F.coalesce(F.col("language").isin("python", "typescript"), F.lit(False))).alias("reducible"),
    )


def wire_metrics(before: Column, after: Column) -> tuple[Column, Column]:
    """(tokens saved, never below 0; their share of what there was)."""
    saved = F.greatest(F.lit(0).cast("long"), before - after)
    return saved, F.when(before > 0, saved / before).otherwise(F.lit(0.0))


def round_scaled(value: Column, places: int) -> Column:
    """The double times 10^places, rounded with halves away from zero, and scaled back.

    DuckDB's round() does so on doubles; Spark's rounds the shortest decimal form, which differs at ties that doubles cannot hold.
    """
    scale = F.lit(10.0**places)
    return F.round(value * scale) / scale


def percent(share: Column) -> Column:
    """A share as text with two places, halves away from zero; format_number alone takes them to the even digit."""
    return F.concat(F.format_number(round_scaled(share * 100, 2), 2), F.lit("%"))
