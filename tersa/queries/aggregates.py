"""Aggregations and windows: survey rows A, L, W."""

from __future__ import annotations

from pyspark.sql import functions as F

from tersa.functions import directives, symbols
from tersa.operators import elision, metrics
from tersa.plans.recipes import items, run, turns, with_items
from tersa.queries import query
from tersa.queries.scalars import ESTIMATE, KEY, SEGMENTS, classes

COUNTS = ", ".join([f"count(*) FILTER (kind = '{k}') AS kind_{k}" for k in metrics.KINDS] + [f"count(*) FILTER (content_type = '{c}') AS type_{c}" for c in metrics.CONTENT_TYPES])


@query(with_items(f"SELECT bundle_id, count(*) AS n_items, CAST(sum(length(content)) AS BIGINT) AS total_chars, {COUNTS} FROM items GROUP BY bundle_id"))
def a1_bundle_statistics(spark, sf_dir):
    return metrics.bundle_statistics(items(spark, sf_dir))


@query(with_items(f"SELECT bundle_id, CAST(sum(len(d)) AS BIGINT) AS n_directives, count(*) FILTER (len(d) > 0) AS n_items FROM (SELECT bundle_id, {SEGMENTS} AS d FROM items WHERE content_type <> 'code') GROUP BY bundle_id"))
def a2_t1_directive_totals(spark, sf_dir):
    d = items(spark, sf_dir).filter("content_type <> 'code'").select("bundle_id", F.size(directives.directives(F.col("content"))).alias("n"))
    return d.groupBy("bundle_id").agg(F.sum("n").alias("n_directives"), F.count_if(F.col("n") > 0).alias("n_items"))


@query(with_items("SELECT session_id, turn, ord, count(*) OVER (PARTITION BY session_id, turn, sha256(content)) AS copies FROM turns"))
def a3_occurrences(spark, sf_dir):
    return elision.session_dedup(turns(spark, sf_dir)).select("session_id", "turn", "ord", "copies")


LEDGER = """SELECT session_id, item_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS refs, any_value(now) AS now FROM (SELECT session_id, doc_id AS item_id, turn, max(turn) OVER (PARTITION BY session_id) AS now FROM turns) GROUP BY session_id, item_id"""
CONFIDENCE = "least(1.0, greatest(0.0, pow(0.9::DOUBLE, now - last_turn) + least(0.3::DOUBLE, (refs - 1) * 0.15::DOUBLE)))"


@query(with_items(f"SELECT session_id, item_id, first_turn, last_turn, refs AS n_refs, round({CONFIDENCE}, 9) AS confidence, {CONFIDENCE} < 0.7 AS candidate FROM ({LEDGER})"))
def a7_l1_ledger(spark, sf_dir):
    made = metrics.ledger(turns(spark, sf_dir).select("session_id", F.col("doc_id").alias("item_id"), "turn"))
    return made.select("session_id", "item_id", "first_turn", "last_turn", F.col("references").alias("n_refs"), F.round("confidence", 9).alias("confidence"), (F.col("confidence") < metrics.CONFIDENCE_LIMIT).alias("candidate"))


@query(
    with_items(
        f"""SELECT session_id, round(conf, 9) AS confidence, round(least(100.0, greatest(0.0, 50.0 * (1 - conf) + 35.0 * elided / total + 1.5 * age)), 6) AS debt, least(100.0, greatest(0.0, 50.0 * (1 - conf) + 35.0 * elided / total + 1.5 * age)) > 75 AS rehydrate FROM (
 SELECT session_id, min({CONFIDENCE}) AS conf, any_value(now) - min(first_turn) AS age FROM ({LEDGER}) GROUP BY session_id) JOIN (
 SELECT session_id, CAST(sum(length(content)) FILTER (turn % 2 = 0) AS DOUBLE) AS elided, CAST(sum(length(content)) AS DOUBLE) AS total FROM turns GROUP BY session_id) USING (session_id)"""
    )
)
def a4_a6_debt(spark, sf_dir):
    t = turns(spark, sf_dir)
    led = metrics.ledger(t.select("session_id", F.col("doc_id").alias("item_id"), "turn"))
    n = F.length("content").cast("double")
    size = t.groupBy("session_id").agg(F.sum(F.when(F.col("turn") % 2 == 0, n)).alias("elided"), F.sum(n).alias("total"), F.max("turn").alias("now"))
    conf = led.groupBy("session_id").agg(metrics.overall_confidence(F.col("confidence")).alias("confidence"), F.min("first_turn").alias("oldest"))
    d = conf.join(size, "session_id").withColumn("debt", metrics.debt(F.col("confidence"), F.col("elided"), F.col("total"), F.col("now") - F.col("oldest")))
    return d.select("session_id", F.round("confidence", 9).alias("confidence"), F.round("debt", 6).alias("debt"), (F.col("debt") > metrics.DEBT_LIMIT).alias("rehydrate"))


@query(
    with_items(
        f"""SELECT bundle_id, round(r, 9) AS symbol_retention, round(1 - r, 9) AS drift, 1 - r > 0.4 AS refused FROM (SELECT bundle_id, CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (kept) / count(*) END AS r FROM (
 SELECT DISTINCT b.bundle_id, tag, EXISTS (SELECT 1 FROM s a WHERE a.bundle_id = b.bundle_id AND a.tag = b.tag AND a.ord % 3 <> 0) AS kept FROM s b) GROUP BY bundle_id)"""
    ).replace("turns AS (", "s AS (SELECT bundle_id, ord, unnest(list_distinct(list_concat(list_transform(list_concat(regexp_extract_all(content, '" + symbols.JS_FUNCTION + "', 1), regexp_extract_all(content, '" + symbols.PY_FUNCTION + "', 1)), lambda x: 'fn:' || x), list_transform(regexp_extract_all(content, '" + symbols.VARIABLE + "', 1), lambda x: 'var:' || x)))) AS tag FROM items WHERE content_type = 'code'), turns AS (")
)
def a8_a9_v8_drift(spark, sf_dir):
    """Every third item loses its code; functions and variables are the symbols, no markers are measured."""
    found = F.filter(symbols.symbols(F.col("content"), F.col("content_type")), lambda s: s.rlike("^(fn|var):"))
    none = F.array().cast("array<string>")
    i = items(spark, sf_dir).filter("content_type = 'code'").withColumn("symbols_before", found)
    pairs = i.select("bundle_id", "symbols_before", F.when(F.expr("ord % 3 <> 0"), F.col("symbols_before")).otherwise(none).alias("symbols_after"), none.alias("markers_before"), none.alias("markers_after"))
    return metrics.bundle_drift(pairs).select("bundle_id", F.round("symbol_retention", 9).alias("symbol_retention"), F.round("drift", 9).alias("drift"), "refused")


RUNS = """SELECT lang AS dataset, source AS sweep, CAST(n_chars % 97 AS DOUBLE) / 97 AS reduction, n_chars % 5 = 0 AS fallback, CAST(n_chars % 211 AS DOUBLE) AS latency, n_chars % 7 <> 0 AS syntax_ok, n_chars % 3 <> 0 AS passed, n_chars % 4 AS issues FROM {documents}"""


@query(
    f"""SELECT dataset, sweep, count(*) AS n, round(avg(reduction), 9) AS reduction, round(avg(fallback::INT), 9) AS fallback_rate, round(avg(latency), 9) AS latency, round(avg(syntax_ok::INT), 9) AS syntax_rate, round(avg(passed::INT), 9) AS pass_rate, CAST(sum(issues) AS BIGINT) AS issues,
 list_sort(list(latency))[CAST(least(count(*) - 1, floor(0.95 * count(*))) AS INT) + 1] AS latency_p95 FROM ({RUNS.replace('{documents}', 'documents')}) GROUP BY ROLLUP (dataset, sweep)"""
)
def a13_a15_bench_summary(spark, sf_dir):
    runs = run(spark, RUNS, sf_dir)
    s = metrics.bench_summary(runs, "dataset", "sweep")
    return s.select("dataset", "sweep", "n", *(F.round(c, 9).alias(c) for c in ("reduction", "fallback_rate", "latency", "syntax_rate", "pass_rate")), "issues", "latency_p95")


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS raw_chars, CAST(sum(CASE WHEN turn > 0 THEN length(text) // 2 ELSE 0 END) AS BIGINT) AS saved_chars, round(sum(CASE WHEN turn > 0 THEN length(text) // 2 ELSE 0 END) / sum(length(text)), 9) AS ratio FROM conversations GROUP BY conv_id")
def a16_session_metrics(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    saved = F.when(F.col("turn") > 0, F.expr("length(text) DIV 2")).otherwise(F.lit(0))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text").cast("long")).alias("raw_chars"), F.sum(saved).cast("long").alias("saved_chars"), F.round(F.sum(saved) / F.sum(F.length("text")), 9).alias("ratio"))


@query("SELECT lang AS bucket, source AS route, count(*) AS n, count(*) FILTER (saved > 0.0001) AS reduced, round(sum(before - after) / sum(before), 9) AS saved_share, round(median(after), 6) AS median_after FROM (SELECT *, n_chars AS before, CASE WHEN n_chars % 3 = 0 THEN n_chars ELSE n_chars // 2 END AS after, (n_chars - CASE WHEN n_chars % 3 = 0 THEN n_chars ELSE n_chars // 2 END) / n_chars AS saved FROM documents) GROUP BY ALL")
def a19_a20_corpus(spark, sf_dir):
    """Saved share as a ratio of sums, and an exact median."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("after", F.expr("CASE WHEN n_chars % 3 = 0 THEN n_chars ELSE n_chars DIV 2 END"))
    saved = (F.col("n_chars") - F.col("after")) / F.col("n_chars")
    return d.groupBy(F.col("lang").alias("bucket"), F.col("source").alias("route")).agg(F.count("*").alias("n"), F.count_if(saved > 0.0001).alias("reduced"), F.round(F.sum(F.col("n_chars") - F.col("after")) / F.sum("n_chars"), 9).alias("saved_share"), F.round(F.median("after"), 6).alias("median_after"))


COUNTED = f"(SELECT *, {ESTIMATE} AS tokens FROM (SELECT *, {classes('content')} FROM items))"


@query(
    with_items(
        f"""SELECT ord, tokens, coalesce(before, 0) < 1024 AS prefix_locked, has_constraint, coalesce(before, 0) < 1024 OR coalesce(role = 'system', false) OR kind = 'diff' OR has_constraint AS pinned FROM (
 SELECT *, sum(tokens) OVER (PARTITION BY bundle_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, content_type <> 'code' AND len({SEGMENTS}) > 0 AS has_constraint FROM {COUNTED})"""
    )
)
def w1_w2_prefix_lock(spark, sf_dir):
    return elision.prefix_locked(items(spark, sf_dir), preserve=("diff",)).select("ord", "tokens", "prefix_locked", "has_constraint", "pinned")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 3")
def w7_k6_newest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    # ties of the time stamp go by the id, so the order is total
    return elision.newest(e.select("user_id", "event_id", F.struct(F.col("ts").alias("ts"), (-F.col("event_id")).alias("id")).alias("touched")), ["user_id"], "touched", 3).select("user_id", "event_id")
