"""Budgets, knapsack, plan modes: survey rows K and P31."""

from __future__ import annotations

from pyspark.sql import functions as F

from tersa.functions.tokens import token_estimate
from tersa.operators import elision, selection
from tersa.plans.recipes import items, with_items
from tersa.queries import query
from tersa.queries.aggregates import COUNTED

BUDGETED = f"(SELECT *, sum(tokens) OVER (PARTITION BY bundle_id) AS total, sum(CASE WHEN pinned THEN tokens ELSE 0 END) OVER (PARTITION BY bundle_id) AS held FROM (SELECT *, tokens AS weight, CAST(1 + ord * 7919 % 89 AS DOUBLE) AS value, coalesce(role = 'system', false) AS pinned FROM {COUNTED}))"


def weighed(spark, sf_dir, share: float):
    """Items with weight, value, pinned and a budget of a share of their bundle's tokens."""
    from pyspark.sql import Window

    i = items(spark, sf_dir).select("bundle_id", "ord", "role", token_estimate(F.col("content")).alias("weight"))
    i = i.withColumn("value", F.expr("CAST(1 + ord * 7919 % 89 AS DOUBLE)")).withColumn("pinned", F.coalesce(F.col("role") == "system", F.lit(False)))
    return i.withColumn("budget", F.floor(F.sum("weight").over(Window.partitionBy("bundle_id")) * F.lit(share)).cast("long"))


@query(with_items(f"SELECT bundle_id, total AS n_tokens, least(CASE WHEN bundle_id % 3 > 0 THEN 5000 * (bundle_id % 3) END, CASE WHEN bundle_id % 2 = 0 THEN CAST(floor(total * (1.0::DOUBLE - 0.3::DOUBLE)) AS BIGINT) END) AS ceiling FROM (SELECT bundle_id, CAST(sum(tokens) AS BIGINT) AS total FROM {COUNTED} GROUP BY bundle_id)"))
def k1_token_ceiling(spark, sf_dir):
    t = items(spark, sf_dir).select("bundle_id", token_estimate(F.col("content")).alias("t")).groupBy("bundle_id").agg(F.sum("t").alias("n_tokens"))
    most, ratio = F.col("bundle_id") % 3 * 5000, F.when(F.col("bundle_id") % 2 == 0, F.lit(0.3)).otherwise(F.lit(0.0))
    return t.select("bundle_id", "n_tokens", elision.token_ceiling(F.col("n_tokens"), most, ratio).alias("ceiling"))


@query(
    with_items(
        f"""SELECT ord, budget, CASE WHEN total <= budget THEN 'pass_through' WHEN budget - held <= 0 OR free = 0 THEN 'pinned_only' WHEN free <= 100 AND budget - held <= 10000 THEN 'dp' ELSE 'greedy' END AS strategy
 FROM (SELECT *, CAST(floor(total * CASE WHEN bundle_id % 4 = 0 THEN 1.0::DOUBLE WHEN bundle_id % 4 = 1 THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END) AS BIGINT) AS budget, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY bundle_id) AS free FROM {BUDGETED})"""
    )
)
def k2_strategy(spark, sf_dir):
    w = weighed(spark, sf_dir, 1.0)
    share = F.expr("CASE WHEN bundle_id % 4 = 0 THEN 1.0D WHEN bundle_id % 4 = 1 THEN 0.0D ELSE 0.4D END")
    return selection.strategies(w.withColumn("budget", F.floor(F.col("budget") * share).cast("long"))).select("ord", "budget", "strategy")


@query()
def k3_knapsack(spark, sf_dir):
    """Exact and greedy selection under 40 % of each bundle's tokens; tests compare with brute force."""
    return selection.select(weighed(spark, sf_dir, 0.4)).select("bundle_id", "ord", "strategy", "selected")


@query(
    with_items(
        f"""SELECT ord, elided FROM (SELECT ord, can AND saved > 0 AND total - coalesce(before, 0) > floor(total * 0.5::DOUBLE) AS elided FROM (
 SELECT *, sum(saved) OVER (PARTITION BY bundle_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(tokens) OVER (PARTITION BY bundle_id) AS total FROM (
 SELECT *, CASE WHEN can THEN tokens - marker_tokens ELSE 0 END AS saved FROM (SELECT *, CAST(ceil(punct_m * 0.55::DOUBLE + space_m * 0.35::DOUBLE + (n_m - punct_m - space_m) * 0.22::DOUBLE) AS BIGINT) AS marker_tokens FROM (
 SELECT *, length(regexp_replace(marker, '[^ ]', '', 'g')) AS space_m, length(regexp_replace(marker, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS punct_m, length(marker) AS n_m, coalesce(role <> 'system', true) AND length(content) >= 40 AND length(marker) < length(content) AND content_type IN ('text', 'logs', 'markdown') AND NOT regexp_matches(content, 'def\\s+[A-Za-z_]|(class|type|struct|enum|interface)\\s+[A-Za-z_$]|function\\s+[A-Za-z_$]|(public|private|static|get|set|async|protected)\\s+[A-Za-z_$][A-Za-z0-9_$]*\\s*\\(') AS can
 FROM (SELECT *, __MARK__ AS marker FROM {COUNTED}))))))""".replace("{{", "{")
    ).replace("__MARK__", __import__("tersa.queries.scalars", fromlist=["MARK"]).MARK)
)
def w4_ceiling_elision(spark, sf_dir):
    return elision.elide_to_ceiling(items(spark, sf_dir), 0.5).select("ord", "elided")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'session_dedup' WHEN doc_id % 3 > 0 OR doc_id % 5 > 2 THEN 'topology_knapsack' ELSE 'pass_through' END AS mode, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 3 > 0 OR doc_id % 5 > 2 THEN 4 ELSE 0 END AS n_stages FROM documents")
def k7_plan_mode(spark, sf_dir):
    from tersa.operators.modes import plan_columns

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mode, stages = plan_columns(F.col("doc_id") % 7 == 0, F.col("doc_id") % 3, F.when(F.col("doc_id") % 5 > 2, 0.3).otherwise(0.0))
    return d.select("doc_id", mode.alias("mode"), F.size(stages).cast("int").alias("n_stages"))
