"""Scanners, diffs, gates and the whole engine: survey rows D, E, T, V, R, B, Z."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tersa.functions import symbols, text
from tersa.operators import diffs, scanners
from tersa.plans import reduce
from tersa.plans.recipes import items, with_items
from tersa.queries import query
from tersa.queries.scalars import ESTIMATE, classes


def edited(spark, sf_dir):
    """Documents and their edit: every seventh line dropped, one appended."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("old"))
    kept = F.filter(F.split("old", "\n"), lambda x, i: (i + 1) % 7 != 0)
    return d.withColumn("new", F.concat(F.array_join(kept, "\n"), F.lit("\nlast line of row "), F.col("doc_id").cast("string")))


@query("SELECT doc_id, n // 7 AS n_deleted, 1 AS n_added, n - n // 7 AS n_kept FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def d1_line_diff(spark, sf_dir):
    ops = edited(spark, sf_dir).select("doc_id", diffs.diff_ops("old", "new").alias("ops"))
    count = lambda op: F.size(F.filter("ops", lambda x: x["op"] == op)).cast("long")
    return ops.select("doc_id", count("delete").alias("n_deleted"), count("add").cast("int").alias("n_added"), count("keep").alias("n_kept"))


@query()
def d2_t4_unified_diff(spark, sf_dir):
    e = edited(spark, sf_dir)
    return e.select("doc_id", diffs.unified_diff("old", "new", F.lit("base"), F.lit("current")).alias("diff"))


#: Closing quotes of both languages left out, or closing brackets.
DAMAGED = "CASE WHEN ord % 5 = 0 THEN replace(replace(content, '\"' || chr(10), chr(10)), '\";' || chr(10), ';' || chr(10)) WHEN ord % 7 = 0 THEN replace(content, ')', '') ELSE content END"


COUNT_OF = lambda c, text="content": f"(length({text}) - length(replace({text}, '{c}', '')))"


@query(with_items(f"""SELECT ord, CASE WHEN language = 'python' THEN 'python' ELSE 'script' END AS validator, {COUNT_OF('(')} = {COUNT_OF(')')} AND {COUNT_OF('{')} = {COUNT_OF('}')} AND len(list_filter(string_split(content, chr(10)), lambda x: {COUNT_OF('"', 'x')} % 2 = 1)) = 0 AS valid
 FROM (SELECT * REPLACE ({DAMAGED} AS content) FROM items WHERE content_type = 'code')"""))
def v1_v2_v4_balance(spark, sf_dir):
    """All code items, a fifth of them with unterminated strings, a seventh without closing brackets; SQL counts brackets and quotes."""
    i = items(spark, sf_dir).filter("content_type = 'code'").withColumn("content", F.expr(DAMAGED))
    i = i.withColumn("validator", scanners.validator(F.col("language"), F.col("path"), F.col("content_type")))
    return i.select("ord", "validator", (F.size(scanners.balance_issues("content", "validator")) == 0).alias("valid"))


JSONISH = "CASE event_id % 6 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN concat(props, chr(10), props) WHEN 2 THEN concat('[', props, '] x]') WHEN 3 THEN concat('[', props, ', null]') WHEN 4 THEN concat(' ', props) ELSE props END"


@query(f"SELECT event_id, left(b, 1) IN ('{{{{', '[') AND json_valid(b) AS is_json, json_valid(b) AS valid FROM (SELECT event_id, {JSONISH} AS b FROM events)".replace("{{", "{"))
def v3_p8_json(spark, sf_dir):
    """The probe and the check over whole values, cut ones, lines of values, and text after a value."""
    from tersa.functions.classify import looks_like_json

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(JSONISH).alias("b"))
    return e.select("event_id", looks_like_json(F.col("b")).alias("is_json"), (F.size(scanners.balance_issues("b", F.lit("json"))) == 0).alias("valid"))


PY_BODY = "strpos(content, 'v = \"') - 1, strpos(content, 'return v') + 7"
TS_BODY = "strpos(content, 'string {') + 7, strpos(content, chr(10) || '}' || chr(10))"


@query(with_items(f"SELECT ord, 1 AS n_regions, CASE WHEN language = 'python' THEN {PY_BODY.split(', strpos')[0]} ELSE {TS_BODY.split(', strpos')[0]} END AS first_start, CASE WHEN language = 'python' THEN strpos{PY_BODY.split(', strpos')[1]} ELSE strpos{TS_BODY.split(', strpos')[1]} END AS first_end FROM items WHERE content_type = 'code'"))
def e1_e4_regions(spark, sf_dir):
    """Function bodies of all code items, with their places."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in scanners.regions(t, lang, least=80)] for t, lang in zip(texts, languages)])

    i = items(spark, sf_dir).filter("content_type = 'code'").select("ord", found("content", "language").alias("r"))
    return i.select("ord", F.size("r").alias("n_regions"), F.col("r")[0]["start"].cast("long").alias("first_start"), F.col("r")[0]["end"].cast("long").alias("first_end"))


@query(with_items("SELECT ord, content_type = 'text' AS unwitnessed FROM items WHERE content_type IN ('text', 'code') AND NOT regexp_matches(content, 'XX') AND (content_type = 'code' OR NOT regexp_matches(content, 'def\\s+[A-Za-z_]|(class|interface|type|enum|struct)\\s+[A-Za-z_$]|function\\s|(?:public|private|protected|async|static|get|set)\\s+[A-Za-z_$][A-Za-z0-9_$]*\\s*\\('))"))
def g3_v7_unwitnessed(spark, sf_dir):
    i = items(spark, sf_dir).filter("content_type IN ('text', 'code')")
    before = symbols.symbols(F.col("content"), F.col("content_type"))
    after = symbols.content_markers(text.elision_marker(F.col("content"), text.noun(F.col("content_type"))), F.col("content_type"))
    prose = i.select("ord", "content_type", F.size(before).alias("n"), F.size(after).alias("m"))
    return prose.filter((F.col("content_type") == "code") | (F.col("n") == 0)).select("ord", ((F.col("n") == 0) & (F.col("m") == 0)).alias("unwitnessed"))


@query(with_items("SELECT ord, unnest(['must', 'Do not']) AS lost FROM items WHERE ord % 6 = 0 AND ord % 4 = 0"))
def v6_directive_retention(spark, sf_dir):
    """All items; those of instruction whose last sentences are cut lose their directives and all their keywords."""
    from tersa.functions.directives import directives, keywords

    i = items(spark, sf_dir).withColumn("after", F.expr("CASE WHEN ord % 4 = 0 THEN regexp_replace(content, ' You must keep row.*$', '') ELSE content END"))
    lost = F.filter(directives(F.col("content")), lambda d: ~F.contains(F.col("after"), d))
    return i.select("ord", F.explode(keywords(lost)).alias("lost"))


@query(with_items("SELECT bundle_id, bad = 0 AS passed, CASE WHEN bad = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN bad = 0 THEN '' WHEN warn = 0 THEN 'E1' ELSE 'E1; E2' END AS reason FROM (SELECT bundle_id, count(*) FILTER (ord % 150 = 0) AS bad, count(*) FILTER (ord % 300 = 0) AS warn FROM items GROUP BY bundle_id)"))
def u5_v10_verdicts(spark, sf_dir):
    i = items(spark, sf_dir)
    one = i.filter("ord % 150 = 0").select("bundle_id", "item_id", F.lit("E1").alias("code"), F.lit("error").alias("severity"))
    two = i.filter("ord % 300 = 0").select("bundle_id", "item_id", F.lit("E2").alias("code"), F.lit("error").alias("severity"))
    info = i.select("bundle_id", "item_id", F.lit("I1").alias("code"), F.lit("info").alias("severity"))
    return reduce.verdicts(i, one.unionByName(two).unionByName(info))


@query()
def t3_r1_r3_engine(spark, sf_dir):
    """The plan over all bundles at a reduction of 30 %, without a workspace: tokens before and after, changes, reverts, fallbacks."""
    return reduce.trace(reduce.reduce_bundles(items(spark, sf_dir), reduce.Budget(target_reduction_ratio=0.3)))


@query(with_items(f"""SELECT bundle_id, CAST(count(*) AS BIGINT) AS n_items, n_tokens AS tokens_before, 2000 AS most, n_tokens > 2000 AS over FROM (SELECT bundle_id, {ESTIMATE} AS n_tokens, k FROM (SELECT bundle_id, sum(space) + count(*) - 1 AS space, sum(punct) AS punct, sum(wide) AS wide, sum(n) + count(*) - 1 AS n, count(*) AS k FROM (SELECT bundle_id, {classes('content')} FROM items) GROUP BY bundle_id)), range(k) GROUP BY bundle_id, n_tokens""".replace("range(k) GROUP BY bundle_id, n_tokens", "LATERAL (SELECT unnest(range(k))) GROUP BY bundle_id, n_tokens")))
def v9_budget_gate(spark, sf_dir):
    """Bundles whose tokens exceed a limit, as the gate of the engine finds them when nothing was reduced."""
    i = items(spark, sf_dir).withColumn("original_content", F.col("content")).withColumn("whole_elided", F.lit(False))
    found = reduce.issues(i, 2000).filter("code = 'BUDGET_EXCEEDED'").select("bundle_id", F.lit(True).alias("hit"))
    before = reduce.bundle_tokens(i).withColumnRenamed("n_tokens", "tokens_before")
    n = i.groupBy("bundle_id").agg(F.count("*").alias("n_items"))
    return n.join(before, "bundle_id").join(found, "bundle_id", "left").select("bundle_id", "n_items", "tokens_before", F.lit(2000).alias("most"), F.coalesce("hit", F.lit(False)).alias("over"))


@query(with_items("SELECT bundle_id, array_to_string(list_sort(list(DISTINCT item_id) FILTER (ord % 150 = 0)), ',') AS items, bool_or(ord % 300 = 0) AS unattributable FROM items WHERE ord % 150 = 0 GROUP BY bundle_id"))
def a12_attribution(spark, sf_dir):
    """Errors of items, and errors of whole bundles, which name none."""
    i = items(spark, sf_dir)
    of = lambda f, item: i.filter(f).select("bundle_id", item.alias("item_id"), F.lit("E").alias("code"), F.lit("error").alias("severity"), F.lit("").alias("message"))
    found = of("ord % 150 = 0", F.col("item_id")).unionByName(of("ord % 300 = 0", F.lit(None).cast("string"))).unionByName(of("ord % 150 = 0", F.col("item_id")))
    return reduce.attribution(found).withColumn("items", F.array_join("items", ","))


@query("SELECT user_id, n AS n_session, count(*) AS n_events, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, n".replace("CAST(sum(value) AS DOUBLE)", "round(sum(value), 4)"))
def z3_idle_sessions(spark, sf_dir):
    """Sessions that end after an idle hour."""
    from tersa.streaming.sessions import number_sessions

    e = number_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")
    return e.groupBy("user_id", "n_session").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
