"""Payloads, coverage, fixtures, manifests: survey rows S6, S20, P12, P25, P29, A10 to A12, B1, Z1."""

from __future__ import annotations

from pyspark.sql import functions as F

from tersa.functions import classify, text
from tersa.functions.tokens import token_estimate
from tersa.operators import metrics, scanners
from tersa.plans.recipes import items, with_items
from tersa.queries import query
from tersa.queries.scalars import ESTIMATE, MARK, RESERVED_SQL, classes


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'system', turn) - 1 AS slot, role, CASE WHEN role = 'system' THEN 'prompt' ELSE 'conversation' END AS kind, text AS content FROM conversations")
def s6_messages_with_system(spark, sf_dir):
    """Payloads whose system text stands beside the messages; it becomes the first item."""
    from tersa.sources.payloads import chat_items

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.sort_array(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "role", F.col("text").alias("content")))))
    system = F.max(F.when(F.col("role") == "system", F.col("text")))
    return chat_items(c.groupBy("conv_id").agg(system.alias("system"), said.alias("messages")).select("conv_id", F.to_json(F.struct("system", "messages")).alias("body")), ["conv_id"]).drop("structured")


PY = {k: getattr(classify, k).replace("'", "''") for k in ("PY_STRONG", "PY_WEAK", "PY_NOT")}
PY_LINES = r"list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '^[ \t]*#'))"
PY_OTHERS = f"list_filter(l, lambda x: NOT regexp_matches(x, '{PY['PY_NOT']}'))"


@query(
    with_items(
        f"""SELECT ord, strong >= 2 AND (strong + weak) * 100 >= n * 15 AND (n - len(o)) * 10 < n AS is_python FROM (SELECT ord, o, len(l) AS n, len(list_filter(o, lambda x: regexp_matches(x, '{PY['PY_STRONG']}'))) AS strong,
 len(list_filter(o, lambda x: NOT regexp_matches(x, '{PY['PY_STRONG']}') AND regexp_matches(x, '{PY['PY_WEAK']}'))) AS weak FROM (SELECT ord, l, {PY_OTHERS} AS o FROM (SELECT ord, {PY_LINES} AS l FROM items)))"""
    )
)
def p12_python_probe(spark, sf_dir):
    """Counts of lines choose candidates, the balance check confirms them; only candidates reach Python."""
    i = items(spark, sf_dir).select("ord", "content", classify.may_be_python(F.col("content")).alias("maybe"))
    sound = F.size(scanners.balance_issues("content", F.when(F.col("maybe"), "python"))) == 0
    return i.select("ord", (F.col("maybe") & sound).alias("is_python"))


@query(with_items(f"SELECT ord, before - after AS saved, round((before - after) / before, 9) AS ratio, format('{{:.2f}}%', round((before - after) / before * 100, 2)) AS said FROM (SELECT ord, {ESTIMATE} AS before FROM (SELECT ord, {classes('content')} FROM items)) JOIN (SELECT ord, {ESTIMATE} AS after FROM (SELECT ord, {classes('left(content, length(content) // 2)')} FROM items)) USING (ord)"))
def p25_p29_wire_metrics(spark, sf_dir):
    half = F.expr("left(content, length(content) DIV 2)")
    i = items(spark, sf_dir).select("ord", token_estimate(F.col("content")).alias("before"), token_estimate(half).alias("after"))
    saved, ratio = metrics.wire_metrics(F.col("before"), F.col("after"))
    return i.select("ord", saved.alias("saved"), metrics.round_scaled(ratio, 9).alias("ratio"), metrics.percent(ratio).alias("said"))


@query(with_items("SELECT bundle_id, count(*) FILTER (content_type = 'code') AS checked, count(*) FILTER (content_type <> 'code') AS unchecked, array_to_string(list_sort(list(DISTINCT content_type) FILTER (content_type <> 'code')), ',') AS unchecked_types, array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), ',') AS languages, true AS reducible FROM items GROUP BY bundle_id"))
def a10_a12_coverage(spark, sf_dir):
    c = metrics.check_coverage(items(spark, sf_dir))
    return c.withColumn("unchecked_types", F.array_join("unchecked_types", ",")).withColumn("languages", F.array_join("languages", ","))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('h', doc_id) WHEN 1 THEN concat('b', doc_id) WHEN 2 THEN concat('m', doc_id) ELSE 'default' END AS session FROM documents")
def z1_session_key(spark, sf_dir):
    from tersa.sources.payloads import session_key

    n = F.col("doc_id").cast("string")
    headers = F.when(F.expr("doc_id % 4 = 0"), F.create_map(F.lit("x-session-id"), F.concat(F.lit("h"), n))).otherwise(F.create_map(F.lit("accept"), F.lit("*")))
    body = F.expr("CASE doc_id % 4 WHEN 1 THEN concat('{\"session_id\":\"b', doc_id, '\"}') WHEN 2 THEN concat('{\"metadata\":{\"session_id\":\"m', doc_id, '\"}}') ELSE '{}' END")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", session_key(headers, body).alias("session"))


@query(f"SELECT item_id, preserved >= 0.7 AS passed FROM (SELECT item_id, CASE WHEN len(k) = 0 THEN 1.0 ELSE len(list_intersect(k, a)) / len(k) END AS preserved FROM (SELECT item_id, list_distinct(list_filter(regexp_extract_all(text, '\\b[A-Za-z_]\\w+'), lambda x: lower(x) NOT IN ({RESERVED_SQL}))) AS k, list_distinct(regexp_extract_all(left(text, length(text) * (5 + item_id % 5) // 10), '\\w+')) AS a FROM benchmark))")
def b1_fixture_evaluation(spark, sf_dir):
    from tersa.sources.fixtures import evaluate

    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = b.select("item_id", F.col("text").alias("prompt"), F.expr("left(text, CAST(length(text) * (5 + item_id % 5) DIV 10 AS INT))").alias("output"), F.lit(None).cast("string").alias("check"))
    return evaluate(pairs).select("item_id", "passed")


@query("SELECT source AS bucket, path, size, sha256 FROM (SELECT source, 'd/' || doc_id AS path, strlen(text) AS size, sha256(text) AS sha256, row_number() OVER (PARTITION BY source ORDER BY 'd/' || doc_id) AS n FROM documents WHERE strlen(text) BETWEEN 100 AND 5000) WHERE n <= 10")
def s20_corpus_freeze(spark, sf_dir):
    """The first ten texts by path of each bucket, within sizes, with their hashes: the limit is the feature."""
    from tersa.sources.files import freeze

    return freeze(as_files(spark, sf_dir), 10, 100, 5000)


def as_files(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("source").alias("bucket"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("bytes"))


@query("SELECT 'd/' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'unlisted' END AS problem FROM documents WHERE doc_id % 5 IN (0, 1) OR doc_id % 7 = 3")
def s21_manifest_verify(spark, sf_dir):
    """Files that went, changed, or came since the manifest was written."""
    from tersa.sources.files import manifest, verify

    f = as_files(spark, sf_dir)
    n = F.substring("path", 3, 20).cast("long")
    listed = manifest(f.filter((n % 7 != 3) | (n % 5).isin(0, 1)))
    now = f.filter(n % 5 != 0).withColumn("bytes", F.when(n % 5 == 1, F.concat("bytes", F.lit("!").cast("binary"))).otherwise(F.col("bytes")))
    return verify(listed, now)


@query("SELECT doc_id, 'd/' || doc_id || '.md' AS path, sha256(text) AS sha256, true AS representable, 'markdown' AS content_type FROM documents")
def s1_s2_s13_folder_round_trip(spark, sf_dir):
    """Texts written as files to the shared folder and scanned as items: bytes, names, types."""
    from tersa.sources.files import as_items, scan, write_files
    from tersa.storage import fresh_path

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "folder")
    write_files(d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("bytes")), folder)
    i = as_items(scan(spark, folder))
    name = F.element_at(F.split("path", "/"), -1)
    return i.select(F.regexp_extract(name, r"^(\d+)", 1).cast("long").alias("doc_id"), F.concat(F.lit("d/"), name).alias("path"), F.sha2("bytes", 256).alias("sha256"), "representable", "content_type")


@query("SELECT conv_id, count(*) FILTER (turn % 2 = 1) AS n_changes, coalesce(string_agg(nth || ':' || left(text, 5), '|' ORDER BY nth) FILTER (turn % 2 = 1 AND left(text, 5) <> text), '') AS changes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations) GROUP BY conv_id".replace("count(*) FILTER (turn % 2 = 1)", "count(*) FILTER (turn % 2 = 1 AND left(text, 5) <> text)"))
def j12_slots(spark, sf_dir):
    """Every other message of a payload is shortened; the changes come back by slot."""
    from tersa.operators.lookups import by_slot
    from tersa.sources.payloads import chat_items

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages")))
    payloads = c.groupBy("conv_id").agg(body.alias("body"), F.sort_array(F.collect_list("turn")).alias("turns"))
    i = chat_items(payloads, ["conv_id"]).join(payloads.select("conv_id", "turns"), "conv_id").withColumnRenamed("content", "original_content")
    odd = F.col("turns")[F.col("slot").cast("int")] % 2 == 1
    final = i.withColumn("content", F.when(odd, F.substring("original_content", 1, 5)).otherwise(F.col("original_content")))
    back = by_slot(payloads.select("conv_id", "body"), final, ["conv_id"])
    return back.select("conv_id", F.size("changes").cast("long").alias("n_changes"), F.array_join(F.transform("changes", lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["new"])), "|").alias("changes"))


@query(with_items(f"SELECT ord, contains(c, '[tersa') OR contains(c, '<BLOCK_HASH:') AS already, regexp_matches(c, '^\\s*\\[\\s*\\{{') AS structured FROM (SELECT ord, CASE ord % 4 WHEN 0 THEN 'see ' || {MARK} WHEN 1 THEN '<BLOCK_HASH:' || sha256(content) || '>' WHEN 2 THEN '[' || '{{\"type\": \"text\"}}' || ']' ELSE content END AS c FROM items)".replace("{{", "{").replace("}}", "}")))
def f3_f4_guards(spark, sf_dir):
    """Items that hold markers of old, and items of blocks, are never elided."""
    from tersa.operators.elision import eligibility

    i = items(spark, sf_dir)
    marker = text.elision_marker(F.col("content"), text.noun(F.col("content_type")))
    kind = F.expr("ord % 4")
    c = F.when(kind == 0, F.concat(F.lit("see "), marker)).when(kind == 1, F.concat(F.lit("<BLOCK_HASH:"), text.content_hash(F.col("content")), F.lit(">"))).when(kind == 2, F.lit('[{"type": "text"}]')).otherwise(F.col("content"))
    e = eligibility(i.withColumn("content", c))
    return e.select("ord", "already", "structured")


@query(with_items("SELECT ord, left(sha256(content), 12) AS ref, 1 AS n FROM items"))
def p22_json_markers(spark, sf_dir):
    """Markers wrapped as JSON and unwrapped again."""
    i = items(spark, sf_dir)
    wrapped = i.select("ord", text.wrap_json_marker(text.elision_marker(F.col("content"), text.noun(F.col("content_type")))).alias("j"))
    refs = text.marker_refs(text.unwrap_json_marker(F.col("j")))
    return wrapped.select("ord", F.element_at(refs, 1).alias("ref"), F.size(refs).alias("n"))


SYMBOLS_SQL = "content_type = 'code' OR regexp_matches(content, 'def\\s+[A-Za-z_]|(class|interface|type|enum|struct)\\s+[A-Za-z_$]|function\\s+[A-Za-z_$]|(public|private|protected|async|static|get|set)\\s+[A-Za-z_$][A-Za-z0-9_$]*\\s*\\(')"


@query(with_items(f"SELECT bundle_id, count(*) FILTER (NOT saves) AS no_savings, count(*) FILTER (structured) AS structured_content, count(*) FILTER (saves AND NOT structured AND ({SYMBOLS_SQL})) AS has_symbols FROM (SELECT *, length({MARK}) < length(content) AS saves, regexp_matches(content, '^\\s*\\[\\s*\\{{') AS structured FROM items) GROUP BY bundle_id"))
def a17_skip_reasons(spark, sf_dir):
    """All items, short ones too, of which markers save nothing."""
    from tersa.plans.stages import skip_reasons

    return skip_reasons(items(spark, sf_dir)).drop("tokens_at_stake")


@query()
def k4_a18_t2_prune(spark, sf_dir):
    """Bundles pruned to 60 % of their tokens by graph, state, kind and constraints; what stays and how near it is."""
    from tersa.plans.stages import mean_distance, prune

    i = items(spark, sf_dir)
    changed = i.filter("path IS NOT NULL AND ord % 97 = 0").select("bundle_id", "path")
    status = i.filter("path IS NOT NULL AND ord % 13 = 0").select("path", F.lit("recent").alias("state"))
    return mean_distance(prune(i, changed, status, 0.4))


@query(with_items("SELECT item_id, content_type = 'markdown' OR content_type = 'text' AS same FROM items WHERE content_type IN ('markdown', 'text', 'logs')"))
def t4_delta(spark, sf_dir):
    """Logs gain a line over their base version; the operator decides whether a delta saves."""
    from tersa.plans.stages import delta

    i = items(spark, sf_dir).filter("content_type IN ('markdown', 'text', 'logs')").withColumn("origin", F.lit(None).cast("string"))
    now = i.withColumn("content", F.when(F.col("content_type") == "logs", F.concat("content", F.lit("\n12:00:00 INFO end"))).otherwise(F.col("content")))
    # the context of a one-line log is the log itself, so a delta saves nothing and the item is left as it is
    d = delta(now, i).join(now.select("item_id", "content_type"), "item_id")
    return d.select("item_id", ((F.col("content_type") != "logs") & F.col("delta").isNull()).alias("same"))
