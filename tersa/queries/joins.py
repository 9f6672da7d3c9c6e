"""Joins hidden in look-ups: survey rows J, S18, H, U."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tersa.functions import text
from tersa.operators import elision, lookups
from tersa.plans.recipes import items, turns, with_items
from tersa.queries import query


@query(
    with_items(
        """SELECT session_id, turn, ord, seen, copies, nth, CASE WHEN NOT seen THEN 'keep' WHEN nth > 1 THEN 'recoverable' WHEN copies = 1 THEN 'lossy' ELSE 'referent' END AS decision FROM (
 SELECT session_id, turn, ord, min(turn) OVER (PARTITION BY session_id, sha256(content)) < turn AS seen, count(*) OVER (PARTITION BY session_id, turn, sha256(content)) AS copies,
 row_number() OVER (PARTITION BY session_id, turn, sha256(content) ORDER BY ord) AS nth FROM turns)"""
    )
)
def j1_w3_t5_session_dedup(spark, sf_dir):
    return elision.session_dedup(turns(spark, sf_dir)).select("session_id", "turn", "ord", "seen", "copies", F.col("nth").cast("long").alias("nth"), "decision")


@query(with_items("SELECT bundle_id, item_id, length(content) AS before_chars, CASE WHEN ord % 4 = 0 THEN NULL ELSE length(replace(content, 'value', 'v')) END AS after_chars, ord % 4 = 0 AS dropped FROM items"))
def j2_s18_before_after(spark, sf_dir):
    before = items(spark, sf_dir)
    after = before.filter("ord % 4 <> 0").withColumn("content", F.expr("replace(content, 'value', 'v')"))
    paired = lookups.before_after(before, after)
    return paired.select("bundle_id", "item_id", F.length("before").cast("long").alias("before_chars"), F.length("after").cast("long").alias("after_chars"), F.col("after").isNull().alias("dropped"))


@query(with_items("SELECT bundle_id, item_id, path FROM items WHERE ord % 4 = 0"))
def s18_j13_dropped(spark, sf_dir):
    before = items(spark, sf_dir)
    return lookups.dropped(before, before.filter("ord % 4 <> 0")).select("bundle_id", "item_id", "path")


BASE = "SELECT CASE WHEN ord % 12 = 0 THEN 'old-' || item_id ELSE item_id END AS base_id, CASE WHEN ord % 3 <> 1 THEN path END AS base_path, ord AS base_ord FROM items"


@query(with_items(f"SELECT item_id, how, base_id FROM (SELECT item_id, how, base_id, row_number() OVER (PARTITION BY item_id ORDER BY rank, base_ord) AS n FROM (SELECT item_id, 0 AS rank, 'path' AS how, base_id, base_ord FROM items JOIN ({BASE}) ON path = base_path UNION ALL SELECT item_id, 1, 'id', base_id, base_ord FROM items JOIN ({BASE}) ON item_id = base_id)) WHERE n = 1"))
def j3_base_version(spark, sf_dir):
    now = items(spark, sf_dir)
    base = now.select("item_id", F.when(F.expr("ord % 3 <> 1"), F.col("path")).alias("path"), F.lit(None).cast("string").alias("origin"), "content", "ord")
    base = base.withColumn("item_id", F.when(F.expr("ord % 12 = 0"), F.concat(F.lit("old-"), "item_id")).otherwise(F.col("item_id")))
    return lookups.base_versions(now.withColumn("origin", F.lit(None).cast("string")), base).select("item_id", "how", "base_id")


@query(with_items("SELECT ord, ref, content AS found FROM (SELECT ord, left(sha256(content), 12) AS ref, content FROM items)"))
def j8_h1_prefix_lookup(spark, sf_dir):
    i = items(spark, sf_dir)
    blocks = lookups.blocks(i.select("content"))
    marked = i.select("ord", F.substring(text.content_hash(F.col("content")), 1, 12).alias("ref"))
    return lookups.resolve_refs(marked, blocks).select("ord", "ref", F.col("block").alias("found"))


@query(with_items("SELECT ord, left(sha256(content), 12) AS ref FROM items i WHERE NOT EXISTS (SELECT 1 FROM items b WHERE b.ord % 5 <> 0 AND b.content = i.content)"))
def j10_missing_blocks(spark, sf_dir):
    i = items(spark, sf_dir)
    blocks = lookups.blocks(i.filter("ord % 5 <> 0").select("content"))
    marked = i.select("ord", F.concat(F.lit("see "), text.session_marker(F.col("content"), F.col("kind")), F.lit(" there")).alias("content"))
    return lookups.missing_refs(marked, blocks).select("ord", "ref")


@query(with_items("SELECT ord, CASE WHEN ord % 4 = 3 THEN content WHEN ord % 9 = 0 THEN concat('a <BLOCK_HASH:', repeat('0', 64), '> b') ELSE concat('a ', content, ' b') END AS restored FROM items"))
def h2_h3_rehydrate(spark, sf_dir):
    """All items behind markers of three syntaxes, whole ones wrapped as JSON, and some that no store knows."""
    i = items(spark, sf_dir)
    marker = text.elision_marker(F.col("content"), text.noun(F.col("content_type")))
    kind = F.expr("ord % 4")
    block = F.concat(F.lit("<BLOCK_HASH:"), text.content_hash(F.col("content")), F.lit(">"))
    some = F.when(F.expr("ord % 9 = 0"), F.lit(f"<BLOCK_HASH:{'0' * 64}>")).when(kind == 0, marker).when(kind == 1, text.session_marker(F.col("content"), F.col("kind"))).otherwise(block)
    elided = i.select("ord", F.when(kind == 3, text.wrap_json_marker(marker)).otherwise(F.concat(F.lit("a "), some, F.lit(" b"))).alias("content"))
    return lookups.rehydrate(elided, lookups.blocks(i.select("content")), ["ord"]).select("ord", F.col("content").alias("restored"))


@query("SELECT item_id, ratio, most, run FROM benchmark, (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE)) r(ratio), (VALUES (500::BIGINT), (5000::BIGINT)) m(most), (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) n(run)")
def j11_fixture_sweeps(spark, sf_dir):
    """Fixtures under every budget and run: rows are multiplied by an array of parameters, not joined."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")
    for name, values, kind in (("ratio", (0.0, 0.3, 0.6), "double"), ("most", (500, 5000), "long"), ("run", (1, 2, 3), "long")):
        b = b.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))
    return b


@query("SELECT conv_id, turn, ref, text AS found FROM (SELECT conv_id, turn, left(sha256(text), 6 + turn) AS ref, text, count(*) OVER (PARTITION BY conv_id, left(sha256(text), 6)) AS n FROM conversations) WHERE n = 1")
def j9_session_refs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    blocks = c.select(F.col("conv_id").alias("session_id"), text.content_hash(F.col("text")).alias("hash"), F.col("text").alias("block"))
    wanted = c.select(F.col("conv_id").alias("session_id"), "turn", F.substring(text.content_hash(F.col("text")), F.lit(1), (F.col("turn") + 6).cast("int")).alias("ref"))
    found = lookups.session_refs(wanted, blocks, ["session_id", "turn"])
    return found.select(F.col("session_id").alias("conv_id"), "turn", "ref", F.col("block").alias("found"))


@query(with_items("SELECT bundle_id, string_agg(label || content, chr(10) ORDER BY ord) AS rendered FROM (SELECT bundle_id, ord, '==> ' || coalesce(path, 'item-' || nth) || ' <==' || chr(10) AS label, content FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ord) AS nth FROM items)) GROUP BY bundle_id"))
def s12_render(spark, sf_dir):
    return lookups.render(items(spark, sf_dir)).select("bundle_id", "rendered")


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'prompt' ELSE 'conversation' END AS kind, role, turn AS slot, text AS content FROM conversations")
def s5_chat_payload(spark, sf_dir):
    """Conversations packed into chat payloads and read back as items, one per message."""
    from tersa.sources.payloads import chat_items

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages")))
    found = chat_items(c.groupBy("conv_id").agg(body.alias("body")), ["conv_id"])
    # conversations may start after turn 0, slots never do
    first = c.groupBy("conv_id").agg(F.min("turn").alias("t0"))
    return found.join(first, "conv_id").select("conv_id", (F.col("slot") + F.col("t0")).alias("turn"), "kind", "role", (F.col("slot") + F.col("t0")).alias("slot"), "content")


@query(with_items("SELECT bundle_id, count(*) AS n_items, sha256(string_agg(sha256(content), ',' ORDER BY ord)) AS bundle_hash, left(string_agg(content, chr(10) ORDER BY ord), 80) AS preview FROM items GROUP BY bundle_id"))
def p30_bundle_assembly(spark, sf_dir):
    return lookups.assemble(items(spark, sf_dir))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS so_far FROM conversations")
def w5_w8_turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("n"), F.sum(F.length("text").cast("long")).over(w).alias("so_far"))
