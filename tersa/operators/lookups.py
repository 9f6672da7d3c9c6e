"""Look-ups by id, path, hash and reference, as equi-joins that Spark may broadcast after it has seen their size, or shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.functions import text as T

KEY = ["bundle_id", "item_id"]


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """KEY, before, after: after is null for items that are gone."""
    return before.select(*KEY, F.col("content").alias("before")).join(after.select(*KEY, F.col("content").alias("after")), KEY, "left")


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items of before that after lacks."""
    return before.join(after.select(*KEY), KEY, "left_anti")


def base_versions(now: DataFrame, base: DataFrame) -> DataFrame:
    """item_id, how, base_id, base: the base item of equal path, else id, else origin; the first in order of several.

    Three equi-joins instead of one OR condition, which would compare all pairs.
    """
    found = None
    for rank, (how, mine, theirs) in enumerate((("path", "path", "path"), ("id", "item_id", "item_id"), ("origin", "origin", "origin"))):
        left = now.filter(F.col(mine).isNotNull()).select("item_id", F.col(mine).alias("k"))
        right = base.filter(F.col(theirs).isNotNull()).select(F.col(theirs).alias("k"), F.col("item_id").alias("base_id"), F.col("content").alias("base"), F.col("ord").alias("base_ord"))
        one = left.join(right, "k").select("item_id", F.lit(rank).alias("rank"), F.lit(how).alias("how"), "base_id", "base", "base_ord")
        found = one if found is None else found.unionByName(one)
    first = F.min_by(F.struct("how", "base_id", "base"), F.struct("rank", "base_ord"))
    return found.groupBy("item_id").agg(first.alias("f")).select("item_id", "f.*")


def blocks(contents: DataFrame) -> DataFrame:
    """hash, block: one row per distinct content."""
    return contents.select(T.content_hash(F.col("content")).alias("hash"), F.col("content").alias("block")).dropDuplicates(["hash"])


def unambiguous(blocks_: DataFrame, digits: int = 12) -> DataFrame:
    """ref, block for references that only one hash starts with."""
    refs = blocks_.groupBy(F.substring("hash", 1, digits).alias("ref")).agg(F.min("hash").alias("hash"), F.max("hash").alias("last")).filter("hash = last")
    return refs.select("ref", "hash").join(blocks_, "hash").select("ref", "block")


def resolve_refs(rows: DataFrame, blocks_: DataFrame) -> DataFrame:
    """rows, which have ref, with block; a reference that is ambiguous or unknown finds none."""
    return rows.join(unambiguous(blocks_), "ref", "left")


def missing_refs(rows: DataFrame, blocks_: DataFrame) -> DataFrame:
    """A row, with ref, for each marker in content whose block the store lacks."""
    exploded = rows.withColumn("ref", F.explode(F.array_distinct(T.marker_refs(F.col("content"))))).withColumn("ref", F.substring("ref", 1, 12))
    return exploded.join(unambiguous(blocks_).select("ref"), "ref", "left_anti")


def rehydrate(rows: DataFrame, blocks_: DataFrame, key: list[str]) -> DataFrame:
    """rows with every marker in content, of all three syntaxes, replaced by its block; markers without one stay.

    A content that is a marker wrapped as JSON becomes the block itself, or stays as it is if there is none.
    """
    wrapped = T.unwrap_json_marker(F.col("content"))
    found = F.when(wrapped.isNotNull(), F.slice(T.marker_texts(wrapped), 1, 1)).otherwise(T.marker_texts(F.col("content")))
    marks = rows.select(*key, wrapped.isNotNull().alias("whole"), F.explode(F.array_distinct(found)).alias("mark")).withColumn("ref", F.substring(F.element_at(T.marker_refs(F.col("mark")), 1), 1, 12))
    pairs = marks.join(unambiguous(blocks_), "ref").groupBy(*key).agg(F.bool_or("whole").alias("whole"), F.collect_list(F.struct("mark", "block")).alias("pairs"))
    joined = rows.join(pairs, key, "left")
    # a marker's text is unique to its block, so the order of replacement matters to no one
    restored = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<mark:string,block:string>>")), F.col("content"), lambda acc, p: F.replace(acc, p["mark"], p["block"]))
    return joined.withColumn("content", F.when(F.col("whole"), F.col("pairs")[0]["block"]).otherwise(restored)).drop("pairs", "whole")


def by_slot(payloads: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """payloads (key, body) with changes, an array of (slot, old, new) in order of slots: the final items back at their places.

    items: key, slot, original_content, content. Only what differs comes back; a payload without changes has an empty array.
    """
    changed = items.filter("content <> original_content").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("slot").alias("slot"), F.col("original_content").alias("old"), F.col("content").alias("new")))).alias("changes"))
    return payloads.join(changed, key, "left").withColumn("changes", F.coalesce("changes", F.array().cast("array<struct<slot:bigint,old:string,new:string>>")))


def session_refs(wanted: DataFrame, blocks_: DataFrame, key: list[str], least: int = 6) -> DataFrame:
    """wanted, which has session_id and ref, with the one block of the session whose hash starts with ref.

    The join's key is the session and the first digits, so that only blocks that share these are compared.
    """
    w = wanted.withColumn("k", F.substring("ref", 1, least))
    b = blocks_.dropDuplicates(["session_id", "hash"]).withColumn("k", F.substring("hash", 1, least))
    hits = w.join(b, ["session_id", "k"]).filter(F.col("hash").startswith(F.col("ref")))
    one = hits.groupBy(*key).agg(F.count("*").alias("n"), F.first("ref").alias("ref"), F.first("block").alias("block"))
    return one.filter("n = 1").drop("n")


def assemble(items: DataFrame, head: int = 80) -> DataFrame:
    """bundle_id, n_items, bundle_hash, preview: the hash of the items' hashes in order, and the start of their contents joined by newlines."""
    h = items.select("bundle_id", "ord", T.content_hash(F.col("content")).alias("h"), F.substring("content", 1, head).alias("start"))
    ordered = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("ord", name))), lambda x: x[name])
    preview = F.substring(F.array_join(F.slice(ordered("start"), 1, head), "\n"), 1, head)
    return h.groupBy("bundle_id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(ordered("h"), ","), 256).alias("bundle_hash"), preview.alias("preview"))


def render(items: DataFrame) -> DataFrame:
    """bundle_id, rendered: a single item as it is, several under labels, in order."""
    listed = items.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("ord", "path", "content"))).alias("l"))
    label = lambda x, i: F.concat(F.lit("==> "), F.coalesce(x["path"], F.concat(F.lit("item-"), (i + 1).cast("string"))), F.lit(" <==\n"), x["content"])
    return listed.select("bundle_id", F.when(F.size("l") == 1, F.col("l")[0]["content"]).otherwise(F.array_join(F.transform("l", label), "\n")).alias("rendered"))
