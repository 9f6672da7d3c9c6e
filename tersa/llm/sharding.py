"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. Groups are sorted by size, largest first, and each
goes to the shard with the least bytes so far, which a heap yields. The driver never holds all groups: those of at
least ``total / (shards * fine)`` bytes (at most ``shards * fine`` of them, whatever the input) are scheduled one by
one, smaller ones are first bundled by hash into ``bundles`` units. Both bounds are parameters, not data sizes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersa.llm.common import materialize

SHARDS, FINE, BUNDLES, BLOCKS = 8, 1024, 1 << 16, 1024


def lpt(sizes: dict, shards: int) -> dict:
    """Unit -> shard. Ties between units go by the unit, between shards by the number, so reruns agree."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, bundles: int = BUNDLES, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of docs.

    A null text has size 1 and the CRC of no bytes, and groups with the empty text. Repeated rows each get a slot of
    their own. Slots run without gaps from 0 in each shard, in order of hashed blocks of ids and then of ids; rows
    alike in every column may swap slots. An empty table gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        # two texts that share a hash stay together as well, which no law forbids
        F.xxhash64(text).alias("grp"),
    )
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    small = dict(groups.groupBy(F.pmod("grp", F.lit(bundles)).alias("b")).agg(F.sum("bytes")).collect())  # at most `bundles` rows
    total = sum(small.values())
    least = max(1, -(-total // (shards * fine)))
    alone = dict(groups.filter(F.col("bytes") >= least).collect())  # at most shards * fine rows, as their bytes sum to total at most
    units = {("a", g): n for g, n in alone.items()}
    for g, n in alone.items():
        small[g % bundles] -= n
    units |= {("b", b): n for b, n in small.items() if n}
    placed = lpt(units, shards)

    def lookup(kind: str, name: str, shard: str) -> DataFrame:
        found = [(unit, s) for (k, unit), s in placed.items() if k == kind]
        return spark.createDataFrame(found, T.StructType([T.StructField(name, T.LongType()), T.StructField(shard, T.IntegerType())]))

    # both tables are bounded by parameters, so they may be broadcast whatever the input
    dealt = (
        rows.withColumn("b", F.pmod("grp", F.lit(bundles)).cast("long"))
        .join(F.broadcast(lookup("a", "grp", "own")), "grp", "left")
        .join(F.broadcast(lookup("b", "b", "shared")), "b", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block"))
    )
    return number_slots(dealt, blocks).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def number_slots(dealt: DataFrame, blocks: int) -> DataFrame:
    """Number the rows of each shard without gaps: counts by (shard, block), their prefix sums, and ranks within a block."""
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))  # shards * blocks rows at most
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))
