"""Mixing sources to target weights by systematic sampling.

Within a source each document is expected ``target / source_size`` times. The expected copies are summed up along the
documents of the source, one random offset is added, and a document is emitted once for each integer that its piece of
the running sum crosses. Running over the documents by size keeps the words taken next to the target, not only the rows.
The running sum is not computed in one task: documents are counted by (source, size class, salt), the counts' prefix sums
give each class its start, and ranks within a class do the rest. Sums are kept in whole numbers of 2^-31, so that no
rounding can add or lose a copy at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import materialize, n_words

CAP, SEED, UNIT, SALTS = 3, "mix-1", 1 << 31, 256


def size_class(size: Column) -> Column:
    """Classes of sizes within about 3 % of each other, of at most 2,000 numbers for any size."""
    shift = F.greatest(F.length(F.bin(size)) - 6, F.lit(0))
    return (shift * 64 + F.floor(size / F.pow(F.lit(2.0), shift))).cast("long")


def id_salt(doc_id: Column, salts: int = SALTS) -> Column:
    """0 to salts - 1 by all digits of the id, so that ids in steps are dealt out too."""
    return F.pmod(doc_id + F.floor(doc_id / salts) + F.floor(doc_id / (salts * salts)), F.lit(salts)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3 by the order of code points, null last, filled up to cap * source_size.

    Sources may be as many as hosts, so they are ranked by a distributed sort. Reshared excess ends at one level L with
    target = min(cap * size, L * weight): from the level at which no source is full, those that are above it are filled and
    the level of the rest is computed again, which can only rise, until no further source is full.
    """
    named = sizes.filter("source IS NOT NULL").repartitionByRange("source").withColumn("range", F.spark_partition_id())
    named = materialize(named, "mix-sources")
    starts = named.groupBy("range").agg(F.count("*").alias("n"))  # a row per partition of the sort
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("source")) + F.col("start")
    ranked = named.join(F.broadcast(starts), "range").select("source", "source_size", rank.alias("rank"))
    last = sizes.filter("source IS NULL").select("source", "source_size", F.lit(named.count() + 1).cast("long").alias("rank"))
    weighted = ranked.unionByName(last).select("source", "source_size", ((F.col("rank") - 1) % 3 + 1).alias("weight"), (F.col("source_size") * cap).alias("most"))
    weighted = materialize(weighted, "mix-weights")
    level, full = 0.0, -1
    while True:
        filled = F.col("most") < F.lit(level) * F.col("weight")
        found = weighted.agg(F.count_if(filled), F.sum("source_size"), F.coalesce(F.sum(F.when(filled, F.col("most"))), F.lit(0)), F.sum(F.when(~filled, F.col("weight")))).first()
        if found[0] == full or not found[3]:
            break
        full, level = found[0], (found[1] - found[2]) / found[3]
    return weighted.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def copies_plan(docs: DataFrame, cap: int = CAP, seed: str = SEED, salts: int = SALTS, carry: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, copies (and row, a struct of all columns of docs, if asked for); see mix()."""
    named = [F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size")]
    sizes = materialize(docs.select(*named), "mix-sizes").withColumn("class", size_class(F.col("size")))
    aims = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), cap), "mix-targets")
    # every class is dealt to the same number of salts by the id, at every size of the corpus: no task ranks a class of many rows
    salted = lambda rows: rows.withColumn("salt", id_salt(F.coalesce("doc_id", F.lit(0)), salts))

    key = ["source", "class", "salt"]
    counts = salted(sizes).groupBy(*key).agg(F.count("*").alias("n"))
    # a source has at most as many classes as there are numbers of them, a class at most `salts` salts
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counts.groupBy(F.col("source").alias("s"), F.col("class").alias("c")).agg(F.sum("n").alias("n"))
    classes = classes.select("s", "c", earlier(Window.partitionBy("s").orderBy("c")).alias("class_start"))
    classes = classes.join(aims.withColumnRenamed("source", "a"), F.col("s").eqNullSafe(F.col("a"))).drop("a")
    starts = counts.select(*key, earlier(Window.partitionBy("source", "class").orderBy("salt")).alias("within"))
    starts = starts.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).withColumn("start", F.col("class_start") + F.col("within")).drop("s", "c")
    rows = docs.select(*named, F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumn("class", size_class(F.col("size"))) if carry else sizes
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id"))
    ranked = salted(rows).withColumn("rank", rank).alias("r")
    placed = ranked.join(starts.alias("s"), on=F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.class") == F.col("s.class")) & (F.col("r.salt") == F.col("s.salt")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("r.source"), F.lit("\x00null")))), 1, 7), 16, 10).cast("long") * 8
    out = placed.select(
        *[f"r.{c}" for c in ("doc_id", "size", "source")],
        "source_size",
        "target",
        F.least(F.floor(ratio), F.lit(cap)).cast("long").alias("whole"),
        F.least(F.floor((ratio - F.floor(ratio)) * UNIT), F.lit(UNIT - 1)).cast("long").alias("part"),
        offset.alias("offset"),
        (F.col("start") + F.col("rank")).cast("long").alias("nth"),
        *(["r.row"] if carry else []),
    )
    # the running sum after this document, modulo 1, is less than the piece itself just if an integer was crossed
    sum_after = F.pmod(F.col("offset") + F.col("part") * F.pmod(F.col("nth"), F.lit(UNIT)), F.lit(UNIT))
    copies = F.least(F.col("whole") + (sum_after < F.col("part")).cast("long"), F.lit(cap)).cast("long")
    return out.withColumn("copies", copies).drop("whole", "part", "offset", "nth")


def emit(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs, all columns, as many times as it is drawn; see mix() for nulls, repeats and no rows.

    Rows travel as structs, so columns may have any names.
    """
    plan = copies_plan(docs, cap, seed, carry=True).filter("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of docs.

    Null texts have size 0, null sources are one source, the last. A source without words keeps every document once. Rows
    alike are counted and drawn one by one; which of them is drawn does not matter. Rows with the same id but other sizes
    are drawn one by one too. An empty table gives no rows. Other columns are ignored.
    """
    plan = copies_plan(docs, cap, seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
