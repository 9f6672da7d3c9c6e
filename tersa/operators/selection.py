"""Selection under a budget: strategy by size, exact 0/1 knapsack, greedy by density."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The exact solver takes at most so many items and so much room.
DP_ITEMS, DP_ROOM = 100, 10_000


def strategies(items: DataFrame, budget: str = "budget") -> DataFrame:
    """items (bundle_id, ord, weight, value, pinned, budget) with room and strategy: pass_through, pinned_only, dp or greedy."""
    b = Window.partitionBy("bundle_id")
    total, pinned = F.sum("weight").over(b), F.sum(F.when(F.col("pinned"), F.col("weight")).otherwise(0)).over(b)
    n = F.count_if(~F.col("pinned")).over(b)
    room = F.col(budget) - pinned
    s = F.when(total <= F.col(budget), "pass_through").when((room <= 0) | (n == 0), "pinned_only").when((n <= DP_ITEMS) & (room <= DP_ROOM), "dp").otherwise("greedy")
    return items.withColumn("room", room).withColumn("strategy", s)


def solve_exact(weights: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """Which items an optimal 0/1 selection takes; of equal ones that which takes later items only if they add value."""
    best = np.zeros(room + 1)
    take = np.zeros((len(weights), room + 1), bool)
    for k, (w, v) in enumerate(zip(weights, values)):
        if w <= room:
            with_k = best[: room + 1 - w] + v
            better = with_k > best[w:]
            take[k, w:] = better
            best[w:] = np.where(better, with_k, best[w:])
    chosen, left = np.zeros(len(weights), bool), room
    for k in range(len(weights) - 1, -1, -1):
        if take[k, left]:
            chosen[k] = True
            left -= int(weights[k])
    return chosen


def select_exact(items: DataFrame) -> DataFrame:
    """bundle_id, ord of what is selected in bundles of strategy dp; groups are of DP_ITEMS items at most, so one fits a task."""
    rows = items.filter("strategy = 'dp' AND NOT pinned").select("bundle_id", "ord", F.col("weight").cast("long").alias("weight"), F.col("value").cast("double").alias("value"), F.col("room").cast("long").alias("room"))

    def solve(pdf):
        pdf = pdf.sort_values("ord")
        return pdf.loc[solve_exact(pdf.weight.to_numpy(), pdf.value.to_numpy(), int(pdf.room.iloc[0])), ["bundle_id", "ord"]]

    return rows.groupBy("bundle_id").applyInPandas(solve, "bundle_id long, ord long")


def select_greedy(items: DataFrame) -> DataFrame:
    """bundle_id, ord selected in bundles of strategy greedy: by density, then value, then order, skipping what does not fit; a single item worth more than all of these instead.

    A native fold over each bundle's sorted candidates: state is the room left, the value so far and what was taken.
    """
    rows = items.filter("strategy = 'greedy' AND NOT pinned AND weight <= room")
    density = F.col("value").cast("double") / F.greatest(F.col("weight"), F.lit(1)).cast("double")
    c = F.sort_array(F.collect_list(F.struct((-density).alias("d"), (-F.col("value").cast("double")).alias("v"), F.col("ord").cast("long").alias("ord"), F.col("weight").cast("long").alias("w"))))
    lists = rows.groupBy("bundle_id").agg(F.max("room").cast("long").alias("room"), c.alias("c"), F.max_by(F.struct(F.col("ord").cast("long").alias("ord"), F.col("value").cast("double").alias("value")), F.struct(F.col("value").cast("double"), -F.col("ord"))).alias("single"))
    zero = F.struct(F.col("room").alias("left"), F.lit(0.0).alias("value"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        more = F.struct((acc["left"] - x["w"]).alias("left"), (acc["value"] - x["v"]).alias("value"), F.concat(acc["taken"], F.array(x["ord"])).alias("taken"))
        return F.when(x["w"] <= acc["left"], more).otherwise(acc)

    done = lists.select("bundle_id", "single", F.aggregate("c", zero, step).alias("g"))
    taken = F.when(F.col("single.value") > F.col("g.value"), F.array("single.ord")).otherwise(F.col("g.taken"))
    return done.select("bundle_id", F.explode(taken).alias("ord"))


def select(items: DataFrame) -> DataFrame:
    """items with strategy and selected: everything that fits, else what is pinned and what its strategy takes."""
    s = strategies(items)
    chosen = select_exact(s).unionByName(select_greedy(s)).withColumn("chosen", F.lit(True))
    joined = s.join(chosen, ["bundle_id", "ord"], "left")
    return joined.withColumn("selected", F.col("pinned") | (F.col("strategy") == "pass_through") | F.coalesce("chosen", F.lit(False))).drop("chosen")
