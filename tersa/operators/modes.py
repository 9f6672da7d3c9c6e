"""Plan modes as columns, so that bundles of all modes run in one job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNAPSACK = ("cleanup:constraint-preservation", "pruning:topology-pruner", "compression:token-hashing", "compression:delta-compression")


def plan_columns(session: Column, max_input_tokens: Column, ratio: Column) -> tuple[Column, Column]:
    """(mode, stages): session dedup where it is on, knapsack where a budget is set, else nothing."""
    budget = F.coalesce(max_input_tokens > 0, F.lit(False)) | F.coalesce(ratio > 0, F.lit(False))
    mode = F.when(session, "session_dedup").when(budget, "topology_knapsack").otherwise("pass_through")
    stages = F.when(session, F.array(F.lit("cleanup:session-dedup"))).when(budget, F.array(*map(F.lit, KNAPSACK))).otherwise(F.array().cast("array<string>"))
    return mode, stages
