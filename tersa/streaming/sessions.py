"""Turns of sessions as a stream: which contents were seen in earlier turns, and idle sessions.

Two forms. ``seen_within_watermark`` uses built-in deduplication under a watermark. ``seen_state`` keeps, per session, the
hashes seen with their last turn, at most MOST of them (the oldest go), and drops a session's state when it was idle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.functions.text import content_hash

MOST_HASHES, IDLE = 1000, "1 hour"


def number_sessions(rows: DataFrame, key: str, ts: str, tie: str, idle: str = IDLE) -> DataFrame:
    """Batch: rows with n_session, from 1; a gap of more than `idle` starts the next."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    fresh = F.coalesce((F.col(ts) - F.lag(ts).over(w) > F.expr(f"INTERVAL {idle}")).cast("long"), F.lit(1))
    return rows.withColumn("_fresh", fresh).withColumn("n_session", F.sum("_fresh").over(w)).drop("_fresh")


def seen_within_watermark(stream: DataFrame, ts: str, delay: str = IDLE) -> DataFrame:
    """The first occurrence of each content per session within the delay; repeats are dropped."""
    return stream.withColumn("hash", content_hash(F.col("content"))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["session_id", "hash"])


def turn_metrics(stream: DataFrame) -> DataFrame:
    """Running totals per session: turns, characters, and characters saved."""
    return stream.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("content").cast("long")).alias("raw_chars"), F.sum(F.when(F.col("seen"), F.length("content").cast("long")).otherwise(0)).alias("saved_chars"))


SEEN = "session_id long, turn long, ord long, hash string, seen boolean"


def seen_state(stream: DataFrame, most: int = MOST_HASHES, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Streaming: session_id, turn, ord, hash, seen of (session_id, turn, ord, content); seen looks at earlier turns only.

    With idle_ms a session that had no turn for so long is forgotten; such a query always has a next batch, so runs that are
    to end by themselves (availableNow) take None.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    hashed = stream.select("session_id", "turn", "ord", content_hash(F.col("content")).alias("hash"))

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["turn", "ord"])
        out = []
        for turn, group in rows.groupby("turn", sort=True):
            out += [(key[0], turn, o, h, known.get(h, turn) < turn) for o, h in zip(group.ord, group.hash)]
            for h in group.hash:
                first = min(known.pop(h, turn), turn)
                known[h] = first  # to the end: last touched
            while len(known) > most:
                known.pop(next(iter(known)))
        state.update((list(known), list(known.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "turn", "ord", "hash", "seen"])

    return hashed.groupBy("session_id").applyInPandasWithState(step, SEEN, "hashes array<string>, turns array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
