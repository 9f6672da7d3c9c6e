"""Quality rules with host-level verdicts.

Every document gets counts and two kinds of rules: base rules, which reject it alone, and soft rules, which only mark
it. Failures (base or soft) are summed by host (column ``source``; documents carry no URL). A host's rate is shrunk
towards a beta prior whose mean and weight come from all hosts' rates by the method of moments, so that hosts of a few
documents stay near the common rate. A host is bad if its shrunk rate exceeds ``bad_rate`` and, at ``margin`` times, the
prior's mean. A document that breaks two soft rules is rejected, on bad hosts one is enough; a document that breaks no rule is kept whatever its host is.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import append_columns, map_columns, materialize

SPACES, SYMBOLS, WINDOW = "\t\n\x0b\x0c\r ", "#*$%&|<>", 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SOFT_SYMBOLS_PERCENT, SOFT_DUP_LINES, SOFT_REPEAT_PERCENT = 3, 3, 15
BAD_RATE, MARGIN = 0.3, 1.5

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Odd multipliers, by which the hashes of a window's words are combined.
MIX = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW)]


class _Hashes(dict):
    """Word -> 64-bit hash; forgets all when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def repeat_words(words: list[bytes], hashes: dict) -> int:
    """Words that lie in some window of WINDOW words which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.array([hashes[w] for w in words], np.uint64)
    windows = np.zeros(n, np.uint64)
    for k, m in enumerate(MIX):
        windows += h[k : k + n] * np.uint64(m)
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(text: str | None, hashes: dict) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    lines = [x for x in lines if x.strip(SPACES)] if len(lines) > 1 else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words, hashes)


def _counter():
    hashes = _Hashes()

    def step(ids, sources, texts):
        return [ids, sources, *zip(*(count_text(t, hashes) for t in texts))]

    return step


def with_counts(docs: DataFrame) -> DataFrame:
    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text"), _counter, f"doc_id long, source string, {COUNTS}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def soft_failures() -> Column:
    """How many of the soft rules a document breaks."""
    rules = (
        F.col("n_symbols") * 100 > F.col("word_chars") * SOFT_SYMBOLS_PERCENT,
        F.col("n_dup_lines") >= SOFT_DUP_LINES,
        F.col("n_repeat_words") * 100 > F.col("n_words") * SOFT_REPEAT_PERCENT,
    )
    return sum((r.cast("int") for r in rules), F.lit(0))


def verdict() -> Column:
    """Whether a document is kept: it breaks no base rule and fewer than two soft ones, none on a bad host."""
    return ~base_failed() & (soft_failures() < F.when(F.col("host_bad"), 1).otherwise(2))


def host_verdicts(counted: DataFrame, bad_rate: float = BAD_RATE, margin: float = MARGIN) -> DataFrame:
    """host, host_docs, host_failed, host_rate, host_bad: one row per host (null is a host), from counts of all documents.

    With mean m and variance v of the hosts' rates, the prior has weight m (1 - m) / v - 1, held between 1 and 1e6.
    """
    hosts = counted.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("host_docs"), F.sum((base_failed() | (soft_failures() > 0)).cast("long")).alias("host_failed"))
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        F.coalesce(F.var_pop(F.col("host_failed") / F.col("host_docs")), F.lit(0.0)).alias("v"),
    )
    weight = F.when(F.col("v") <= 0, F.lit(1e6)).otherwise(F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.lit(1e6)))
    rate = (F.col("host_failed") + F.col("w") * F.col("m")) / (F.col("host_docs") + F.col("w"))
    # one row of two numbers joins each host: no cross join of documents
    return (
        hosts.join(F.broadcast(prior.withColumn("w", weight)))
        .withColumn("host_rate", rate)
        .select("host", "host_docs", "host_failed", "host_rate", ((F.col("host_rate") > bad_rate) & (F.col("host_rate") > F.col("m") * margin)).alias("host_bad"))
    )


def judge(docs: DataFrame, bad_rate: float = BAD_RATE, margin: float = MARGIN) -> DataFrame:
    """doc_id, source, the counts, base_failed, soft_failures, host_rate, host_bad, kept: a row per row of docs.

    A null or empty text has no words and fails. Repeated rows are judged alike. An empty table gives no rows.
    """
    counted = materialize(with_counts(docs), "quality-counts")
    hosts = materialize(host_verdicts(counted, bad_rate, margin), "quality-hosts")
    return (
        counted.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("soft_failures", soft_failures())
        .withColumn("kept", verdict())
        .select("doc_id", "source", *COUNTS.replace(" long", "").split(", "), "base_failed", "soft_failures", "host_rate", "host_bad", "kept")
    )


def keep_good(docs: DataFrame, bad_rate: float = BAD_RATE, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps; texts are read and counted once.

    Nulls, empty texts and repeated rows are judged as judge() does. Rows travel as structs, so columns may have any names;
    without rows there are none. Only a row that breaks one soft rule waits for its host's verdict: rows that are rejected
    whatever their host are written without their columns, to be counted for the host.
    """

    def make():
        hashes = _Hashes()

        def step(texts):
            counts = [count_text(t, hashes) for t in texts]
            return [[may_stay(*c) for c in counts], *zip(*counts)]

        return step

    counted = append_columns(docs, docs["text"], make, COUNTS, (docs["source"].cast("string").alias("source"),))
    counted = materialize(counted, "quality-rows")
    hosts = materialize(host_verdicts(counted, bad_rate, margin), "quality-hosts").select("host", "host_bad")
    joined = counted.filter("row IS NOT NULL").join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.filter(verdict()).select("row.*")


def may_stay(words: int, chars: int, symbols: int, dup_lines: int, repeats: int) -> bool:
    """Whether some host's verdict keeps a document of these counts."""
    soft = (symbols * 100 > chars * SOFT_SYMBOLS_PERCENT) + (dup_lines >= SOFT_DUP_LINES) + (repeats * 100 > words * SOFT_REPEAT_PERCENT)
    return words >= MIN_WORDS and repeats * 100 <= words * MAX_REPEAT_PERCENT and soft < 2
