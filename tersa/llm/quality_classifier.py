"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on figures of the text, fitted on a bounded sample of labelled documents, gives each document its own
evidence. Documents' probabilities are then summed by site, in two levels: host (column ``source``) and path on it (column
``lang``, as documents carry no URL; both are parameters). Each level is shrunk towards the one above: hosts towards the
mean of all documents, paths towards their host, with weights that the spread of the hosts' and paths' means gives by the
method of moments. So a site of a few documents says little, and one of many speaks for itself. A document's score is the
odds of its own evidence, times the odds of its path, without itself, over the odds of the whole corpus.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import crc_fold, map_columns, materialize
from tersa.llm.quality_rules import SPACES, _Hashes, count_text
from tersa.llm.toxicity import fit_logistic, labelled_sample

TRAIN_EACH, THRESHOLD, MOST_WEIGHT = 3000, 0.5, 1e4


def text_figures(text: str | None, hashes: dict) -> list[float]:
    """Figures of a text for the regression, each between about 0 and 10."""
    text = text or ""
    n, chars, symbols, dup_lines, repeats = count_text(text, hashes)
    if not n:
        return [0.0] * 12
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    counts = Counter(words)
    letters = sum(map(text.count, filter(str.isalpha, set(text))))
    upper = sum(w.isupper() and len(w) > 1 for w in counts) / len(counts)
    return [
        min(10.0, math.log1p(n)),
        min(10.0, chars / n),
        math.sqrt(symbols / n),
        math.sqrt(dup_lines / max(1, len(lines))),
        math.sqrt(repeats / n),
        len(counts) / max(1, len(words)),
        max(counts.values(), default=0) / n,
        math.sqrt(text.count("!") / n),
        upper,
        math.sqrt(sum(map(text.count, "0123456789")) / chars) if chars else 0.0,
        1.0 - letters / chars if chars else 0.0,
        min(5.0, math.log1p(n / max(1, len(lines)))),
    ]


class Model:
    def __init__(self, centre: np.ndarray, scale: np.ndarray, coefficients: np.ndarray, prior: float):
        self.centre, self.scale, self.coefficients, self.prior = centre, scale, coefficients, prior

    def scorer(self):
        hashes = _Hashes()

        def score(texts: list[str | None]) -> list[float]:
            x = (np.array([text_figures(t, hashes) for t in texts]) - self.centre) / self.scale
            return (1 / (1 + np.exp(-np.clip(x @ self.coefficients[:-1] + self.coefficients[-1], -12, 12)))).tolist()

        return score


def fit(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> Model:
    """Learn from at most `each` documents of either label outside the held-out fold."""
    sample, counts = labelled_sample(docs, labels, "quality", {0: each, 1: each})

    def make():
        hashes = _Hashes()

        def step(texts, ys):
            return [[text_figures(t, hashes) for t in texts], ys]

        return step

    rows = map_columns(sample.select("text", "y"), make, "x array<double>, y int").collect()  # 12 numbers for each sampled document
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return Model(np.zeros(12), np.ones(12), np.zeros(13), 0.5)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    w = fit_logistic((x - centre) / scale, y)
    taken = Counter(y.astype(int).tolist())
    w[-1] += math.log((counts[1] / counts[0]) / (taken[1] / taken[0]))
    return Model(centre, scale, w, counts[1] / (counts[0] + counts[1]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _weight(mean: Column, spread: Column) -> Column:
    """Weight of a beta prior of that mean and variance, between 1 and MOST_WEIGHT documents."""
    return F.when(spread <= 1e-12, F.lit(MOST_WEIGHT)).otherwise(F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(MOST_WEIGHT)))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, n, s, prior, host_rate, path_weight: a row per path, from host, path, doc_score of all documents."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("doc_score").alias("s"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    top = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("prior"), F.coalesce(F.var_pop(F.col("host_s") / F.col("host_n")), F.lit(0.0)).alias("host_spread"))
    # one row joins every host: bounded, and no cross join of documents
    rated = hosts.join(F.broadcast(top)).withColumn("w", _weight(F.col("prior"), F.col("host_spread")))
    rated = rated.select(F.col("host").alias("h"), "prior", ((F.col("host_s") + F.col("w") * F.col("prior")) / (F.col("host_n") + F.col("w"))).alias("host_rate"))
    joined = paths.join(rated, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    joined = materialize(joined, "quality-hosts")
    spread = joined.agg(F.coalesce(F.avg(F.pow(F.col("s") / F.col("n") - F.col("host_rate"), F.lit(2.0))), F.lit(0.0)).alias("path_spread"))
    return joined.join(F.broadcast(spread)).withColumn("path_weight", _weight(F.col("prior"), F.col("path_spread"))).drop("path_spread")


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, doc_score, host_rate, path_rate, score, predicted, kept: a row per row of docs.

    Null and empty texts have figures of 0 each. A null host or path is a site of its own. Without labels of both kinds
    every document scores alike. Repeated rows count as often as they occur. No documents give no rows.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(base, labels))

    def make():
        score = shared.value.scorer()

        def step(ids, hosts, paths, texts):
            return [ids, hosts, paths, score(texts)]

        return step

    scored = materialize(map_columns(base, make, "doc_id long, host string, path string, doc_score double"), "quality-scores")
    sites = site_posteriors(scored).select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "prior", "host_rate", "path_weight")
    own = (F.col("s") - F.col("doc_score") + F.col("path_weight") * F.col("host_rate")) / (F.col("n") - 1 + F.col("path_weight"))
    return (
        scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
        .withColumn("path_rate", own)
        .withColumn("odds", _logit(F.col("doc_score")) + _logit(F.col("path_rate")) - _logit(F.col("prior")))
        .withColumn("score", 1 / (1 + F.exp(-F.col("odds"))))
        .select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "doc_score", "host_rate", "path_rate", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("kept"))
    )
