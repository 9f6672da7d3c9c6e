"""Benchmark fixtures of two shapes, normalised, and as items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUMANEVAL = "task_id string, prompt string, canonical_solution string, entry_point string, test string, language string"
CODEXGLUE = "id string, repo string, path string, prompt string, completion string, language string"


def humaneval(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(HUMANEVAL).option("multiLine", True).json(path).filter("task_id IS NOT NULL AND prompt IS NOT NULL")
    return raw.select(F.col("task_id").alias("id"), F.lit("humaneval").alias("dataset"), "prompt", F.col("canonical_solution").alias("completion"), F.coalesce("language", F.lit("python")).alias("language"), F.concat(F.lit("src/"), "entry_point", F.lit(".py")).alias("path"), "entry_point", "test")


def codexglue(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CODEXGLUE).option("multiLine", True).json(path).filter("id IS NOT NULL AND prompt IS NOT NULL")
    by_path = F.when(F.col("path").rlike(r"\.tsx?\z"), "typescript").when(F.col("path").rlike(r"\.jsx?\z"), "javascript").otherwise("python")
    none = F.lit(None).cast("string")
    return raw.select("id", F.lit("codexglue").alias("dataset"), "prompt", "completion", F.coalesce("language", by_path).alias("language"), "path", none.alias("entry_point"), none.alias("test"))


def load(spark: SparkSession, dataset: str, path: str, other: str | None = None) -> DataFrame:
    """humaneval, codexglue, or both (path and other) in this order; any other name is an error."""
    if dataset == "humaneval":
        return humaneval(spark, path)
    if dataset == "codexglue":
        return codexglue(spark, path)
    if dataset == "both":
        return humaneval(spark, path).unionByName(codexglue(spark, other or path))
    raise ValueError(f"no such dataset: {dataset}")


def as_items(fixtures: DataFrame) -> DataFrame:
    """One bundle per fixture: its prompt is a file of the declared language."""
    return fixtures.select(F.xxhash64("dataset", "id").alias("bundle_id"), F.lit(0).cast("long").alias("ord"), F.col("id").alias("item_id"), F.lit("file").alias("kind"), F.lit("code").alias("content_type"), "language", F.lit(None).cast("string").alias("role"), "path", F.col("prompt").alias("content"))


def evaluate(pairs: DataFrame) -> DataFrame:
    """pairs (prompt, output, check) with syntax_before, syntax_after, symbols, similarity and passed.

    A fixture passes if the output has no more issues than the prompt and keeps 70 % of its identifiers. Code is never run.
    """
    from tersa.functions.text import jaccard, symbol_preservation, word_set
    from tersa.operators.scanners import balance_issues

    p = pairs.withColumn("n_before", F.size(balance_issues("prompt", "check"))).withColumn("n_after", F.size(balance_issues("output", "check")))
    p = p.withColumn("symbols", symbol_preservation(F.col("prompt"), F.col("output"))).withColumn("similarity", jaccard(word_set(F.col("prompt")), word_set(F.col("output"))))
    return p.withColumn("syntax_before", F.col("n_before") == 0).withColumn("syntax_after", F.col("n_after") == 0).withColumn("passed", (F.col("n_after") <= F.col("n_before")) & (F.col("symbols") >= 0.7))
