"""One query per training-data operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tersa.llm.common import table
from tersa.llm.oracles import ORACLES  # noqa: F401


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.near_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"), borrow=True)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from tersa.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary or vocabulary_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).drop("source", "host_rate")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersa.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer file of the box; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_warc": op10_warc,
}
