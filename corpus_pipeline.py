"""The corpus pipeline: documents in, token ids out, by five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tersa.llm.bpe import encode_documents
from tersa.llm.common import discard, materialize, scratch, table
from tersa.llm.mixing import emit
from tersa.llm.near_dedup import keep_one
from tersa.llm.quality_rules import keep_good
from tersa.llm.queries import vocabulary_path
from tersa.llm.secret_scan import redact

#: Near copies in the pipeline: five words a shingle, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null and empty texts go, repeated rows are judged alike, no rows give none."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id, and one row of it; rows without an id or without words stay."""
    return keep_one(docs, SHINGLE, PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark and their characters counted again; null texts stay null."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are drawn; a null source is one source, the last."""
    return emit(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document of the mix; null texts have no ids."""
    return encode_documents(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL can express neither the minhashes' candidates, nor inferred grammars, nor BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last = docs
        with scratch():  # what a stage wrote on its way goes when its result has been written
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower(), outlive=True)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
