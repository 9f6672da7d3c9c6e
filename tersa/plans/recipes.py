"""Items derived from the driver's tables, as SQL that both Spark and DuckDB run, so that every operator has something to act on."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

#: Bundles of 50 documents; by id a document is prose that instructs, prose that narrates, Python, TypeScript, a log or Markdown.
ITEMS = """
SELECT CAST(floor(doc_id / 50) AS BIGINT) AS bundle_id, CAST(doc_id AS BIGINT) AS ord, concat('i', CAST(doc_id AS STRING)) AS item_id,
  CASE doc_id % 6 WHEN 0 THEN 'prompt' WHEN 1 THEN 'conversation' WHEN 4 THEN 'note' WHEN 5 THEN 'diff' ELSE 'file' END AS kind,
  CASE doc_id % 6 WHEN 2 THEN 'code' WHEN 3 THEN 'code' WHEN 4 THEN 'logs' WHEN 5 THEN 'markdown' ELSE 'text' END AS content_type,
  CASE doc_id % 6 WHEN 2 THEN 'python' WHEN 3 THEN 'typescript' END AS language,
  CASE WHEN doc_id % 30 = 0 THEN 'system' WHEN doc_id % 6 <= 1 THEN 'user' END AS role,
  CASE doc_id % 6 WHEN 2 THEN concat('p/m_', CAST(doc_id AS STRING), '.py') WHEN 3 THEN concat('p/m_', CAST(doc_id AS STRING), '.ts')
    WHEN 5 THEN concat('p/d_', CAST(doc_id AS STRING), '.md') END AS path,
  CASE doc_id % 6
    WHEN 0 THEN concat(text, ' You must keep row ', CAST(doc_id AS STRING), '. Do not  drop it!')
    WHEN 1 THEN concat(text, ' It has never failed in run ', CAST(doc_id AS STRING), '. We always shipped it.')
    WHEN 2 THEN concat('import os', chr(10), 'from p.m_', CAST(6 * floor(doc_id / 12) + 2 AS BIGINT), ' import fn_0', chr(10), chr(10), '# never call fn_', CAST(doc_id AS STRING), ' twice', chr(10),
      'def fn_', CAST(doc_id AS STRING), '(x):', chr(10), '    v = "', repeat('value of a row ', 6 + CAST(doc_id % 11 AS INT)), '"', chr(10), '    return v', chr(10))
    WHEN 3 THEN concat('import { a } from "./m_', CAST(6 * floor(doc_id / 12) + 3 AS BIGINT), '";', chr(10), 'export function fn_', CAST(doc_id AS STRING), '(x: string): string {', chr(10),
      '  const v = "', repeat('value of a row ', 6 + CAST(doc_id % 11 AS INT)), '";', chr(10), '  return v;', chr(10), '}', chr(10), 'export const limit_', CAST(doc_id AS STRING), ' = 1;', chr(10))
    WHEN 4 THEN concat('12:00:', lpad(CAST(doc_id % 60 AS STRING), 2, '0'), ' ERROR ', replace(text, chr(10), ' '))
    ELSE concat('# Doc ', CAST(doc_id AS STRING), chr(10), chr(10), '- ', text, chr(10), '---', chr(10)) END AS content
FROM {documents}
"""
#: Sessions of blocks: turn k holds block k of 20 documents, block k - 1 again, and a second copy of some of it.
TURNS = """
SELECT session_id, turn, CAST(row_number() OVER (PARTITION BY session_id, turn ORDER BY part, doc_id) AS BIGINT) AS ord, doc_id, text AS content FROM (
  SELECT CAST(floor(doc_id / 100) AS BIGINT) AS session_id, CAST(floor(doc_id / 20) AS BIGINT) % 5 AS turn, 0 AS part, doc_id, text FROM {documents}
  UNION ALL SELECT CAST(floor(doc_id / 100) AS BIGINT), CAST(floor(doc_id / 20) AS BIGINT) % 5 + 1, 1, doc_id, text FROM {documents} WHERE CAST(floor(doc_id / 20) AS BIGINT) % 5 < 4
  UNION ALL SELECT CAST(floor(doc_id / 100) AS BIGINT), CAST(floor(doc_id / 20) AS BIGINT) % 5 + 1, 2, doc_id, text FROM {documents} WHERE CAST(floor(doc_id / 20) AS BIGINT) % 5 < 4 AND doc_id % 5 = 0) t
"""


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it comes in fewer partitions than there are cores, as a file of one row group does; larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def run(spark: SparkSession, sql: str, sf_dir: str) -> DataFrame:
    """A recipe over the tables of a folder."""
    view = "tersa_documents_" + sha256(sf_dir.encode()).hexdigest()[:12]
    documents(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(sql.replace("{documents}", view))


def oracle(sql: str) -> str:
    """The recipe in DuckDB, where tables are views of their own names."""
    return sql.replace("{documents}", "documents")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, ITEMS, sf_dir)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, TURNS, sf_dir)


def with_items(body: str) -> str:
    """DuckDB SQL over the views items and turns."""
    return f"WITH items AS ({oracle(ITEMS)}), turns AS ({oracle(TURNS)}) {body}"
