"""Functions for Spark SQL: register(spark), then SELECT token_estimate(text) and the like.

Those built of expressions become SQL functions by their generated form where Spark SQL can state them, so they are inlined
and optimised; scanners become vectorised functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    from tersa.functions.tokens import PUNCT, SPACE, WEIGHTS, WIDE
    from tersa.operators import diffs, scanners

    count = lambda drop: "length(regexp_replace(coalesce(t, ''), r'" + drop + "', ''))"
    space, punct, wide = count(SPACE), count(PUNCT), count(WIDE)
    word = f"(length(coalesce(t, '')) - {space} - {punct} - {wide})"
    raw = f"{word} * {WEIGHTS['word']}D + {punct} * {WEIGHTS['punct']}D + {space} * {WEIGHTS['space']}D + {wide} * {WEIGHTS['wide']}D"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS BIGINT RETURN CASE WHEN coalesce(t, '') = '' THEN 0 ELSE greatest(1, cast(ceil({raw}) AS BIGINT)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION content_hash(t STRING) RETURNS STRING RETURN sha2(coalesce(t, ''), 256)")
    spark.udf.register("balance_issues", scanners.balance_issues)
    spark.udf.register("line_diff", diffs.diff_ops)
    spark.udf.register("unified_diff", diffs.unified_diff)
    return ["token_estimate", "content_hash", "balance_issues", "line_diff", "unified_diff"]
