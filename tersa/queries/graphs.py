"""Import graphs and scores: survey rows G3 to G9, J4 to J7, P24."""

from __future__ import annotations

from pyspark.sql import functions as F

from tersa.functions import symbols
from tersa.operators import graph
from tersa.plans.recipes import items, with_items
from tersa.queries import query

#: A graph over all files in one bundle: a file imports that of its language at half its number, as the recipes write it.
FILES = "f AS (SELECT ord, path, CAST(6 * floor(ord / 12) + ord % 6 AS BIGINT) AS target FROM items WHERE content_type = 'code'), e AS (SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON b.ord = a.target AND a.ord <> b.ord)"


def files(spark, sf_dir):
    return items(spark, sf_dir).filter("content_type = 'code'").withColumn("bundle_id", F.lit(0).cast("long"))


@query(with_items("SELECT src, dst FROM e").replace(" SELECT src, dst FROM e", f", {FILES} SELECT src, dst FROM e"))
def g5_g7_j4_edges(spark, sf_dir):
    return graph.edges(files(spark, sf_dir)).select("src", "dst")


#: Distances over all hops: a path stands once, at the first round that reaches it, and rounds end when none adds a path.
WALK = f""", {FILES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
 dist(path, distance) USING KEY (path) AS (SELECT path, 0 FROM f WHERE ord % 97 = 0
  UNION SELECT b, min(distance) + 1 FROM dist JOIN u ON a = path WHERE NOT EXISTS (FROM recurring.dist r WHERE r.path = b) GROUP BY b)"""


def walk(spark, sf_dir):
    f = files(spark, sf_dir)
    return graph.distances(graph.edges(f), f.filter("ord % 97 = 0").select("bundle_id", "path"))


def recursive(oracle: str) -> str:
    return oracle.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(with_items("SELECT 1").replace(" SELECT 1", WALK + " SELECT path, distance FROM dist")))
def g8_j6_distances(spark, sf_dir):
    return walk(spark, sf_dir).select("path", "distance")


SCORES = with_items("SELECT 1").replace(
    " SELECT 1",
    WALK
    + """ SELECT i.ord, least(100.0, greatest(1.0, CASE WHEN distance IS NULL THEN 5.0 WHEN distance = 0 THEN 40.0 WHEN distance = 1 THEN 30.0 WHEN distance = 2 THEN 20.0 ELSE 10.0 END + CASE WHEN i.ord % 97 = 0 THEN 30.0 WHEN i.ord % 13 = 0 THEN 15.0 ELSE 0.0 END
 + CASE WHEN i.role = 'system' OR i.kind = 'prompt' THEN 30.0 WHEN i.kind = 'conversation' THEN 20.0 WHEN i.kind = 'file' THEN 15.0 WHEN i.kind = 'diff' THEN 10.0 ELSE 5.0 END + CASE WHEN i.ord % 5 = 0 THEN 25.0 ELSE 0.0 END))::DOUBLE AS score FROM items i LEFT JOIN dist USING (path)""",
)


def scored(spark, sf_dir, reached):
    i = items(spark, sf_dir).withColumn("bundle_id", F.lit(0).cast("long")).withColumn("has_constraint", F.expr("ord % 5 = 0"))
    state = F.when(F.expr("ord % 97 = 0"), "dirty").when(F.expr("ord % 13 = 0"), "recent")
    status = i.filter("path IS NOT NULL").select("path", state.alias("state")).filter("state IS NOT NULL")
    found = graph.scores(i, reached, status)
    # items without a path have no status line; the recipe's state is theirs by id
    own = F.when(F.col("path").isNull(), state).otherwise(F.col("state"))
    return found.select("ord", graph.score(F.col("distance"), own, F.col("kind"), F.col("role"), F.col("has_constraint")).alias("score"))


@query(recursive(SCORES))
def p24_j5_j7_scores(spark, sf_dir):
    return scored(spark, sf_dir, walk(spark, sf_dir))


STATUS = "SELECT ord, concat(CASE ord % 4 WHEN 0 THEN ' M' WHEN 1 THEN '??' WHEN 2 THEN 'R ' ELSE '  ' END, ' ', CASE ord % 4 WHEN 1 THEN concat('\"./', path, '\"') WHEN 2 THEN concat('old.py -> ', path) ELSE path END) AS line FROM {items} WHERE path IS NOT NULL"
LOG = "SELECT CAST(ord % 9 AS BIGINT) AS commit, path FROM {items} WHERE path IS NOT NULL AND ord % 3 < 2"


@query(
    with_items(
        rf"""SELECT path, code, 'dirty' AS state, NULL::BIGINT AS age FROM (SELECT left(line, 2) AS code, regexp_replace(trim(string_split(substr(line, 4), '->')[-1], ' "'), '^(\./)+', '') AS path FROM ({STATUS.replace('{items}', 'items')})) WHERE code <> '  '
 UNION ALL SELECT path, NULL, 'recent', min(commit) FROM ({LOG.replace('{items}', 'items')}) l WHERE commit < 5 AND NOT EXISTS (SELECT 1 FROM ({STATUS.replace('{items}', 'items')}) s WHERE left(s.line, 2) <> '  ' AND contains(s.line, l.path)) GROUP BY path"""
    )
)
def g9_workspace_status(spark, sf_dir):
    """Porcelain lines of four kinds and the files of nine commits, of which five count."""
    items(spark, sf_dir).createOrReplaceTempView("tersa_status_items")
    of = lambda sql: spark.sql(sql.replace("{items}", "tersa_status_items"))
    return graph.workspace_status(of(STATUS).select("line"), of(LOG))


@query(with_items("SELECT ord, CASE WHEN language = 'python' THEN 'fn_' || ord ELSE 'fn_' || ord || '|limit_' || ord END AS exported FROM items WHERE content_type = 'code'"))
def g6_exports(spark, sf_dir):
    return items(spark, sf_dir).filter("content_type = 'code'").select("ord", F.array_join(symbols.exports(F.col("content"), F.col("language")), "|").alias("exported"))
