"""Import graphs: edges from imports, distances from changed files, scores."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.functions import symbols as S
from tersa.functions import text as T
from tersa.storage import materialize

#: What may follow an import's path, in this order; scores by distance, workspace state and kind.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py")
DISTANCE_SCORES, FAR_SCORE, UNREACHED_SCORE = {0: 40.0, 1: 30.0, 2: 20.0}, 10.0, 5.0
DIRTY_SCORE, RECENT_SCORE, CONSTRAINT_SCORE = 30.0, 15.0, 25.0
KIND_SCORES, OTHER_SCORE = {"prompt": 30.0, "conversation": 20.0, "file": 15.0, "diff": 10.0}, 5.0
#: After so many hops what was reached is written as one table, so that plans stay short on long chains.
UNION_HOPS = 32


def import_paths(items: DataFrame) -> DataFrame:
    """bundle_id, src, target: what each item's text imports, as a path without suffix."""
    files = items.filter("path IS NOT NULL").withColumn("src", T.normalize_path(F.col("path")))
    py = files.filter("language = 'python'").select("bundle_id", "src", F.explode(S.python_imports(F.col("content"))).alias("m"))
    slashed = F.replace(F.col("m.module"), F.lit("."), F.lit("/"))
    up = F.concat(F.repeat(F.lit("../"), F.col("m.dots") - 1), slashed)
    py = py.select("bundle_id", "src", F.when(F.col("m.dots") > 0, T.resolve_path(F.col("src"), up)).otherwise(slashed).alias("target"))
    js = files.filter("language IN ('typescript', 'javascript')").select("bundle_id", "src", F.explode(S.script_imports(F.col("content"))).alias("m"))
    js = js.select("bundle_id", "src", F.when(F.col("m").rlike(r"^\.{1,2}/"), T.resolve_path(F.col("src"), F.col("m"))).otherwise(T.normalize_path(F.col("m"))).alias("target"))
    return py.unionByName(js).distinct()


def edges(items: DataFrame) -> DataFrame:
    """bundle_id, src, dst: imports resolved to items of the bundle, by the first suffix that names one; none to itself."""
    known = items.filter("path IS NOT NULL").select("bundle_id", T.normalize_path(F.col("path")).alias("dst")).distinct()
    tries = F.posexplode(F.array(*map(F.lit, SUFFIXES)))
    candidates = import_paths(items).select("bundle_id", "src", "target", tries.alias("rank", "suffix")).withColumn("dst", F.concat("target", "suffix"))
    hit = candidates.join(known, ["bundle_id", "dst"]).groupBy("bundle_id", "src", "target").agg(F.min_by("dst", "rank").alias("dst"))
    return hit.filter("src <> dst").select("bundle_id", "src", "dst").distinct()


def distances(edges_: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """bundle_id, path, distance: hops to the nearest source (bundle_id, path), edges taken both ways, of all that is reachable.

    A frontier is joined a hop a round, for all bundles at once; nodes reached once are left out, so rounds end at the longest distance,
    or at max_hops if a caller wants near ones only.
    """
    both = edges_.select("bundle_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    both = materialize(both.unionByName(both.select("bundle_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    frontier = materialize(sources.select("bundle_id", "path").distinct().withColumn("distance", F.lit(0)), "graph-frontier")
    reached = frontier
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        here = frontier.select("bundle_id", F.col("path").alias("a"))
        step = here.join(both, ["bundle_id", "a"]).select("bundle_id", F.col("b").alias("path")).distinct()
        frontier = materialize(step.join(reached, ["bundle_id", "path"], "left_anti").withColumn("distance", F.lit(hop)), "graph-frontier")
        if not frontier.head(1):
            break
        reached = reached.unionByName(frontier)
        if hop % UNION_HOPS == 0:
            reached = materialize(reached, "graph-reached")
    return reached


def scores(items: DataFrame, reached: DataFrame, status: DataFrame) -> DataFrame:
    """items with distance, score: by distance, status (path, state: dirty or recent), kind, role and constraints; 1 to 100."""
    d = items.join(reached, ["bundle_id", "path"], "left").join(status, "path", "left")
    return d.withColumn("score", score(F.col("distance"), F.col("state"), F.col("kind"), F.col("role"), F.col("has_constraint")))


def score(distance: Column, state: Column, kind: Column, role: Column, has_constraint: Column) -> Column:
    near = F.when(distance.isNull(), F.lit(UNREACHED_SCORE))
    for k, v in DISTANCE_SCORES.items():
        near = near.when(distance == k, F.lit(v))
    near = near.otherwise(F.lit(FAR_SCORE))
    of_state = F.when(state == "dirty", F.lit(DIRTY_SCORE)).when(state == "recent", F.lit(RECENT_SCORE)).otherwise(F.lit(0.0))
    of_kind = F.when(role == "system", F.lit(KIND_SCORES["prompt"]))
    for k, v in KIND_SCORES.items():
        of_kind = of_kind.when(kind == k, F.lit(v))
    of_kind = of_kind.otherwise(F.lit(OTHER_SCORE))
    total = near + of_state + of_kind + F.when(has_constraint, F.lit(CONSTRAINT_SCORE)).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(1.0), total))


def workspace_status(lines: DataFrame, log: DataFrame | None = None, commits: int = 5) -> DataFrame:
    """path, code, state, age: dirty files from porcelain lines, then, from the last commits, recent ones.

    lines: `XY path` or `XY old -> new`; quotes are dropped, untracked files are dirty too, a line of two blanks says nothing.
    log: commit (0 for the last) and path of the files of commits; of those before ``commits`` the first that names a path is
    its age. A dirty file has no age; one that is dirty and recent is dirty.
    """
    parsed = lines.select(F.substring("line", 1, 2).alias("code"), F.substring("line", 4, 1 << 30).alias("rest")).filter("length(rest) > 0 AND code <> '  '")
    name = F.regexp_replace(F.trim(F.element_at(F.split("rest", "->"), -1)), '^"|"$', "")
    none = F.lit(None)
    dirty = parsed.select(T.normalize_path(name).alias("path"), "code", F.lit("dirty").alias("state"), none.cast("long").alias("age"))
    if log is None:
        return dirty
    named = log.filter(F.col("commit") < commits).select(T.normalize_path(F.trim("path")).alias("path"), F.col("commit").cast("long").alias("commit")).filter("path <> ''")
    recent = named.groupBy("path").agg(F.min("commit").alias("age")).join(dirty.select("path"), "path", "left_anti")
    return dirty.unionByName(recent.select("path", none.cast("string").alias("code"), F.lit("recent").alias("state"), "age"))
