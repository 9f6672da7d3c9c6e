"""The reduction engine, set at a time: choose, elide, check, repair, fall back.

Every step is a projection or an aggregation by bundle; originals travel in the row, so before and after are never joined.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.functions import directives as D
from tersa.functions import symbols as S
from tersa.functions import text as T
from tersa.functions.tokens import token_estimate
from tersa.operators import metrics, scanners
from tersa.operators.elision import bundle_tokens, eligibility, has_symbols, token_ceiling
from tersa.storage import materialize


@dataclass(frozen=True)
class Budget:
    """Limits of a reduction; values out of range raise ValueError on the driver."""

    max_input_tokens: int | None = None
    max_output_tokens: int | None = None
    target_reduction_ratio: float | None = None
    max_latency_ms: int | None = None
    risk_tolerance: str = "low"
    preserve_kinds: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("max_input_tokens", "max_output_tokens", "max_latency_ms"):
            v = getattr(self, name)
            if v is not None and (not isinstance(v, int) or v < 0):
                raise ValueError(f"{name} must be a whole number of 0 or more")
        r = self.target_reduction_ratio
        if r is not None and not 0 <= r <= 1:
            raise ValueError("target_reduction_ratio must be within 0 and 1")
        if self.risk_tolerance not in ("low", "medium", "high"):
            raise ValueError("risk_tolerance must be low, medium or high")
        if unknown := set(self.preserve_kinds) - set(metrics.KINDS):
            raise ValueError(f"no such kinds: {sorted(unknown)}")
        object.__setattr__(self, "preserve_kinds", tuple(dict.fromkeys(self.preserve_kinds)))

    def merged(self, other: "Budget") -> "Budget":
        """other's fields where it sets them."""
        default = Budget()
        return Budget(**{f: getattr(other, f) if getattr(other, f) != getattr(default, f) else getattr(self, f) for f in self.__dataclass_fields__})


def plan_mode(session: bool, budget: Budget) -> tuple[str, list[str]]:
    """The mode of a plan and its stages."""
    if session:
        return "session_dedup", ["cleanup:session-dedup"]
    if (budget.max_input_tokens or 0) > 0 or (budget.target_reduction_ratio or 0) > 0:
        return "topology_knapsack", ["cleanup:constraint-preservation", "pruning:topology-pruner", "compression:token-hashing", "compression:delta-compression"]
    return "pass_through", []


def elide_bodies(items: DataFrame, ratio: float, preserve: tuple[str, ...] = (), keep_docstrings: bool = False, most: int | None = None, recoverable: bool = False) -> DataFrame:
    """items with original_content, regions_elided, whole_elided and content after elision to each bundle's ceiling.

    The ceiling is the lesser of ``most`` tokens and what ``ratio`` leaves; items that have a column ``ceiling`` bring their own.
    Items are taken in order while the bundle is above it. Code loses statements of function bodies, one by one as far as it
    is needed, if the check of its language finds no more issues than before. Other items without symbols become markers only
    if a store can give them back (``recoverable``): else nothing would witness what they held, and the gates would undo it
    after the ceiling was spent on it. A bundle is one group: what one item saves decides about the next.
    """
    e = eligibility(items, preserve).withColumn("check", scanners.validator(F.col("language"), F.col("path"), F.col("content_type")))
    can = F.col("eligible") & ~has_symbols(F.col("content"), F.col("content_type")) & F.col("check").isNull()
    e = e.withColumn("whole", can if recoverable else F.lit(False))
    e = e.withColumn("tokens", token_estimate(F.col("content"))).withColumn("marker_tokens", token_estimate(F.col("marker")))
    if "ceiling" not in items.columns:
        e = e.withColumn("ceiling", token_ceiling(F.sum("tokens").over(Window.partitionBy("bundle_id")), F.lit(most).cast("long"), F.lit(ratio)))
    columns = ["bundle_id", "ord", "item_id", "kind", "content_type", "language", "path", "role", "content"]
    rows = e.select(*columns, "marker", "preserved", "is_system", "already", "structured", "too_short", "check", "whole", "tokens", "marker_tokens", "ceiling")
    schema = "bundle_id long, ord long, item_id string, kind string, content_type string, language string, path string, role string, content string, original_content string, regions_elided int, whole_elided boolean"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        running, ceiling = int(pdf.tokens.sum()), pdf.ceiling.iloc[0]
        out = []
        for r in pdf.to_dict("records"):
            content, n, whole = r["content"], 0, False
            over = running - ceiling if pd.notna(ceiling) else 0
            if over > 0 and not (r["preserved"] or r["is_system"] or r["already"] or r["structured"] or r["too_short"]):
                if r["check"] in ("python", "script"):
                    content, n, saved = _elide_regions(content, r["language"], r["check"], over, keep_docstrings)
                    running -= saved
                elif r["whole"] and r["marker_tokens"] < r["tokens"]:
                    content, whole = r["marker"], True
                    running -= int(r["tokens"] - r["marker_tokens"])
            out.append([*(r[c] for c in columns[:-1]), content, r["content"], n, whole])
        return pd.DataFrame(out, columns=[*columns, "original_content", "regions_elided", "whole_elided"])

    return rows.groupBy("bundle_id").applyInPandas(run, schema)


def _estimate(text: str) -> int:
    """token_estimate() of one text, for decisions within a group."""
    import math

    from tersa.functions.tokens import WEIGHTS

    if not text:
        return 0
    space = sum(map(text.count, " \t\n\r"))
    wide = sum(ord(c) > 127 for c in text)
    punct = sum(1 for c in text if c < "\x7f" and c > " " and not c.isalnum())
    return max(1, math.ceil((len(text) - space - wide - punct) * WEIGHTS["word"] + punct * WEIGHTS["punct"] + space * WEIGHTS["space"] + wide * WEIGHTS["wide"]))


def region_marker(text: str) -> str:
    n = text.count("\n") + 1
    return f"[{T.BRAND}: {n} {T.BODY_NOUN} {'line' if n == 1 else 'lines'} elided, {len(text)} bytes, sha256:{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()[:12]}]"


def _elide_regions(text: str, language: str | None, check: str, over: int, keep_docstrings: bool) -> tuple[str, int, int]:
    """(text, spans replaced, tokens saved): of the bodies' statements, or of whole bodies if statements cannot free enough, those that free least, until enough is freed.

    They are replaced in order of place; one is left if the check gets worse by it.
    """
    language = language or ("python" if check == "python" else "typescript")
    bodies = scanners.regions(text, language, keep_docstrings)
    lead, tail = ("# ", "") if language == "python" else ("/* ", " */")

    def price(spans: list[tuple[int, int]]) -> list[tuple]:
        out = []
        for s, e in spans:
            marker = lead + region_marker(text[s:e]) + tail
            if language == "python":  # a block needs a statement
                marker = f"pass  {marker}"
            freed = _estimate(text[s:e]) - _estimate(marker)
            if len(marker) < e - s and freed > 0:
                out.append((freed, s, e, marker))
        return out

    priced = price([part for s, e in bodies for part in scanners.statements(text, s, e, language) or [(s, e)]])
    if sum(p[0] for p in priced) < over:  # statements as short as their markers would not do
        priced = price(bodies)
    taken, got = [], 0
    for p in sorted(priced):
        if got < over:
            taken.append(p)
            got += p[0]
    issues = len(scanners.CHECKS[check](text))
    out, n = text, 0
    for _, s, e, marker in sorted(taken, key=lambda p: -p[1]):  # from the end, so that places before stay
        tried = out[:s] + marker + out[e:]
        if len(scanners.CHECKS[check](tried)) <= issues:
            out, n = tried, n + 1
    return out, n, (_estimate(text) - _estimate(out)) if n else 0


def issues(items: DataFrame, max_tokens: int | None = None, recoverable: bool = False) -> DataFrame:
    """bundle_id, item_id, code, severity, message of items with original_content and content: balance, directives, drift, budget.

    Drift compares what items say with what they said; of whole items that a store can give back (``recoverable``) nothing
    is lost. Rows with ``pruned`` set are out of both sides.
    """
    if "pruned" in items.columns:
        items = items.filter(~F.coalesce("pruned", F.lit(False)))
    changed = items.filter("content <> original_content")
    # regions_elided is null for items that no longer say how they changed
    checked = changed.withColumn("check", scanners.validator(F.col("language"), F.col("path"), F.col("content_type"))).filter("check IS NOT NULL")
    worse = checked.select("bundle_id", "item_id", scanners.balance_issues("content", "check").alias("after"), scanners.balance_issues("original_content", "check").alias("before"))
    balance = worse.filter(F.size("after") > F.size("before")).select("bundle_id", "item_id", F.col("after")[0]["code"].alias("code"), F.lit("error").alias("severity"), F.col("after")[0]["message"].alias("message"))
    said = D.directives(D.prose_regions(F.col("original_content"), F.col("content_type")))
    lost = changed.select("bundle_id", "item_id", F.explode(F.filter(said, lambda d: ~F.contains(F.col("content"), d))).alias("message"))
    lost = lost.select("bundle_id", "item_id", F.lit("CONSTRAINT_DIRECTIVE_LOST").alias("code"), F.lit("error").alias("severity"), "message")
    none = F.array().cast("array<string>")
    still = F.when(F.col("whole_elided"), F.col("original_content")).otherwise(F.col("content")) if recoverable else F.col("content")
    measured = items.withColumn("still", still)
    tags = measured.select(
        "bundle_id",
        S.symbols(F.col("original_content"), F.col("content_type")).alias("symbols_before"),
        S.symbols(F.col("still"), F.col("content_type")).alias("symbols_after"),
        S.markers(F.col("original_content"), F.col("content_type"), F.col("path"), none).alias("markers_before"),
        S.markers(F.col("still"), F.col("content_type"), F.col("path"), none).alias("markers_after"),
    )
    drifted = metrics.bundle_drift(tags).filter("refused").select("bundle_id", F.lit(None).cast("string").alias("item_id"), F.lit("DRIFT_EXCEEDED").alias("code"), F.lit("error").alias("severity"), F.col("drift").cast("string").alias("message"))
    gone = measured.filter("still <> original_content")
    unwitnessed = gone.filter((F.size(S.symbols(F.col("original_content"), F.col("content_type"))) == 0) & (F.size(S.content_markers(F.col("still"), F.col("content_type"))) == 0))
    unmeasured = unwitnessed.select("bundle_id", "item_id", F.lit("UNMEASURABLE").alias("code"), F.lit("error").alias("severity"), F.lit("nothing witnesses what was elided").alias("message"))
    out = balance.unionByName(lost).unionByName(drifted).unionByName(unmeasured)
    if max_tokens:
        over = bundle_tokens(items).filter(F.col("n_tokens") > max_tokens)
        out = out.unionByName(over.select("bundle_id", F.lit(None).cast("string").alias("item_id"), F.lit("BUDGET_EXCEEDED").alias("code"), F.lit("error").alias("severity"), F.col("n_tokens").cast("string").alias("message")))
    return out


def attribution(found: DataFrame) -> DataFrame:
    """bundle_id, items, unattributable: whose errors can be repaired, in order, and whether any error names no item."""
    errors = found.filter("severity = 'error'").groupBy("bundle_id")
    return errors.agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.bool_or(F.col("item_id").isNull()).alias("unattributable"))


def repair(items: DataFrame, found: DataFrame) -> DataFrame:
    """items whose own errors are undone: their content is the original again; reverted says so."""
    bad = found.filter("severity = 'error' AND item_id IS NOT NULL").select("bundle_id", "item_id").distinct().withColumn("reverted", F.lit(True))
    joined = items.join(bad, ["bundle_id", "item_id"], "left").withColumn("reverted", F.coalesce("reverted", F.lit(False)))
    return joined.withColumn("content", F.when(F.col("reverted"), F.col("original_content")).otherwise(F.col("content")))


def verdicts(items: DataFrame, found: DataFrame) -> DataFrame:
    """bundle_id, passed, confidence, reason: passed without errors; reason is the distinct codes in order."""
    errors = found.filter("severity = 'error'").groupBy("bundle_id").agg(F.array_join(F.sort_array(F.collect_set("code")), "; ").alias("reason"))
    every = items.select("bundle_id").distinct().join(errors, "bundle_id", "left")
    return every.select("bundle_id", F.col("reason").isNull().alias("passed"), F.when(F.col("reason").isNull(), 1.0).otherwise(0.0).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"))


def refused(repaired: DataFrame) -> DataFrame:
    """bundle_id of the bundles whose repair left nothing changed: that is a fallback, and not a reduction that passed."""
    stays = F.col("content") == F.col("original_content")
    if "pruned" in repaired.columns:
        stays = stays & ~F.coalesce("pruned", F.lit(False))
    return repaired.groupBy("bundle_id").agg((F.bool_and(stays) & F.bool_or("reverted")).alias("refused")).filter("refused").drop("refused")


def fall_back(items: DataFrame, verdict: DataFrame) -> DataFrame:
    """items of bundles that passed as they are, of the others as they came."""
    v = items.join(verdict.select("bundle_id", "passed"), "bundle_id")
    if "pruned" in items.columns:
        v = v.withColumn("pruned", F.col("pruned") & F.col("passed"))
    return v.withColumn("content", F.when(F.col("passed"), F.col("content")).otherwise(F.col("original_content")))


def stages(items: DataFrame, budget: Budget, changed: DataFrame | None = None, status: DataFrame | None = None, base: DataFrame | None = None, keep_docstrings: bool = False, recoverable: bool = False) -> DataFrame:
    """The plan of the budget, stage by stage: constraints are recorded, items pruned, bodies elided, versions told as deltas.

    Items that pruning drops stay as rows with ``pruned`` set. Pruning needs the workspace (``changed``: bundle_id, path;
    ``status``: path, state), deltas a base (as for plans.stages.delta); without them these stages are left out.
    """
    from tersa.plans import stages as P

    mode, _ = plan_mode(False, budget)
    ratio, most = budget.target_reduction_ratio or 0.0, budget.max_input_tokens
    if mode == "pass_through":
        return items.withColumn("original_content", F.col("content")).withColumn("regions_elided", F.lit(0)).withColumn("whole_elided", F.lit(False)).withColumn("pruned", F.lit(False))
    tokens = F.sum(token_estimate(F.col("content"))).over(Window.partitionBy("bundle_id"))
    now = items.withColumn("ceiling", token_ceiling(tokens, F.lit(most).cast("long"), F.lit(ratio)))
    dropped = None
    if changed is not None:
        none = items.sparkSession.createDataFrame([], "path string, state string")
        pruned = P.prune(now.drop("ceiling"), changed, none if status is None else status, ratio, preserve=budget.preserve_kinds, most=most)
        now = now.join(materialize(pruned.select("bundle_id", "ord", "selected"), "reduce-selected"), ["bundle_id", "ord"])
        dropped = now.filter("NOT selected").drop("selected", "ceiling")
        now = now.filter("selected").drop("selected")
    out = elide_bodies(now, ratio, budget.preserve_kinds, keep_docstrings, most, recoverable)
    if base is not None:
        same = out.filter("content = original_content")
        told = P.delta(same.withColumn("origin", F.lit(None).cast("string")), base).select("item_id", "delta").filter("delta IS NOT NULL")
        out = out.join(told, "item_id", "left").withColumn("content", F.coalesce("delta", "content")).drop("delta")
    out = out.withColumn("pruned", F.lit(False))
    if dropped is None:
        return out
    gone = dropped.withColumn("original_content", F.col("content")).withColumn("regions_elided", F.lit(0)).withColumn("whole_elided", F.lit(False)).withColumn("pruned", F.lit(True))
    return out.unionByName(gone.select(out.columns))


def reduce_bundles(items: DataFrame, budget: Budget, changed: DataFrame | None = None, status: DataFrame | None = None, base: DataFrame | None = None, keep_docstrings: bool = False, recoverable: bool = False) -> DataFrame:
    """items after the plan's stages, check, one repair and fallback, with original_content, pruned, reverted and passed; see stages()."""
    most = budget.max_input_tokens
    elided = materialize(stages(items, budget, changed, status, base, keep_docstrings, recoverable), "reduce-elided")
    repaired = materialize(repair(elided, issues(elided, most, recoverable)), "reduce-repaired")
    nothing = refused(repaired).withColumn("refused", F.lit(True))
    verdict = verdicts(repaired, issues(repaired, most, recoverable)).join(nothing, "bundle_id", "left")
    verdict = materialize(verdict.withColumn("passed", F.col("passed") & F.col("refused").isNull()).drop("refused"), "reduce-verdicts")
    return fall_back(repaired, verdict)


def rehydrated(items: DataFrame, blocks: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """items whose markers and deltas are undone where a store can: those of candidates (bundle_id, item_id), or all; rehydrated says which changed.

    This is what a bundle gets whose debt, confidence or checks are bad, before it is checked again (issues, verdicts).
    """
    from tersa.operators.lookups import rehydrate

    wanted = items.withColumn("wanted", F.lit(True)) if candidates is None else items.join(candidates.select("bundle_id", "item_id").distinct().withColumn("wanted", F.lit(True)), ["bundle_id", "item_id"], "left")
    delta = F.col("content").startswith(f"[{T.BRAND} Delta:")
    open_ = wanted.withColumn("was", F.col("content")).withColumn("content", F.when(F.col("wanted") & delta, F.col("original_content")).otherwise(F.col("content")))
    back = rehydrate(open_.filter("wanted"), blocks, ["bundle_id", "item_id"]).unionByName(open_.filter("wanted IS NULL"))
    return back.withColumn("rehydrated", F.col("content") != F.col("was")).drop("was", "wanted")


def trace(reduced: DataFrame) -> DataFrame:
    """bundle_id, tokens_before, tokens_after, saved_ratio, n_changed, n_pruned, n_reverted, fallback."""
    before = bundle_tokens(reduced, "original_content").withColumnRenamed("n_tokens", "tokens_before")
    after = bundle_tokens(reduced.filter("NOT pruned")).withColumnRenamed("n_tokens", "tokens_after")
    counts = reduced.groupBy("bundle_id").agg(
        F.count_if(F.col("content") != F.col("original_content")).alias("n_changed"), F.count_if("pruned").alias("n_pruned"), F.count_if("reverted").alias("n_reverted"), (~F.bool_and("passed")).alias("fallback")
    )
    out = before.join(after, "bundle_id", "left").join(counts, "bundle_id").withColumn("tokens_after", F.coalesce("tokens_after", F.lit(0).cast("long")))
    saved = F.when(F.col("tokens_before") > 0, 1 - F.col("tokens_after") / F.col("tokens_before")).otherwise(F.lit(0.0))
    return out.withColumn("saved_ratio", saved)
