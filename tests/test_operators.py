"""Operators against brute force and hand-made cases."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tersa.functions import classify, directives, text, tokens
from tersa.functions.register import register
from tersa.operators import diffs, elision, lookups, scanners, selection
from tersa.plans.reduce import Budget, reduce_bundles, region_marker, trace
from tersa.plans.recipes import items
from tersa.sources import files, fixtures, payloads, reports


def test_token_estimate(spark):
    got = spark.createDataFrame([("",), ("a",), ("hello, world\n",), ("é😀",), (None,)], "t string").select(tokens.token_estimate(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 1, 4, 3, 0]
    register(spark)
    assert spark.sql("SELECT token_estimate('hello, world\n')").first()[0] == 4


@pytest.mark.parametrize(
    "body,path,kind",
    [
        ('{"a": 1}', None, "json"),
        ("a: 1\nb: 2\n", None, "yaml"),
        ("---\nkey: |\n  free text here\n  and: more\n", None, "yaml"),
        ("<p>x</p>", None, "html"),
        ("12:00:01 ERROR x\n12:00:02 INFO y", None, "logs"),
        ("import os\n\ndef f(x):\n    return x\n", None, "code"),
        ("see\n- one\n- two", None, "markdown"),
        ("# only a heading", None, "text"),
        ("  \n ", None, "unknown"),
        ("anything", "a/b.RS", "code"),
        ("anything", "notes.md", "markdown"),
    ],
)
def test_content_type(spark, body, path, kind):
    df = spark.createDataFrame([(body, path)], "c string, p string")
    assert df.select(classify.content_type(F.col("c"), F.col("p"))).first()[0] == kind


def test_directives(spark):
    body = "You must not go. It has never failed. Never\tskip; MUST  NOT stop!\nfine"
    r = spark.createDataFrame([(body,)], "c string").select(directives.directives(F.col("c")).alias("d")).select("d", directives.keywords(F.col("d"))).first()
    assert r[0] == ["You must not go.", "Never\tskip;", "MUST  NOT stop!"]
    assert r[1] == ["must not", "must", "Never", "MUST NOT", "MUST"]


def test_prose_regions_of_code(spark):
    body = 'x = 1\n"""doc\nmust\n"""\n# note\ny = critical()\n/* a\n b */ z\n// c'
    r = spark.createDataFrame([(body,)], "c string").select(directives.prose_regions(F.col("c"), F.lit("code"))).first()
    assert r[0] == '"""doc\nmust\n"""\n# note\n/* a\n b */ z\n// c'


def brute(weights, values, room):
    return max(sum(v for v, t in zip(values, take) if t) for take in itertools.product((0, 1), repeat=len(weights)) if sum(w for w, t in zip(weights, take) if t) <= room)


def test_knapsack_is_optimal():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        w, v, room = [rng.randint(0, 12) for _ in range(n)], [rng.randint(1, 9) for _ in range(n)], rng.randint(0, 30)
        took = selection.solve_exact(np.array(w), np.array(v, float), room)
        assert sum(np.array(w)[took]) <= room
        assert sum(np.array(v)[took]) == brute(w, v, room)


def test_selection_keeps_budgets(spark):
    rows = [(b, k, 1 + (b * 31 + k * 17) % 50, float(1 + (k * 7 + b) % 13), k == 0, 300 if b else 20_000) for b in range(3) for k in range(40 if b else 130)]
    rows = [(b, k, w * (1 if b else 10), v, p, m) for b, k, w, v, p, m in rows]
    df = spark.createDataFrame(rows, "bundle_id long, ord long, weight long, value double, pinned boolean, budget long")
    out = selection.select(df).toPandas()
    for b, g in out.groupby("bundle_id"):
        assert g[g.selected].weight.sum() <= g.budget.iloc[0]
        assert g[g.pinned].selected.all()
    assert set(out.strategy) == {"greedy", "dp"}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_diffs_replay_and_are_least():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        ops = diffs.line_diff(a, b)
        assert [x for op, x in ops if op != "add"] == a
        assert [x for op, x in ops if op != "delete"] == b
        assert sum(op == "keep" for op, _ in ops) == lcs(a, b)


def test_unified_diff():
    old, new = "\n".join(map(str, range(20))).split("\n"), "\n".join(str(x) for x in range(20) if x != 9).split("\n")
    d = diffs.unified(diffs.line_diff(old, new), "a", "b", 2)
    assert d == "--- a\n+++ b\n@@ -8,5 +8,4 @@\n 7\n 8\n-9\n 10\n 11"
    assert diffs.unified(diffs.line_diff(old, old), "a", "b") == ""
    assert "\x1b[31m-9" in reports.unified_terminal(d)
    assert reports.side_by_side(diffs.line_diff(["a", "b"], ["a", "c"]), 3) == "a     a\nb   | c"


@pytest.mark.parametrize(
    "check,body,codes",
    [
        ("script", "function f() { return `a${ {b: 1}.b }` }", []),
        ("script", "const r = /[(]\\(/.test(x) ? '(' : \"[\"; // )", []),
        ("script", "f(1", ["AST_UNBALANCED_BRACKET"]),
        ("script", "f(]", ["AST_UNBALANCED_BRACKET"]),
        ("script", "x = 'abc\n y", ["AST_UNTERMINATED_STRING"]),
        ("script", "a /* b", ["AST_UNTERMINATED_COMMENT"]),
        ("script", "a = b / c / d; e(')')", []),
        ("python", "def f(x):\n    return [x,\n  1]\n", []),
        ("python", "def f(x):\nreturn 1\n", ["AST_INDENTATION_ERROR"]),
        ("python", "x = 1\n    y = 2\n", ["AST_INDENTATION_ERROR"]),
        ("python", "if x:\n        a\n    b\n", ["AST_INDENTATION_ERROR"]),
        ("python", "s = 'a\n", ["AST_UNTERMINATED_STRING"]),
        ("python", 's = """a\n', ["AST_UNTERMINATED_STRING"]),
        ("python", "x = (1,\n", ["AST_UNBALANCED_BRACKET"]),
        ("python", "while True:\n", ["AST_COLON_MISMATCH"]),
        ("python", 'd = """x)(\n  y"""\nif d:\n\tpass # :\n', []),
        ("json", '[1] x', ["JSON_SYNTAX_ERROR"]),
        ("json", "NaN", ["JSON_SYNTAX_ERROR"]),
        ("json", " ", ["JSON_SYNTAX_ERROR"]),
        ("json", '{"a": [1, 2.5e3]}', []),
    ],
)
def test_balance(check, body, codes):
    assert [c for _, _, c, _ in scanners.CHECKS[check](body)] == codes


def test_regions():
    long_ = "    x = compute(1, 2, 3)\n" * 6
    py = f'def f(a):\n    """Says."""\n{long_}\nclass C:\n    def g(self):\n        return 1\n'
    (s, e), = scanners.regions(py, "python")
    assert py[s:e].startswith('"""Says."""') and py[s:e].endswith("3)")
    (s, e), = scanners.regions(py, "python", keep_docstrings=True)
    assert py[s:e].startswith("x = ")
    ts = "export function f(a: string): string {\n" + "  call(a);\n" * 15 + "}\nclass D { m() { return 1; } }\nif (x) {" + " y();" * 40 + " }\n"
    (s, e), = scanners.regions(ts, "typescript")
    assert ts[s - 1] == "{" and ts[e] == "}" and len(scanners.statements(ts, s, e, "typescript")) == 15
    assert scanners.regions("x" * 500, "rust") == []
    only_words = 'def f():\n    """' + "a " * 100 + '"""\n'
    assert scanners.regions(only_words, "python") == []


def test_regions_fuzz():
    rng = random.Random(7)
    parts = ["def f(x):\n", "    ", "return x\n", "function g() {", "}", "'", '"', "`", "${", "/*", "*/", "//", "#", "\n", "(", ")", "[", "]", "if (a) ", "=> ", "\\", '"""', "/", "a b", "\t", "{"]
    for _ in range(300):
        body = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        for lang in ("python", "typescript"):
            spans = scanners.regions(body, lang, least=3)
            assert all(0 <= s < e <= len(body) for s, e in spans)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for check in scanners.CHECKS.values():
            check(body)


def test_region_marker_is_found(spark):
    mark = region_marker("a\nb")
    r = spark.createDataFrame([(mark,)], "m string").select(text.marker_refs(F.col("m")), text.has_marker(F.col("m"))).first()
    assert r[0] == [mark[-13:-1]] and r[1]


def test_engine(spark, sf_dir):
    out = reduce_bundles(items(spark, sf_dir), Budget(target_reduction_ratio=0.3))
    pdf = out.toPandas()
    assert (pdf[pdf.role == "system"].content == pdf[pdf.role == "system"].original_content).all()
    changed = pdf[pdf.content != pdf.original_content]
    assert (changed.content.str.len() < changed.original_content.str.len()).all()
    for r in changed.to_dict("records"):  # what is elided can be told by its marker
        assert "[tersa:" in r["content"]
    t = trace(out).toPandas()
    assert (t.tokens_after <= t.tokens_before).all()
    again = reduce_bundles(items(spark, sf_dir).repartition(3), Budget(target_reduction_ratio=0.3)).toPandas()
    assert sorted(again.content) == sorted(pdf.content)


def test_budget():
    with pytest.raises(ValueError):
        Budget(target_reduction_ratio=1.5)
    with pytest.raises(ValueError):
        Budget(max_input_tokens=-1)
    assert Budget(preserve_kinds=("file", "file")).preserve_kinds == ("file",)
    assert Budget(max_input_tokens=5).merged(Budget(target_reduction_ratio=0.2)) == Budget(max_input_tokens=5, target_reduction_ratio=0.2)


def test_splice():
    body = json.dumps({"messages": [{"content": "aaaa"}, {"content": "aaaa"}, {"content": "b"}]})
    assert json.loads(payloads.splice(body, [("aaaa", "aaaa"), ("aaaa", "x")]))["messages"][1]["content"] == "x"
    assert payloads.splice(body, [("zz", "x")]) == body
    assert payloads.splice(body, [("b", "longer")]) == body


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1\n")
    (tmp_path / "a" / "bad.md").write_bytes(b"caf\xe9")
    (tmp_path / "a" / "skip.bin").write_bytes(b"1")
    (tmp_path / "node_modules" / "y.js").write_text("y")
    got = files.scan(spark, str(tmp_path), str(tmp_path / "a"))
    made = {r["path"].rpartition("/")[2]: r for r in files.as_items(got).collect()}
    assert set(made) == {"x.py", "bad.md"}
    assert made["x.py"]["content_type"] == "code" and made["x.py"]["representable"] and not made["bad.md"]["representable"]
    manifest = files.freeze(got.withColumn("bucket", F.lit("b")), 10, expect=got.count()).persist()
    manifest.count()
    (tmp_path / "a" / "x.py").write_text("x = 2\n")
    assert [r["problem"] for r in files.verify(manifest, files.scan(spark, str(tmp_path))).collect()] == ["changed"]


def test_fixtures(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"task_id": "H/0", "prompt": "def f(x):\n    pass\n", "canonical_solution": "x", "entry_point": "f", "test": "t"}]))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "c0", "repo": "r", "path": "a/b.ts", "prompt": "let a = 1;", "completion": "x"}]))
    both = fixtures.load(spark, "both", str(tmp_path / "h.json"), str(tmp_path / "c.json"))
    assert sorted((r["dataset"], r["language"], r["path"]) for r in both.collect()) == [("codexglue", "typescript", "a/b.ts"), ("humaneval", "python", "src/f.py")]
    judged = fixtures.evaluate(fixtures.as_items(both).select(F.col("content").alias("prompt"), F.col("content").alias("output"), F.lit("python").alias("check")))
    assert judged.filter("passed").count() == 2
    with pytest.raises(ValueError):
        fixtures.load(spark, "other", "x")


def test_ambiguous_references_find_nothing(spark):
    blocks = spark.createDataFrame([("abcdef123456aa", "x"), ("abcdef123456bb", "y"), ("ffffffffffffcc", "z")], "hash string, block string")
    rows = spark.createDataFrame([("abcdef123456",), ("ffffffffffff",)], "ref string")
    assert sorted((r["ref"], r["block"]) for r in lookups.resolve_refs(rows, blocks).collect()) == [("abcdef123456", None), ("ffffffffffff", "z")]


def test_plans_stay_native(spark, sf_dir):
    """Session dedup and the prefix lock run in the JVM, and the scan reads only what they use."""
    from tersa.plans.recipes import turns

    plan = elision.session_dedup(turns(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    narrow = spark.read.parquet(f"{sf_dir}/documents.parquet").select(tokens.token_estimate(F.col("text")))
    assert "ReadSchema: struct<text:string>" in narrow._jdf.queryExecution().executedPlan().toString()


def test_streaming_state(spark, tmp_path):
    from tersa.streaming.sessions import seen_state, seen_within_watermark

    src = str(tmp_path / "in")
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "a"), (2, 0, 0, "a"), (1, 1, 1, "c"), (1, 2, 0, "c")]
    spark.createDataFrame(rows, "session_id long, turn long, ord long, content string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session_id long, turn long, ord long, content string").parquet(src)
    q = seen_state(stream, idle_ms=None).writeStream.format("memory").queryName("seen_turns").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session_id"], r["turn"], r["ord"]): r["seen"] for r in spark.table("seen_turns").collect()}
    assert got == {(1, 0, 0): False, (1, 0, 1): False, (1, 1, 0): True, (2, 0, 0): False, (1, 1, 1): False, (1, 2, 0): True}
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("turn") + 1_700_000_000))
    q = seen_within_watermark(timed, "ts").writeStream.format("memory").queryName("first_turns").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first_turns").count() == 4


def test_distances_have_no_hop_limit(spark):
    from tersa.operators import graph

    chain = spark.createDataFrame([(0, f"p{k}", f"p{k + 1}") for k in range(70)], "bundle_id long, src string, dst string")
    got = {r["path"]: r["distance"] for r in graph.distances(chain, spark.createDataFrame([(0, "p70")], "bundle_id long, path string")).collect()}
    assert got == {f"p{k}": 70 - k for k in range(71)}


def test_queries_of_damage_keep_all_code(spark, sf_dir):
    import __spark_entry__ as entry

    code = {r["ord"] for r in items(spark, sf_dir).filter("content_type = 'code'").collect()}
    got = {r["ord"]: r["valid"] for r in entry.queries()["v1_v2_v4_balance"](spark, sf_dir).collect()}
    assert got.keys() == code and not any(v for k, v in got.items() if k % 5 == 0) and any(got.values())
    lost = entry.queries()["v6_directive_retention"](spark, sf_dir).collect()
    assert {r["lost"] for r in lost} == {"must", "Do not"}


def test_skip_reasons_and_deltas_keep_short_items(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    assert any(r["no_savings"] for r in entry.queries()["a17_skip_reasons"](spark, sf).collect())
    prose = items(spark, sf).filter("content_type IN ('markdown', 'text', 'logs')")
    assert entry.queries()["t4_delta"](spark, sf).count() == prose.count() > prose.filter("length(content) > 400").count()


def code_item(k, bundle=0, statements=12, times=4):
    body = "".join(f"    value_{j} = 'a rather long piece of text number {j} that takes some room in the item {k}{', and more of it' * times}'\n" for j in range(statements))
    return (bundle, k, f"i{k}", "file", "code", "python", f"p/m_{k}.py", None, f"import os\n\n\ndef fn_{k}(x):\n{body}    return value_0\n")


ITEM = "bundle_id long, ord long, item_id string, kind string, content_type string, language string, path string, role string, content string"


def test_statements_are_trimmed_to_the_ceiling(spark):
    """Bundles of code come near their target as statements go one by one; where these are too short, whole bodies go."""
    df = spark.createDataFrame([code_item(k, k // 6) for k in range(24)] + [code_item(k, 9, times=0) for k in range(24, 30)], ITEM)
    for ratio in (0.1, 0.3, 0.45):
        for r in trace(reduce_bundles(df, Budget(target_reduction_ratio=ratio))).collect():
            assert not r["fallback"] and r["n_reverted"] == 0 and ratio - 0.01 <= r["saved_ratio"] < ratio + (0.07 if r["bundle_id"] < 9 else 0.17), r


def test_token_limits_are_ceilings_and_gates(spark):
    df = spark.createDataFrame([code_item(k) for k in range(6)], ITEM)
    total = trace(reduce_bundles(df, Budget())).first()["tokens_before"]
    fits = trace(reduce_bundles(df, Budget(max_input_tokens=int(total * 0.8)))).first()
    assert not fits["fallback"] and fits["tokens_after"] <= total * 0.8
    never = reduce_bundles(df, Budget(max_input_tokens=20))
    assert trace(never).first()["fallback"] and never.filter("content <> original_content").count() == 0


def test_pruning_is_executed(spark):
    from tersa.operators.elision import bundle_tokens

    rows = [code_item(k) for k in range(20)] + [(0, 100, "s", "prompt", "text", None, None, "system", "You are a careful helper, and this is what you do all day long.")]
    df = spark.createDataFrame(rows, ITEM)
    changed = spark.createDataFrame([(0, "p/m_3.py")], "bundle_id long, path string")
    out = reduce_bundles(df, Budget(target_reduction_ratio=0.4), changed=changed).persist()
    t = trace(out).first()
    assert t["n_pruned"] > 0 and not t["fallback"] and t["saved_ratio"] >= 0.4
    kept = {r["item_id"] for r in out.filter("NOT pruned").collect()}
    assert "s" in kept and "i3" in kept and out.count() == len(rows)
    assert bundle_tokens(out.filter("NOT pruned")).first()["n_tokens"] == t["tokens_after"]


def test_guards_and_recoverable_items(spark):
    long = "plain words without any name in them, again and again. " * 20
    rows = [(0, 0, "a", "note", "text", None, None, None, long), (0, 1, "b", "note", "text", None, None, None, "<BLOCK_HASH:" + "0" * 64 + "> " + long), (0, 2, "c", "note", "text", None, None, None, '[{"type": "text", "text": "' + long + '"}]')]
    df = spark.createDataFrame(rows, ITEM)
    budget = Budget(target_reduction_ratio=0.9)
    lost = reduce_bundles(df, budget).collect()
    assert all(r["content"] == r["original_content"] and not r["reverted"] for r in lost)
    held = {r["item_id"]: r for r in reduce_bundles(df, budget, recoverable=True).collect()}
    assert held["a"]["content"].startswith("[tersa: ") and held["a"]["passed"]
    assert all(held[k]["content"] == held[k]["original_content"] for k in "bc")


def test_a_repair_that_undoes_all_is_a_fallback(spark):
    from tersa.plans.reduce import refused

    rows = [(0, "a", "x", "x", True), (0, "b", "y", "y", False), (1, "a", "x", "x", True), (1, "b", "z", "y", False), (2, "a", "x", "x", False)]
    df = spark.createDataFrame(rows, "bundle_id long, item_id string, content string, original_content string, reverted boolean")
    assert [r[0] for r in refused(df).collect()] == [0]


def test_rehydrated(spark):
    from tersa.functions import text as T
    from tersa.operators.lookups import blocks
    from tersa.plans.reduce import rehydrated

    base = spark.createDataFrame([(0, "a", "one long content", "text"), (0, "b", "another content", "text"), (0, "c", "delta of it", "text"), (0, "d", "never stored", "text")], "bundle_id long, item_id string, original_content string, t string")
    marked = base.withColumn("content", F.when(F.col("item_id") == "c", F.lit("[tersa Delta: path=x baseHash=0]\n-a")).otherwise(T.elision_marker(F.col("original_content"), F.col("t"))))
    store = blocks(base.filter("item_id <> 'd'").select(F.col("original_content").alias("content")))
    got = {r["item_id"]: r for r in rehydrated(marked, store).collect()}
    assert [k for k in "abcd" if got[k]["content"] == got[k]["original_content"]] == ["a", "b", "c"] and not got["d"]["rehydrated"]
    only = spark.createDataFrame([(0, "b")], "bundle_id long, item_id string")
    assert [k for k, r in sorted((r["item_id"], r) for r in rehydrated(marked, store, only).collect()) if r["rehydrated"]] == ["b"]


def test_greedy_selection_against_brute_force(spark):
    import random

    from tersa.operators import selection

    r = random.Random(3)
    rows = []
    for b in range(30):
        for k in range(r.randint(1, 12)):
            rows.append((b, k, r.randint(0, 20), float(r.randint(0, 30)), r.random() < 0.1, 40))
    df = spark.createDataFrame(rows, "bundle_id long, ord long, weight long, value double, pinned boolean, budget long")
    s = selection.strategies(df).withColumn("strategy", F.when(F.col("strategy") == "dp", "greedy").otherwise(F.col("strategy")))
    got = {(x[0], x[1]) for x in selection.select_greedy(s).collect()}
    want = set()
    for b in range(30):
        mine = [x for x in rows if x[0] == b]
        room = 40 - sum(x[2] for x in mine if x[4])
        free = [x for x in mine if not x[4]]
        if sum(x[2] for x in mine) <= 40 or room <= 0 or not free:
            continue
        fit = [x for x in free if x[2] <= room]
        left, value, taken = room, 0.0, []
        for x in sorted(fit, key=lambda x: (-x[3] / max(1, x[2]), -x[3], x[1])):
            if x[2] <= left:
                left, value = left - x[2], value + x[3]
                taken.append(x[1])
        best = max(fit, key=lambda x: (x[3], -x[1]), default=None)
        if best and best[3] > value:
            taken = [best[1]]
        want |= {(b, k) for k in taken}
    assert got == want and len(want) > 20


def test_exact_tokenizers_are_a_hook(spark):
    from tersa.functions.tokens import counted_by, token_estimate

    df = spark.createDataFrame([("one two three",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token_estimate(F.col("t"), counted_by(str.split))).collect()] == [3, 0, 0]


def test_json_probe(spark):
    from tersa.functions.classify import looks_like_json

    yes = ["{}", "[]", '{"a":1,"a":2}', "[1, [2]]", '{"a": "\\u00e9"}']
    no = ['{"a":1}\n{"b":2}', "[1] x]", "[1]]", "{} {}", "[01]", "[NaN]", "{'a':1}", "[1", "1", "", "text]", '{"a":1},"b":{}', None]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in df.select(looks_like_json(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_p95_by_counts(spark):
    import random

    from tersa.operators.metrics import p95

    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), float(r.randint(0, 9))) for _ in range(300)] + [("c", "z", 1.0)]
    df = spark.createDataFrame(rows, "g string, h string, v double")
    of = lambda v: sorted(v)[min(len(v) - 1, int(0.95 * len(v)))]
    got = {(x["level"], x["g"], x["h"]): x["v_p95"] for x in p95(df, "v", ["g", "h"]).collect()}
    want = {(0, g, h): of([x[2] for x in rows if x[:2] == (g, h)]) for g, h in {x[:2] for x in rows}}
    want |= {(1, g, None): of([x[2] for x in rows if x[0] == g]) for g in {x[0] for x in rows}} | {(3, None, None): of([x[2] for x in rows])}
    assert got == want


def test_percent_rounds_ties_as_sql(spark):
    import duckdb

    from tersa.operators.metrics import percent, wire_metrics

    # every share at a tie of two places, whether doubles hold it (17/32) or not (29/20000), and what is no tie
    pairs = [(2 * n + 1, 20000) for n in range(10000)] + [(17, 32), (401, 800), (1, 3), (0, 7), (7, 7)]
    df = spark.createDataFrame(pairs, "saved long, before long")
    _, ratio = wire_metrics(F.col("before"), F.col("before") - F.col("saved"))
    got = {(r.saved, r.before): r.said for r in df.select("saved", "before", percent(ratio).alias("said")).collect()}
    sql = "SELECT format('{:.2f}%', round(s / b * 100, 2)) FROM (SELECT unnest(?::BIGINT[]) AS s, unnest(?::BIGINT[]) AS b)"
    want = [r[0] for r in duckdb.execute(sql, [[s for s, _ in pairs], [b for _, b in pairs]]).fetchall()]
    assert [got[p] for p in pairs] == want
    assert got[17, 32] == "53.13%" and got[401, 800] == "50.13%" and got[1, 3] == "33.33%"
    assert df.select(percent(F.lit(None).cast("double"))).first()[0] is None


def test_wire_metrics_query_on_ties(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    # some save 17 tokens of 32, a tie at two places of the percentage; one saves 2,579 of 5,120, a tie at nine places of the ratio
    texts = [(6 * n, "x" * n) for n in range(80, 110)] + [(6 * n + 1, "x" * 23000 + "é" * n) for n in range(30, 50)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["p25_p29_wire_metrics"](spark, str(tmp_path)).toPandas().sort_values("ord")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["p25_p29_wire_metrics"]).df().sort_values("ord")
    assert got[["ord", "saved", "ratio", "said"]].values.tolist() == want[["ord", "saved", "ratio", "said"]].values.tolist()
    assert "53.13%" in set(got["said"]) and 0.503710937 in set(got["ratio"])
