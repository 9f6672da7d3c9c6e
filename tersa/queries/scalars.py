"""Scans, projections and filters: survey rows S, P and F."""

from __future__ import annotations

from pyspark.sql import functions as F

from tersa.functions import classify, directives, symbols, text, tokens
from tersa.plans.recipes import documents, items, with_items
from tersa.queries import query

CLASSES = """length(regexp_replace({c}, '[^ \\t\\n\\r]', '', 'g')) AS space, length(regexp_replace({c}, '[^!-/:-@\\[-`{-~]', '', 'g')) AS punct,
 length(regexp_replace({c}, '[\\x00-\\x7F]', '', 'g')) AS wide, length({c}) AS n"""


def classes(column: str) -> str:
    return CLASSES.replace("{c}", column)


ESTIMATE = "CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil((n - space - punct - wide) * 0.22::DOUBLE + punct * 0.55::DOUBLE + space * 0.35::DOUBLE + wide * 1.1::DOUBLE)) END AS BIGINT)"


@query(f"SELECT doc_id, {ESTIMATE} AS n_tokens FROM (SELECT doc_id, {classes('text')} FROM documents)")
def p1_token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tokens.token_estimate(F.col("text")).alias("n_tokens"))


@query(with_items(f"SELECT bundle_id, {ESTIMATE} AS n_tokens FROM (SELECT bundle_id, sum(space) + count(*) - 1 AS space, sum(punct) AS punct, sum(wide) AS wide, sum(n) + count(*) - 1 AS n FROM (SELECT bundle_id, {classes('content')} FROM items) GROUP BY bundle_id)"))
def p2_bundle_tokens(spark, sf_dir):
    counted = items(spark, sf_dir).select("bundle_id", tokens.class_counts(F.col("content")).alias("c"))
    return counted.groupBy("bundle_id").agg(tokens.joined_tokens(F.col("c")).alias("n_tokens"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(text, 1, 80) AS preview FROM documents")
def p4_p6_hash_and_preview(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.preview(F.col("text")).alias("preview"))


@query("SELECT conv_id, turn, sha256(role || chr(1) || text) AS role_hash FROM conversations")
def p5_role_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.role_hash(F.col("role"), F.col("text")).alias("role_hash"))


CLOCK, LEVEL = r"(^|[^\d:.])\d{1,2}:\d{2}:\d{2}($|\D)", r"(^|[\s\[(<|])(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|NOTICE)($|[\s\])>:,|])"
STAMP = r"^\s*\[?(\d{4}[-/]\d{2}[-/]\d{2}[T ])?\d{1,2}:\d{2}:\d{2}"
MD = r"(regexp_matches(b, '(?s)```.*```') OR regexp_matches(b, '(^|\n)(-|\*|\d+\.)\s+\S') OR regexp_matches(b, '\[[^\]]+\]\([^)]+\)'))"
HTML = r"(regexp_matches(b, '(?i)<!doctype\s+html') OR list_has_any(list_transform(regexp_extract_all(b, '(?i)</([a-z][a-z0-9-]*)\s*>', 1), lambda x: lower(x)), list_transform(regexp_extract_all(b, '(?i)<([a-z][a-z0-9-]*)(?:\s[^<>]*)?/?>', 1), lambda x: lower(x))))"
LINES = r"list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '\S'))"
LOGS = f"(len({LINES}) > 0 AND 2 * len(list_filter({LINES}, lambda x: regexp_matches(x, '{CLOCK}') AND (regexp_matches(x, '{LEVEL}') OR regexp_matches(x, '{STAMP}')))) >= len({LINES}))"


@query(
    with_items(
        rf"""SELECT src, id, CASE WHEN left(b, 1) IN ('{{', '[') AND json_valid(b) THEN 'json' WHEN {HTML} THEN 'html' WHEN {LOGS} THEN 'logs' WHEN {MD} THEN 'markdown' WHEN b <> '' THEN 'text' ELSE 'unknown' END AS content_type
 FROM (SELECT src, id, regexp_replace(c, '^\s+|\s+$', '', 'g') AS b FROM (SELECT 'item' AS src, ord AS id, content AS c FROM items WHERE content_type <> 'code' UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'event', event_id, CASE event_id % 4 WHEN 1 THEN props || chr(10) || props WHEN 2 THEN '[' || event_id || '] ]' ELSE props END FROM events))"""
    )
)
def p7_content_type(spark, sf_dir):
    i = items(spark, sf_dir).filter("content_type <> 'code'").select(F.lit("item").alias("src"), F.col("ord").alias("id"), F.col("content").alias("c"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("c"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("event").alias("src"), F.col("event_id").alias("id"), F.expr("CASE event_id % 4 WHEN 1 THEN concat(props, chr(10), props) WHEN 2 THEN concat('[', event_id, '] ]') ELSE props END").alias("c"))
    return i.unionByName(pages).unionByName(events).select("src", "id", classify.content_type(F.col("c")).alias("content_type"))


@query(with_items(f"SELECT ord, {MD} AS is_markdown, {LOGS} AS is_log, {HTML} AS is_html FROM (SELECT ord, content AS b FROM items)"))
def p10_p11_p13_probes(spark, sf_dir):
    c = F.col("content")
    return items(spark, sf_dir).select("ord", classify.looks_like_markdown(c).alias("is_markdown"), classify.looks_like_logs(c).alias("is_log"), classify.looks_like_html(c).alias("is_html"))


YAML_OF = "concat('---', chr(10), 'id: ', CAST(doc_id AS STRING), chr(10), 'lang: ', lang, chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('note: |', chr(10), '  free text: of row', chr(10)) WHEN doc_id % 3 = 1 THEN concat(text, chr(10)) ELSE concat('- a', chr(10)) END)"


@query(
    rf"""SELECT doc_id, mappings + markers > 0 AND (mappings >= 2 OR markers >= 1 AND mappings >= 1) AND (mappings + markers) * 4 >= decisive * 3 AS is_yaml FROM (
 SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^\s*(-\s+)?([\w.\-/]+|"[^"]+"|''[^'']+'')\s*:(\s+\S.*|\s*)$'))) - CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN true THEN 0 END) ELSE 0 END AS mappings,
 len(list_filter(l, lambda x: regexp_matches(x, '^(---|\.\.\.)\s*$'))) AS markers,
 len(list_filter(l, lambda x: NOT regexp_matches(x, '^\s*(#|-(\s+\S.*)?$)') OR regexp_matches(x, '^(---|\.\.\.)\s*$'))) AS decisive
 FROM (SELECT doc_id, list_filter(string_split({YAML_OF}, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT starts_with(x, '  free')) AS l FROM documents))"""
)
def p9_yaml_probe(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", classify.looks_like_yaml(F.expr(YAML_OF)).alias("is_yaml"))


ALIAS_SQL = " ".join(f"WHEN a IN ({', '.join(repr(x) for x in names)}) THEN '{name}'" for name, names in text.ALIASES.items())
SPOKEN = "CASE doc_id % 8 WHEN 0 THEN ' Py ' WHEN 1 THEN 'TSX' WHEN 2 THEN 'c++' WHEN 3 THEN 'golang' WHEN 4 THEN 'yml' WHEN 5 THEN 'cobol' WHEN 6 THEN 'Bash' ELSE lang END"


@query(f"SELECT doc_id, language, CASE WHEN language IN ('json','yaml','html','markdown','logs','text') THEN language WHEN language IS NOT NULL THEN 'code' END AS content_type FROM (SELECT doc_id, CASE {ALIAS_SQL} END AS language FROM (SELECT doc_id, lower(trim({SPOKEN})) AS a FROM documents))")
def p14_language(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalize_language(F.expr(SPOKEN)).alias("language"))
    return d.withColumn("content_type", text.language_content_type(F.col("language")))


@query(with_items(r"SELECT ord, CASE WHEN content_type = 'code' THEN array_to_string(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(x), '^(//|#|--|\*)')), chr(10)) ELSE content END AS prose FROM items"))
def p15_prose_regions(spark, sf_dir):
    return items(spark, sf_dir).select("ord", directives.prose_regions(F.col("content"), F.col("content_type")).alias("prose"))


KEY = directives.KEYWORD.replace("(?i)", "")
SEGMENTS = r"list_filter(list_transform(regexp_extract_all(content, '[^.!?;\n]+[.!?;]?'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '' AND regexp_matches(s, '(?i)" + KEY + r"') AND NOT (len(list_filter(regexp_extract_all(s, '(?i)" + KEY + r"', 1), lambda k: NOT regexp_matches(k, '(?i)^(never|always)$'))) = 0 AND regexp_matches(s, '" + directives.NARRATIVE + r"')))"


@query(
    with_items(
        f"""SELECT ord, len(d) AS n_directives, array_to_string(d, '|') AS directives, array_to_string(list_sort(list_distinct(list_concat(k, list_transform(list_filter(k, lambda x: starts_with(upper(x), 'MUST ')), lambda x: CASE WHEN x[1] = 'M' THEN 'MUST' ELSE 'must' END)))), '|') AS keywords, raw AS has_keyword
 FROM (SELECT ord, d, raw, list_transform(flatten(list_transform(d, lambda s: regexp_extract_all(s, '(?i){KEY}', 1))), lambda x: regexp_replace(x, '\\s+', ' ', 'g')) AS k FROM (SELECT ord, {SEGMENTS} AS d, regexp_matches(content, '(?i){KEY}') AS raw FROM items WHERE content_type <> 'code'))"""
    )
)
def p16_p19_directives(spark, sf_dir):
    i = items(spark, sf_dir).filter("content_type <> 'code'").select("ord", "content", directives.directives(F.col("content")).alias("d"))
    return i.select(
        "ord",
        F.size("d").cast("long").alias("n_directives"),
        F.array_join("d", "|").alias("directives"),
        F.array_join(F.sort_array(directives.keywords(F.col("d"))), "|").alias("keywords"),
        directives.has_keyword(F.col("content")).alias("has_keyword"),
    )


NOUN = "CASE content_type WHEN 'logs' THEN 'log' ELSE content_type END"
MARK = f"concat('[tersa: ', CAST(len(string_split(content, chr(10))) AS VARCHAR), ' ', {NOUN}, CASE WHEN len(string_split(content, chr(10))) = 1 THEN ' line' ELSE ' lines' END, ' elided, ', CAST(length(content) AS VARCHAR), ' bytes, sha256:', left(sha256(content), 12), ']')"


@query(with_items(f"SELECT ord, {MARK} AS marker, concat('[tersa Elided: ref=', left(sha256(content), 12), ' bytes=', CAST(length(content) AS VARCHAR), ' kind=', kind, ']') AS session_marker, left(sha256(content), 12) AS ref, true AS has_marker, concat('{{\"__tersa_block__\":\"', {MARK}, '\"}}') AS wrapped FROM items".replace("{{", "{").replace("}}", "}")))
def p20_p22_markers(spark, sf_dir):
    i = items(spark, sf_dir).select("ord", text.elision_marker(F.col("content"), text.noun(F.col("content_type"))).alias("marker"), text.session_marker(F.col("content"), F.col("kind")).alias("session_marker"))
    return i.withColumn("ref", F.element_at(text.marker_refs(F.col("marker")), 1)).withColumn("has_marker", text.has_marker(F.concat(F.lit("x "), "session_marker"))).withColumn("wrapped", text.wrap_json_marker(F.col("marker")))


@query("SELECT doc_id, concat('src/', source, '/m', CAST(doc_id AS VARCHAR)) AS resolved, concat('a/', source, '/x.ts') AS normal FROM documents")
def p23_paths(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    relative = F.concat(F.lit("./../"), "source", F.lit("/./m"), F.col("doc_id").cast("string"))
    return d.select("doc_id", text.resolve_path(F.lit("src/core/x.ts"), relative).alias("resolved"), text.normalize_path(F.concat(F.lit(".\\a\\"), "source", F.lit("\\x.ts"))).alias("normal"))


RESERVED_SQL = ", ".join(f"'{w}'" for w in text.RESERVED)


@query(
    with_items(
        f"""SELECT ord, len(w) AS n_words, len(k) AS n_keys, CASE WHEN len(k) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(k, a))::DOUBLE / len(k) END AS preserved,
 CASE WHEN len(list_distinct(list_concat(w, wa))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(w, wa))::DOUBLE / len(list_distinct(list_concat(w, wa))) END AS similarity
 FROM (SELECT ord, list_distinct(regexp_extract_all(lower(content), '\\b\\w+\\b')) AS w, list_distinct(list_filter(regexp_extract_all(content, '\\b[A-Za-z_]\\w+\\b'), lambda x: lower(x) NOT IN ({RESERVED_SQL}))) AS k,
 list_distinct(regexp_extract_all(left(content, length(content) // 2), '\\b\\w+\\b')) AS a, list_distinct(regexp_extract_all(lower(left(content, length(content) // 2)), '\\b\\w+\\b')) AS wa FROM items)"""
    )
)
def p26_u2_u6_word_sets(spark, sf_dir):
    half = F.expr("left(content, length(content) DIV 2)")
    i = items(spark, sf_dir).select("ord", "content", half.alias("after"))
    return i.select(
        "ord",
        F.size(text.word_set(F.col("content"))).cast("long").alias("n_words"),
        F.size(text.key_symbols(F.col("content"))).cast("long").alias("n_keys"),
        text.symbol_preservation(F.col("content"), F.col("after")).alias("preserved"),
        text.jaccard(text.word_set(F.col("content")), text.word_set(F.col("after"))).alias("similarity"),
    )


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def p28_html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query(
    with_items(
        rf"""SELECT ord, array_to_string(list_sort(list_distinct(list_concat(list_transform(list_concat(regexp_extract_all(content, '{symbols.JS_FUNCTION}', 1), regexp_extract_all(content, '{symbols.PY_FUNCTION}', 1)), lambda x: 'fn:' || x),
 list_transform(regexp_extract_all(content, '{symbols.TYPE}', 1), lambda x: 'type:' || x), list_transform(regexp_extract_all(content, '{symbols.VARIABLE}', 1), lambda x: 'var:' || x),
 list_transform(list_concat(regexp_extract_all(content, '{symbols.JS_IMPORT.replace("'", "''")}', 1), list_filter(list_concat(regexp_extract_all(content, '{symbols.PY_IMPORT}', 1), regexp_extract_all(content, '{symbols.PY_IMPORT}', 2)), lambda x: x <> '')), lambda x: 'import:' || x)))), '|') AS symbols FROM items"""
    )
)
def g1_symbols(spark, sf_dir):
    return items(spark, sf_dir).select("ord", F.array_join(F.sort_array(symbols.symbols(F.col("content"), F.col("content_type"))), "|").alias("symbols"))


@query(
    with_items(
        r"""SELECT ord, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN path IS NOT NULL THEN ['filepath:' || path] ELSE [] END, CASE WHEN content_type = 'markdown' THEN list_concat(
 list_transform(list_filter(l, lambda x: regexp_matches(x, '^#{1,6}\s+')), lambda x: 'heading:' || x), list_transform(list_filter(l, lambda x: regexp_matches(x, '(?i)^(---|===|System:|User:|Assistant:)')), lambda x: 'section:' || x)) ELSE [] END))), '|') AS markers
 FROM (SELECT *, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM items)"""
    )
)
def g2_markers(spark, sf_dir):
    none = F.array().cast("array<string>")
    return items(spark, sf_dir).select("ord", F.array_join(F.sort_array(symbols.markers(F.col("content"), F.col("content_type"), F.col("path"), none)), "|").alias("markers"))


@query(
    with_items(
        """SELECT ord, kind = 'prompt' AS preserved, coalesce(role = 'system', false) AS is_system, length(content) < 40 AS too_short, length(marker) < length(content) AS saves, language IN ('python', 'typescript') IS TRUE AS reducible,
 NOT (kind = 'prompt') AND coalesce(role <> 'system', true) AND length(content) >= 40 AND length(marker) < length(content) AS eligible FROM (SELECT *, {MARK} AS marker FROM items)""".replace("{MARK}", MARK)
    )
)
def f1_f10_eligible(spark, sf_dir):
    from tersa.operators.elision import eligibility

    return eligibility(items(spark, sf_dir), preserve=("prompt",)).select("ord", "preserved", "is_system", "too_short", "saves", "reducible", "eligible")
