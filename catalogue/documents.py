"""Text operators over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.views import (
    _PY_TOKEN,
    DOC_FILES,
    DOC_FINDINGS,
    DOC_NOW,
    DOCS,
    document_files,
    document_registry,
    sql_blanked,
    spread_table,
    sql_text,
    with_ctes,
)
from duskwatch import registry_from_rows
from duskwatch.functions.text import MARKUP, PYTHON, blank_comments, line_hits, safe_text
from duskwatch.operators.findings import build_findings, rank_findings, top_evidence
from duskwatch.operators.rules import compile_rules
from duskwatch.operators.summary import severity_counts
from duskwatch.operators.usage import match_usage
from duskwatch.sources.files import select_sources


def _hits(spark, folder, cap=None, **options):
    rules = compile_rules(document_registry(spark))
    return match_usage(document_files(spark, folder), rules, cap=cap, token=None, **options)


def match_lines(spark, folder):
    return _hits(spark, folder).select("repo", "id", "file", "regex_ord", "line", "text")


def line_cap(spark, folder):
    return _hits(spark, folder, cap=50).select("repo", "id", "file", "regex_ord", "line", "text")


SENTENCE_END = r"\.\n[A-Z]"


def match_multiline(spark, folder):
    found = line_hits(safe_text(F.col("text")), SENTENCE_END)
    return spread_table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.inline(found))


_MULTILINE_SQL = rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, {sql_text(SENTENCE_END)}) AS found,
    string_split_regex(text, {sql_text(SENTENCE_END)}) AS rest FROM documents),
pieces AS (SELECT doc_id, unnest(found) AS m, unnest(rest[1:len(found)]) AS before,
    generate_subscripts(found, 1) AS k FROM cut WHERE len(found) > 0),
counted AS (SELECT doc_id, k, m, len(before) - len(replace(before, chr(10), '')) AS n FROM pieces)
SELECT doc_id, CAST(1 + (k - 1) + sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS line,
  replace(m, chr(10), ' ') AS text FROM counted
"""


def suppressed_lines(spark, folder):
    """Here the directive is a frequent word, so that many lines are suppressed."""
    rules = compile_rules(document_registry(spark))
    hits = match_usage(document_files(spark, folder), rules, token="de")
    return hits.select("repo", "id", "file", "regex_ord", "line", "text")


_SUPPRESSED_SQL = r"""
kept AS (SELECT h.* FROM doc_hits h ANTI JOIN (
    SELECT path, line FROM doc_lines WHERE regexp_matches(line_text, '\bde\b')) s
  ON s.path = h.file AND s.line = h.line)
"""


def language_scope(spark, folder):
    hits = _hits(spark, folder)
    ext = F.regexp_extract("file", r"\.([^.]*)$", 1)
    per_file = hits.groupBy(ext.alias("ext"), "id", "file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("ext", "id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("hits")
    )


def size_cap(spark, folder):
    chosen = select_sources(document_files(spark, folder), extensions=None, max_bytes=4096)
    return chosen.select("repo", "path", "size")


def comment_strip_html(spark, folder):
    blank = blank_comments(F.col("html"), MARKUP)
    return spread_table(spark, folder, "pages", "page_id", "html").select(
        "page_id", F.length(blank).alias("n_chars"), F.md5(blank).alias("digest")
    )


def comment_strip_script(spark, folder):
    blank = blank_comments(F.col("text"), PYTHON)
    return spread_table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.md5(blank).alias("digest"))


_HTML_BLANK = sql_blanked("html", r"(?s)<!--.*?(?:-->|\z)|[^<]+|<", ["<!--"])


# --- pages: links as imports, quoted language codes as models --------------------------------

PAGE_ENTRIES = [
    ("nav-que", ["que", "the"], [r"<footer>", r"\btrack\(\d"], ["en"]),
    ("nav-none", [], [r"<h1>[A-Z]\w+"], ["utf-8", "fr"]),
    ("nav-der", ["der"], [], ["de", "es"]),
]


def _page_hits(spark, folder):
    registry = registry_from_rows(spark, [
        {"id": id_, "vendor": "Web", "title": id_, "severity": "medium",
         "detect": {"sdk": sdk, "patterns": patterns, "models": models}}
        for id_, sdk, patterns, models in PAGE_ENTRIES
    ])
    pages = spread_table(spark, folder, "pages", "page_id", "html").select(
        F.lit("web").alias("repo"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.replace("html", F.lit(">"), F.lit(">\n")).alias("content"),
    )
    links = F.regexp_extract_all(F.col("text"), F.lit(r'href="/([^"]+)"'), F.lit(1))
    return match_usage(
        pages, compile_rules(registry), syntaxes={"html": MARKUP}, imports=links,
        gateable=F.lit(True),
    )


def link_gate(spark, folder):
    return _page_hits(spark, folder).select("id", "file", "kind", "regex_ord", "line", "text", "mention")


def model_literals(spark, folder):
    models = _page_hits(spark, folder).filter("kind = 'model'")
    return models.groupBy("id", "text", "mention").agg(F.count(F.lit(1)).alias("n"))


def _page_rules() -> str:
    rows = []
    for id_, sdk, patterns, models in PAGE_ENTRIES:
        regexes = [("model", "|".join(rf"{q}{m}(?:-\d{{4}}-\d{{2}}-\d{{2}})?{q}" for q in "'\"`")) for m in models]
        regexes += [("pattern", p) for p in patterns]
        names = "CAST([" + ", ".join(sql_text(s) for s in sdk) + "] AS VARCHAR[])"
        rows += [
            f"({sql_text(id_)}, {names}, {sql_text(kind)}, {sql_text(regex)}, {order})"
            for order, (kind, regex) in enumerate(regexes)
        ]
    return ", ".join(rows)


_PAGE_HITS = f"""
page_rules(id, sdk, kind, regex, regex_ord) AS (VALUES {_page_rules()}),
page_texts AS (SELECT concat('p', page_id, '.html') AS file,
  {sql_blanked("replace(html, '>', '>' || chr(10))", r"(?s)<!--.*?(?:-->|\z)|[^<]+|<", ["<!--"])} AS text
  FROM pages),
page_open AS (SELECT file, text, unnest(list_distinct(regexp_extract_all(text, 'href="/([^"]+)"', 1))) AS link
  FROM page_texts),
page_gates AS (SELECT DISTINCT o.file, r.id FROM page_open o JOIN page_rules r
  ON len(list_filter(r.sdk, lambda s: o.link = s OR starts_with(o.link, s || '/'))) > 0),
page_lines AS (SELECT file, unnest(string_split(text, chr(10))) AS line_text,
  generate_subscripts(string_split(text, chr(10)), 1) AS line FROM page_texts),
page_found AS (SELECT l.file, l.line, l.line_text, r.*, len(r.sdk) = 0 OR g.id IS NOT NULL AS opened
  FROM page_lines l JOIN page_rules r ON regexp_matches(l.line_text, r.regex)
  LEFT JOIN page_gates g ON g.file = l.file AND g.id = r.id),
page_hits AS (SELECT id, file, kind, CAST(regex_ord AS INTEGER) AS regex_ord, CAST(line AS INTEGER) AS line,
  trim(regexp_replace(regexp_extract(line_text, regex), '\\s+', ' ', 'g')) AS text,
  NOT opened AS mention FROM page_found WHERE opened OR kind = 'model')
"""


# --- findings over documents -----------------------------------------------------------------

FINDING_COLUMNS = (
    "repo", "id", "n_hits", "test_only", "severity", "effective_severity", "effective_status",
    "days_until", "trips_gate",
)


def _findings(spark, folder):
    return build_findings(document_registry(spark), _hits(spark, folder), now=DOC_NOW)


def findings(spark, folder):
    ranked = rank_findings(_findings(spark, folder))
    return ranked.select(*FINDING_COLUMNS, F.col("finding_rank").cast("bigint").alias("finding_rank"))


def finding_severities(spark, folder):
    return severity_counts(_findings(spark, folder))


def top_locations(spark, folder):
    shown = top_evidence(_hits(spark, folder))
    return shown.select(
        "repo", "id", "file", "line", "text", F.col("evidence_rank").cast("bigint").alias("evidence_rank"),
        "n_more",
    )


_HIT_SELECT = "SELECT repo, id, file, regex_ord, line, text FROM "

QUERIES = {
    "match_lines": (match_lines, with_ctes(*DOCS, _HIT_SELECT + "doc_hits")),
    "line_cap": (line_cap, with_ctes(*DOCS, _HIT_SELECT + """doc_hits
  QUALIFY row_number() OVER (PARTITION BY file, id, regex_ord ORDER BY line) <= 50""")),
    "match_multiline": (match_multiline, _MULTILINE_SQL),
    "suppressed_lines": (
        suppressed_lines,
        with_ctes(*DOCS, _SUPPRESSED_SQL, _HIT_SELECT + "kept"),
    ),
    "language_scope": (
        language_scope,
        with_ctes(*DOCS, """SELECT regexp_extract(file, '\\.([^.]*)$', 1) AS ext, id,
  count(DISTINCT file) AS files, count(*) AS hits FROM doc_hits GROUP BY ALL"""),
    ),
    "size_cap": (size_cap, with_ctes(DOC_FILES, "SELECT repo, path, size FROM doc_files WHERE size <= 4096")),
    "comment_strip_html": (
        comment_strip_html,
        f"SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest "
        f"FROM (SELECT page_id, {_HTML_BLANK} AS t FROM pages)",
    ),
    "comment_strip_script": (
        comment_strip_script,
        f"SELECT doc_id, md5({sql_blanked('text', _PY_TOKEN, ['#'])}) AS digest FROM documents",
    ),
    "link_gate": (
        link_gate,
        with_ctes(_PAGE_HITS, "SELECT id, file, kind, regex_ord, line, text, mention FROM page_hits"),
    ),
    "model_literals": (
        model_literals,
        with_ctes(_PAGE_HITS, """SELECT id, text, mention, count(*) AS n FROM page_hits
  WHERE kind = 'model' GROUP BY ALL"""),
    ),
    "findings": (
        findings,
        with_ctes(*DOCS, DOC_FINDINGS, f"""SELECT {', '.join(FINDING_COLUMNS[:7])},
  CAST(days_until AS INTEGER) AS days_until, trips_gate,
  row_number() OVER (PARTITION BY repo ORDER BY
    CASE effective_severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
    coalesce(nullif(sunset_date, ''), '9999-12-31'), entry_ord) AS finding_rank FROM doc_gated"""),
    ),
    "severity_counts": (
        finding_severities,
        with_ctes(*DOCS, DOC_FINDINGS, """SELECT repo,
  count(*) FILTER (effective_severity = 'high') AS high,
  count(*) FILTER (effective_severity = 'medium') AS medium,
  count(*) FILTER (effective_severity = 'low') AS low FROM doc_gated GROUP BY repo"""),
    ),
    "top_evidence": (
        top_locations,
        with_ctes(*DOCS, """
distinct_hits AS (SELECT DISTINCT repo, id, file, line, text FROM doc_hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY file, line, text) AS evidence_rank,
  count(*) OVER (PARTITION BY repo, id) AS n FROM distinct_hits)""",
                  """SELECT repo, id, file, line, text, evidence_rank, greatest(n - 12, 0) AS n_more
  FROM ranked WHERE evidence_rank <= 12"""),
    ),
}
