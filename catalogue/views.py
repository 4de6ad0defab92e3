"""The tables as corpora: the same derivation once for Spark, once as SQL for the check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import shared_folder
from duskwatch.sources.files import balance, read_corpus, write_corpus


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """For work on texts: the test tables are single files, which one core alone would read."""
    return balance(table(spark, folder, name).select(*columns))


_CORPORA: dict[tuple[str, str, str], str] = {}


def stored_corpus(spark: SparkSession, folder: str, name: str, files: DataFrame) -> DataFrame:
    """A corpus made from the tables, written once per session the way a fleet would store it:
    partitioned by kind, with path and size as columns of their own."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _CORPORA:
        path = f"{shared_folder(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        write_corpus(files, path)
        _CORPORA[key] = path
    return balance(read_corpus(spark, _CORPORA[key]))


def with_ctes(*parts: str) -> str:
    """Join CTE texts into one statement; the last part ends in the final SELECT."""
    *ctes, final = [part.strip().rstrip(",") for part in parts]
    joint = "\n" if final.startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(ctes) + joint + final


# --- documents as files of repositories `source`, language as extension ------------------------

_DOC_PATH = (
    "concat(source, '/', case when n_chars < 500 then 'src' when n_chars < 1500 then 'tests' "
    "when n_chars < 3000 then 'lib' else 'docs' end, '/f', doc_id, '.', lang)"
)


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    return spread_table(spark, folder, "documents", *columns).selectExpr(
        "source as repo", f"{_DOC_PATH} as path", "text as content",
        "cast(octet_length(text) as bigint) as size",
    )


DOC_FILES = f"""
doc_files AS (SELECT source AS repo, lang AS ext, {_DOC_PATH} AS path, text AS content,
  CAST(strlen(text) AS BIGINT) AS size FROM documents)
"""

# id, severity, status, applies_to, sunset, patterns
DOC_ENTRIES = [
    ("w-the", "high", None, ["en"], "1999-03-01", [r"\bthe\b", r"\b[Tt]here?[a-z]*\b"]),
    ("w-nicht", "medium", None, ["de"], "1998-02-01", [r"\bnicht\b", r"\bund\b"]),
    ("w-les", "low", None, ["fr"], None, [r"\bles\b", r"\bdes\b"]),
    ("w-que", "medium", "scheduled", ["es", "fr"], "1998-01-20", [r"\bque\b"]),
    ("w-licence", "high", "retired", ["*"], "1997-06-30", [r"\b(?:MIT|Apache)\b"]),
    ("w-number", "low", None, ["*"], "", [r"\b\d+\.\d+\.\d+\b"]),
    ("w-token", "high", None, ["*"], None, [r"\btoken\s=\s\S{4}"]),
]
DOC_NOW = "1998-01-01"


def document_registry(spark: SparkSession) -> DataFrame:
    from duskwatch import registry_from_rows

    return registry_from_rows(spark, [
        {
            "id": id_, "vendor": "Words", "title": id_, "severity": severity, "status": status,
            "applies_to": exts, "sunset_date": sunset, "summary": "", "migration_url": "",
            "detect": {"sdk": [], "patterns": patterns, "models": []},
        }
        for id_, severity, status, exts, sunset, patterns in DOC_ENTRIES
    ])


def sql_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _doc_rule_rows() -> str:
    rows = []
    for n, (id_, severity, status, exts, sunset, patterns) in enumerate(DOC_ENTRIES):
        for order, pattern in enumerate(patterns):
            names = "[" + ", ".join(sql_text(e) for e in exts) + "]"
            rows.append(
                f"({sql_text(id_)}, {sql_text(severity)}, {sql_text(status)}, {names}, "
                f"{sql_text(sunset)}, {sql_text(pattern)}, {order}, {n})"
            )
    return ", ".join(rows)


DOC_RULES = f"""
doc_rules(id, severity, status, applies_to, sunset_date, regex, regex_ord, entry_ord) AS (
  VALUES {_doc_rule_rows()})
"""

# An independent formulation of matching: cut into lines first, then look at each line.
DOC_HITS = """
doc_lines AS (SELECT repo, path, ext, unnest(string_split(content, chr(10))) AS line_text,
  generate_subscripts(string_split(content, chr(10)), 1) AS line FROM doc_files),
doc_hits AS (SELECT repo, id, path AS file, CAST(regex_ord AS INTEGER) AS regex_ord,
  CAST(line AS INTEGER) AS line,
  trim(regexp_replace(regexp_extract(line_text, regex), '\\s+', ' ', 'g')) AS text
  FROM doc_lines JOIN doc_rules ON list_contains(applies_to, '*') OR list_contains(applies_to, ext)
  WHERE regexp_matches(line_text, regex))
"""

# A path in a test tree or with a test file's name.
SQL_IS_TEST = (
    "(regexp_matches({0}, '(^|/)(tests|test|__tests__|spec)/') OR regexp_matches({0}, "
    "'(^|/)(conftest\\.py|test_[^/]*\\.py|[^/]*_test\\.py|[^/]*\\.(test|spec)\\.(c|m)?[jt]sx?)$'))"
)

DOC_FINDINGS = f"""
doc_findings AS (SELECT h.repo, h.id, r.severity, r.status, r.sunset_date, r.entry_ord,
  count(*) AS n_hits, bool_and({SQL_IS_TEST.format('file')}) AS test_only
  FROM doc_hits h JOIN (SELECT DISTINCT id, severity, status, sunset_date, entry_ord
    FROM doc_rules) r ON h.id = r.id GROUP BY ALL),
doc_urgent AS (SELECT *, CASE WHEN test_only THEN 'low' ELSE severity END AS effective_severity,
  coalesce(status, CASE WHEN nullif(sunset_date, '') IS NULL THEN 'deprecated'
    WHEN CAST(nullif(sunset_date, '') AS DATE) < DATE '{DOC_NOW}' THEN 'retired'
    ELSE 'scheduled' END) AS effective_status,
  CAST(nullif(sunset_date, '') AS DATE) - DATE '{DOC_NOW}' AS days_until FROM doc_findings),
doc_gated AS (SELECT *, NOT test_only AND CASE WHEN severity = 'high' THEN effective_status <> 'retired'
  ELSE effective_status = 'scheduled' AND coalesce(days_until BETWEEN 0 AND 30, false) END AS trips_gate
  FROM doc_urgent)
"""

# --- line items as source files --------------------------------------------------------------

_CODE_EXT = (
    "case when l_quantity <= 10 then 'js' when l_quantity <= 20 then 'ts' "
    "when l_quantity <= 30 then 'py' when l_quantity <= 40 then 'go' else 'rb' end"
)
_CODE_DIR = (
    "case when l_returnflag = 'A' then 'src' "
    "when l_returnflag = 'N' and l_linestatus = 'O' then 'tests' "
    "when l_returnflag = 'N' then 'lib' when l_discount >= 0.05 then 'vendor/x' "
    "when l_linestatus = 'O' then '.cache' else 'pkg' end"
)
# One list of lines per language family; {f} is the return flag, {s} the line status.
_JS_LINES = [
    "case when l_tax >= 0.04 then concat('import {{ Client }} from \"kit', {f}, '/core\";') "
    "when l_tax >= 0.02 then concat('const c = require(', chr(39), 'kit', {f}, chr(39), ');') "
    "else 'import \"kitx\";' end",
    "concat('// once client.legacy', {s}, '(0) was here')",
    "concat('const m = \"model-', {f}, '-1\";')",
    "concat('/* client.legacy', {s}, '(7)')",
    "concat('client.legacyF(8) */ client.legacy', {s}, '(1);')",
    "concat('client.legacy', {s}, '(2); // dusk-ignore')",
    "'// dusk-ignore-next-line'",
    "concat('client.legacy', {s}, '(3);')",
    "concat('use(\"// client.legacy', {s}, '(4) /*\");')",
]
_PY_LINES = [
    "case when l_tax >= 0.04 then concat('import os, kit', {f}, '.core as kit') "
    "when l_tax >= 0.02 then concat('from kit', {f}, ' import client') else 'from . import kitx' end",
    "concat('# once client.legacy', {s}, '(0) was here')",
    "concat('m = ', chr(39), 'model-', {f}, '-1-2024-05-13', chr(39))",
    "concat('doc = \"\"\" it', chr(39), 's # no comment')",
    "concat('client.legacy', {s}, '(5) \"\"\" # client.legacyF(8)')",
    "concat('client.legacy', {s}, '(2)  # dusk-ignore')",
    "'# dusk-ignore-next-line'",
    "concat('client.legacy', {s}, '(3)')",
]
_RB_LINES = [
    "concat('require \"kit', {f}, '\"')",
    "concat('# client.legacy', {s}, '(6) counts: comments stay')",
    "concat('client.legacy', {s}, '(1) # dusk-ignore')",
]


def _text_of(lines: list[str]) -> str:
    cells = ", ".join(
        line.format(f="lower(l_returnflag)", s="l_linestatus") for line in lines
    )
    return f"concat(concat_ws(chr(10), {cells}), chr(10))"


_CODE_TEXT = (
    f"case when l_quantity <= 20 or (l_quantity > 30 and l_quantity <= 40) then {_text_of(_JS_LINES)} "
    f"when l_quantity <= 30 then {_text_of(_PY_LINES)} else {_text_of(_RB_LINES)} end"
)
_CODE_PATH = (
    f"concat({_CODE_DIR}, '/o', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', "
    f"cast(l_quantity as int), '.', {_CODE_EXT})"
)


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    columns = (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax",
        "l_discount", "l_returnflag", "l_linestatus",
    )
    files = spread_table(spark, folder, "lineitem", *columns).selectExpr(
        "concat('s', l_suppkey) as repo", f"{_CODE_PATH} as path",
        f"{_CODE_TEXT} as content",
    )
    sized = files.withColumn("size", F.octet_length("content").cast("bigint"))
    return stored_corpus(spark, folder, "code", sized)


CODE_FILES = f"""
code_files AS (SELECT repo, path, ext, content, CAST(strlen(content) AS BIGINT) AS size FROM (
  SELECT concat('s', l_suppkey) AS repo, {_CODE_PATH} AS path, {_CODE_EXT} AS ext,
  {_CODE_TEXT} AS content FROM lineitem))
"""

# id, severity, applies_to, sunset, sdk, patterns, models
CODE_ENTRIES = [
    ("kit-legacy-o", "high", ["js", "ts", "py"], "2026-08-01", ["kita", "kitn"],
     [r"\bclient\.legacyO\(\d"], ["model-a-1"]),
    ("kit-legacy-f", "medium", ["*"], None, [], [r"\bclient\.legacyF\(\d\)", r"legacyF\([1-5]"], []),
    ("kit-model-n", "low", ["*"], "2026-06-20", ["kitn"], [], ["model-n-1", "model-n"]),
    ("kit-flag-r", "high", ["js", "go", "rb"], "2020-01-01", ["kitr"], [r"\blegacy[OF]\(\d"], ["model-r-1"]),
    ("kit-model-a", "medium", ["py", "ts"], "2026-06-20", [], [], ["model-a-1"]),
]
CODE_NOW = "2026-06-06"


def code_registry(spark: SparkSession) -> DataFrame:
    from duskwatch import registry_from_rows

    return registry_from_rows(spark, [
        {
            "id": id_, "vendor": "Kit", "title": id_.upper(), "severity": severity,
            "applies_to": exts, "sunset_date": sunset, "summary": "Use something newer.",
            "migration_url": "https://kit.example.com/" + id_,
            "detect": {"sdk": sdk, "patterns": patterns, "models": models},
        }
        for id_, severity, exts, sunset, sdk, patterns, models in CODE_ENTRIES
    ])


def _list(values) -> str:
    return "CAST([" + ", ".join(sql_text(v) for v in values) + "] AS VARCHAR[])"


def _code_rule_rows() -> str:
    rows = []
    for n, (id_, severity, exts, sunset, sdk, patterns, models) in enumerate(CODE_ENTRIES):
        # Without back-references a quoted model is one alternative per quote.
        regexes = [
            ("model", "|".join(rf"{q}{m}(?:-\d{{4}}-\d{{2}}-\d{{2}})?{q}" for q in "'\"`"))
            for m in models
        ]
        regexes += [("pattern", p) for p in patterns]
        for order, (kind, regex) in enumerate(regexes):
            rows.append(
                f"({sql_text(id_)}, {sql_text(severity)}, {_list(exts)}, {sql_text(sunset)}, "
                f"{_list(sdk)}, {sql_text(kind)}, {sql_text(regex)}, {order}, {n}, "
                f"{str(bool(models)).lower()})"
            )
    return ", ".join(rows)


CODE_RULES = f"""
code_rules(id, severity, applies_to, sunset_date, sdk, kind, regex, regex_ord, entry_ord, has_models)
  AS (VALUES {_code_rule_rows()})
"""

_JS_TOKEN = (
    r"""(?s)"(?:[^"\\]|\\.)*(?:"|\\?\z)|'(?:[^'\\]|\\.)*(?:'|\\?\z)|`(?:[^`\\]|\\.)*(?:`|\\?\z)"""
    r"""|/\*.*?(?:\*/|\z)|//[^\n]*|[^"'`/]+|/"""
)
_PY_TOKEN = (
    r'''(?s)""".*?(?:"""|\z)|\'\'\'.*?(?:\'\'\'|\z)|"(?:[^"\\]|\\.)*(?:"|\\?\z)'''
    r"""|'(?:[^'\\]|\\.)*(?:'|\\?\z)|#[^\n]*|[^"'#]+"""
).replace("\\'", "'")


def sql_blanked(column: str, token: str, openers: list[str]) -> str:
    """SQL that blanks comments: cut into tokens, blank those that open like a comment."""
    test = " OR ".join(f"starts_with(t, {sql_text(o)})" for o in openers)
    return (
        f"array_to_string(list_transform(regexp_extract_all({column}, {sql_text(token)}), "
        f"lambda t: CASE WHEN {test} THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END), '')"
    )


SQL_BLANK_JS = sql_blanked("content", _JS_TOKEN, ["//", "/*"])
SQL_BLANK_PY = sql_blanked("content", _PY_TOKEN, ["#"])

# Which directories are skipped; hidden ones too.
SQL_KEPT = (
    "NOT regexp_matches(path, '(^|/)(node_modules|\\.next|dist|build|out|coverage|\\.venv|venv|env|"
    "site-packages|__pycache__|vendor|target|\\.git)/') AND NOT regexp_matches(path, '(^|/)\\.')"
)

CODE_TEXTS = f"""
code_texts AS (SELECT repo, path, ext, content, CASE WHEN ext IN ('js', 'ts', 'go') THEN {SQL_BLANK_JS}
  WHEN ext = 'py' THEN {SQL_BLANK_PY} ELSE content END AS text
  FROM code_files WHERE {SQL_KEPT})
"""

# Imports line by line: each generated line holds at most one import statement.
CODE_IMPORTS = r"""
code_import_lines AS (SELECT repo, path, ext, unnest(string_split(text, chr(10))) AS line_text
  FROM code_texts WHERE ext IN ('js', 'ts', 'py')),
code_imports AS (
  SELECT repo, path, regexp_extract(line_text, 'from "([^"]+)"', 1) AS module
    FROM code_import_lines WHERE ext <> 'py' AND regexp_matches(line_text, '^import .* from "')
  UNION SELECT repo, path, regexp_extract(line_text, 'import "([^"]+)"', 1)
    FROM code_import_lines WHERE ext <> 'py' AND regexp_matches(line_text, '^import "')
  UNION SELECT repo, path, regexp_extract(line_text, 'require\(''([^'']+)''', 1)
    FROM code_import_lines WHERE ext <> 'py' AND contains(line_text, 'require(')
  UNION SELECT repo, path, split_part(regexp_extract(line_text, '^from (\S+) import', 1), '.', 1)
    FROM code_import_lines WHERE ext = 'py' AND regexp_matches(line_text, '^from [^.]\S* import')
  UNION SELECT repo, path, split_part(trim(unnest(string_split(
      regexp_extract(line_text, '^import (.+)$', 1), ','))), '.', 1)
    FROM code_import_lines WHERE ext = 'py' AND starts_with(line_text, 'import '))
"""

CODE_HITS = r"""
code_module_lists AS (SELECT repo, path, list(module) AS modules FROM code_imports GROUP BY ALL),
code_silent AS (
  SELECT repo, path, CASE WHEN contains(raw, 'dusk-ignore-next-line') THEN n + 1 ELSE n END AS line
  FROM (SELECT repo, path, unnest(string_split(content, chr(10))) AS raw,
    generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code_texts)
  WHERE contains(raw, 'dusk-ignore')),
code_lines AS (SELECT repo, path, ext, unnest(string_split(text, chr(10))) AS line_text,
  generate_subscripts(string_split(text, chr(10)), 1) AS line FROM code_texts),
code_pairs AS (SELECT l.*, r.*, (len(r.sdk) = 0 OR l.ext NOT IN ('js', 'ts', 'py')
    OR len(list_filter(coalesce(m.modules, CAST([] AS VARCHAR[])), lambda i:
      list_contains(r.sdk, i) OR list_contains(r.sdk, split_part(i, '/', 1)))) > 0) AS opened
  FROM code_lines l JOIN code_rules r ON (list_contains(applies_to, '*') OR list_contains(applies_to, l.ext))
  LEFT JOIN code_module_lists m ON m.repo = l.repo AND m.path = l.path
  WHERE regexp_matches(l.line_text, r.regex)),
code_hits AS (SELECT p.repo, p.id, p.path AS file, p.kind, CAST(p.regex_ord AS INTEGER) AS regex_ord,
  CAST(p.line AS INTEGER) AS line,
  trim(regexp_replace(regexp_extract(p.line_text, p.regex), '\s+', ' ', 'g')) AS text,
  NOT p.opened AS mention
  FROM code_pairs p LEFT JOIN code_silent s ON s.repo = p.repo AND s.path = p.path AND s.line = p.line
  WHERE s.line IS NULL AND (p.opened OR p.kind = 'model'))
"""

CODE_FINDINGS = f"""
code_entries AS (SELECT DISTINCT id, severity, sunset_date, entry_ord, has_models FROM code_rules),
code_findings AS (SELECT h.repo, h.id, e.severity, e.sunset_date, e.entry_ord, e.has_models,
  count(*) AS n_hits, bool_and({SQL_IS_TEST.format('file')}) AS test_only, bool_and(mention) AS mention_only
  FROM code_hits h JOIN code_entries e ON h.id = e.id GROUP BY ALL),
code_urgent AS (SELECT *, CASE WHEN test_only OR mention_only THEN 'low' ELSE severity END AS effective_severity,
  CASE WHEN sunset_date IS NULL THEN 'deprecated' WHEN CAST(sunset_date AS DATE) < DATE '{CODE_NOW}'
    THEN 'retired' ELSE 'scheduled' END AS effective_status,
  CAST(sunset_date AS DATE) - DATE '{CODE_NOW}' AS days_until FROM code_findings),
code_gated AS (SELECT *, NOT test_only AND NOT mention_only AND CASE WHEN severity = 'high'
    THEN effective_status <> 'retired'
    ELSE effective_status = 'scheduled' AND coalesce(days_until BETWEEN 0 AND 30, false) END AS trips_gate
  FROM code_urgent)
"""
CODE = (CODE_FILES, CODE_RULES, CODE_TEXTS, CODE_IMPORTS, CODE_HITS)
DOCS = (DOC_FILES, DOC_RULES, DOC_HITS)
