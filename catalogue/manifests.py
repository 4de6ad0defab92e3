"""Manifests, names, versions and registry validation over part, events, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.views import spread_table, sql_text, table, with_ctes
from duskwatch import registry_from_rows
from duskwatch.functions.versions import normalize_name, version_in_range, version_numbers
from duskwatch.operators.audit import pattern_audit, registry_audit, unusable_patterns
from duskwatch.operators.dependencies import match_dependencies, versions_in_ranges
from duskwatch.plans.joins import dealt
from duskwatch.sources.manifests import (
    dependencies,
    go_mod_dependencies,
    package_json_dependencies,
    read_manifests,
    requirements_dependencies,
)
from duskwatch.sources.registry import coerce_entries, entries_of_json

# --- events: JSON maps ------------------------------------------------------------------------


def props_map(spark, folder):
    content = F.expr(
        """concat('{"dependencies": ', props, ', "devDependencies": {"', event_type, '": "^',
        user_id, '.0"}, "peerDependencies": 5}')"""
    )
    found = F.inline(package_json_dependencies(content))
    rows = table(spark, folder, "events").select("event_id", found)
    return rows.select("event_id", "name", "version", "field_ord", "pos")


_PROPS_SQL = """
SELECT event_id, unnest(json_keys(props)) AS name, CAST(NULL AS VARCHAR) AS version,
  CAST(0 AS INTEGER) AS field_ord, CAST(0 AS INTEGER) AS pos FROM events
UNION ALL SELECT event_id, event_type, concat('^', user_id, '.0'), 1, 0 FROM events"""


# --- part: requirements, go.mod, versions -------------------------------------------------------

_REQUIREMENTS = """concat_ws(chr(10), '# pinned', concat(replace(p_name, ' ', '_'), ' == ', p_size, '.1  # why'),
  concat('-r ', p_brand), concat(p_type, '[extra] >= ', p_size, ' ; python_version'), concat('git+https://', p_type),
  concat(upper(replace(p_name, ' ', '.')), '~=2'), concat('x', p_size, ' @ file:///x'), '  ')"""


def requirement_parse(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"{_REQUIREMENTS} as content")
    found = rows.select("p_partkey", F.inline(requirements_dependencies(F.col("content"))))
    return found.select(
        "p_partkey", "name", normalize_name(F.col("name")).alias("norm"), "version", "pos"
    )


_REQUIREMENT_SQL = """
SELECT p_partkey, name, lower(regexp_replace(name, '[_.-]+', '-', 'g')) AS norm, version, CAST(pos AS INTEGER) AS pos
FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS name, concat('==', p_size, '.1') AS version, 1 AS pos FROM part
  UNION ALL SELECT p_partkey, p_type, concat('>=', p_size), 3 FROM part
  UNION ALL SELECT p_partkey, upper(replace(p_name, ' ', '.')), '~=2', 5 FROM part)"""

_GO_MOD = """concat_ws(chr(10), concat('module ', p_type), '', 'require (', concat(chr(9), 'host/', p_brand, ' v', p_size, '.0 // indirect'),
  '  // only a comment', concat('  host/', replace(p_name, ' ', '/'), ' v1'), ')',
  concat('require single/', p_type, ' v0.', p_size), concat('exclude x/y v', p_size), 'require lonely')"""


def go_mod_parse(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"{_GO_MOD} as content")
    return rows.select("p_partkey", F.inline(go_mod_dependencies(F.col("content")))).select(
        "p_partkey", "name", "version", "pos"
    )


_GO_SQL = """
SELECT p_partkey, concat('host/', p_brand) AS name, concat('v', p_size, '.0') AS version, CAST(0 AS INTEGER) AS pos FROM part
UNION ALL SELECT p_partkey, concat('host/', replace(p_name, ' ', '/')), 'v1', 1 FROM part
UNION ALL SELECT p_partkey, concat('single/', p_type), concat('v0.', p_size), 2 FROM part"""

RANGES = ["<3", "<=3.0.0", ">12.5", ">=20", "=7.1", "7.1.0", "== 7", "~1.2", "", "v30"]
_DECLARED = (
    "case when p_size < 4 then 'latest' when p_size < 8 then concat('^', p_size, '.1.', p_partkey) "
    "when p_size < 20 then concat('v', p_size) when p_size < 40 then concat('>=', p_size, '.0') "
    "else concat('release-', p_size, '.1-beta2') end"
)


def version_range(spark, folder):
    rows = spread_table(spark, folder, "part", "p_partkey", "p_size").selectExpr(
        "p_partkey", f"{_DECLARED} as declared"
    )
    ranges = F.explode(F.array(*[F.lit(r) for r in RANGES])).alias("range")
    pairs = rows.select("p_partkey", "declared", ranges)
    first = F.get(version_numbers(F.col("declared")), F.lit(0)).cast("bigint")
    holds = version_in_range(F.col("declared"), F.col("range"))
    return pairs.select("p_partkey", "range", first.alias("major"), holds.alias("holds"))


def _padded(value: str) -> str:
    """Dotted numbers as one comparable list of four integers, missing ones zero."""
    parts = f"string_split(regexp_extract({value}, '(\\d+(?:\\.\\d+)*)', 1), '.')"
    return (
        "[" + ", ".join(f"CAST(coalesce({parts}[{n}], '0') AS BIGINT)" for n in range(1, 5)) + "]"
    )


_RANGE_SQL = f"""
WITH pairs AS (SELECT p_partkey, {_DECLARED} AS declared,
  unnest([{', '.join(sql_text(r) for r in RANGES)}]) AS range FROM part),
read AS (SELECT *, regexp_extract(declared, '\\d+') AS digits,
  regexp_extract(range, '^(<=|>=|<|>|=*)', 1) AS op,
  regexp_matches(range, '^\\s*(<=|>=|<|>|=|==|===)?\\s*v?\\d+(\\.\\d+)*\\s*$') AS readable FROM pairs)
SELECT p_partkey, range, CAST(nullif(digits, '') AS BIGINT) AS major,
  CASE WHEN NOT readable THEN true WHEN digits = '' THEN false
    WHEN op = '<' THEN {_padded('declared')} < {_padded('range')}
    WHEN op = '<=' THEN {_padded('declared')} <= {_padded('range')}
    WHEN op = '>' THEN {_padded('declared')} > {_padded('range')}
    WHEN op = '>=' THEN {_padded('declared')} >= {_padded('range')}
    ELSE {_padded('declared')} = {_padded('range')} END AS holds FROM read"""


def version_join(spark, folder):
    """Brands as packages, each with its parts' versions and every range: an interval join by name and leading number."""
    declared = spread_table(spark, folder, "part", "p_partkey", "p_size", "p_brand").selectExpr(
        "lower(p_brand) as norm", f"{_DECLARED} as version"
    )
    ranges = declared.select("norm").distinct().select("norm", F.explode(F.array(*[F.lit(r) for r in RANGES])).alias("range"))
    return versions_in_ranges(declared, ranges)


_VERSION_JOIN_SQL = f"""SELECT DISTINCT lower(p_brand) AS norm, declared AS version, range FROM (
{_RANGE_SQL.replace("SELECT p_partkey, range, CAST", "SELECT p_partkey, declared, range, CAST")}) h JOIN part USING (p_partkey) WHERE holds"""


# --- part × registry: dependency matching ---------------------------------------------------------

# id, match, applies_to, sdk, version_range
DEP_ENTRIES = [
    ("d-widget", "sdk", ["*"], ["red-widget", "Blue_Widget", "hot.gizmo"], None),
    ("d-ring", "version", ["js", "ts"], ["small.ring", "old ring"], "<20"),
    ("d-bolt", "version", ["py"], ["new-bolt", "hot-bolt"], ">=25.1"),
    ("d-rod", "sdk", ["go"], ["old-rod", "large-rod"], None),
    ("d-any", "version", ["py", "go"], ["cold-anvil"], "whatever"),
]
_PART_DEPS = """
SELECT p_brand AS repo, CASE WHEN p_size <= 17 THEN 'package.json' WHEN p_size <= 34 THEN 'requirements.txt'
    WHEN p_size <= 45 THEN 'go.mod' ELSE 'sub/pom.xml' END AS manifest,
  replace(p_name, ' ', CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN '_' ELSE '-' END) AS name,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE concat('^', p_size, '.1') END AS version,
  CASE WHEN p_type < 'M' THEN 0 ELSE 1 END AS field_ord, p_partkey AS pos FROM part"""


def dep_match(spark, folder):
    table(spark, folder, "part").createOrReplaceTempView("duskwatch_part")
    deps = spark.sql(_PART_DEPS.replace("FROM part", "FROM duskwatch_part"))
    registry = registry_from_rows(spark, [
        {"id": id_, "vendor": "V", "title": id_, "severity": "low", "match": match,
         "applies_to": exts, "detect": {"sdk": sdk}, "version_range": range_}
        for id_, match, exts, sdk, range_ in DEP_ENTRIES
    ])
    return match_dependencies(deps, registry)


def _dep_rows() -> str:
    rows = []
    for id_, match, exts, sdk, range_ in DEP_ENTRIES:
        names = "[" + ", ".join(sql_text(e) for e in exts) + "]"
        rows += [
            f"({sql_text(id_)}, {sql_text(match)}, {names}, {sql_text(s)}, {n}, {sql_text(range_)})"
            for n, s in enumerate(sdk)
        ]
    return ", ".join(rows)


_DEP_SQL = f"""
WITH deps AS ({_PART_DEPS}),
packages(id, match, exts, sdk, sdk_ord, range) AS (VALUES {_dep_rows()}),
met AS (SELECT d.*, p.* FROM deps d JOIN packages p
  ON lower(regexp_replace(d.name, '[_.-]+', '-', 'g')) = lower(regexp_replace(p.sdk, '[_.-]+', '-', 'g'))
  WHERE list_contains(exts, '*') OR CASE manifest
    WHEN 'package.json' THEN list_has_any(exts, ['js', 'ts', 'jsx', 'tsx', 'mjs', 'cjs'])
    WHEN 'requirements.txt' THEN list_contains(exts, 'py') WHEN 'go.mod' THEN list_contains(exts, 'go')
    ELSE true END),
firsts AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY repo, id, manifest, name
  ORDER BY sdk_ord, field_ord, pos) = 1),
sized AS (SELECT *, CAST(regexp_extract(version, '\\d+') AS INTEGER) AS major FROM firsts
  WHERE match = 'sdk' OR range = 'whatever' OR version IS NOT NULL)
SELECT repo, id, manifest, name AS sdk, version FROM sized
WHERE match = 'sdk' OR CASE range WHEN '<20' THEN major < 20 WHEN '>=25.1' THEN major >= 25 ELSE true END"""


# --- customers, orders, suppliers as repositories with manifests --------------------------------------

_ROOT_JSON = """concat('{"name": "c', c_custkey, '", "dependencies": {"', lower(c_mktsegment), '": "^',
  c_nationkey, '.0.0", "shared": ', c_nationkey, '}, "optionalDependencies": {"opt-', c_nationkey, '": "*"}, "workspaces": ',
  case when c_nationkey < 8 then '["packages/*", "!packages/p*"]'
    when c_nationkey < 16 then '{"packages": ["./apps/**/", 7]}' else '"packages/*"' end, '}')"""
_MEMBER_PATH = """concat(case o_orderstatus when 'F' then 'packages/o' when 'O' then 'apps/deep/er/o' else 'packages/p' end,
  o_orderkey, '/package.json')"""
_MEMBER_JSON = """concat('{"dependencies": {"', lower(replace(o_orderpriority, ' ', '-')), '": "', cast(o_totalprice as int),
  '"}, "devDependencies": {"tool": "1"}}')"""
_REQS = """concat('flask>=', c_nationkey, chr(10), '# no', chr(10), lower(c_mktsegment), '_py')"""


def _manifest_files(spark, folder, others=()):
    """Files of repositories: those of every customer, ``others`` (path, content) among them, and a member for every order.

    Rows of both tables are dealt to all cores together, before they become files: every task makes files of each kind.
    """
    customers = table(spark, folder, "customer").select(F.lit(True).alias("root"), "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    listed = lambda files: ", ".join(f"named_struct('path', {path}, 'content', {content})" for path, content in files)
    of_root = [
        ("'package.json'", _ROOT_JSON), ("'requirements.txt'", _REQS), ("case when c_acctbal < 0 then 'go.mod' end", "'require broken'"), *others,
    ]
    return dealt(customers.unionByName(orders, allowMissingColumns=True)).selectExpr(
        "concat('c', if(root, c_custkey, o_custkey)) as repo",
        f"inline(if(root, filter(array({listed(of_root)}), f -> f.path is not null), array({listed([(_MEMBER_PATH, _MEMBER_JSON)])})))",
    )


def manifest_inventory(spark, folder):
    deps = dependencies(read_manifests(_manifest_files(spark, folder)))
    return deps.select("repo", "manifest", "name", "version", "field_ord", "pos")


def manifests_read(spark, folder):
    found = read_manifests(_manifest_files(spark, folder))
    return found.groupBy("repo").agg(F.count(F.lit(1)).alias("manifests"))


_MEMBERS = f"""
members AS (SELECT concat('c', o_custkey) AS repo, {_MEMBER_PATH} AS manifest, o_orderpriority, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE (c_nationkey < 8 AND o_orderstatus = 'F') OR (c_nationkey BETWEEN 8 AND 15 AND o_orderstatus = 'O'))
"""
_INVENTORY_SQL = """SELECT *, CAST(f AS INTEGER) AS field_ord, CAST(p AS INTEGER) AS pos FROM (
  SELECT concat('c', c_custkey) AS repo, 'package.json' AS manifest, lower(c_mktsegment) AS name,
    concat('^', c_nationkey, '.0.0') AS version, 0 AS f, 0 AS p FROM customer
  UNION ALL SELECT concat('c', c_custkey), 'package.json', 'shared', NULL, 0, 1 FROM customer
  UNION ALL SELECT concat('c', c_custkey), 'package.json', concat('opt-', c_nationkey), '*', 3, 0 FROM customer
  UNION ALL SELECT concat('c', c_custkey), 'requirements.txt', 'flask', concat('>=', c_nationkey), 0, 0 FROM customer
  UNION ALL SELECT concat('c', c_custkey), 'requirements.txt', concat(lower(c_mktsegment), '_py'), NULL, 0, 2 FROM customer
  UNION ALL SELECT repo, manifest, lower(replace(o_orderpriority, ' ', '-')), CAST(CAST(trunc(o_totalprice) AS INTEGER) AS VARCHAR), 0, 0 FROM members
  UNION ALL SELECT repo, manifest, 'tool', '1', 1, 0 FROM members)""".replace("SELECT *, ", "SELECT repo, manifest, name, version, ", 1)
_READ_SQL = """SELECT repo, sum(n)::BIGINT AS manifests FROM (
  SELECT concat('c', c_custkey) AS repo, 2 + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS n FROM customer
  UNION ALL SELECT repo, 1 FROM members) GROUP BY repo"""


# --- part: registry validation ---------------------------------------------------------------------------

_ENTRY_JSON = """concat('{"id": ', case when p_size = 1 then '7' when p_size = 2 then '""' else concat('"', replace(p_name, ' ', '-'), '-', p_partkey, '"') end,
  ', "vendor": "', p_brand, '", "title": "', p_name, '", "severity": "', case p_type when 'ECONOMY' then 'high'
    when 'LARGE' then 'urgent' when 'SMALL' then 'low' else 'medium' end, '"',
  case when p_size < 10 then '' when p_size < 20 then ', "match": null' when p_size < 30 then ', "match": "sdk"'
    when p_size < 40 then ', "match": "version", "version_range": "<2"' else ', "match": "endpoint"' end,
  ', "sunset_date": ', case when p_size < 5 then 'null' when p_size < 15 then '"2026-13-01"' when p_size < 35 then '"2026-08-26"' else '""' end,
  ', "status": "', case when p_type = 'PROMO' then 'retired' else 'unknown' end, '", "confidence": "', case when p_size > 25 then 'confirmed' else 'guess' end,
  '", "applies_to": ', case when p_size < 12 then '[]' when p_size < 24 then '[".JS", "py"]' when p_size < 36 then '["t s"]' else '["js", 5]' end,
  ', "detect": {"patterns": ', case when p_size < 25 then '["a", "b"]' else '["a", null]' end, ', "sdk": ', case when p_size < 33 then concat('["', p_type, '"]') else '[]' end, '}',
  ', "source": ', case when p_size < 20 then '"s"' else '12' end, '}')"""


def _raw_registry(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"{_ENTRY_JSON} as text")
    return entries_of_json(rows, "text", "p_partkey")


def registry_validate(spark, folder):
    e = coerce_entries(_raw_registry(spark, folder))
    joined = [F.array_join(c, "|").alias(n) for n, c in (
        ("scopes", F.col("applies_to")), ("patterns", F.col("detect.patterns")), ("sdk", F.col("detect.sdk")),
    )]
    return e.select(
        "entry_ord", "id", "vendor", "severity", "match", "status", "sunset_date", "confidence",
        "version_range", "source", "valid", *joined,
    )


# Patterns that do not parse, or that a long text could make exhaust the stack, among ones that are fine.
_PATTERNS = {
    r"\bold_{0}\(": True, r"(old_{0}": False, r"(?:a|b|\s)+old_{0}": True, r"(?:ab|ac)+old_{0}": False, r"old_{0}[z-a]": False,
    r"a**{0}": False, r"(?:\.\w+)*\(old_{0}": True, r"(?:\w+,)*\w+{0}": False, r"[a-z]+{0}": True,
}


def _pattern_registry(spark, folder):
    """An entry per part with two of the patterns; ids of parts that share a name and size are shared."""
    shown = F.array(*[F.lit(p) for p in _PATTERNS])
    pick = lambda n: F.replace(F.get(shown, (F.col("p_partkey") * n % len(_PATTERNS)).cast("int")), F.lit("{0}"), F.col("p_size").cast("string"))
    entry = F.struct(
        F.concat("p_name", F.lit("-"), F.col("p_size").cast("string")).alias("id"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("title"),
        F.lit("low").alias("severity"), F.struct(F.array(pick(1), pick(2)).alias("patterns"), F.array(F.lit("m(")).alias("models")).alias("detect"),
    )
    parts = dealt(table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_brand"))
    return entries_of_json(parts.select("p_partkey", F.to_json(entry).alias("text")), "text", "p_partkey")


def patterns_unusable(spark, folder):
    return unusable_patterns(_pattern_registry(spark, folder)).select("entry_ord", "id", "kind", "source")


def patterns_audit(spark, folder):
    return pattern_audit(_pattern_registry(spark, folder))


_PATTERN_CTES = """
shown(n, shown, fine) AS (VALUES """ + ", ".join(f"({n}, {sql_text(p)}, {str(ok).lower()})" for n, (p, ok) in enumerate(_PATTERNS.items())) + f"""),
bad AS (SELECT p_partkey AS entry_ord, concat(p_name, '-', p_size) AS id, 'pattern' AS kind, replace(shown, '{{0}}', CAST(p_size AS VARCHAR)) AS source
  FROM part CROSS JOIN (VALUES (1), (2)) t(times) JOIN shown ON shown.n = p_partkey * times % {len(_PATTERNS)} WHERE NOT fine)
"""
_PATTERNS_AUDIT_SQL = """SELECT (SELECT count(*) FROM part) AS pattern_entries, (SELECT count(*) FROM bad) AS unusable_patterns,
  (SELECT count(DISTINCT entry_ord) FROM bad) AS entries_affected,
  (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_name, p_size HAVING count(*) > 1)) AS shared_ids"""


def audit(spark, folder):
    return registry_audit(_raw_registry(spark, folder), now="2026-06-06")


_REGISTRY = """
coerced AS (SELECT p_partkey AS entry_ord,
  CASE WHEN p_size > 2 THEN concat(replace(p_name, ' ', '-'), '-', p_partkey) END AS id, p_brand AS vendor,
  CASE p_type WHEN 'ECONOMY' THEN 'high' WHEN 'LARGE' THEN NULL WHEN 'SMALL' THEN 'low' ELSE 'medium' END AS severity,
  CASE WHEN p_size < 20 THEN 'pattern' WHEN p_size < 30 THEN 'sdk' WHEN p_size < 40 THEN 'version' END AS match,
  CASE WHEN p_type = 'PROMO' THEN 'retired' END AS status,
  CASE WHEN p_size < 5 THEN NULL WHEN p_size < 15 THEN '2026-13-01' WHEN p_size < 35 THEN '2026-08-26' END AS sunset_date,
  CASE WHEN p_size > 25 THEN 'confirmed' END AS confidence,
  CASE WHEN p_size BETWEEN 30 AND 39 THEN '<2' END AS version_range,
  CASE WHEN p_size < 20 THEN 's' ELSE '' END AS source,
  CASE WHEN p_size < 12 THEN '*' WHEN p_size < 24 THEN 'js|py' WHEN p_size < 36 THEN 't s' ELSE '*' END AS scopes,
  CASE WHEN p_size < 25 THEN 'a|b' ELSE '' END AS patterns,
  CASE WHEN p_size < 33 THEN p_type ELSE '' END AS sdk FROM part),
checked AS (SELECT *, id IS NOT NULL AND severity IS NOT NULL AND match IS NOT NULL
  AND CASE WHEN match = 'pattern' THEN patterns <> '' ELSE sdk <> '' END AS valid FROM coerced)
"""
_AUDIT_SQL = """SELECT count(*) AS entries, CAST(0 AS BIGINT) AS duplicate_ids,
  count(*) FILTER (NOT valid) AS dropped,
  count(*) FILTER (valid AND sunset_date = '2026-13-01') AS bad_dates,
  count(*) FILTER (valid AND scopes = 't s') AS bad_scopes,
  count(*) FILTER (valid AND confidence IS NULL) AS no_confidence,
  count(*) FILTER (valid AND source = '') AS no_source, count(*) FILTER (valid) AS no_migration_url,
  count(*) FILTER (valid AND (coalesce(status, CASE WHEN sunset_date = '2026-08-26' THEN 'scheduled'
    ELSE 'deprecated' END) = 'deprecated') <> (sunset_date IS NULL)) AS status_date_mismatch FROM checked"""

QUERIES = {
    "version_join": (version_join, _VERSION_JOIN_SQL),
    "patterns_unusable": (patterns_unusable, with_ctes(_PATTERN_CTES, "SELECT entry_ord, id, kind, source FROM bad")),
    "patterns_audit": (patterns_audit, with_ctes(_PATTERN_CTES, _PATTERNS_AUDIT_SQL)),
    "props_map": (props_map, _PROPS_SQL),
    "requirement_parse": (requirement_parse, _REQUIREMENT_SQL),
    "go_mod_parse": (go_mod_parse, _GO_SQL),
    "version_range": (version_range, _RANGE_SQL),
    "dep_match": (dep_match, _DEP_SQL),
    "manifest_inventory": (manifest_inventory, with_ctes(_MEMBERS, _INVENTORY_SQL)),
    "manifests_read": (manifests_read, with_ctes(_MEMBERS, _READ_SQL)),
    "registry_validate": (registry_validate, with_ctes(_REGISTRY, """SELECT entry_ord, id, vendor, severity,
  match, status, sunset_date, confidence, version_range, source, valid, scopes, patterns, sdk FROM checked""")),
    "registry_audit": (audit, with_ctes(_REGISTRY, _AUDIT_SQL)),
}
