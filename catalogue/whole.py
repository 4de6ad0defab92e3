"""One scan of repositories that hold everything: sources, manifests with workspaces, ignore files, all match modes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.manifests import _MEMBERS, _READ_SQL, _manifest_files
from catalogue.views import table, with_ctes
from duskwatch import registry_from_rows
from duskwatch.plans.scan import scan
from duskwatch.session import shared_folder
from duskwatch.operators.inventory import latest_findings
from duskwatch.sinks.reports import Batch, read_table, scan_rows, store_reports
from duskwatch.sources.checkouts import scan_checkouts
from duskwatch.sources.files import read_corpus, select_sources, write_corpus
from duskwatch.sources.manifests import dependencies, read_manifests

NOW = "2026-06-06"
_OTHER_FILES = [
    ("'src/app.js'", "case when c_acctbal > 0 then concat('legacy.call(1);', chr(10), 'legacy.call(2);') else 'none();' end"),
    ("'gen/app.js'", "'legacy.call(3);'"),
    ("'README.md'", "'legacy.call(4);'"),
    ("'docs/Main.java'", "'legacy.call(5);'"),
    ("'node_modules/x/a.js'", "'legacy.call(6);'"),
    ("'.github/workflows/gen.js'", "'legacy.call(7);'"),
    ("'.duskignore'", "case when c_nationkey < 12 then concat('gen/', chr(10), 'lib/[z-a].js', chr(10), 'a{b,{c') else '# none' end"),
]


def _registry(spark):
    def entry(id_, severity, match, exts, sunset, sdk=(), patterns=(), version_range=None):
        return {
            "id": id_, "vendor": "V", "title": id_, "severity": severity, "match": match, "applies_to": exts, "sunset_date": sunset,
            "version_range": version_range, "detect": {"sdk": list(sdk), "patterns": list(patterns), "models": []},
        }

    return registry_from_rows(spark, [
        entry("p-legacy", "high", "pattern", ["js"], "2026-08-01", patterns=[r"\blegacy\.call\(\d"]),
        entry("s-flask", "medium", "sdk", ["py"], None, sdk=["Flask"]),
        entry("v-building", "low", "version", ["*"], "2026-06-20", sdk=["building"], version_range=">=12"),
        entry("v-tool", "high", "version", ["js"], None, sdk=["tool"], version_range=">=2"),
        entry("s-urgent", "high", "sdk", ["ts"], None, sdk=["1_Urgent"]),
    ])


def _files(spark, folder):
    return _manifest_files(spark, folder, _OTHER_FILES).withColumn("size", F.octet_length("content").cast("bigint"))


def _scanned(spark, folder):
    """A scan of a stored corpus: its files are made once, spread over all cores, and each branch reads its own kinds."""
    store = f"{shared_folder(spark)}/whole-{uuid.uuid4().hex}"
    write_corpus(_files(spark, folder), f"{store}/corpus")
    return scan(read_corpus(spark, f"{store}/corpus"), _registry(spark), now=NOW, store=store)


def scan_findings(spark, folder):
    return _scanned(spark, folder).findings.select(
        "repo", "id", "n_hits", "n_manifests", "effective_severity", "effective_status", "trips_gate"
    )


def scan_totals(spark, folder):
    return _scanned(spark, folder).summary.select("repo", "scanned_files", "manifests_scanned", "detected", "verdict")


def scan_reported(spark, folder):
    """A scan stored as the reports of its repositories; their findings and evidence read back from the report tables."""
    root = f"{shared_folder(spark)}/reported-{uuid.uuid4().hex}"
    store_reports(scan_rows(_scanned(spark, folder), f"{NOW} 12:00:00", "1"), root, Batch("scan", 0))
    reports, key = read_table(spark, root, "reports"), ["repo", "report_id", "id"]
    places = latest_findings(read_table(spark, root, "evidence"), reports).groupBy(*key).agg(F.count(F.lit(1)).alias("n_hits"))
    found = latest_findings(read_table(spark, root, "findings"), reports).join(places, key, "left")
    return found.join(reports.select("report_id", "detected"), "report_id").select(
        "repo", "id", "severity", "status", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "detected"
    )


def registry_excluded(spark, folder):
    """A custom registry that lies inside one repository is not scanned there, and nowhere else left out."""
    chosen = select_sources(_files(spark, folder), registry_path=("c7", "src/app.js"))
    return chosen.select("repo", "path")


# --- checkouts on disk -----------------------------------------------------------------------------

_ON_DISK = [
    ("src/app.js", "case when s_acctbal > 0 then 'legacy.call(1);' else 'none();' end"), ("src/.hidden/b.js", "'hidden'"), ("README.md", "'read me'"),
    (".git/config", "'[core]'"), (".git/objects/ab/x.js", "'never listed'"), ("node_modules/x/a.js", "'never listed'"),
    ("vendor/y/package.json", "'{}'"), ("vendor/y/b.js", "'vendored'"), ("package.json", "concat('{\"dependencies\": {\"d', s_nationkey, '\": \"1\"}}')"),
    (".github/workflows/ci.yml", "'run: duskwatch'"), ("lib/deep/er/c.py", "repeat('x', s_nationkey * 10)"),
]


def _checkouts(spark, folder):
    """A folder of files for every supplier, written by the executors."""
    import os

    root = f"{shared_folder(spark)}/checkouts-{uuid.uuid4().hex}"
    rows = table(spark, folder, "supplier").selectExpr("concat('s', s_suppkey) as repo", *[f"{c} as f{n}" for n, (_, c) in enumerate(_ON_DISK)])

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for n, (path, _) in enumerate(_ON_DISK):
                    file = os.path.join(root, row["repo"], path)
                    os.makedirs(os.path.dirname(file), exist_ok=True)
                    with open(file, "w") as out:
                        out.write(row[f"f{n}"])
            yield batch

    rows.repartition(8).mapInArrow(write, rows.schema).count()
    return root


def checkouts_read(spark, folder):
    """Files of checkouts, pruned while listed; on top a condition that the reader takes over."""
    root = _checkouts(spark, folder)
    usual = scan_checkouts(spark, root, partitions=64).select(F.lit("usual").alias("request"), "repo", "path", "content", "size")
    few = scan_checkouts(spark, root, partitions=64).filter("path like 'lib/%' and size <= 100 and repo in ('s1', 's2', 's3')")
    return usual.unionByName(few.select(F.lit("few").alias("request"), "repo", "path", "content", "size"))


def checkouts_scanned(spark, folder):
    """Dependencies declared in checkouts on disk: from files to inventory."""
    found = dependencies(read_manifests(scan_checkouts(spark, _checkouts(spark, folder), partitions=64)))
    return found.select("repo", "manifest", "name", "version")


_LISTED_SQL = "WITH on_disk AS (" + "\nUNION ALL ".join(
    f"SELECT concat('s', s_suppkey) AS repo, s_suppkey, '{path}' AS path, {content.replace(chr(92) + chr(34), chr(34))} AS content FROM supplier"
    for path, content in _ON_DISK if path not in ("src/.hidden/b.js", ".git/objects/ab/x.js", "node_modules/x/a.js", "vendor/y/b.js")
) + """)
SELECT 'usual' AS request, repo, path, content, CAST(strlen(content) AS BIGINT) AS size FROM on_disk
UNION ALL SELECT 'few', repo, path, content, CAST(strlen(content) AS BIGINT) FROM on_disk
  WHERE path = 'lib/deep/er/c.py' AND strlen(content) <= 100 AND s_suppkey <= 3"""


def stored_corpus(spark, folder):
    """Files chosen from a stored corpus, under requests that its partition of sources does and does not cover."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    write_corpus(_files(spark, folder), path)
    corpus = read_corpus(spark, path)
    requests = {"usual": {}, "java": {"extensions": ("java",)}, "deps": {"include_deps": True}}
    chosen = [select_sources(corpus, **options).select(F.lit(name).alias("request"), "repo", "path") for name, options in requests.items()]
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2])


_FINDINGS = f"""
whole AS (
  SELECT concat('c', c_custkey) AS repo, 'p-legacy' AS id,
    CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END + CASE WHEN c_nationkey >= 12 THEN 1 ELSE 0 END AS n_hits, 0 AS n_manifests,
    'high' AS effective_severity, 'scheduled' AS effective_status, true AS trips_gate
    FROM customer WHERE c_acctbal > 0 OR c_nationkey >= 12
  UNION ALL SELECT concat('c', c_custkey), 's-flask', 0, 1, 'medium', 'deprecated', false FROM customer
  UNION ALL SELECT concat('c', c_custkey), 'v-building', 0, 1, 'low', 'scheduled', true FROM customer
    WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 12
  UNION ALL SELECT repo, 's-urgent', 0, count(*), 'high', 'deprecated', true FROM members
    WHERE lower(replace(o_orderpriority, ' ', '-')) = '1-urgent' GROUP BY repo)
"""
_TOTALS_SQL = f"""
SELECT concat('c', c_custkey) AS repo, CAST(CASE WHEN c_nationkey >= 12 THEN 2 ELSE 1 END AS BIGINT) AS scanned_files,
  m.manifests AS manifests_scanned, w.detected, CAST(CASE WHEN w.tripped THEN 1 ELSE 0 END AS INTEGER) AS verdict
FROM customer JOIN ({_READ_SQL}) m ON m.repo = concat('c', c_custkey)
JOIN (SELECT repo, count(*) AS detected, bool_or(trips_gate) AS tripped FROM whole GROUP BY repo) w ON w.repo = m.repo"""
_STORED_SQL = "\nUNION ALL ".join(
    f"SELECT '{request}' AS request, concat('c', c_custkey) AS repo, '{path}' AS path FROM customer"
    for request, paths in (
        ("usual", ("src/app.js", "gen/app.js")), ("java", ("docs/Main.java",)),
        ("deps", ("src/app.js", "gen/app.js", "node_modules/x/a.js", ".github/workflows/gen.js")),
    ) for path in paths
)

QUERIES = {
    "scan_findings": (scan_findings, with_ctes(
        _MEMBERS, _FINDINGS, """SELECT repo, id, CAST(n_hits AS BIGINT) AS n_hits, CAST(n_manifests AS BIGINT) AS n_manifests,
  effective_severity, effective_status, trips_gate FROM whole""")),
    "scan_totals": (scan_totals, with_ctes(_MEMBERS, _FINDINGS, _TOTALS_SQL)),
    "stored_corpus": (stored_corpus, _STORED_SQL),
    "scan_reported": (scan_reported, with_ctes(
        _MEMBERS, _FINDINGS, """SELECT repo, id, effective_severity AS severity, effective_status AS status, CAST(n_hits AS BIGINT) AS n_hits,
  count(*) OVER (PARTITION BY repo) AS detected FROM whole""")),
    "registry_excluded": (registry_excluded, """SELECT concat('c', c_custkey) AS repo, path FROM customer
  CROSS JOIN (VALUES ('src/app.js'), ('gen/app.js')) p(path) WHERE c_custkey <> 7 OR path <> 'src/app.js'"""),
    "checkouts_read": (checkouts_read, _LISTED_SQL),
    "checkouts_scanned": (checkouts_scanned, """SELECT concat('s', s_suppkey) AS repo, 'package.json' AS manifest,
  concat('d', s_nationkey) AS name, '1' AS version FROM supplier"""),
}
