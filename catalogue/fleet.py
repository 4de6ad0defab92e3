"""Monitoring in batch and CI coverage: inventories, notifications, snapshots, remotes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogue.manifests import _REGISTRY, _raw_registry
from catalogue.views import table, with_ctes
from duskwatch.functions.remotes import github_remote, remote_hosts
from duskwatch.operators.coverage import coverage_audit, lacking_scan
from duskwatch.operators.inventory import latest_inventory, notifications
from duskwatch.session import shared_folder
from duskwatch.sinks.snapshots import newest_snapshot, read_snapshot, write_snapshot
from duskwatch.sources.registry import load_registry, read_entries, validate_entries

# --- orders as reports, their line items as the reported inventory --------------------------------


def _reports(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "concat('c', o_custkey) as repo", "cast(o_orderkey as string) as report_id",
        "o_orderdate as reported_at",
    )


def _inventory(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey as string) as report_id",
        "case when l_tax < 0.04 then 'package.json' when l_tax < 0.06 then 'requirements.txt' else 'go.mod' end as manifest",
        "concat('P_', l_partkey) as name", "cast(cast(l_quantity as int) as string) as version",
        "l_returnflag",
    )
    return lines.join(_reports(spark, folder), "report_id")


_INVENTORY = """
reports AS (SELECT concat('c', o_custkey) AS repo, CAST(o_orderkey AS VARCHAR) AS report_id, o_orderdate AS reported_at FROM orders),
inventory AS (SELECT r.*, CASE WHEN l_tax < 0.04 THEN 'package.json' WHEN l_tax < 0.06 THEN 'requirements.txt' ELSE 'go.mod' END AS manifest,
  concat('P_', l_partkey) AS name, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS version, l_returnflag
  FROM lineitem JOIN reports r ON CAST(l_orderkey AS VARCHAR) = r.report_id),
newest AS (SELECT repo, report_id FROM reports
  QUALIFY row_number() OVER (PARTITION BY repo ORDER BY reported_at DESC, report_id DESC) = 1),
latest AS (SELECT i.* FROM inventory i SEMI JOIN newest n ON i.repo = n.repo AND i.report_id = n.report_id)
"""


def latest(spark, folder):
    found = latest_inventory(_inventory(spark, folder), _reports(spark, folder))
    return found.select("repo", "report_id", "manifest", "name", "version")


def notify(spark, folder):
    """Parts as entries: small ones were seen before; some pairs were already sent."""
    parts = table(spark, folder, "part")
    registry = parts.selectExpr(
        "concat('n', p_partkey) as id", "'pattern' as match", "cast(null as string) as version_range",
        "case when p_type = 'PROMO' then array('go') when p_type = 'SMALL' then array('js', 'py') else array('*') end as applies_to",
        "named_struct('sdk', case when p_size = 50 then array() else array(concat('p-', p_partkey)) end) as detect",
        "p_size",
    )
    inventory = _inventory(spark, folder)
    sent = inventory.filter("l_returnflag = 'A'").selectExpr("repo", "replace(name, 'P_', 'n') as id")
    now_known = latest_inventory(inventory, _reports(spark, folder))
    return notifications(registry, registry.filter("p_size < 30"), now_known, sent)


_NOTIFY_SQL = """
fresh AS (SELECT concat('n', p_partkey) AS id, concat('P_', p_partkey) AS name, p_type FROM part WHERE p_size >= 30 AND p_size < 50),
due AS (SELECT DISTINCT l.repo, f.id FROM latest l JOIN fresh f ON l.name = f.name
  WHERE CASE f.p_type WHEN 'PROMO' THEN manifest = 'go.mod' WHEN 'SMALL' THEN manifest <> 'go.mod' ELSE true END)
SELECT d.repo, d.id FROM due d ANTI JOIN (SELECT repo, replace(name, 'P_', 'n') AS id FROM inventory
  WHERE l_returnflag = 'A') s ON s.repo = d.repo AND s.id = d.id"""


# --- customers as repositories with git configurations, orders as workflow files --------------------

_CONFIG = """concat('[core]', chr(10), case c_mktsegment
  when 'AUTOMOBILE' then concat(chr(9), 'url = git@github.com:org/c', c_custkey, '.git', chr(10))
  when 'BUILDING' then concat('url=https://gitlab.example.com/g/c', c_custkey, chr(10), 'url = ssh://git@hub.example.org/x/y', chr(10))
  when 'FURNITURE' then concat('  url = ssh://git@bitbucket.example.org/x/c', c_custkey, '.git', chr(10), ' url = https://github.com/own/c', c_custkey, '/  ', chr(10))
  when 'MACHINERY' then concat('url = https://user@GitHub.corp.example.com:8443/a/c', c_custkey, '.git', chr(10))
  else concat('pushurl = none', chr(10)) end)"""
_WORKFLOW = """concat('.github/workflows/', case when o_totalprice > 450000 then 'duskwatch.yml'
  when o_orderstatus = 'F' then concat('o', o_orderkey, '.YAML') when o_orderstatus = 'O' then concat('o', o_orderkey, '.yml')
  else concat('o', o_orderkey, '.yml.bak') end)"""


def _fleet(spark, folder):
    customers = table(spark, folder, "customer")
    repo = "concat('c', c_custkey) as repo"
    configs = customers.filter("c_nationkey >= 3").selectExpr(
        repo, "'.git/config' as path", f"{_CONFIG} as content"
    )
    pointers = customers.filter("c_nationkey = 2").selectExpr(
        repo, "'.git' as path", "'gitdir: ../x' as content"
    )
    workflows = table(spark, folder, "orders").selectExpr(
        "concat('c', o_custkey) as repo", f"{_WORKFLOW} as path",
        "case when o_orderpriority = '1-URGENT' then 'run: duskwatch scan' else 'run: test' end as content",
    )
    return configs.unionByName(pointers).unionByName(workflows), customers.selectExpr(repo)


def audit(spark, folder):
    return coverage_audit(*_fleet(spark, folder))


def lacking(spark, folder):
    return lacking_scan(coverage_audit(*_fleet(spark, folder)))


_AUDIT = f"""
flows AS (SELECT concat('c', o_custkey) AS repo, {_WORKFLOW} AS path, o_orderpriority = '1-URGENT' AS marked FROM orders),
flags AS (SELECT repo, bool_or(path = '.github/workflows/duskwatch.yml') AS ours,
  min(path) FILTER (marked AND regexp_matches(lower(path), '\\.ya?ml$')) AS other FROM flows GROUP BY repo),
audited AS (SELECT concat('c', c_custkey) AS repo, c_nationkey >= 2 AS git,
  c_nationkey >= 3 AND c_mktsegment = 'BUILDING' AS outside, coalesce(ours, false) AS ours,
  CASE WHEN ours THEN '.github/workflows/duskwatch.yml' ELSE other END AS workflow,
  CASE WHEN c_nationkey >= 3 THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'org' WHEN 'FURNITURE' THEN 'own' WHEN 'MACHINERY' THEN 'a' END END AS owner, c_custkey
  FROM customer LEFT JOIN flags ON flags.repo = concat('c', c_custkey)),
judged AS (SELECT repo, CASE WHEN NOT git THEN 'not-git' WHEN outside THEN 'non-github'
  WHEN workflow IS NOT NULL THEN 'already' ELSE 'eligible' END AS outcome,
  CASE WHEN outside THEN 'gitlab.example.com' END AS host, workflow, ours, owner,
  CASE WHEN owner IS NOT NULL THEN concat('c', c_custkey) END AS name FROM audited)
"""


def hosts(spark, folder):
    """Page addresses as the only remote of a configuration."""
    config = F.concat(F.lit('[remote "origin"]\n\turl = '), F.col("url"), F.lit("\n\tfetch = x\n"))
    remote = github_remote(F.replace(config, F.lit("//"), F.lit("//github.")))
    return table(spark, folder, "pages").select(
        "page_id", F.get(remote_hosts(config), F.lit(0)).alias("host"),
        remote["owner"].alias("owner"), remote["repo"].alias("name"),
    )


_HOSTS_SQL = r"""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host,
  nullif(regexp_extract(url, '[:/]([^:/\s]+)/([^/\s]+?)(?:\.git)?/?$', 1), '') AS owner,
  nullif(regexp_extract(url, '[:/]([^:/\s]+)/([^/\s]+?)(?:\.git)?/?$', 2), '') AS name FROM pages"""


def registry_snapshot(spark, folder):
    """Two versions of a registry made from parts; readers get the newer one."""
    root = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    raw = _raw_registry(spark, folder)
    write_snapshot(spark, root, raw.filter("entry is not null"), "parts", dt.datetime(2026, 6, 1))
    named = raw.filter("try_variant_get(entry, '$.severity', 'string') = 'high'")
    write_snapshot(spark, root, named, "parts", dt.datetime(2026, 6, 2))
    newest = newest_snapshot(spark, root)
    entries = read_snapshot(spark, root, newest["version"])
    return entries.select(
        "id", "vendor", "match", F.lit(newest["version"]).alias("version"),
        F.lit(newest["entries"]).cast("bigint").alias("entries"),
    )


def _registry_file(spark, folder, wrapped: bool) -> str:
    """The registry made from parts as one JSON document, as an object or as a bare array."""
    entries = _raw_registry(spark, folder).filter("entry is not null").select(F.to_json("entry").alias("text"), "entry_ord")
    ends = ('{"deprecations": [', "]}") if wrapped else ("[", "]")
    # Line by line in one sorted file: no entry waits for another in memory.
    edges = spark.createDataFrame([(0, ends[0]), (2, ends[1])], "part int, text string")
    ordered = entries.select(F.lit(1).alias("part"), "entry_ord", "text").unionByName(edges.withColumn("entry_ord", F.lit(None).cast("bigint")))
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    first = F.lag("part").over(W.partitionBy(F.lit(1)).orderBy("part", "entry_ord", "text")) == 0
    ordered.select(F.when((F.col("part") == 1) & ~first, F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("value")).write.text(path)
    return path


def registry_read(spark, folder):
    """Entries of a document in both of its shapes, by their places."""
    parts = [
        validate_entries(read_entries(spark, _registry_file(spark, folder, wrapped))).select(F.lit(name).alias("shape"), "id", "severity", "entry_ord")
        for name, wrapped in (("object", True), ("array", False))
    ]
    return parts[0].unionByName(parts[1])


def registry_resolve(spark, folder):
    """Which registry a run takes: the caller's file, else the newest snapshot, else the bundled one."""
    root, file = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", _registry_file(spark, folder, True)
    before = load_registry(spark, snapshots=root)
    write_snapshot(spark, root, _raw_registry(spark, folder).filter("try_variant_get(entry, '$.severity', 'string') = 'low'"), "parts", dt.datetime(2026, 6, 1))
    loaded = {"none": before, "snapshot": load_registry(spark, snapshots=root), "file": load_registry(spark, custom=file, snapshots=root)}
    rows = None
    for given, registry in loaded.items():
        found = registry.entries.select(F.lit(given).alias("given"), F.lit(registry.origin).alias("origin"), "id").filter(F.lit(given != "none"))
        mark = spark.createDataFrame([(given, registry.origin, None)], "given string, origin string, id string")
        part = mark if given == "none" else found
        rows = part if rows is None else rows.unionByName(part)
    return rows


def registry_load(spark, folder):
    return validate_entries(_raw_registry(spark, folder)).select(
        "id", "vendor", "severity", "match", F.size("detect.sdk").alias("n_sdk"), "entry_ord"
    )


QUERIES = {
    "latest_inventory": (
        latest, with_ctes(_INVENTORY, "SELECT repo, report_id, manifest, name, version FROM latest")
    ),
    "notify": (notify, with_ctes(_INVENTORY, _NOTIFY_SQL)),
    "coverage_audit": (
        audit, with_ctes(_AUDIT, "SELECT repo, outcome, host, workflow, ours, owner, name FROM judged")
    ),
    "coverage_lacking": (
        lacking, with_ctes(_AUDIT, "SELECT repo, outcome FROM judged WHERE outcome <> 'not-git' AND workflow IS NULL")
    ),
    "remote_hosts": (hosts, _HOSTS_SQL),
    "registry_load": (
        registry_load,
        with_ctes(_REGISTRY, """SELECT id, vendor, severity, match,
  CAST(CASE WHEN sdk = '' THEN 0 ELSE 1 END AS INTEGER) AS n_sdk, entry_ord FROM checked WHERE valid"""),
    ),
    "registry_read": (
        registry_read,
        with_ctes(_REGISTRY, """placed AS (SELECT *, row_number() OVER (ORDER BY entry_ord) - 1 AS place FROM checked)
SELECT shape, id, severity, place AS entry_ord FROM placed CROSS JOIN (VALUES ('object'), ('array')) s(shape) WHERE valid"""),
    ),
    "registry_resolve": (
        registry_resolve,
        with_ctes(_REGISTRY, """SELECT 'none' AS given, 'bundled' AS origin, NULL AS id
UNION ALL SELECT 'snapshot', 'cache', id FROM checked WHERE valid AND severity = 'low'
UNION ALL SELECT 'file', 'custom', id FROM checked WHERE valid"""),
    ),
    "registry_snapshot": (
        registry_snapshot,
        with_ctes(_REGISTRY, """SELECT id, vendor, match, CAST(2 AS INTEGER) AS version,
  count(*) OVER () AS entries FROM checked WHERE valid AND severity = 'high'"""),
    ),
}
