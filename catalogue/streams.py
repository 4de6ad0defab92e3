"""Streams over the test tables, run to their end and read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.views import table
from duskwatch.operators.inventory import current_inventory, latest_findings, latest_inventory
from duskwatch.plans.joins import dealt
from duskwatch.session import shared_folder
from duskwatch.sinks.reports import read_table
from duskwatch.streaming.monitor import drop_repeats, ingest_reports, keep_first, notify_new_entries


def _fresh_root(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, folder, name):
    source = table(spark, folder, name)
    files = spark.readStream.schema(source.schema).option("pathGlobFilter", f"{name}.parquet")
    return files.parquet(folder)


# Each order uploads a report that declares two packages.
_UPLOAD = [
    "concat('c', o_custkey) as repo", "'1.0' as cliVersion",
    "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z') as reportedAt",
    "1L as scannedFiles", "0L as detected",
    "named_struct('dependencies', array("
    "named_struct('name', concat('P.', o_custkey), 'version', cast(o_orderkey as string), 'manifest', 'go.mod'),"
    "named_struct('name', lower(o_orderpriority), 'version', cast(null as string), 'manifest', 'package.json'))) as inventory",
]


def _uploads(spark, folder, *more):
    """Orders are dealt to all cores while they are narrow: a file is one split, and what a report holds is many times its order."""
    orders = _stream(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return dealt(orders).selectExpr(*_UPLOAD, *more)


def _ingest(spark, folder, root):
    uploads = _uploads(spark, folder)
    ingest_reports(uploads, root, f"{root}/checkpoint-reports").awaitTermination()


def stream_ingest(spark, folder):
    root = _fresh_root(spark)
    _ingest(spark, folder, root)
    reports = read_table(spark, root, "reports")
    newest = latest_inventory(read_table(spark, root, "inventory"), reports)
    return newest.groupBy("repo").agg(
        F.count(F.lit(1)).alias("packages"),
        F.date_format(F.max("reported_at"), "yyyy-MM-dd").alias("reported"),
    )


_INGEST_SQL = """
SELECT concat('c', o_custkey) AS repo, CAST(2 AS BIGINT) AS packages,
  strftime(max(o_orderdate), '%Y-%m-%d') AS reported FROM orders GROUP BY o_custkey"""


def _entries(spark, folder):
    """Parts as registry entries, each naming one package."""
    return table(spark, folder, "part").selectExpr(
        "concat('e', p_partkey) as id", "array('*') as applies_to", "'pattern' as match",
        "cast(null as string) as version_range",
        "named_struct('sdk', array(concat('p-', p_partkey), 'none')) as detect",
        "p_size",
    )


def stream_notify(spark, folder):
    """The first delivery (small parts) seeds silently; the second notifies for the rest."""
    root = _fresh_root(spark)
    _ingest(spark, folder, root)
    entries = _entries(spark, folder)
    source = f"{root}/entries"
    for delivery in (entries.filter("p_size < 10"), entries):
        delivery.write.mode("append").parquet(source)
        stream = spark.readStream.schema(entries.schema).parquet(source)
        notify_new_entries(stream, root, f"{root}/checkpoint-entries").awaitTermination()
    return read_table(spark, root, "notifications").select("repo", "id")


_NOTIFY_SQL = """
SELECT DISTINCT concat('c', o_custkey) AS repo, concat('e', p_partkey) AS id
FROM orders JOIN part ON p_partkey = o_custkey WHERE p_size >= 10"""


def stream_two_sources(spark, folder):
    """Two streams, each with its own checkpoint and batch numbers, into the same tables."""
    root = _fresh_root(spark)
    uploads = _stream(spark, folder, "orders")
    for name, half in (("urgent", "o_orderpriority < '3'"), ("rest", "o_orderpriority >= '3' or o_orderpriority is null")):
        part = uploads.filter(half).selectExpr(*_UPLOAD)
        ingest_reports(part, root, f"{root}/checkpoint-{name}").awaitTermination()
    newest = latest_inventory(read_table(spark, root, "inventory"), read_table(spark, root, "reports"))
    return newest.groupBy("repo").agg(
        F.count(F.lit(1)).alias("packages"), F.date_format(F.max("reported_at"), "yyyy-MM-dd").alias("reported"),
    )


def stream_restart(spark, folder):
    """The second delivery comes with a new checkpoint: what the first seeded is remembered."""
    root = _fresh_root(spark)
    _ingest(spark, folder, root)
    entries = _entries(spark, folder)
    source = f"{root}/entries"
    for number, delivery in enumerate((entries.filter("p_size < 10"), entries)):
        delivery.write.mode("append").parquet(source)
        stream = spark.readStream.schema(entries.schema).parquet(source)
        notify_new_entries(stream, root, f"{root}/checkpoint-entries-{number}").awaitTermination()
    return read_table(spark, root, "notifications").select("repo", "id")


def stream_dedupe(spark, folder):
    root = _fresh_root(spark)
    first = drop_repeats(_stream(spark, folder, "events"), ["user_id", "event_type"], "ts")
    query = (
        first.select("user_id", "event_type").writeStream.format("parquet")
        .option("path", f"{root}/first").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/first")


def stream_first_only(spark, folder):
    """Events of each type arrive as a batch of their own, so repeats of a user are batches and days apart."""
    root = _fresh_root(spark)
    events = table(spark, folder, "events").select("user_id", "event_type", "ts")
    events.repartition(6, "event_type").write.parquet(f"{root}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    keep_first(stream, ["user_id"], root, "first", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/first").groupBy("user_id").agg(F.count(F.lit(1)).alias("times"))


# --- what is kept up to date ---------------------------------------------------------------------

# Which upload counts where a repository has several of one day: the first as JSON, so the order of its number as text.
_TOLD_SQL = """
told AS (SELECT o_custkey, o_orderdate, min(CAST(o_orderkey AS VARCHAR)) AS version,
  arg_min(lower(o_orderpriority), CAST(o_orderkey AS VARCHAR)) AS priority FROM orders {where} GROUP BY o_custkey, o_orderdate),
newest AS (SELECT o_custkey, version, priority FROM told QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1)
"""


def _in_two(spark, folder, root):
    """Reports up to a day first, the rest (and some of the first again) as a second delivery."""
    orders = table(spark, folder, "orders")
    for number, days in enumerate(("o_orderdate < '1996-01-01'", "o_orderdate >= '1995-12-01'")):
        orders.filter(days).write.parquet(f"{root}/orders/delivery={number}")
    for number in range(2):
        source = f"{root}/orders/delivery={number}"
        uploads = spark.readStream.schema(orders.schema).parquet(source).selectExpr(*_UPLOAD)
        ingest_reports(uploads, root, f"{root}/checkpoint-{number}").awaitTermination()


def inventory_kept(spark, folder):
    """Latest inventories as they are kept up to date, without a look at the log."""
    root = _fresh_root(spark)
    _in_two(spark, folder, root)
    return current_inventory(spark, root).select("repo", "manifest", "name", "version")


_KEPT_SQL = "WITH " + _TOLD_SQL.format(where="") + """
SELECT concat('c', o_custkey) AS repo, 'go.mod' AS manifest, concat('P.', o_custkey) AS name, version FROM newest
UNION ALL SELECT concat('c', o_custkey), 'package.json', priority, NULL FROM newest"""


def inventory_changes(spark, folder):
    """What the second delivery's reports added to and removed from the inventories of the first."""
    root = _fresh_root(spark)
    _in_two(spark, folder, root)
    changes = read_table(spark, root, "changes")
    late = changes.filter("reported_at >= '1996-01-01'")
    return late.select("repo", "manifest", "name", "version", "change")


_CHANGES_SQL = "WITH " + _TOLD_SQL.format(where="WHERE o_orderdate < DATE '1996-01-01'").replace("told AS", "told_before AS").replace(
    "newest AS", "before AS").replace("FROM told ", "FROM told_before ").rstrip() + "," + _TOLD_SQL.format(where="WHERE o_orderdate >= DATE '1996-01-01'") + """,
held AS (SELECT o_custkey, 'go.mod' AS manifest, concat('P.', o_custkey) AS name, version FROM before
  UNION ALL SELECT o_custkey, 'package.json', priority, NULL FROM before),
now_held AS (SELECT o_custkey, 'go.mod' AS manifest, concat('P.', o_custkey) AS name, version FROM newest
  UNION ALL SELECT o_custkey, 'package.json', priority, NULL FROM newest),
added AS (SELECT * FROM now_held EXCEPT SELECT * FROM held),
removed AS (SELECT h.* FROM held h SEMI JOIN newest n ON n.o_custkey = h.o_custkey EXCEPT SELECT * FROM now_held)
SELECT concat('c', o_custkey) AS repo, manifest, name, version, 'added' AS change FROM added
UNION ALL SELECT concat('c', o_custkey), manifest, name, version, 'removed' FROM removed"""


def stream_findings(spark, folder):
    """Findings that reports bring along: those of each repository's newest report, with their evidence counted."""
    root = _fresh_root(spark)
    found = """transform(sequence(0, cast(o_custkey % 3 as int)), i -> named_struct('id', concat('e', i), 'severity', 'low', 'baseSeverity', 'high',
      'status', 'scheduled', 'sunset_date', date_format(o_orderdate, 'yyyy-MM-dd'), 'testOnly', i = 1, 'mentionOnly', false,
      'patternMatches', transform(sequence(1, i + 1), k -> named_struct('file', concat('f', k), 'line', k, 'text', 'x', 'mention', false)))) as findings"""
    uploads = _uploads(spark, folder, found)
    ingest_reports(uploads, root, f"{root}/checkpoint").awaitTermination()
    reports = read_table(spark, root, "reports")
    key = ["repo", "report_id", "id"]
    places = latest_findings(read_table(spark, root, "evidence"), reports).groupBy(*key).agg(F.count(F.lit(1)).alias("places"))
    newest = latest_findings(read_table(spark, root, "findings"), reports)
    return newest.join(places, key, "left").select("repo", "id", "severity", "base_severity", "status", "sunset_date", "test_only", "places")


_STREAM_FINDINGS_SQL = """
WITH newest AS (SELECT o_custkey, max(o_orderdate) AS day FROM orders GROUP BY o_custkey),
each AS (SELECT *, unnest(range(0, o_custkey % 3 + 1)) AS i FROM newest)
SELECT concat('c', o_custkey) AS repo, concat('e', i) AS id, 'low' AS severity, 'high' AS base_severity, 'scheduled' AS status,
  strftime(day, '%Y-%m-%d') AS sunset_date, i = 1 AS test_only, CAST(i + 1 AS BIGINT) AS places FROM each"""

QUERIES = {
    "inventory_kept": (inventory_kept, _KEPT_SQL),
    "inventory_changes": (inventory_changes, _CHANGES_SQL),
    "stream_findings": (stream_findings, _STREAM_FINDINGS_SQL),
    "stream_ingest": (stream_ingest, _INGEST_SQL),
    "stream_two_sources": (stream_two_sources, _INGEST_SQL),
    "stream_notify": (stream_notify, _NOTIFY_SQL),
    "stream_restart": (stream_restart, _NOTIFY_SQL),
    "stream_dedupe": (stream_dedupe, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_first_only": (stream_first_only, "SELECT user_id, CAST(1 AS BIGINT) AS times FROM events GROUP BY user_id"),
}
