"""Dates, status, urgency and order over orders and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.views import spread_table, table, with_ctes
from duskwatch.functions import lifecycle, phrases
from duskwatch.operators.findings import effective_severity, rank_findings, with_urgency
from duskwatch.operators.inventory import sunset_calendar, sunset_rollup
from duskwatch.operators.replay import change_points, daily_changes, gate_series, read_changes, state_on, write_changes
from duskwatch.session import shared_folder
from duskwatch.streaming.monitor import replay_gate

NOW = "1998-01-01"
# Orders read as registry facts: some dates missing, partial or impossible, some statuses explicit.
_SUNSET = """case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then null
  when o_orderpriority = '5-LOW' then '' when o_orderpriority = '4-NOT SPECIFIED' then {month}
  else {day} end"""
_SEVERITY = "case when o_orderpriority = '1-URGENT' then 'high' when o_orderpriority < '4' then 'medium' else 'low' end"
_STATUS = "case when o_totalprice < 20000 then 'scheduled' when o_totalprice > 480000 then 'retired' end"


def _facts(spark, folder):
    sunset = _SUNSET.format(
        day="date_format(o_orderdate, 'yyyy-MM-dd')", month="date_format(o_orderdate, 'yyyy-MM')"
    )
    columns = (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    return spread_table(spark, folder, "orders", *columns).selectExpr(
        "o_orderkey", "concat('c', o_custkey) as repo", f"{_SEVERITY} as severity",
        f"{_STATUS} as status", f"nullif({sunset}, '') as sunset_date",
        "o_orderstatus = 'F' as test_only", "o_orderpriority = '3-MEDIUM' as mention_only",
    )


_FACTS = f"""
facts AS (SELECT o_orderkey, concat('c', o_custkey) AS repo, {_SEVERITY} AS severity, {_STATUS} AS status,
  nullif({_SUNSET.format(day="strftime(o_orderdate, '%Y-%m-%d')", month="strftime(o_orderdate, '%Y-%m')")}, '') AS sunset_date,
  o_orderstatus = 'F' AS test_only, o_orderpriority = '3-MEDIUM' AS mention_only FROM orders),
dated AS (SELECT *, CAST(CASE WHEN length(sunset_date) = 7 THEN sunset_date || '-01' ELSE sunset_date END AS DATE) AS day FROM facts),
urgent AS (SELECT *, CAST(day - DATE '{NOW}' AS INTEGER) AS days_until,
  coalesce(status, CASE WHEN day IS NULL THEN 'deprecated' WHEN day < DATE '{NOW}' THEN 'retired' ELSE 'scheduled' END) AS effective_status,
  CASE WHEN test_only OR mention_only THEN 'low' ELSE severity END AS effective_severity FROM dated)
"""


def status_days(spark, folder):
    status, sunset = F.col("status"), F.col("sunset_date")
    return _facts(spark, folder).select(
        "o_orderkey", lifecycle.effective_status(status, sunset, NOW).alias("effective_status"),
        lifecycle.days_until(sunset, NOW).alias("days_until"),
    )


def gate(spark, folder):
    """Per customer: how many findings trip the gate, plain and with retired ones counted."""
    plain = with_urgency(_facts(spark, folder), NOW, within=90)
    strict = lifecycle.actionable(
        F.col("severity"), F.col("status"), F.col("sunset_date"), NOW, 90, fail_on_retired=True
    )
    weak = F.col("test_only") | F.col("mention_only")
    return plain.groupBy("repo").agg(
        F.count_if("trips_gate").alias("tripped"),
        F.count_if(strict & ~weak).alias("tripped_strict"),
        F.max(F.col("trips_gate").cast("int")).alias("verdict"),
    )


_TRIPS = """NOT test_only AND NOT mention_only AND CASE WHEN severity = 'high' THEN {high}
  ELSE effective_status = 'scheduled' AND coalesce(days_until BETWEEN 0 AND {within}, false) END"""


def gate_replay(spark, folder):
    seen = replay_gate(_facts(spark, folder), ["1997-06-01", NOW, "1998-03-15"])
    return seen.groupBy("as_of").agg(
        F.count_if("trips_gate").alias("tripped"),
        F.count_if(F.col("effective_status") == "retired").alias("retired"),
    )


_REPLAY_SQL = """
days(as_of) AS (VALUES (DATE '1997-06-01'), (DATE '1998-01-01'), (DATE '1998-03-15')),
seen AS (SELECT * EXCLUDE (days_until, effective_status), CAST(day - as_of AS INTEGER) AS days_until,
  coalesce(status, CASE WHEN day IS NULL THEN 'deprecated' WHEN day < as_of THEN 'retired' ELSE 'scheduled' END) AS effective_status
  FROM urgent CROSS JOIN days)
SELECT as_of, count(*) FILTER (""" + _TRIPS.format(high="effective_status <> 'retired'", within=30) + """) AS tripped,
  count(*) FILTER (effective_status = 'retired') AS retired FROM seen GROUP BY as_of"""


def _stored_changes(spark, folder):
    path = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    write_changes(change_points(_facts(spark, folder).withColumn("finding", F.col("o_orderkey"))), path)
    return path


def gate_by_changes(spark, folder):
    """The same three days from stored change points: each finding's last one up to the day."""
    path, days = _stored_changes(spark, folder), ["1997-06-01", NOW, "1998-03-15"]
    seen = [state_on(read_changes(spark, path, upto=d), d, ["finding"]).withColumn("as_of", F.lit(d).cast("date")) for d in days]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("as_of").agg(
        F.count_if("trips_gate").alias("tripped"), F.count_if(F.col("effective_status") == "retired").alias("retired")
    )


def gate_daily(spark, folder):
    """Two years day by day: running sums over what changes on each day."""
    daily = daily_changes(read_changes(spark, _stored_changes(spark, folder)))
    days = spark.range(731).select(F.date_add(F.lit("1996-12-01").cast("date"), F.col("id").cast("int")).alias("as_of"))
    return gate_series(daily, days)


_DAILY_SQL = """
days AS (SELECT CAST(unnest(generate_series(DATE '1996-12-01', DATE '1996-12-01' + 730, INTERVAL 1 DAY)) AS DATE) AS as_of),
seen AS (SELECT * EXCLUDE (days_until, effective_status), CAST(day - as_of AS INTEGER) AS days_until,
  coalesce(status, CASE WHEN day IS NULL THEN 'deprecated' WHEN day < as_of THEN 'retired' ELSE 'scheduled' END) AS effective_status
  FROM urgent CROSS JOIN days)
SELECT as_of, count(*) FILTER (""" + _TRIPS.format(high="effective_status <> 'retired'", within=30) + """) AS tripped,
  count(*) FILTER (effective_status = 'retired') AS retired, count(*) FILTER (effective_status = 'scheduled') AS scheduled FROM seen GROUP BY as_of"""


def finding_order(spark, folder):
    """One finding per customer and (severity, sunset month), as a registry would bound it."""
    level = effective_severity(F.col("severity"), F.col("test_only"), F.col("mention_only"))
    found = _facts(spark, folder).groupBy(
        "repo", level.alias("effective_severity"), F.substring("sunset_date", 1, 7).alias("sunset_date")
    ).agg(F.min("o_orderkey").alias("entry_ord"), F.count(F.lit(1)).alias("n"))
    return rank_findings(found).select(
        "repo", "effective_severity", "sunset_date", "n",
        F.col("finding_rank").cast("bigint").alias("finding_rank"),
    )


_ORDER_SQL = """
found AS (SELECT repo, effective_severity, substring(sunset_date, 1, 7) AS sunset_date,
  min(o_orderkey) AS entry_ord, count(*) AS n FROM urgent GROUP BY 1, 2, 3)
SELECT repo, effective_severity, sunset_date, n, row_number() OVER (PARTITION BY repo ORDER BY
  CASE effective_severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
  coalesce(sunset_date, '9999-12-31'), entry_ord) AS finding_rank FROM found"""


def status_phrases(spark, folder):
    status, sunset = F.col("status"), F.col("sunset_date")
    return _facts(spark, folder).select(
        "o_orderkey", phrases.status_phrase(status, sunset, NOW).alias("phrase"),
        phrases.reference_phrase(
            F.col("severity") == "low", F.col("test_only"), F.col("mention_only")
        ).alias("reference"),
    )


_PHRASE_SQL = """SELECT o_orderkey, CASE
  WHEN effective_status = 'deprecated' OR days_until IS NULL
    THEN 'deprecated · no removal date announced — migrate before it''s pulled'
  WHEN effective_status = 'retired' THEN concat('retired ', sunset_date, ' (', abs(days_until),
    CASE WHEN abs(days_until) = 1 THEN ' day ago)' ELSE ' days ago)' END)
  WHEN days_until <= 0 THEN concat('sunsets ', sunset_date, ' (today)')
  ELSE concat('sunsets ', sunset_date, ' (in ', days_until, CASE WHEN days_until = 1 THEN ' day)' ELSE ' days)' END) END AS phrase,
  concat(CASE WHEN test_only THEN 'test code ' ELSE '' END, 'references a deprecated ',
    CASE WHEN severity = 'low' THEN 'model' ELSE 'API' END,
    CASE WHEN mention_only AND NOT test_only THEN ' · no matching SDK import (informational)' ELSE '' END) AS reference
FROM urgent"""

_CLOCK = "2024-01-15 12:00:00"


def freshness(spark, folder):
    """Each event as a registry fetch, seen from one fixed moment."""
    now = F.lit(_CLOCK).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    origin = F.when(F.col("event_type") == "click", "custom").when(
        F.col("event_type") == "view", "bundled"
    ).otherwise("cache")
    fetched = F.when(F.col("event_type") != "error", ts)
    return table(spark, folder, "events").select(
        "event_id", lifecycle.is_fresh(ts, now).alias("fresh"),
        phrases.provenance_phrase(origin, F.col("props"), fetched, now).alias("phrase"),
    )


_FRESH_SQL = f"""
WITH aged AS (SELECT *, epoch_us(TIMESTAMP '{_CLOCK}') - epoch_us(ts) AS us FROM events),
days AS (SELECT *, us // 86400000000 AS d FROM aged)
SELECT event_id, us >= 0 AND us < 86400000000 AS fresh, CASE event_type
  WHEN 'click' THEN concat('dataset: custom (', props, ')') WHEN 'view' THEN 'dataset: bundled'
  WHEN 'error' THEN 'dataset: updated (age unknown)'
  ELSE concat('dataset: ', CASE WHEN us < 0 THEN 'updated recently' WHEN d = 0 THEN 'updated today'
    WHEN d = 1 THEN 'updated 1 day ago' ELSE concat('updated ', d, ' days ago') END) END AS phrase FROM days"""


def _calendar_facts(spark, folder):
    found = _facts(spark, folder).withColumn("id", F.concat_ws("-", "severity", "status"))
    return found.withColumns({
        "vendor": F.coalesce("status", F.lit("none")),
        "effective_severity": effective_severity(
            F.col("severity"), F.col("test_only"), F.col("mention_only")
        ),
    })


def calendar(spark, folder):
    return sunset_calendar(_calendar_facts(spark, folder), NOW)


def calendar_rollup(spark, folder):
    return sunset_rollup(_calendar_facts(spark, folder), NOW)


_CALENDAR_SQL = """
named AS (SELECT *, concat_ws('-', severity, status) AS id FROM urgent WHERE days_until >= 0)
SELECT day AS sunset_day, count(DISTINCT repo) AS repos, count(DISTINCT (repo, id)) AS findings,
  count(DISTINCT id) AS entries, min(days_until) AS days_left FROM named GROUP BY day"""
_ROLLUP_SQL = """
named AS (SELECT coalesce(status, 'none') AS vendor, effective_severity, sunset_date FROM urgent WHERE days_until >= 0)
SELECT vendor, effective_severity, count(*) AS findings, min(sunset_date) AS next_sunset
FROM named GROUP BY ROLLUP (vendor, effective_severity)"""

QUERIES = {
    "status_days": (
        status_days, with_ctes(_FACTS, "SELECT o_orderkey, effective_status, days_until FROM urgent")
    ),
    "gate": (
        gate,
        with_ctes(_FACTS, f"""trips AS (SELECT repo,
  {_TRIPS.format(high="effective_status <> 'retired'", within=90)} AS t,
  {_TRIPS.format(high="true", within=90)} AS strict FROM urgent)
SELECT repo, count(*) FILTER (t) AS tripped, count(*) FILTER (strict) AS tripped_strict,
  max(CAST(t AS INTEGER)) AS verdict FROM trips GROUP BY repo"""),
    ),
    "gate_replay": (gate_replay, with_ctes(_FACTS, _REPLAY_SQL)),
    "gate_by_changes": (gate_by_changes, with_ctes(_FACTS, _REPLAY_SQL)),
    "gate_daily": (gate_daily, with_ctes(_FACTS, _DAILY_SQL)),
    "finding_order": (finding_order, with_ctes(_FACTS, _ORDER_SQL)),
    "status_phrase": (status_phrases, with_ctes(_FACTS, _PHRASE_SQL)),
    "freshness": (freshness, _FRESH_SQL),
    "sunset_calendar": (calendar, with_ctes(_FACTS, _CALENDAR_SQL)),
    "sunset_rollup": (calendar_rollup, with_ctes(_FACTS, _ROLLUP_SQL)),
}
