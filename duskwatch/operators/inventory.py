"""Monitoring in batch: latest inventories, new entries, notifications, the sunset calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.lifecycle import day, days_until, parse_day
from duskwatch.functions.versions import manifest_compatible, normalize_name
from duskwatch.operators.dependencies import registry_packages
from duskwatch.plans.joins import fits_broadcast, salted_join, sized


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest ``(repo, report_id, reported_at)`` per repository; ties go to the larger id."""
    newest = reports.groupBy("repo").agg(F.max(F.struct("reported_at", "report_id")).alias("m"))
    return newest.select("repo", "m.report_id", "m.reported_at")


def latest_inventory(inventory: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows of each repository's newest report; an empty newest report leaves nothing."""
    newest = latest_reports(reports).select("repo", "report_id")
    return inventory.join(newest, ["repo", "report_id"], "left_semi")  # a report is no hot key


def latest_findings(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Findings of each repository's newest report."""
    return latest_inventory(findings, reports)


# --- kept up to date, report by report --------------------------------------------------------


def _renewed(before: DataFrame, newest: DataFrame) -> DataFrame:
    """Repositories whose newest report is newer than the one known, with the packages of both."""
    old = before.select("repo", F.struct("reported_at", "report_id").alias("old"), F.col("packages").alias("held"))
    none = F.array().cast(newest.schema["packages"].dataType)
    joined = newest.join(old, "repo", "left").withColumn("held", F.coalesce("held", none))
    return joined.filter(F.col("old").isNull() | (F.struct("reported_at", "report_id") > F.col("old")))


def package_changes(before: DataFrame, newest: DataFrame) -> DataFrame:
    """What a repository's newer report adds and removes: rows (repo, report, manifest, name, version, change)."""
    changed = _renewed(before, newest)
    part = lambda of, other, name: changed.select(
        "repo", "report_id", "reported_at", F.explode(F.array_except(of, other)).alias("p"), F.lit(name).alias("change")
    )
    both = part("packages", "held", "added").unionByName(part("held", "packages", "removed"))
    return both.select("repo", "report_id", "reported_at", "p.manifest", "p.name", "p.version", "change")


def package_rows(before: DataFrame, newest: DataFrame) -> DataFrame:
    """Rows for the state by package: all that a newer report declares, and what it does not declare any more."""
    key = lambda packages: F.transform(
        packages, lambda p: F.struct(normalize_name(p["name"]).alias("norm"), p["manifest"].alias("manifest"))
    )
    changed = _renewed(before, newest).withColumn("now", key(F.col("packages"))).withColumn("then", key(F.col("held")))
    part = lambda of, present: changed.select(
        "repo", "report_id", "reported_at", F.explode(of).alias("k"), F.lit(present).alias("present")
    )
    rows = part(F.array_distinct("now"), True).unionByName(part(F.array_except("then", "now"), False))
    return rows.select("k.norm", "k.manifest", "repo", "present", "reported_at", "report_id").filter("norm is not null")


def current_inventory(spark, root: str) -> DataFrame:
    """Every repository's latest inventory as it is kept, without a look at the log of reports."""
    from duskwatch.streaming.state import latest_per_repo

    return latest_per_repo(spark, root).read().select("repo", "report_id", "reported_at", F.inline("packages"))


def inventory_of_packages(spark, root: str, names: DataFrame) -> DataFrame:
    """The latest declarations of the packages ``names(norm)``: rows (repo, manifest, name).

    Reads the buckets of these packages, then those of the repositories found, whose newest
    report decides; not the inventories of the fleet.
    """
    from duskwatch.streaming.state import latest_per_repo, repos_per_package

    found = repos_per_package(spark, root).read(names).join(names.distinct(), "norm").filter("present").select("repo").distinct()
    found = found.persist()
    try:
        held = latest_per_repo(spark, root).read(found)
    finally:
        found.unpersist()
    rows = held.select("repo", F.inline("packages")).withColumn("norm", normalize_name(F.col("name")))
    return salted_join(rows, names.distinct(), ["norm"], "left_semi", spread=["repo"]).select("repo", "manifest", "name")


def new_entries(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries whose id nobody saw before; an edit to a known id is nothing new."""
    return registry.join(sized(seen.select("id")), "id", "left_anti")


def affected_repos(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(repo, id)`` pairs whose inventory holds a package the entry names."""
    packages = registry_packages(entries).select("id", "norm", "applies_to").distinct()
    declared = inventory.select("repo", "manifest", normalize_name(F.col("name")).alias("norm"))
    if fits_broadcast(packages):  # the few rows that meet a package go on; the fleet is not shuffled
        met = declared.join(F.broadcast(packages), "norm")
    else:
        met = salted_join(declared, packages, ["norm"], "inner", spread=["repo", "manifest"], large=True)
    fits = manifest_compatible(F.col("manifest"), F.col("applies_to"))
    return met.filter(fits).select("repo", "id").distinct()


def notifications(
    registry: DataFrame, seen: DataFrame, inventory: DataFrame, sent: DataFrame
) -> DataFrame:
    """Pairs to notify now: new entry, present in the latest inventory, never sent before."""
    pairs = affected_repos(new_entries(registry, seen), inventory)
    return pairs.join(sent.select("repo", "id"), ["repo", "id"], "left_anti")


def sunset_calendar(findings: DataFrame, now) -> DataFrame:
    """Upcoming dates across the fleet: repositories and entries touched per day."""
    sunset = F.col("sunset_date")
    dated = findings.select(parse_day(sunset).alias("sunset_day"), "repo", "id")
    upcoming = dated.filter(F.col("sunset_day") >= day(now))
    # Per day and repository, then per day; per day and entry, then per day: no row is copied for a distinct count.
    per_id = upcoming.groupBy("sunset_day", "id").agg(F.lit(1)).groupBy("sunset_day").agg(F.count(F.lit(1)).alias("entries"))
    per_repo = (
        upcoming.distinct().groupBy("sunset_day", "repo").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("sunset_day").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("findings"))
    )
    per_day = per_repo.join(per_id, "sunset_day").select("sunset_day", "repos", "findings", "entries")
    return per_day.withColumn("days_left", F.datediff("sunset_day", day(now)))


def sunset_rollup(findings: DataFrame, now) -> DataFrame:
    """Upcoming findings by vendor and severity, with subtotals."""
    upcoming = findings.filter(days_until(F.col("sunset_date"), now) >= 0)
    return upcoming.rollup("vendor", "effective_severity").agg(
        F.count(F.lit(1)).alias("findings"),
        F.min("sunset_date").alias("next_sunset"),
    )
