"""Scan reports as append-only tables, keyed by the stream and batch that wrote them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.plans.joins import as_constants, fits_broadcast

REPORTS = (
    "repo string, report_id string, reported_at timestamp, version string, scanned_files long, detected long, "
    "stream string, batch long"
)
INVENTORY = (
    "repo string, report_id string, reported_at timestamp, manifest string, name string, "
    "version string, stream string, batch long"
)
FINDINGS = (
    "repo string, report_id string, reported_at timestamp, id string, severity string, base_severity string, status string, "
    "sunset_date string, test_only boolean, mention_only boolean, stream string, batch long"
)
EVIDENCE = (
    "repo string, report_id string, reported_at timestamp, id string, file string, line int, text string, mention boolean, "
    "stream string, batch long"
)
CHANGES = (
    "repo string, report_id string, reported_at timestamp, manifest string, name string, version string, change string, "
    "stream string, batch long"
)
SEEN = "id string, stream string, batch long"
SENT = "repo string, id string, stream string, batch long"
SCHEMAS = {
    "reports": REPORTS, "inventory": INVENTORY, "findings": FINDINGS, "evidence": EVIDENCE, "changes": CHANGES, "seen": SEEN,
    "notifications": SENT,
}

# One uploaded report: a scan's payload with its repository, tool version and time.
REPORT_SCHEMA = (
    "repo string, cliVersion string, reportedAt string, scannedFiles long, detected long, "
    "inventory struct<dependencies:array<struct<name:string,version:string,manifest:string>>>, "
    "findings array<struct<id:string,severity:string,baseSeverity:string,status:string,sunset_date:string,testOnly:boolean,"
    "mentionOnly:boolean,patternMatches:array<struct<file:string,line:int,text:string,mention:boolean>>>>"
)


class Batch(NamedTuple):
    """Which delivery writes: numbers of one stream say nothing about those of another."""

    stream: str
    number: int


def current(spark: SparkSession, number: int) -> Batch:
    """The batch a ``foreachBatch`` call handles; a stream with a new checkpoint is a new stream."""
    return Batch(spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct", number)


def write_batch(df: DataFrame, root: str, table: str, batch: Batch) -> None:
    """Write one batch into its own folder; writing it again replaces it, so retries are safe."""
    df.write.mode("overwrite").parquet(f"{root}/{table}/stream={batch.stream}/batch={batch.number}")


def read_table(
    spark: SparkSession, root: str, table: str, ahead_of: Batch | None = None, schema: str | None = None
) -> DataFrame:
    """All batches, or all but one and what its stream wrote after it; a table nobody wrote yet is empty."""
    schema = schema or SCHEMAS[table]
    try:
        rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    if ahead_of is None:
        return rows
    return rows.filter((F.col("stream") != ahead_of.stream) | (F.col("batch") < ahead_of.number))


def report_id(repo, reported_at):
    """A repository and the time it names are a report."""
    return F.sha2(F.concat_ws("\x1f", repo, reported_at), 256)


def report_rows(uploads: DataFrame) -> dict[str, DataFrame]:
    """Uploads in :data:`REPORT_SCHEMA` as rows of the tables reports, inventory, findings and evidence.

    Uploads of an older tool, without a column of findings, give no rows of them and no table.
    """
    told = uploads.withColumns({"report_id": report_id("repo", "reportedAt"), "reported_at": F.try_to_timestamp("reportedAt")})
    key = ("repo", "report_id", "reported_at")
    tables = {
        "reports": told.select(*key, F.col("cliVersion").alias("version"), F.col("scannedFiles").alias("scanned_files"), "detected"),
        "inventory": told.select(*key, F.explode("inventory.dependencies").alias("d")).select(*key, "d.manifest", "d.name", "d.version"),
    }
    if "findings" not in uploads.columns:
        return tables
    found = told.select(*key, F.explode("findings").alias("f"))
    return {
        **tables,
        "findings": found.select(
            *key, "f.id", "f.severity", F.col("f.baseSeverity").alias("base_severity"), "f.status", "f.sunset_date",
            F.col("f.testOnly").alias("test_only"), F.col("f.mentionOnly").alias("mention_only"),
        ),
        "evidence": found.select(*key, "f.id", F.explode("f.patternMatches").alias("m")).select(*key, "id", "m.file", "m.line", "m.text", "m.mention"),
    }


def scan_rows(result, reported_at: str, version: str) -> dict[str, DataFrame]:
    """A scan's result as rows of the same tables, whatever the size of its repositories: one report a repository."""
    at = F.lit(reported_at)

    def keyed(df: DataFrame, *columns) -> DataFrame:
        return df.select("repo", report_id("repo", at).alias("report_id"), at.cast("timestamp").alias("reported_at"), *columns)

    return {
        "reports": keyed(result.summary, F.lit(version).alias("version"), "scanned_files", "detected"),
        "inventory": keyed(result.dependencies, "manifest", "name", "version"),
        "findings": keyed(
            result.findings, "id", F.col("effective_severity").alias("severity"), F.col("severity").alias("base_severity"),
            F.col("effective_status").alias("status"), "sunset_date", "test_only", "mention_only",
        ),
        "evidence": keyed(result.hits, "id", "file", "line", "text", "mention"),
    }


def _one_of_each(uploads: DataFrame) -> DataFrame:
    """One upload per repository and time. Where few are repeated, only these move; the others stay where they were read."""
    key = ("repo", "reportedAt")
    rest = F.struct(*[c for c in uploads.columns if c not in key])

    def first(rows: DataFrame) -> DataFrame:
        u = F.min_by(rest, F.to_json(rest, {"ignoreNullFields": "false"})).alias("u")
        return rows.groupBy(*key).agg(u).select(*key, "u.*")

    repeated = uploads.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key).persist()
    try:
        if not fits_broadcast(repeated):
            return first(uploads)
        known = F.broadcast(as_constants(repeated).toDF("_repo", "_at"))
    finally:
        repeated.unpersist()
    same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("reportedAt").eqNullSafe(F.col("_at"))
    several = first(uploads.join(known, same, "left_semi"))
    return uploads.join(known, same, "left_anti").select(several.columns).unionByName(several)


def append_reports(uploads: DataFrame, root: str, batch: Batch) -> None:
    """Store a batch of uploads. A report delivered twice, in one batch or in two, counts once.

    Of different uploads under one repository and time, the one that comes first as JSON is taken, report
    and inventory from the same.
    """
    once = _one_of_each(uploads)
    once = once.persist()
    try:
        store_reports(report_rows(once), root, batch)
    finally:
        once.unpersist()


def store_reports(tables: dict[str, DataFrame], root: str, batch: Batch) -> None:
    """Append rows of reports to their tables, leaving out reports that are there, and bring the states up to date.

    Only the buckets of state that hold this batch's reports, repositories and packages are read, not the tables' history.
    The states come last and are replaced with their batch: a retry repeats the same result.
    """
    from duskwatch.operators.inventory import latest_reports, package_changes, package_rows
    from duskwatch.streaming.state import known_reports, latest_per_repo, repos_per_package

    spark = tables["reports"].sparkSession
    known = known_reports(spark, root)
    ids = tables["reports"].select("report_id")
    old = known.read(ids, ahead_of=batch)
    for name, rows in tables.items():
        write_batch(rows.join(old, "report_id", "left_anti"), root, name, batch)
    fresh = {name: read_batch(spark, root, name, batch) for name in ("reports", "inventory")}
    latest = latest_per_repo(spark, root)
    before = latest.read(fresh["reports"].select("repo"), ahead_of=batch)
    newest = latest_reports(fresh["reports"])
    packages = F.sort_array(F.collect_list(F.struct("manifest", "name", "version")))
    declared = fresh["inventory"].join(newest, ["repo", "report_id"], "left_semi").groupBy("repo").agg(packages.alias("packages"))
    newest = newest.join(declared, "repo", "left").select(
        "repo", "report_id", "reported_at", F.coalesce("packages", F.array().cast(declared.schema["packages"].dataType)).alias("packages")
    ).persist()
    try:
        write_batch(package_changes(before, newest), root, "changes", batch)
        repos_per_package(spark, root).write(package_rows(before, newest), batch)
        latest.write(newest, batch)
    finally:
        newest.unpersist()
    known.write(ids, batch)


def read_batch(spark: SparkSession, root: str, table: str, batch: Batch) -> DataFrame:
    schema = ", ".join(part for part in SCHEMAS[table].split(", ") if part not in ("stream string", "batch long"))
    return spark.read.schema(schema).parquet(f"{root}/{table}/stream={batch.stream}/batch={batch.number}")


def append_first(rows: DataFrame, root: str, table: str, keys: list[str], batch: Batch) -> None:
    """Store the rows whose key no earlier batch of any stream stored, one per key: at most once, for ever.

    Which keys there are is state in buckets: a batch reads those of its own keys.
    """
    from duskwatch.streaming.state import State, first_of_key

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    stored = State(rows.sparkSession, root, table, schema, tuple(keys), first_of_key(*keys))
    once = rows.dropDuplicates(keys)
    known = stored.read(once.select(*keys), ahead_of=batch)
    write_batch(once.join(known, keys, "left_anti"), root, table, batch)
    stored.write(once.select(*keys), batch)
