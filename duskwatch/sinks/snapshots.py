"""Versioned registry snapshots: validated before they are written, never overwritten."""

from __future__ import annotations

import datetime as dt
import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.sources.registry import RegistryError, read_entries, validate_entries

META = "version int, path string, url string, entries long, fetched_at timestamp"


def _meta(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(META).option("recursiveFileLookup", "true").parquet(f"{root}/meta")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def newest_snapshot(spark: SparkSession, root: str) -> dict | None:
    """The last snapshot that was completely written, as a dict of its meta row."""
    meta = _meta(spark, root)
    row = meta.agg(F.max_by(F.struct("*"), "version").alias("m")).first() if meta else None
    return row.m.asDict() if row and row.m else None


def write_snapshot(
    spark: SparkSession, root: str, candidate: DataFrame, url: str, fetched_at: dt.datetime
) -> dict:
    """Store the raw entries of ``candidate(entry variant, entry_ord)`` as the next version.

    Without one valid entry nothing is written. The entries go into a folder of their own, then the number is
    claimed by a file that only one writer can make, and the meta row comes last: a reader never meets
    a half-written version, and of two writers at once each gets a version.
    """
    valid = validate_entries(candidate).count()
    if valid == 0:
        raise RegistryError(f"the registry at {url} contains no valid entries")
    path = f"{root}/entries/{uuid4().hex}"
    candidate.select(F.to_json("entry").alias("text"), "entry_ord").write.parquet(path)
    before = newest_snapshot(spark, root)
    version = before["version"] + 1 if before else 1
    while not _claimed(spark, f"{root}/claims", version):
        version += 1
    row = (version, path, url, valid, fetched_at)
    spark.createDataFrame([row], META).coalesce(1).write.parquet(f"{root}/meta/{version}")
    return dict(zip(("version", "path", "url", "entries", "fetched_at"), row))


def _claimed(spark: SparkSession, folder: str, version: int) -> bool:
    """Whether this writer is the one who made the file that stands for a version."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{folder}/{version}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(folder))
    if files.getUri().getScheme() == "file":  # where Hadoop's own check and creation are two steps
        try:
            os.close(os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    if files.exists(where):
        return False
    try:
        files.create(where, False).close()
        return True
    except Exception:
        if files.exists(where):
            return False
        raise


def refresh(
    spark: SparkSession, root: str, source: str, now: dt.datetime, ttl_seconds: int | None = None
) -> dict:
    """Take over a new registry file unless the newest snapshot is still fresh. Never raises."""
    from duskwatch.fixed import SNAPSHOT_TTL_SECONDS

    ttl = SNAPSHOT_TTL_SECONDS if ttl_seconds is None else ttl_seconds
    try:
        newest = newest_snapshot(spark, root)
        if newest and newest["fetched_at"]:
            age = (now - newest["fetched_at"]).total_seconds()
            if 0 <= age < ttl:
                return {"refreshed": False, "reason": "fresh"}
        write_snapshot(spark, root, read_entries(spark, source), source, now)
        return {"refreshed": True, "reason": "refreshed"}
    except Exception as error:
        return {"refreshed": False, "reason": "error", "detail": str(error).splitlines()[0]}


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    row = _meta(spark, root).filter(F.col("version") == version).first()
    stored = spark.read.parquet(row["path"])
    return validate_entries(
        stored.select(F.parse_json("text").alias("entry"), F.col("entry_ord").cast("bigint"))
    )
