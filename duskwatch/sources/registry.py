"""The registry of deprecations: read, validate, resolve."""

from __future__ import annotations

import datetime as dt
import json
import pathlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.fixed import CONFIDENCES, MATCH_MODES, SEVERITIES, STATUSES
from duskwatch.sources.documents import BrokenDocument, MissingArray, elements_of

BUNDLED = str(pathlib.Path(__file__).resolve().parents[1] / "data" / "registry.json")

#: Documents up to this size are parsed as one value; a value cannot hold much more than 16 MB.
WHOLE_DOCUMENT_BYTES = 4 * 1024 * 1024

DETECT = "struct<sdk:array<string>,patterns:array<string>,models:array<string>>"
REGISTRY_SCHEMA = (
    "id string, vendor string, title string, severity string, match string, status string, "
    "applies_to array<string>, sunset_date string, announced_date string, source string, "
    f"confidence string, detect {DETECT}, version_range string, migration_url string, "
    "summary string, entry_ord bigint"
)


class RegistryError(ValueError):
    """The registry text as a whole cannot be used."""


# --- SRC-2: validation --------------------------------------------------------------


def _kind(entry: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(entry, path, "variant"))


def _text(entry: Column, path: str) -> Column:
    """The value when it is a JSON string, else null: numbers are not read as text."""
    return F.when(_kind(entry, path) == "STRING", F.try_variant_get(entry, path, "string"))


def _filled(entry: Column, path: str) -> Column:
    return F.nullif(_text(entry, path), F.lit(""))


def _one_of(entry: Column, path: str, allowed: tuple[str, ...]) -> Column:
    text = _text(entry, path)
    return F.when(text.isin(*allowed), text)


def _texts(entry: Column, path: str) -> Column:
    """An array made of strings only, else the empty array."""
    items = F.try_variant_get(entry, path, "array<variant>")
    all_text = F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    texts = F.try_variant_get(entry, path, "array<string>")
    return F.when(F.coalesce(all_text, F.lit(False)), texts).otherwise(
        F.array().cast("array<string>")
    )


def coerce_entries(raw: DataFrame) -> DataFrame:
    """``raw(entry variant, entry_ord)`` with every registry column plus ``valid``.

    Unknown match modes are invalid, not defaulted: an entry written for newer semantics must not
    run under the wrong ones. Entries that can never fire are invalid too.
    """
    e = F.col("entry")
    mode = _kind(e, "$.match")
    match = F.when(mode.isNull() | (mode == "VOID"), "pattern").otherwise(
        _one_of(e, "$.match", MATCH_MODES)
    )
    scopes = F.transform(
        _texts(e, "$.applies_to"), lambda x: F.regexp_replace(F.lower(x), r"^\.", "")
    )
    sdk, patterns, models = (_texts(e, f"$.detect.{k}") for k in ("sdk", "patterns", "models"))
    columns = raw.select(
        "entry_ord",
        _filled(e, "$.id").alias("id"),
        _filled(e, "$.vendor").alias("vendor"),
        _filled(e, "$.title").alias("title"),
        _one_of(e, "$.severity", SEVERITIES).alias("severity"),
        match.alias("match"),
        _one_of(e, "$.status", STATUSES).alias("status"),
        F.when(F.size(scopes) > 0, scopes).otherwise(F.array(F.lit("*"))).alias("applies_to"),
        _filled(e, "$.sunset_date").alias("sunset_date"),
        _filled(e, "$.announced_date").alias("announced_date"),
        F.coalesce(_text(e, "$.source"), F.lit("")).alias("source"),
        _one_of(e, "$.confidence", CONFIDENCES).alias("confidence"),
        F.struct(sdk.alias("sdk"), patterns.alias("patterns"), models.alias("models")).alias("detect"),
        _filled(e, "$.version_range").alias("version_range"),
        F.coalesce(_text(e, "$.migration_url"), F.lit("")).alias("migration_url"),
        F.coalesce(_text(e, "$.summary"), F.lit("")).alias("summary"),
    )
    named = F.col("id").isNotNull() & F.col("vendor").isNotNull() & F.col("title").isNotNull()
    known = F.col("severity").isNotNull() & F.col("match").isNotNull()
    has_regex = (F.size("detect.patterns") > 0) | (F.size("detect.models") > 0)
    can_fire = F.when(F.col("match") == "pattern", has_regex).otherwise(F.size("detect.sdk") > 0)
    return columns.withColumn("valid", F.coalesce(named & known & can_fire, F.lit(False)))


def validate_entries(raw: DataFrame) -> DataFrame:
    """The usable entries of ``raw``, in the registry schema."""
    names = [part.strip().split(" ")[0] for part in _schema_fields()]
    return coerce_entries(raw).filter("valid").select(*names)


def _schema_fields() -> list[str]:
    fields, depth, start = [], 0, 0
    for at, char in enumerate(REGISTRY_SCHEMA + ","):
        depth += {"<": 1, ">": -1}.get(char, 0)
        if char == "," and depth == 0:
            fields.append(REGISTRY_SCHEMA[start:at])
            start = at + 1
    return fields


# --- SRC-1: reading ------------------------------------------------------------------


def entries_of_json(df: DataFrame, text: str, order: str) -> DataFrame:
    """A table with one JSON entry per row as ``raw(entry, entry_ord)``: scales with the table."""
    return df.select(
        F.try_parse_json(F.col(text)).alias("entry"), F.col(order).cast("bigint").alias("entry_ord")
    )


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """One registry document: an object with ``deprecations``, or a bare array of entries.

    A document beyond ``WHOLE_DOCUMENT_BYTES`` is cut into its entries by many tasks.
    """
    entries = F.coalesce(
        F.try_variant_get("doc", "$", "array<variant>"),
        F.try_variant_get("doc", "$.deprecations", "array<variant>"),
    )
    try:
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
        if largest is not None and largest > WHOLE_DOCUMENT_BYTES:
            return elements_of(spark, path, "deprecations")
        document = spark.read.text(path, wholetext=True).select(
            F.try_parse_json("value").alias("doc")
        )
        found = document.select(F.col("doc").isNull().alias("broken"), entries.alias("entries"))
        states = found.select("broken", F.col("entries").isNull().alias("missing")).take(1)
    except PySparkException as error:
        raise RegistryError(f"could not read the registry at {path}") from error
    except BrokenDocument as error:
        raise RegistryError(f"the registry is not valid JSON: {path}") from error
    except MissingArray as error:
        raise RegistryError(f'the registry must contain a "deprecations" array: {path}') from error
    if not states or states[0].broken:
        raise RegistryError(f"the registry is not valid JSON: {path}")
    if states[0].missing:
        raise RegistryError(f'the registry must contain a "deprecations" array: {path}')
    entries = found.select(F.posexplode("entries").alias("entry_ord", "entry"))
    return entries.withColumn("entry_ord", F.col("entry_ord").cast("bigint"))


def pinned(registry: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A registry of ordinary size, validated once and kept in the plan with its exact size; a
    larger one stays as it is."""
    rows = registry.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return registry
    return registry.sparkSession.createDataFrame(rows, schema=registry.schema)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return pinned(validate_entries(read_entries(spark, path)))


def registry_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A registry written in Python, validated like any other."""
    texts = spark.createDataFrame(pa.table({
        "entry_ord": pa.array(range(len(rows)), pa.int64()),
        "text": pa.array([json.dumps(row) for row in rows], pa.string()),
    }))
    return pinned(validate_entries(entries_of_json(texts, "text", "entry_ord")))


# --- SRC-3: resolution ----------------------------------------------------------------


@dataclass(frozen=True)
class LoadedRegistry:
    entries: DataFrame
    origin: str  # custom, cache or bundled
    path: str
    fetched_at: dt.datetime | None = None
    warning: str | None = None


def load_registry(
    spark: SparkSession, custom: str | None = None, snapshots: str | None = None,
    bundled: str = BUNDLED,
) -> LoadedRegistry:
    """The caller's file, else the newest snapshot, else the bundled registry.

    A broken custom file is an error; a broken snapshot only costs a warning.
    """
    from duskwatch.sinks.snapshots import newest_snapshot, read_snapshot

    if custom:
        return LoadedRegistry(read_registry(spark, custom), "custom", custom)
    warning = None
    try:
        meta = newest_snapshot(spark, snapshots) if snapshots else None
        if meta:
            entries = read_snapshot(spark, snapshots, meta["version"])
            return LoadedRegistry(entries, "cache", meta["path"], meta["fetched_at"])
    except Exception as error:
        reason = str(error).splitlines()[0]
        warning = f"the cached registry was invalid ({reason}); used the bundled one"
    return LoadedRegistry(read_registry(spark, bundled), "bundled", bundled, warning=warning)


def provenance(spark: SparkSession, loaded: LoadedRegistry) -> DataFrame:
    """One row: where a run's registry came from."""
    return spark.createDataFrame(
        [(loaded.origin, loaded.path, loaded.fetched_at)],
        "origin string, path string, fetched_at timestamp",
    )
