"""Quality checks over a raw registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.fixed import EXTENSION_TOKEN
from duskwatch.functions.lifecycle import effective_status, parse_day
from duskwatch.functions.regexes import UnsupportedRegex, model_regex, to_java
from duskwatch.plans.joins import dealt
from duskwatch.sources.registry import coerce_entries


def duplicate_ids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def registry_audit(raw: DataFrame, now) -> DataFrame:
    """One row of counts over ``raw(entry variant, entry_ord)``; all zeros but the first two is
    a healthy registry. Ids are counted first, so no shuffle carries more than one row per id."""
    entries = coerce_entries(raw)
    sunset, announced = F.col("sunset_date"), F.col("announced_date")
    status = effective_status(F.col("status"), sunset, now)
    bad_scope = F.exists("applies_to", lambda ext: ~ext.rlike(EXTENSION_TOKEN))
    checks = {
        "dropped": ~F.col("valid"),
        "bad_dates": (sunset.isNotNull() & parse_day(sunset).isNull())
        | (announced.isNotNull() & parse_day(announced).isNull()),
        "bad_scopes": bad_scope,
        "no_confidence": F.col("confidence").isNull(),
        "no_source": F.col("source") == "",
        "no_migration_url": F.col("migration_url") == "",
        "status_date_mismatch": (status == "deprecated") != sunset.isNull(),
    }
    checks = {k: v if k == "dropped" else F.col("valid") & v for k, v in checks.items()}
    per_id = entries.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(test).alias(k) for k, test in checks.items()]
    )
    return per_id.agg(
        F.sum("n").alias("entries"),
        F.count_if(F.col("id").isNotNull() & (F.col("n") > 1)).alias("duplicate_ids"),
        *[F.sum(name).alias(name) for name in checks],
    )


def _told(batches):
    """(entry, kind, source) of expressions with the reason why they cannot run; those that can are left out."""
    import pyarrow as pa

    for batch in batches:
        rows, reasons = [], []
        for row, (kind, source) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            try:
                to_java(model_regex(source) if kind == "model" else source)
            except UnsupportedRegex as error:
                rows.append(row)
                reasons.append(str(error))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(pa.array(rows, pa.int64())) for i in range(4)), pa.array(reasons, pa.string())],
            names=["entry_ord", "id", "kind", "source", "reason"],
        )


def unusable_patterns(raw: DataFrame) -> DataFrame:
    """Expressions of the valid pattern entries of ``raw`` that a scan would set aside, with the reason.

    Judged by the grammar of the registry's dialect and by what can run at any length of text, on the executors: a registry of any
    size can be audited before it is taken over. Expressions are dealt to all cores, in whatever few splits the entries came.
    """
    entries = coerce_entries(raw).filter("valid and match = 'pattern'")
    named = lambda kind: F.transform(f"detect.{kind}s", lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("source")))
    every = entries.select("entry_ord", "id", F.explode(F.concat(named("pattern"), named("model"))).alias("e"))
    return dealt(every.select("entry_ord", "id", "e.kind", "e.source")).mapInArrow(
        _told, "entry_ord bigint, id string, kind string, source string, reason string"
    )


def pattern_audit(raw: DataFrame) -> DataFrame:
    """One row: pattern entries, those with an unusable expression, unusable expressions, ids that entries share."""
    bad = unusable_patterns(raw).agg(F.count(F.lit(1)).alias("unusable_patterns"), F.count_distinct("entry_ord").alias("entries_affected"))
    entries = coerce_entries(raw)
    total = entries.filter("valid and match = 'pattern'").agg(F.count(F.lit(1)).alias("pattern_entries"))
    shared = duplicate_ids(entries.filter("id is not null")).agg(F.count(F.lit(1)).alias("shared_ids"))
    one = F.lit(1).alias("one")
    return total.select(one, "*").join(bad.select(one, "*"), "one").join(shared.select(one, "*"), "one").drop("one")
