"""Continuous monitoring: report ingestion and notification of new registry entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.operators.findings import with_urgency
from duskwatch.operators.dependencies import registry_packages
from duskwatch.operators.inventory import affected_repos, inventory_of_packages, new_entries
from duskwatch.sinks.reports import Batch, append_first, append_reports, current, write_batch
from duskwatch.streaming.state import seen_entries, sent_notifications

#: Work off what is there, then stop. ``{"processingTime": "1 minute"}`` goes on for ever.
ONCE = {"availableNow": True}

# --- STR-1 -------------------------------------------------------------------------------


def ingest_reports(uploads: DataFrame, root: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Append a stream of uploads to the report tables under ``root``, exactly once.

    Several streams may share a root, and a stream may be begun again with a new checkpoint.
    """
    return (
        uploads.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(lambda batch, number: append_reports(batch, root, current(batch.sparkSession, number)))
        .start()
    )


# --- STR-2 -------------------------------------------------------------------------------


def notify_batch(spark: SparkSession, entries: DataFrame, root: str, batch: Batch) -> None:
    """Handle one delivery of registry entries.

    The first delivery ever only marks its entries as seen. Later ones notify every repository
    whose latest inventory holds a package of a new entry, once per repository and entry. What was seen and
    sent, and who holds a package, is state in buckets: of it the batch reads what its own keys need, however
    long the history. It is written last and with its batch: a retry after a lost driver repeats the
    same result, and a new checkpoint does not seed again.
    """
    seen, sent = seen_entries(spark, root), sent_notifications(spark, root)
    first_run = not seen.runs(ahead_of=batch)
    ids = entries.select("id").distinct()
    known = seen.read(ids, ahead_of=batch)
    if not first_run:
        names = registry_packages(new_entries(entries, known)).select("norm").distinct()
        inventory = inventory_of_packages(spark, root, names)
        pairs = affected_repos(new_entries(entries, known), inventory).persist()
        try:
            due = pairs.join(sent.read(pairs, ahead_of=batch), ["repo", "id"], "left_anti")
            write_batch(due, root, "notifications", batch)
            sent.write(due, batch)
        finally:
            pairs.unpersist()
    write_batch(ids.join(known, "id", "left_anti"), root, "seen", batch)
    seen.write(ids, batch)


def notify_new_entries(entries: DataFrame, root: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Run :func:`notify_batch` over a stream of validated registry entries."""

    def handle(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            notify_batch(batch.sparkSession, kept, root, current(batch.sparkSession, number))
        finally:
            kept.unpersist()

    return (
        entries.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger).foreachBatch(handle).start()
    )


# --- STR-3 -------------------------------------------------------------------------------


def drop_repeats(
    stream: DataFrame, keys: list[str], event_time: str = "reported_at", delay: str = "1 day"
) -> DataFrame:
    """Let the first row per key through; its state is forgotten ``delay`` after its time.

    Repeats further apart come through again: see :func:`keep_first` for at most once.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def keep_first(stream: DataFrame, keys: list[str], root: str, table: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Store the first row per key of a stream, however far apart its repeats are."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(lambda batch, number: append_first(batch, root, table, keys, current(batch.sparkSession, number)))
        .start()
    )


# --- STR-4 -------------------------------------------------------------------------------


def replay_gate(findings: DataFrame, days: list[str], within=None, fail_on_retired=False) -> DataFrame:
    """Stored findings as the gate sees them on each of ``days``: dates move while code rests."""
    dated = findings.withColumn(
        "as_of", F.explode(F.array(*[F.lit(d).cast("date") for d in days]))
    )
    return with_urgency(dated, F.col("as_of"), within, fail_on_retired)
