"""State by key: what a batch reads does not grow with the history, and a retry repeats its result."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

import duskwatch.sinks.snapshots as snapshots
from duskwatch import registry_from_rows
from duskwatch.operators.inventory import current_inventory, latest_inventory
from duskwatch.sinks.reports import REPORT_SCHEMA, Batch, append_first, append_reports, read_table
from duskwatch.sources.registry import entries_of_json
from duskwatch.streaming.monitor import notify_batch
from duskwatch.streaming.state import FAN, State, first_of_key, last_of_key

SCHEMA = "k string, at int, v string"


def state(spark, root):
    return State(spark, str(root), "t", SCHEMA, ("k",), last_of_key(("k",), ("at",)))


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    kept, files = state(spark, tmp_path), {}
    for n in range(30):
        rows = [(f"k{n}-{i}", n, "x") for i in range(3)] + [("hot", n, f"v{n}")]
        kept.write(spark.createDataFrame(rows, SCHEMA), Batch("s", n))
        if n in (2, 29):
            mine = spark.createDataFrame([("hot",)], "k string")
            files[n] = kept.pending(mine).select(F.input_file_name()).distinct().count()
            assert len(kept.runs()) <= 2 * FAN
    assert files[29] <= 2 * FAN and files[2] <= 3
    assert kept.read().count() == 91 and kept.read().filter("k = 'hot'").first().v == "v29"


def test_runs_of_a_repeated_batch_are_not_its_own_past(spark, tmp_path):
    kept = state(spark, tmp_path)
    row = lambda k, at, v: spark.createDataFrame([(k, at, v)], SCHEMA)
    for n in range(FAN + 2):
        kept.write(row("a", n, f"v{n}"), Batch("s", n))
    kept.write(row("b", 1, "other"), Batch("t", 0))
    last = Batch("s", FAN + 1)
    assert {r.k: r.v for r in kept.read(ahead_of=last).collect()} == {"a": f"v{FAN}", "b": "other"}
    kept.write(row("a", FAN + 1, "again"), last)
    assert {r.k: r.v for r in kept.read().collect()} == {"a": "again", "b": "other"}
    # A lower run that a merged one covers does not come back, whether it is deleted yet or not.
    kept.write(row("a", 0, "late"), Batch("s", FAN + 2))
    assert kept.read().filter("k = 'a'").first().v == "again"


def test_first_of_a_key_for_ever(spark, tmp_path):
    root = str(tmp_path)
    for n in range(FAN + 3):
        for _ in range(2 if n in (0, FAN + 2) else 1):  # the first and the last batch are tried twice
            rows = spark.createDataFrame([("same", n), (f"k{n}", n)], "k string, n int")
            append_first(rows, root, "first", ["k"], Batch(f"s{n % 2}", n))
    got = {r.k: r.n for r in spark.read.parquet(f"{root}/first").collect()}
    assert got == {"same": 0, **{f"k{n}": n for n in range(FAN + 3)}}
    assert spark.read.parquet(f"{root}/first").count() == len(got)
    known = State(spark, root, "first", "k string", ("k",), first_of_key("k"))
    assert {r.k for r in known.read().collect()} == set(got)


def uploads(spark, *rows):
    texts = spark.createDataFrame([(json.dumps(r),) for r in rows], "t string")
    return texts.select(F.from_json("t", REPORT_SCHEMA).alias("u")).select("u.*")


def upload(repo, at, *packages):
    deps = [{"name": n, "version": None, "manifest": "go.mod"} for n in packages]
    return {"repo": repo, "cliVersion": "1", "reportedAt": at, "inventory": {"dependencies": deps}}


def entry(id_, sdk):
    return {"id": id_, "vendor": "v", "title": "t", "severity": "low", "detect": {"sdk": [sdk], "patterns": ["x"]}}


def test_reports_that_come_late_or_twice(spark, tmp_path):
    """Kept inventories equal those computed from the log, in whatever order and by whichever stream reports come."""
    root = str(tmp_path)
    days = [("a", 3, "p", "q"), ("a", 1, "p", "old"), ("a", 2, "z"), ("b", 1, "p"), ("b", 2), ("c", 1, "P_", "q"), ("a", 3, "p", "q"), ("a", 4, "q")]
    for n, (repo, day, *names) in enumerate(days):
        append_reports(uploads(spark, upload(repo, f"2026-06-0{day}T00:00:00Z", *names)), root, Batch(f"s{n % 2}", n))
    log = latest_inventory(read_table(spark, root, "inventory"), read_table(spark, root, "reports"))
    kept = current_inventory(spark, root)
    assert sorted((r.repo, r.name) for r in kept.collect()) == sorted((r.repo, r.name) for r in log.collect()) == [("a", "q"), ("c", "P_"), ("c", "q")]
    changes = [(r.repo, r.reported_at.day, r.name, r.change) for r in read_table(spark, root, "changes").collect()]
    assert ("b", 2, "p", "removed") in changes and ("a", 4, "p", "removed") in changes and ("a", 1, "old", "added") not in changes
    notify_batch(spark, registry_from_rows(spark, [entry("seed", "none")]), root, Batch("n", 0))
    notify_batch(spark, registry_from_rows(spark, [entry(i, s) for i, s in (("e-p", "p"), ("e-q", "Q"), ("e-old", "old"), ("e-p_", "p_"))]), root, Batch("n", 1))
    sent = {(r.repo, r.id) for r in read_table(spark, root, "notifications").collect()}
    assert sent == {("a", "e-q"), ("c", "e-q"), ("c", "e-p_")}


# --- snapshots -----------------------------------------------------------------------------------


def test_two_writers_at_once_leave_two_versions(spark, tmp_path, monkeypatch):
    root, meet = str(tmp_path / "s"), threading.Barrier(2)
    newest = snapshots.newest_snapshot

    def together(*args):
        found = newest(*args)
        meet.wait(timeout=60)
        return found

    monkeypatch.setattr(snapshots, "newest_snapshot", together)
    good = {"id": "a", "vendor": "v", "title": "t", "severity": "high", "detect": {"patterns": ["x"]}}
    raws = [entries_of_json(spark.createDataFrame([(0, json.dumps({**good, "id": i}))], "n int, t string"), "t", "n") for i in "ab"]
    done = []
    threads = [
        threading.Thread(target=lambda r=raw, u=url: done.append(snapshots.write_snapshot(spark, root, r, u, dt.datetime(2026, 6, 1))))
        for raw, url in zip(raws, "ab", strict=True)
    ]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(d["version"] for d in done) == [1, 2]
    assert {d["url"]: [r.id for r in snapshots.read_snapshot(spark, root, d["version"]).collect()] for d in done} == {"a": ["a"], "b": ["b"]}
    assert newest(spark, root)["version"] == 2


@pytest.mark.parametrize("left", [1, 3])
def test_a_writer_that_died_leaves_a_gap(spark, tmp_path, left):
    root = str(tmp_path / "s")
    raw = entries_of_json(spark.createDataFrame([(0, json.dumps({"id": "a", "vendor": "v", "title": "t", "severity": "high", "detect": {"patterns": ["x"]}}))], "n int, t string"), "t", "n")
    assert all(snapshots._claimed(spark, f"{root}/claims", n) for n in range(1, left + 1))
    assert snapshots.newest_snapshot(spark, root) is None
    assert snapshots.write_snapshot(spark, root, raw, "u", dt.datetime(2026, 6, 1))["version"] == left + 1
