"""Change points against the gate asked day by day."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import plan_of

from duskwatch.operators.replay import change_points, daily_changes, gate_series, read_changes, state_on, write_changes
from duskwatch.streaming.monitor import replay_gate

START, DAYS = dt.date(2025, 1, 1), 730


def findings(spark, n=150):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        day = START + dt.timedelta(days=rng.randrange(-40, DAYS + 40))
        sunset = rng.choice([None, "", "soon", str(day), str(day), str(day), str(day)[:7], str(day)[:4]])
        rows.append((i, f"r{i % 7}", rng.choice(["high", "medium", "low"]), rng.choice([None, None, None, "scheduled", "retired", "deprecated"]), sunset, rng.random() < 0.1, rng.random() < 0.1))
    return spark.createDataFrame(rows, "finding int, repo string, severity string, status string, sunset_date string, test_only boolean, mention_only boolean")


def test_every_day_of_two_years(spark, tmp_path):
    found = findings(spark)
    days = [str(START + dt.timedelta(days=n)) for n in range(DAYS)]
    asked = spark.createDataFrame([(START + dt.timedelta(days=n),) for n in range(DAYS)], "as_of date")
    for within, strict in ((30, False), (0, True), (400, False)):
        want = replay_gate(found, days, within, strict).groupBy("as_of").agg(
            F.count_if("trips_gate").alias("tripped"), F.count_if(F.col("effective_status") == "retired").alias("retired"),
            F.count_if(F.col("effective_status") == "scheduled").alias("scheduled"),
        )
        got = gate_series(daily_changes(change_points(found, within, strict)), asked)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    per_repo = gate_series(daily_changes(change_points(found), "repo"), asked.limit(3), "repo")
    assert per_repo.count() == 21


def test_states_on_a_day_and_days_in_between(spark, tmp_path):
    found, path = findings(spark), str(tmp_path / "c")
    points = change_points(found)
    assert points.groupBy("finding").count().agg(F.max("count")).first()[0] <= 4
    write_changes(points, path)
    for day in ("2025-01-01", "2025-07-15", "2026-12-30"):
        want = replay_gate(found, [day]).select("finding", "effective_status", "trips_gate")
        got = state_on(read_changes(spark, path, upto=day), day, ["finding"]).select("finding", "effective_status", "trips_gate")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    between = read_changes(spark, path, after="2025-03-10", upto="2025-05-01")
    plan = plan_of(between)
    assert "PartitionFilters: [isnotnull(month" in plan and "202503" in plan and "202505" in plan
    files = [r.f for r in between.select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all(any(f"month=20250{m}" in f for m in (3, 4, 5)) for f in files)
    assert {r.from_day for r in between.collect()} == {
        r.from_day for r in points.filter("from_day > '2025-03-10' and from_day <= '2025-05-01'").collect()
    }
    # Yesterday's states and the days in between give today's.
    then = state_on(read_changes(spark, path, upto="2025-03-10"), "2025-03-10", ["finding"])
    both = state_on(then.select(*points.columns).unionByName(between.select(*points.columns)), "2025-05-01", ["finding"])
    want = state_on(points, "2025-05-01", ["finding"])
    columns = ["finding", "from_day", "effective_status", "trips_gate"]
    assert sorted(map(tuple, both.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
