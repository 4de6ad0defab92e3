import datetime as dt

from pyspark.sql import functions as F

from duskwatch.functions import lifecycle as life
from duskwatch.functions import phrases

NOW = "2026-06-06"


def ahead(days):
    return (dt.date(2026, 6, 6) + dt.timedelta(days)).isoformat()


def test_days(spark):
    cases = {
        "2026-06-20": 14, "2026-06-06": 0, "2026-06-05": -1, "2026-07": 25, "2026": -156, "2026-02-30": -96,
        "2026-8-1": None, "2026-13-01": None, "2026-00-10": None, "2026-01-32": None, "soon": None, "": None, None: None,
        "2026-06-06T00:00": None, "02026-06-06": None,
    }
    df = spark.createDataFrame([(n, d) for n, d in enumerate(cases)], "n int, d string")
    got = [r.v for r in df.select("n", life.days_until(F.col("d"), NOW).alias("v")).orderBy("n").collect()]
    assert got == list(cases.values())


def test_clock_forms():
    forms = [NOW, dt.date(2026, 6, 6), dt.datetime(2026, 6, 6, 23, 59), NOW + "T23:59:59Z",
             dt.datetime(2026, 6, 7, 1, tzinfo=dt.timezone(dt.timedelta(hours=2)))]
    assert len({str(life.day(form)) for form in forms}) == 1


def test_status_and_gate(spark):
    # severity, explicit status, sunset, within, fail_on_retired -> status, actionable
    cases = [
        ("high", None, None, 30, False, "deprecated", True), ("high", None, ahead(60), 30, False, "scheduled", True),
        ("high", None, "2020-01-01", 30, False, "retired", False), ("high", None, "2020-01-01", 30, True, "retired", True),
        ("medium", None, None, 30, False, "deprecated", False), ("medium", None, "2020-01-01", 30, True, "retired", False),
        ("medium", None, ahead(14), 30, False, "scheduled", True), ("medium", None, ahead(14), 7, False, "scheduled", False),
        ("medium", None, ahead(120), 30, False, "scheduled", False), ("low", None, ahead(0), 0, False, "scheduled", True),
        ("medium", "scheduled", "2020-01-01", 30, False, "scheduled", False), ("medium", "scheduled", None, 30, False, "scheduled", False),
        ("high", "deprecated", "2020-01-01", 30, False, "deprecated", True), ("medium", None, ahead(30), None, False, "scheduled", True),
        ("medium", None, ahead(31), -5, False, "scheduled", False), ("medium", None, ahead(30), "x", False, "scheduled", True),
    ]
    for severity, status, sunset, within, retired, effective, fails in cases:
        df = spark.createDataFrame([(severity, status, sunset)], "v string, s string, d string")
        row = df.select(
            life.effective_status(F.col("s"), F.col("d"), NOW),
            life.actionable(F.col("v"), F.col("s"), F.col("d"), NOW, within, retired),
        ).first()
        assert tuple(row) == (effective, fails), (severity, status, sunset, within, retired)


def test_phrases(spark):
    cases = {
        (None, None): phrases.NO_DATE, (None, "2026-06-05"): "retired 2026-06-05 (1 day ago)",
        (None, "2026-06-06"): "sunsets 2026-06-06 (today)", (None, "2026-06-07"): "sunsets 2026-06-07 (in 1 day)",
        ("scheduled", "2026-06-01"): "sunsets 2026-06-01 (today)", ("retired", "2026-06-08"): "retired 2026-06-08 (2 days ago)",
        ("retired", None): phrases.NO_DATE, ("deprecated", "2030-01-01"): phrases.NO_DATE,
    }
    df = spark.createDataFrame([(n, *k) for n, k in enumerate(cases)], "n int, s string, d string")
    got = df.select("n", phrases.status_phrase(F.col("s"), F.col("d"), NOW).alias("p")).orderBy("n").collect()
    assert [r.p for r in got] == list(cases.values())


def test_freshness(spark):
    now = dt.datetime(2026, 6, 6, 12)
    ages = [(0, True, "updated today"), (86399, True, "updated today"), (86400, False, "updated 1 day ago"),
            (3 * 86400 + 5, False, "updated 3 days ago"), (-1, False, "updated recently")]
    df = spark.createDataFrame([(n, now - dt.timedelta(seconds=a)) for n, (a, *_) in enumerate(ages)], "n int, t timestamp")
    got = df.select("n", life.is_fresh(F.col("t"), F.lit(now)).alias("f"), phrases.age_phrase(F.col("t"), F.lit(now)).alias("p")).orderBy("n")
    assert [(r.f, r.p) for r in got.collect()] == [a[1:] for a in ages]
    none = F.lit(None).cast("timestamp")
    row = df.limit(1).select(
        life.is_fresh(none, F.lit(now)),
        phrases.provenance_phrase(F.lit("cache"), F.lit("p"), none, F.lit(now), offline=True),
        phrases.provenance_phrase(F.lit("bundled"), F.lit("p"), none, F.lit(now), refresh_failed=True),
        phrases.provenance_phrase(F.lit("custom"), F.lit("p"), none, F.lit(now)),
    ).first()
    assert row[0] is False and row[1] == "dataset: updated (age unknown) · offline"
    assert row[2].startswith("dataset: bundled · refresh failed") and row[3] == "dataset: custom (p)"
