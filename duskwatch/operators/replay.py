"""The gate through time: the days on which a finding's status or verdict turns, kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.functions import lifecycle

#: The day from which a finding's first state holds: before all others.
BEGINNING = "0001-01-01"


def change_points(findings: DataFrame, within=None, fail_on_retired: bool = False) -> DataFrame:
    """``findings`` once per state: ``from_day``, ``effective_status``, ``trips_gate``, as ``with_urgency`` gives them from that day on.

    A finding has at most four states: from the beginning, from the day its window opens, from its sunset, and from the day after.
    Rows whose state is that of the row before are left out.
    """
    sunset = lifecycle.parse_day(F.col("sunset_date"))
    start = F.lit(BEGINNING).cast("date")
    days = F.when(sunset.isNull(), F.array(start)).otherwise(
        F.array(start, F.date_sub(sunset, lifecycle.within_days(within)), sunset, F.date_add(sunset, 1))
    )

    def state(day: Column) -> Column:
        left = F.datediff(sunset, day)
        status = lifecycle.status_by_days(F.col("status"), left)
        urgent = lifecycle.actionable_by_days(F.col("severity"), status, left, within, fail_on_retired)
        trips = urgent & ~F.col("test_only") & ~F.col("mention_only")
        return F.struct(day.alias("from_day"), status.alias("effective_status"), trips.alias("trips_gate"))

    held = lambda s: F.struct(s["effective_status"], s["trips_gate"])
    states = F.col("states")
    turned = F.filter(states, lambda s, i: (i == 0) | (held(s) != held(F.get(states, i - 1))))
    return findings.withColumn("states", F.transform(days, state)).select(*findings.columns, F.inline(turned))


def write_changes(changes: DataFrame, path: str) -> None:
    """Store change points by month, so that days in between are partitions in between."""
    dated = changes.withColumn("month", _month_of(F.col("from_day")))
    dated.hint("rebalance", "month").write.partitionBy("month").parquet(path)  # few files a month; a large one is split


def read_changes(spark: SparkSession, path: str, after=None, upto=None) -> DataFrame:
    """Stored change points of the days after ``after``, up to ``upto``; months outside are not read."""
    rows = spark.read.parquet(path)
    for day, months, days in ((after, F.col("month") >= _month(after), F.col("from_day") > _day(after)),
                              (upto, F.col("month") <= _month(upto), F.col("from_day") <= _day(upto))):
        if day is not None:
            rows = rows.filter(months & days)
    return rows


def _day(day) -> Column:
    return F.lit(None) if day is None else lifecycle.day(day)


def _month(day) -> Column:
    return F.lit(None) if day is None else _month_of(lifecycle.day(day))


def _month_of(day: Column) -> Column:
    return 100 * F.year(day) + F.month(day)


def state_on(changes: DataFrame, day, keys: list[str]) -> DataFrame:
    """Every finding as the gate sees it on one day: its last change up to then."""
    past = changes.filter(F.col("from_day") <= lifecycle.day(day))
    row = F.struct(*[c for c in changes.columns if c not in keys])
    return past.groupBy(*keys).agg(F.max_by(row, "from_day").alias("r")).select(*keys, "r.*")


def daily_changes(changes: DataFrame, *by: str) -> DataFrame:
    """Per day and group: by how much the tripped, retired and scheduled findings change on it. Small: a row a day with a change."""
    previous = Window.partitionBy("finding").orderBy("from_day")
    flags = {"tripped": F.col("trips_gate"), "retired": F.col("effective_status") == "retired", "scheduled": F.col("effective_status") == "scheduled"}
    numbers = changes.select("finding", *by, "from_day", *[flag.cast("int").alias(n) for n, flag in flags.items()])
    steps = numbers.select(*by, "from_day", *[(F.col(n) - F.coalesce(F.lag(n).over(previous), F.lit(0))).alias(n) for n in flags])
    return steps.groupBy(*by, "from_day").agg(*[F.sum(n).alias(n) for n in flags])


def gate_series(daily: DataFrame, days: DataFrame, *by: str) -> DataFrame:
    """Tripped, retired and scheduled findings on each of ``days(as_of)``, from :func:`daily_changes`.

    A running sum over days with a change and days asked for; findings themselves are not looked at.
    """
    names = ("tripped", "retired", "scheduled")
    asked = days.select(F.col("as_of").alias("from_day")).distinct()
    if by:
        asked = asked.join(daily.select(*by).distinct())
    zeros = asked.select(*by, "from_day", *[F.lit(0).cast("bigint").alias(n) for n in names], F.lit(True).alias("asked"))
    rows = daily.select(*by, "from_day", *names, F.lit(False).alias("asked")).unionByName(zeros)
    so_far = Window.partitionBy(*by).orderBy("from_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.select(*by, "from_day", "asked", *[F.sum(n).over(so_far).alias(n) for n in names])
    return totals.filter("asked").select(*by, F.col("from_day").alias("as_of"), *names)
