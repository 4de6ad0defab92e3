"""Dates, status, urgency. ``now`` is always an argument: one clock per run."""

from __future__ import annotations

import re

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.fixed import DEFAULT_WITHIN_DAYS, FAR_FUTURE, SNAPSHOT_TTL_SECONDS


def day(now) -> Column:
    """A Python date, datetime, ISO string or Column as a UTC calendar day."""
    if isinstance(now, Column):
        return now.cast("date")
    if isinstance(now, dt.datetime) and now.tzinfo is not None:
        now = now.astimezone(dt.timezone.utc)
    if isinstance(now, (dt.date, dt.datetime)):
        now = now.strftime("%Y-%m-%d")
    return F.lit(now[:10]).cast("date")


def parse_day(text: Column) -> Column:
    """ISO ``YYYY-MM-DD``, ``YYYY-MM`` or ``YYYY``; anything else is null.

    A day of 29 to 31 in a shorter month rolls over into the next one.
    """
    full = F.length(text) > 7
    first = F.when(full, F.concat(F.substring(text, 1, 7), F.lit("-01"))).otherwise(text)
    offset = F.when(full, F.substring(text, 9, 2).try_cast("int") - 1).otherwise(0)
    shaped = text.rlike(r"^\d{4}(?:-\d{2}(?:-\d{2})?)?\z") & offset.between(0, 30)
    return F.when(shaped, F.date_add(first.try_cast("date"), offset))


def days_until(sunset: Column, now) -> Column:
    return F.datediff(parse_day(sunset), day(now))


def status_by_days(status: Column, days: Column) -> Column:
    derived = F.when(days.isNull(), "deprecated").when(days < 0, "retired").otherwise("scheduled")
    return F.coalesce(status, derived)


def effective_status(status: Column, sunset: Column, now) -> Column:
    return status_by_days(status, days_until(sunset, now))


def within_days(value, default: int = DEFAULT_WITHIN_DAYS) -> int:
    """The number a value begins with (``7d`` is 7, ``3.5`` is 3) if it is 0 or more, else the default window."""
    number = re.match(r"\s*([+-]?\d+)", "" if value is None else str(value), re.ASCII)
    days = int(number[1]) if number else -1
    return days if days >= 0 else default


def actionable_by_days(
    severity: Column, effective: Column, days: Column, within=None, fail_on_retired=False
) -> Column:
    soon = F.coalesce(days.between(0, within_days(within)), F.lit(False))
    return (
        F.when(severity == "high", (effective != "retired") | F.lit(bool(fail_on_retired)))
        .when(effective == "scheduled", soon)
        .otherwise(False)
    )


def actionable(
    severity: Column, status: Column, sunset: Column, now, within=None, fail_on_retired=False
) -> Column:
    """Does a finding of this base severity and status fail the gate?"""
    days = days_until(sunset, now)
    effective = status_by_days(status, days)
    return actionable_by_days(severity, effective, days, within, fail_on_retired)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def sunset_key(sunset: Column) -> Column:
    return F.coalesce(F.nullif(sunset, F.lit("")), F.lit(FAR_FUTURE))


def is_fresh(fetched_at: Column, now: Column, ttl: int = SNAPSHOT_TTL_SECONDS) -> Column:
    age = F.unix_micros(now) - F.unix_micros(fetched_at)
    return F.coalesce((age >= 0) & (age < ttl * 1_000_000), F.lit(False))
