"""Freshness, schedules and local clocks. Every ``now`` is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MINUTES = 1440


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0.0))


def fresh_until(last_checked: Column, interval: Column) -> Column:
    """A check stays good for three intervals, a day at least."""
    return last_checked + minutes(F.greatest(interval * 3, F.lit(DAY_MINUTES)))


def is_fresh(as_of: Column, last_checked: Column, interval: Column) -> Column:
    return F.coalesce(as_of <= fresh_until(last_checked, interval), F.lit(False))


def backoff(completed: Column, interval: Column) -> Column:
    """The next check after a failed one: twice the interval, a day at most."""
    return completed + minutes(F.least(F.lit(DAY_MINUTES), interval * 2))


def hours_backoff(completed: Column, interval: Column) -> Column:
    return completed + minutes(F.least(F.lit(120), interval))


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    return ts >= as_of - F.make_dt_interval(F.lit(days))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def iso_weekday(ts: Column) -> Column:
    return F.extract(F.lit("DAYOFWEEK_ISO"), ts).cast("int")


def interval_open(weekday: Column, opens: Column, closes: Column, next_day: Column, local_now: Column) -> Column:
    """Whether an interval covers a local time; one that closes next day also covers the early hours of
    the day after. Seconds within the minute do not matter."""
    today, minute = iso_weekday(local_now), minute_of_day(local_now)
    yesterday = F.when(today == 1, 7).otherwise(today - 1)
    same_day = ~next_day & (weekday == today) & (minute >= opens) & (minute < closes)
    overnight = next_day & (((weekday == today) & (minute >= opens)) | ((weekday == yesterday) & (minute < closes)))
    return same_day | overnight


def closes_next_day(opens: Column, closes: Column) -> Column:
    return closes <= opens


def weekday_range(first: Column, last: Column) -> Column:
    """ISO weekdays from first to last, over the weekend where last comes before first."""
    return F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(7))), lambda i: F.pmod(first - 1 + i, F.lit(7)) + 1)


def shifted_minute(minute: Column, by: Column) -> Column:
    return F.pmod(minute + by, F.lit(DAY_MINUTES))


def clock_minute(text: Column) -> Column:
    """Minute of the day of ``7``, ``07:30``, ``7.30 pm``; null for anything else."""
    clean = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("."), F.lit(":")), r"\s+", "")
    shape = r"^(\d{1,2})(?::([0-5]\d))?(am|pm)?$"
    hour, minute, half = (F.regexp_extract(clean, shape, i) for i in (1, 2, 3))
    h = hour.try_cast("int")
    twelve = F.when(half == "am", F.when(h == 12, 0).otherwise(h)).otherwise(F.when(h == 12, 12).otherwise(h + 12))
    hours = F.when(half == "", F.when(h.between(0, 23), h)).otherwise(F.when(h.between(1, 12), twelve))
    return F.when(clean.rlike(shape), hours * 60 + F.coalesce(minute.try_cast("int"), F.lit(0)))


def source_health(enabled: Column, as_of: Column, last_checked: Column, interval: Column, failures: Column, outcome: Column) -> Column:
    """disabled, unverified, stale, degraded or healthy, the first that applies."""
    bad = F.coalesce(outcome.isin("quarantined", "fetch_error", "extraction_error", "blocked_by_robots"), F.lit(False))
    return (
        F.when(~enabled, "disabled")
        .when(last_checked.isNull() | interval.isNull(), "unverified")
        .when(fresh_until(last_checked, interval) < as_of, "stale")
        .when((F.coalesce(failures, F.lit(0)) > 0) | bad, "degraded")
        .otherwise("healthy")
    )


def action_status(enabled: Column, expires: Column, as_of: Column) -> Column:
    soon = expires <= as_of + F.make_dt_interval(F.lit(7))
    return F.when(~enabled, "disabled").when(expires <= as_of, "expired").when(soon, "expiring").otherwise("verified")
