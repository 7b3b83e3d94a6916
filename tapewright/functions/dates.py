"""Market time: UTC timestamps seen in the exchange's zone (UTC+5:30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone's offset and the session, in minutes of the day.
OFFSET_MINUTES, MARKET_OPEN, MARKET_CLOSE = 330, 555, 930


def ist(ts: Column) -> Column:
    return ts + F.expr(f"INTERVAL '{OFFSET_MINUTES}' MINUTE")


def ist_date(ts: Column) -> Column:
    return F.to_date(ist(ts))


def ist_minutes(ts: Column) -> Column:
    return F.hour(ist(ts)) * 60 + F.minute(ist(ts))


def session(trading_day: Column, minutes: Column) -> Column:
    return (
        F.when(~trading_day, "closed-day")
        .when(minutes < MARKET_OPEN, "before-open")
        .when(minutes < MARKET_CLOSE, "in-session")
        .otherwise("after-close")
    )


def pretty(d: Column) -> Column:
    """28-Oct-2025."""
    return F.date_format(d, "dd-MMM-yyyy")
