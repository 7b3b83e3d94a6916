"""As-of joins with the trading calendar, as equi joins on a dense date map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import ist_date, ist_minutes, session


def dense_days(calendar: DataFrame, margin: int = 10) -> DataFrame:
    """Rows (dt, trading, fwd, back): every date of the calendar's span, with the next and last trading day index.

    The span is a few thousand dates whatever the corpus, so its one window is
    small. ``margin`` more days precede it; days after it have no forward index.
    """
    span = calendar.agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    days = span.select(F.explode(F.sequence(F.date_sub("a", margin), F.date_add("b", margin), F.expr("INTERVAL 1 DAY"))).alias("dt"))
    days = days.join(calendar.select("dt", "d"), "dt", "left")
    ahead, behind = W.orderBy("dt").rowsBetween(0, W.unboundedFollowing), W.orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    return days.select("dt", F.col("d").isNotNull().alias("trading"), F.first("d", True).over(ahead).alias("fwd"), F.last("d", True).over(behind).alias("back"))


def place(messages: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds session, day and minutes_in: where a message falls and the first day it can act on. Later than the calendar: dropped."""
    last = calendar.agg(F.max("d").alias("last_day"))
    m = messages.withColumn("__date", ist_date(F.col(ts))).withColumn("__min", ist_minutes(F.col(ts)))
    # the date map has a row a day: a proven bound, whatever the number of messages
    m = m.join(F.broadcast(dense_days(calendar)), F.col("__date") == F.col("dt")).crossJoin(F.broadcast(last))
    m = m.withColumn("session", session(F.col("trading"), F.col("__min")))
    m = m.withColumn("day", F.when(F.col("session") == "after-close", F.col("fwd") + 1).otherwise(F.col("fwd")))
    m = m.withColumn("minutes_in", F.when(F.col("session") == "in-session", F.col("__min") - 555))
    return m.where("day IS NOT NULL AND day <= last_day").drop("__date", "__min", "dt", "trading", "fwd", "back", "last_day")


def day_before(frame: DataFrame, calendar: DataFrame, date: str, out: str = "until") -> DataFrame:
    """Adds the last trading day index on or before a date."""
    days = F.broadcast(dense_days(calendar).select(F.col("dt").alias("__dt"), F.col("back").alias(out)))
    return frame.join(days, F.col(date) == F.col("__dt"), "left").drop("__dt")
