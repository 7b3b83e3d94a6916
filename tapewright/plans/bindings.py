"""Views over the supplied tables that give every operator deterministic rows to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ist_date
from ..operators.bars import from_ticks, trading_calendar
from ..operators.calendar import day_before, place

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar a user and day of ``events``; the user is the instrument."""
    return from_ticks(table(spark, sf_dir, "events").select("user_id", "ts", "value"), "user_id", "ts", "value")


def calendar(spark: SparkSession, sf_dir: str, sundays: bool = False) -> DataFrame:
    return trading_calendar(raw_bars(spark, sf_dir), F.lit(False) if sundays else F.dayofweek("dt") == 1)


def bars(spark: SparkSession, sf_dir: str, sundays: bool = False) -> DataFrame:
    """Bars of trading days, with the day index d."""
    days = F.broadcast(calendar(spark, sf_dir, sundays))  # a row a trading day
    return raw_bars(spark, sf_dir).join(days, "dt").select("instrument_id", "d", "dt", "o", "h", "l", "c", "v")


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar a supplier and ship date of ``lineitem``: histories of some years; d counts the dates."""
    t = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("dt"), c("l_extendedprice").alias("p"), F.struct("l_orderkey", "l_linenumber").alias("k"))
    b = t.groupBy("instrument_id", "dt").agg(F.min_by("p", "k").alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", "k").alias("c"), F.count("*").alias("v"))
    return b.join(F.broadcast(trading_calendar(b, F.lit(False))), "dt")  # a row a date


def long_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of fifty pieces as calls on their supplier, on the day of shipment."""
    t = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity = 50")
    days = long_bars(spark, sf_dir).select("dt", c("d").alias("day")).distinct()
    k = t.select(c("l_orderkey").alias("call_id"), c("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("dt"))
    return k.join(F.broadcast(days), "dt")  # a row a date


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as calls: side, entry type, horizon and confidence follow from the event's number."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    i, v = c("event_id"), c("value")
    up = i % 2 == 0
    e = e.select(
        i.alias("call_id"), i.alias("msg_id"), F.lit(0).alias("pos"), c("user_id").alias("instrument_id"), (c("user_id") % 10).alias("channel_id"), c("ts"),
        F.when(i % 7 == 0, "option").otherwise("equity").alias("kind"), F.when(up, "long").otherwise("short").alias("side"),
        F.element_at(F.array(*map(F.lit, ("at", "above", "below", "none"))), (i % 4 + 1).cast("int")).alias("entry_type"),
        v.alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.when(up, F.array(v * 1.2, v * 1.4)).otherwise(F.array(v * 0.8, v * 0.6)).alias("targets"), F.when(up, v * 0.8).otherwise(v * 1.2).alias("stop"),
        F.element_at(F.array(*map(F.lit, ("intraday", "btst", "swing", "positional", "unspecified"))), (i % 5 + 1).cast("int")).alias("horizon"),
        F.when(i % 11 == 0, "low").otherwise("high").alias("confidence"),
    )
    days = calendar(spark, sf_dir)
    placed = place(e, days).crossJoin(F.broadcast(days.agg(F.max("d").alias("last_day"))))
    expiry = F.when(c("kind") == "option", c("day") + 7)
    return placed.withColumn("expiry_day", expiry).withColumn("settlement", F.lit(None).cast("double")).withColumn("announced", c("call_id") % 3 == 0)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks as result posts on their user's channel; every fifth replies to the event at the fifty before it, which may be a call."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    i = c("event_id")
    e = e.select(
        i.alias("post_id"), (c("user_id") % 10).alias("channel_id"), c("ts"), F.when(i % 3 == 0, c("user_id")).alias("named"), F.when(i % 5 == 0, i - i % 50).cast("long").alias("reply_to"),
        F.when(c("event_type") == "purchase", "target-hit").when(i % 2 == 0, "stop-hit").otherwise("profit").alias("kind"),
        (c("event_type") == "purchase").alias("claims_target"), F.when(i % 4 == 1, c("value")).alias("quoted"),
    )
    return day_before(e.withColumn("__date", ist_date(c("ts"))), calendar(spark, sf_dir), "__date").drop("__date")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as channels of messages, 8 minutes apart and every third time 33."""
    m = table(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + c("conv_id") * 86_400 + c("turn") * 480 + F.floor(c("turn") / 3) * 1_500)
    return m.select(c("conv_id").alias("channel_id"), c("turn").alias("msg_id"), ts.alias("ts"), "role", "text")


#: The same views as common table expressions, for the oracle queries.
SQL_VIEWS = """
raw AS (SELECT user_id AS instrument_id, CAST(ts AS DATE) AS dt, min_by(value, ts) AS o, max(value) AS h, min(value) AS l, max_by(value, ts) AS c, count(*) AS v FROM events GROUP BY 1, 2),
cal AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS d FROM (SELECT DISTINCT dt FROM raw WHERE dayofweek(dt) <> 0)),
bars AS (SELECT instrument_id, d, dt, o, h, l, c, v FROM raw JOIN cal USING (dt)),
cal7 AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS d FROM (SELECT DISTINCT dt FROM raw)),
bars7 AS (SELECT instrument_id, d, dt, o, h, l, c, v FROM raw JOIN cal7 USING (dt)),
lastd AS (SELECT max(d) AS last_day FROM cal),
sig AS (SELECT event_id AS call_id, user_id AS instrument_id, user_id % 10 AS channel_id, ts, event_id % 2 = 0 AS up, value AS lo, value,
  CASE WHEN event_id % 7 = 0 THEN 'option' ELSE 'equity' END AS kind, ['at', 'above', 'below', 'none'][event_id % 4 + 1] AS entry_type,
  ['intraday', 'btst', 'swing', 'positional', 'unspecified'][event_id % 5 + 1] AS horizon, CASE WHEN event_id % 11 = 0 THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN event_id % 2 = 0 THEN value * 0.8 ELSE value * 1.2 END AS stop, CASE WHEN event_id % 2 = 0 THEN [value * 1.2, value * 1.4] ELSE [value * 0.8, value * 0.6] END AS targets,
  CAST(ts + INTERVAL 330 MINUTE AS DATE) AS idate, hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE) AS imin FROM events WHERE event_type = 'signup'),
placed AS (SELECT sig.*, cal.d AS fwd, cal.dt = idate AS trading FROM sig ASOF JOIN cal ON sig.idate <= cal.dt),
calls AS (SELECT p.*, CASE WHEN NOT trading THEN 'closed-day' WHEN imin < 555 THEN 'before-open' WHEN imin < 930 THEN 'in-session' ELSE 'after-close' END AS session,
  fwd + CASE WHEN trading AND imin >= 930 THEN 1 ELSE 0 END AS day, CASE WHEN trading AND imin >= 555 AND imin < 930 THEN imin - 555 END AS minutes_in, last_day,
  CASE WHEN kind = 'option' THEN fwd + CASE WHEN trading AND imin >= 930 THEN 1 ELSE 0 END + 7 END AS expiry_day, call_id % 3 = 0 AS announced
  FROM placed p, lastd WHERE fwd + CASE WHEN trading AND imin >= 930 THEN 1 ELSE 0 END <= last_day),
posts AS (SELECT event_id AS post_id, user_id % 10 AS channel_id, ts, CASE WHEN event_id % 3 = 0 THEN user_id END AS named, CASE WHEN event_id % 5 = 0 THEN event_id - event_id % 50 END AS reply_to, value,
  CASE WHEN event_type = 'purchase' THEN 'target-hit' WHEN event_id % 2 = 0 THEN 'stop-hit' ELSE 'profit' END AS kind, event_type = 'purchase' AS claims_target,
  CASE WHEN event_id % 4 = 1 THEN value END AS quoted, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS idate FROM events WHERE event_type IN ('purchase', 'click')),
posts_u AS (SELECT posts.*, cal.d AS until FROM posts ASOF LEFT JOIN cal ON posts.idate >= cal.dt)
"""
