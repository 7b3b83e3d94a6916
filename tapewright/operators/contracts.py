"""Which option or future a call means, what it settles at, and when it ends.

Every step is an equi join on symbol or contract with at most a few candidate
expiries a call; nothing is looked up call by call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import OFF_EXCHANGE
from ..functions.numbers import intrinsic
from ..sources.market import candidate_expiries
from .instruments import UNNAMED

c = F.col
#: Groups that calls on unnamed indices are dealt to.
SALTS = 64


def fits(entry_type: Column, lo: Column, hi: Column, low: Column, high: Column) -> Column:
    """Whether a day's bar (low, high; nulls for none) can have shown the quoted price: within 2 %, looser for above and below."""
    top = F.when(entry_type == "range", F.coalesce(hi, lo)).otherwise(lo)
    ok = (
        F.when((entry_type == "none") | lo.isNull(), True)
        .when(entry_type == "above", (high >= lo * 0.98) & (low <= lo * 1.6))
        .when(entry_type == "below", (low <= lo * 1.02) & (high >= lo * 0.6))
        .otherwise((top >= low * 0.98) & (lo <= high * 1.02))
    )
    return F.when(low.isNull(), False).otherwise(ok)


def day_index(dates: DataFrame, calendar: DataFrame, date: str = "expiry", out: str = "expiry_day") -> DataFrame:
    """Adds the trading-day index of a date: the first day on or after it; past the data 5/7 of the days beyond the last, one at least; null of a null date."""
    last = calendar.agg(F.max("dt").alias("__to"), F.max("d").alias("__last"))  # one row
    wanted = dates.select(date).distinct()
    # a map of the dates asked to days: each date meets the days of its week and the next, which holds a trading day
    near = wanted.withColumn("__dt", F.explode(F.sequence(c(date), F.date_add(date, 13)))).join(calendar.select(c("dt").alias("__dt"), "d"), "__dt").groupBy(date).agg(F.min("d").alias("__d"))
    days = wanted.join(near, date, "left").crossJoin(F.broadcast(last))
    beyond = F.greatest(F.lit(1), F.floor(F.datediff(c(date), c("__to")) * 5 / 7 + 0.5))
    days = days.select(date, F.coalesce("__d", c("__last") + beyond).cast("int").alias(out))
    return dates.join(days, date, "left")


def options(calls: DataFrame, expiries: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows (call_id, symbol, expiry, lot, rank, fits): of the expiries a call can mean the first whose bar of the day fits, else the first that traded.

    calls: call_id, symbol, strike, opt_type, entry_type, lo, hi, today, day,
    hint_day, hint_month. expiries: symbol, expiry, lot, has_options. bars:
    symbol, expiry, strike, opt_type, d, l, h of options.
    """
    key = ["symbol", "expiry", "strike", "opt_type"]
    asked = calls.select("call_id", "symbol", "strike", "opt_type", "entry_type", "lo", "hi", "today", "day", "hint_day", "hint_month")
    can = candidate_expiries(asked, expiries.where("has_options").select("symbol", "expiry", "lot")).withColumn("strike", c("strike").cast("double"))
    b = bars.select("symbol", "expiry", c("strike").cast("double").alias("strike"), "opt_type", "d", "l", "h")
    traded = can.join(b.select(*key).distinct(), key, "left_semi")
    day = traded.join(b.withColumnRenamed("d", "day"), [*key, "day"], "left")
    ok = fits(c("entry_type"), c("lo"), c("hi"), c("l"), c("h"))
    return day.withColumn("fits", ok).groupBy("call_id", "symbol").agg(F.min_by(F.struct("expiry", "lot", "rank", "fits"), F.struct(~c("fits"), "rank")).alias("x")).select("call_id", "symbol", "x.*")


def futures(calls: DataFrame, expiries: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows (call_id, symbol, expiry, lot): the nearest expiry a call can mean, if it traded at all; no later one is tried."""
    can = candidate_expiries(calls.select("call_id", "symbol", "today", "hint_day", "hint_month"), expiries.where("has_futures").select("symbol", "expiry", "lot")).where("rank = 1")
    return can.join(bars.select("symbol", "expiry").distinct(), ["symbol", "expiry"], "left_semi").select("call_id", "symbol", "expiry", "lot")


def settlements(chosen: DataFrame, spot: DataFrame) -> DataFrame:
    """Adds settlement: what an option is worth at the underlying's close of its expiry day; null where that is not known. chosen: symbol, expiry_day, strike, opt_type."""
    s = spot.select("symbol", c("d").alias("expiry_day"), "price")
    return chosen.join(s, ["symbol", "expiry_day"], "left").withColumn("settlement", F.when(c("price").isNotNull(), intrinsic(c("price"), c("strike"), c("opt_type")))).drop("price")


def spread_unnamed(calls: DataFrame, underlyings: DataFrame) -> DataFrame:
    """Calls on an index that is not named, once for each index; all others as they are.

    Calls are dealt to SALTS groups, each of which has all indices: an equi join that no single task does.
    """
    index = underlyings.where("kind = 'index'").select(c("symbol").alias("__s")).distinct().withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_calls = calls.where(c("symbol") == UNNAMED).withColumn("__g", F.pmod(F.xxhash64("call_id"), F.lit(SALTS)).cast("int"))
    rows = open_calls.join(index, "__g").withColumn("symbol", c("__s")).select(*calls.columns)
    return calls.where(c("symbol") != UNNAMED).unionByName(rows)


def inferred(outcomes: DataFrame) -> DataFrame:
    """Rows (call_id, reading, symbol, code): of a call tried on several indices the one whose prices fit; code is
    unknown-instrument where none or several do. outcomes: call_id, reading, symbol, entry_type, entry_price, entry_basis."""
    ok = c("entry_price").isNotNull() & (c("entry_basis") != "open")
    got = outcomes.groupBy("call_id", "reading").agg(F.count_if(ok).alias("n"), F.min(F.when(ok, c("symbol"))).alias("one"), F.first("entry_type").alias("entry_type"))
    known = (c("n") == 1) & (c("entry_type") != "none")
    return got.select("call_id", "reading", F.when(known, c("one")).alias("symbol"), F.when(~known, "unknown-instrument").alias("code"))


def unchecked(calls: DataFrame, underlyings: DataFrame, first_day: Column, stock_options_from: Column) -> DataFrame:
    """Adds code: why a call cannot be checked at all, the first reason that holds; null where it can.

    calls: ts, symbol, kind, strike, today (null where it comes after the data).
    before-data goes by the UTC date of the message.
    """
    u = underlyings.select(c("symbol").alias("__u"), c("kind").alias("__k")).dropDuplicates(["__u"])
    t = calls.join(u, c("symbol") == c("__u"), "left")
    outside = c("symbol").isin(*OFF_EXCHANGE) & c("__u").isNull()
    derivative = c("kind") != "equity"
    code = (
        F.when(c("today").isNull(), "too-recent")
        .when(F.to_date("ts") < first_day, "before-data")
        .when(outside, "off-exchange")
        .when(derivative & (c("symbol") != UNNAMED) & c("__u").isNull(), "unknown-instrument")
        .when((c("kind") == "option") & c("strike").isNull(), "unknown-instrument")
        .when((c("kind") == "option") & (c("__k") == "stock") & (c("today") < stock_options_from), "before-data")
    )
    return t.withColumn("code", code).drop("__u", "__k")
