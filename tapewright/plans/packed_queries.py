"""Queries that write the supplied events as a packed market and work on what its reader gives back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import shared_dir
from ..operators import replay
from ..sources import packed_source as S
from . import bindings as V
from .market_queries import _OUT, _REPLAY, _longs

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}
FIRST_EXPIRY = dt.date(2024, 1, 7)


def _expiry():
    return F.date_add(F.lit(FIRST_EXPIRY), (7 * F.floor(c("instrument_id") / 30)).cast("int"))


def market_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every third user's bars as a share, as two strikes of an option, or as a future; closes of derivatives as spot."""
    b = V.bars(spark, d).withColumn("of", c("instrument_id") % 3)
    under, null = F.concat(F.lit("U"), (c("instrument_id") % 30).cast("string")), F.lit(None)
    price = lambda add: [(c(x) + add).alias(x) for x in "ohlc"]
    day, volume = c("d").cast("int").alias("d"), c("v").cast("long").alias("v")
    cash = b.where("of = 0").select(F.lit("cash").alias("kind"), F.concat(F.lit("S"), c("instrument_id").cast("string")).alias("symbol"), null.cast("date").alias("expiry"), null.cast("double").alias("strike"), null.cast("string").alias("opt_type"), day, *price(0), volume)
    kind = F.when(c("instrument_id") % 2 == 0, "CE").otherwise("PE")
    options = [b.where("of = 1").select(F.lit("option").alias("kind"), under.alias("symbol"), _expiry().alias("expiry"), F.lit(k).alias("strike"), kind.alias("opt_type"), day, *price(k - 20), volume) for k in (20.0, 25.0)]
    future = b.where("of = 2").select(F.lit("future").alias("kind"), under.alias("symbol"), _expiry().alias("expiry"), null.cast("double").alias("strike"), null.cast("string").alias("opt_type"), day, *price(0), volume)
    spot = b.where("of > 0").groupBy(under.alias("symbol"), "d").agg(F.min("c").alias("c"))
    spot = spot.select(F.lit("spot").alias("kind"), "symbol", null.cast("date").alias("expiry"), null.cast("double").alias("strike"), null.cast("string").alias("opt_type"), day, *[null.cast("double").alias(x) for x in "ohl"], "c", null.cast("long").alias("v"))
    return cash.unionByName(options[0]).unionByName(options[1]).unionByName(future).unionByName(spot)


def packed(spark: SparkSession, d: str) -> str:
    """A folder with the rows as a packed market."""
    path = f"{shared_dir(spark)}/market-{uuid.uuid4().hex}"
    S.write_market(market_rows(spark, d), path, V.calendar(spark, d))
    return path


_MARKET = """, mb AS (SELECT *, instrument_id % 3 AS kd, 'U' || (instrument_id % 30) AS under, DATE '2024-01-07' + CAST(7 * (instrument_id // 30) AS INTEGER) AS ex FROM bars),
market AS (
  SELECT 'cash' AS kind, 'S' || instrument_id AS symbol, NULL::DATE AS expiry, NULL::DOUBLE AS strike, NULL::VARCHAR AS opt_type, d, o, h, l, c, v FROM mb WHERE kd = 0
  UNION ALL SELECT 'option', under, ex, k, CASE WHEN instrument_id % 2 = 0 THEN 'CE' ELSE 'PE' END, d, o + k - 20, h + k - 20, l + k - 20, c + k - 20, v FROM mb, (VALUES (20.0::DOUBLE), (25.0::DOUBLE)) s(k) WHERE kd = 1
  UNION ALL SELECT 'future', under, ex, NULL, NULL, d, o, h, l, c, v FROM mb WHERE kd = 2
  UNION ALL SELECT 'spot', under, NULL, NULL, NULL, d, NULL, NULL, NULL, min(c), NULL FROM mb WHERE kd > 0 GROUP BY under, d)
"""
_PRICES = ", ".join(f"floor({x} * 100 + 0.5) / 100 AS {x}" for x in "ohlc")


def _out(df: DataFrame) -> DataFrame:
    return df.select("kind", "symbol", "expiry", "strike", "opt_type", c("d").cast("long").alias("d"), *[(F.floor(c(x) * 100 + 0.5) / 100).alias(x) for x in "ohlc"], "v")


def src_market_open(spark: SparkSession, d: str) -> DataFrame:
    """src_cash, src_options, src_futures, src_spot and snk_market: every table of a packed market, written and read back."""
    return _out(S.market_bars(spark, packed(spark, d)))


def src_options(spark: SparkSession, d: str) -> DataFrame:
    """Options and futures of two underlyings that expire in one fortnight: of the others no file is opened."""
    until = FIRST_EXPIRY + dt.timedelta(days=14)
    return _out(S.market_bars(spark, packed(spark, d), ("option", "future"), ("U7", "U8"), FIRST_EXPIRY, until))


def replay_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Calls on options (the lower strike) and futures, replayed on the bars that the packed market's reader gives."""
    b = S.market_bars(spark, packed(spark, d), ("option", "future")).where("coalesce(strike, 20) = 20")
    key = F.concat_ws("|", "symbol", "expiry")
    under = F.concat(F.lit("U"), (c("instrument_id") % 30).cast("string"))
    k = V.calls(spark, d).where("instrument_id % 3 <> 0").withColumn("instrument_id", F.concat_ws("|", under, _expiry()))
    got = replay.replay(k, b.select(key.alias("instrument_id"), "d", "o", "h", "l", "c", "v"))
    return _longs(got, "entry_day", "exit_day", "days_held").drop("notes")


_ROWS = f"SELECT kind, symbol, expiry, strike, opt_type, d, {_PRICES}, v FROM market"
for f, sql in (
    (src_market_open, f"WITH {V.SQL_VIEWS}{_MARKET}{_ROWS}"),
    (src_options, f"WITH {V.SQL_VIEWS}{_MARKET}{_ROWS} WHERE kind IN ('option', 'future') AND symbol IN ('U7', 'U8') AND expiry BETWEEN DATE '2024-01-07' AND DATE '2024-01-21'"),
    (replay_contracts, f"WITH {V.SQL_VIEWS}{_REPLAY}SELECT {_OUT} FROM outcomes WHERE call_id IN (SELECT call_id FROM calls WHERE instrument_id % 3 <> 0)"),
):
    QUERIES[f.__name__], SQL[f.__name__] = f, sql
