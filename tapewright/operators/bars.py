"""Daily bars: building, splits, and the windows that describe price and volume around a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import clamp, fraction_table, ratio


def from_ticks(ticks: DataFrame, instrument: str, ts: str, price: str) -> DataFrame:
    """Open, high, low, close and count of each instrument's day; one aggregation."""
    return (
        ticks.groupBy(F.col(instrument).alias("instrument_id"), F.to_date(ts).alias("dt"))
        .agg(F.min_by(price, ts).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, ts).alias("c"), F.count("*").alias("v"))
    )


def trading_calendar(bars: DataFrame, closed: Column) -> DataFrame:
    """Dense day index of the dates that have bars and are not closed."""
    days = bars.select("dt").distinct().where(~closed)
    return days.select((F.row_number().over(W.orderBy("dt")) - 1).alias("d"), "dt")


def traded_close(o: str = "c", last: str = "last") -> Column:
    """The close, or the last trade drawn into the day's range when the close is outside it."""
    c = F.col(o)
    return F.when(c.between(F.col("l"), F.col("h")), c).otherwise(clamp(F.col(last), F.col("l"), F.col("h")))


# What counts as a price restated overnight, and how near a simple fraction must be.
RESTATED, BEYOND_BAND, NEAR_WHOLE, NEAR = 0.01, 0.21, 0.05, 0.015


def split_factors(bars: DataFrame, previous: str | None = None) -> DataFrame:
    """Rows (instrument_id, d, factor) of days whose price scale changed.

    The factor is the restated previous close over the last close, and the open
    over that, as far as either is out of the ordinary; it becomes the simplest
    near fraction, or stays as it is. ``previous`` names the column of restated
    previous closes; without one the last close stands for it.
    """
    w = W.partitionBy("instrument_id").orderBy("d")
    last = F.lag("c").over(w)
    t = bars.select("instrument_id", "d", "o", last.alias("last"), (F.col(previous) if previous else last).alias("prev")).where("last > 0 AND prev > 0 AND o > 0")
    part = lambda x, far: F.when(F.abs(x - 1) > far, x).otherwise(1.0)
    t = t.withColumn("raw", part(F.col("prev") / F.col("last"), RESTATED) * part(F.col("o") / F.col("prev"), BEYOND_BAND)).where("raw <> 1")
    table = F.broadcast(bars.sparkSession.createDataFrame(fraction_table(), "a int, b int, f double"))  # some 200 rows, fixed
    near = F.abs(F.col("f") / F.col("raw") - 1) < F.when(F.col("a") == 1, NEAR_WHOLE).otherwise(NEAR)
    t = t.join(table, near, "left").groupBy("instrument_id", "d").agg(F.min_by("f", F.struct(F.col("a") + F.col("b"), "a")).alias("f"), F.first("raw").alias("raw"))
    return t.select("instrument_id", "d", (F.floor(F.coalesce("f", "raw") * 1e5 + 0.5) / 1e5).alias("factor"))


def in_terms_of(bars: DataFrame, splits: DataFrame, day: str = "day") -> DataFrame:
    """Bars restated to a day: prices divided by, volumes times, the product of splits between that day and the bar. ``bars`` carries call_id and the day."""
    s = splits.select(F.col("instrument_id").alias("__i"), F.col("d").alias("__d"), "factor")
    hit = bars.join(s, (F.col("instrument_id") == F.col("__i")) & (F.col(day) < F.col("__d")) & (F.col("__d") <= F.col("d")), "left")
    k = hit.groupBy("call_id", "instrument_id", "d").agg(F.coalesce(F.product("factor"), F.lit(1.0)).alias("k"))
    both = bars.join(k, ["call_id", "instrument_id", "d"])
    return both.select(*[(F.col(c) / F.col("k")).alias(c) if c in "ohlc" else F.floor(F.col(c) * F.col("k") + 0.5).alias(c) if c == "v" else F.col(c) for c in bars.columns])


def shape_windows(bars: DataFrame) -> DataFrame:
    """Per bar: the measures of price and volume before and after it, in one window pass plus a bounded self join.

    Columns base_vol, recent_vol, turnover (medians), pre_gain, pre_volume,
    post_gain, post_volume, peak, fall, fall_days, complete. Only bars with 21
    earlier ones have them. Prices of zero give infinite and undefined gains and falls.
    """
    w = W.partitionBy("instrument_id").orderBy("d")
    median = lambda x, a, b: F.expr(f"percentile({x}, 0.5)").over(w.rowsBetween(a, b))
    n = bars.withColumn("rn", F.row_number().over(w) - 1)
    n = n.select(
        "*",
        median("v", -25, -6).alias("base_vol"),
        median("v", -20, -1).alias("recent_vol"),
        median("v * c", -20, -1).alias("turnover"),
        F.lag("c", 1).over(w).alias("c1"),
        F.lag("c", 6).over(w).alias("c6"),
        F.max("v").over(w.rowsBetween(-5, -1)).alias("vmax_before"),
        F.max("c").over(w.rowsBetween(0, 2)).alias("cmax_after"),
        F.max("v").over(w.rowsBetween(0, 2)).alias("vmax_after"),
        F.max(F.struct("h", -F.col("rn"))).over(w.rowsBetween(0, 5)).alias("top"),
        # the closes of the ten bars after any of the six the peak can be
        F.collect_list(F.struct("rn", "c")).over(w.rowsBetween(1, 15)).alias("next"),
    ).where("rn >= 21")
    n = n.withColumn("peak", F.col("top.h")).withColumn("peak_rn", -F.col("top.col2"))
    n = n.withColumn("later", F.expr("filter(next, x -> x.rn > peak_rn AND x.rn <= peak_rn + 10)"))
    low = F.when(F.size("later") > 0, F.array_min(F.col("later.c"))).otherwise(F.col("peak"))
    return n.select(
        "instrument_id", "d", "rn", "base_vol", "recent_vol", "turnover",
        (ratio(F.col("c1"), F.col("c6")) - 1).alias("pre_gain"),
        F.when(F.col("base_vol") > 0, F.col("vmax_before") / F.col("base_vol")).otherwise(0.0).alias("pre_volume"),
        (ratio(F.col("cmax_after"), F.col("c1")) - 1).alias("post_gain"),
        F.when(F.col("recent_vol") > 0, F.col("vmax_after") / F.col("recent_vol")).otherwise(0.0).alias("post_volume"),
        "peak",
        (1 - ratio(low, F.col("peak"))).alias("fall"),
        F.when(F.size("later") > 0, F.array_position(F.col("later.c"), low)).otherwise(0).cast("int").alias("fall_days"),
        (F.size("later") >= 5).alias("complete"),
    )
