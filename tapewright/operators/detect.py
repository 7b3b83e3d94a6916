"""Patterns of price and volume around calls, result posts against prices, and the case study's rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import shape_windows

c = F.col
# The thresholds of the patterns, and the slack of claims.
SPIKE_GAIN, SPIKE_VOLUME, DUMP_FALL, PRE_GAIN, PRE_VOLUME, THIN = 0.08, 3.0, 0.15, 0.10, 3.0, 2_500_000.0
SLACK = 0.01


def shapes_at(calls: DataFrame, bars: DataFrame) -> DataFrame:
    """Each call with the shape at its first bar on or after its day; calls without 21 earlier bars have none."""
    shapes = shape_windows(bars)
    b = bars.select(c("instrument_id").alias("__i"), c("d").alias("__d"))
    near = calls.join(b, (c("instrument_id") == c("__i")) & (c("__d") >= c("day")), "left").groupBy("call_id").agg(F.min("__d").alias("__d"))
    return calls.join(near, "call_id").join(shapes.withColumnRenamed("d", "__d"), ["instrument_id", "__d"]).drop("__d", "rn")


def fires() -> dict:
    """The four patterns over shape columns. A pump is a spike as well; live flags keep the two apart."""
    spike = (c("post_gain") >= SPIKE_GAIN) & (c("post_volume") >= SPIKE_VOLUME)
    return {"spike": spike, "pump": spike & (c("fall") >= DUMP_FALL), "pre_run": (c("pre_gain") >= PRE_GAIN) & (c("pre_volume") >= PRE_VOLUME), "thin": (c("turnover") > 0) & (c("turnover") < THIN)}


def flags(shaped: DataFrame) -> DataFrame:
    """Rows (call_id, kind, stats, evidence): thin, pre-run, and spike or pump-shape."""
    f = fires()
    stats = lambda **k: F.create_map(*[x for name, col in k.items() for x in (F.lit(name), col.cast("double"))])
    # gains over a price of zero are infinite or undefined
    pct = lambda x: F.concat(F.when(F.abs(x) < 9e14, F.floor(x * 100 + 0.5).cast("string")).otherwise(x.cast("string")), F.lit("%"))
    times = lambda x: F.concat(F.when(x >= 10, F.floor(x + 0.5).cast("string")).otherwise(F.format_number(x, 1)), F.lit("x"))
    text = F.concat_ws
    rows = F.array(
        F.when(f["thin"], F.struct(F.lit("thin").alias("kind"), stats(turnover=c("turnover")).alias("stats"), text(" ", F.lit("Median daily turnover before the call, in lakh:"), F.floor(c("turnover") / 1e5 + 0.5).cast("string")).alias("evidence"))),
        F.when(f["pre_run"], F.struct(F.lit("pre-run").alias("kind"), stats(gain=c("pre_gain"), volume=c("pre_volume")).alias("stats"), text(" ", F.lit("Before the call up"), pct(c("pre_gain")), F.lit("on"), times(c("pre_volume")), F.lit("volume")).alias("evidence"))),
        F.when(f["pump"], F.struct(F.lit("pump-shape").alias("kind"), stats(gain=c("post_gain"), volume=c("post_volume"), fall=c("fall"), fallDays=c("fall_days")).alias("stats"), text(" ", F.lit("After the call up"), pct(c("post_gain")), F.lit("on"), times(c("post_volume")), F.lit("volume, then down"), pct(c("fall"))).alias("evidence"))).when(
            f["spike"], F.struct(F.lit("spike").alias("kind"), stats(gain=c("post_gain"), volume=c("post_volume")).alias("stats"), text(" ", F.lit("After the call up"), pct(c("post_gain")), F.lit("on"), times(c("post_volume")), F.lit("volume")).alias("evidence"))
        ),
    )
    return shaped.select("call_id", F.explode(F.array_compact(rows)).alias("f")).select("call_id", "f.*")


def expiry_day(calls: DataFrame, outcomes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Options bought on the last day of their contract; ``calls`` carries expiry."""
    days = F.broadcast(calendar.select(c("d").alias("__d"), "dt"))  # a row a trading day
    hit = calls.where("kind = 'option'").join(outcomes, "call_id").join(days, c("entry_day") == c("__d")).where("expiry = dt")
    return hit.select("call_id", F.lit("expiry-day").alias("kind"))


def sme_board(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Shares listed on the platform for small companies; ``symbols`` has instrument_id, series and sme."""
    small = symbols.where(c("sme") | c("series").isin("SM", "ST")).select("instrument_id")
    return calls.where("kind = 'equity'").join(small, "instrument_id", "left_semi").select("call_id", F.lit("sme-board").alias("kind"))


def examples(flagged: DataFrame, calls: DataFrame, most: int = 3) -> DataFrame:
    """The first three flags of a kind, one per instrument and day."""
    f = flagged.join(calls.select("call_id", "instrument_id", "day", "channel_id"), "call_id")
    one = f.groupBy("channel_id", "kind", "instrument_id", "day").agg(F.min("call_id").alias("call_id"))
    w = W.partitionBy("channel_id", "kind").orderBy("call_id")
    return one.withColumn("rn", F.row_number().over(w)).where(c("rn") <= most)


def ordinary_days(bars: DataFrame, marked: DataFrame, apart: int = 15, first: int = 30, tail: int = 12) -> DataFrame:
    """Every fifth bar of the marked instruments, far enough from any mark: an anti join on the instrument and a band."""
    w = W.partitionBy("instrument_id")
    n = bars.join(marked.select("instrument_id").distinct(), "instrument_id", "left_semi")
    n = n.withColumn("rn", F.row_number().over(w.orderBy("d")) - 1).withColumn("n", F.count("*").over(w))
    n = n.where(f"rn >= {first} AND rn < n - {tail} AND (rn - {first}) % 5 = 0").select("instrument_id", "d")
    m = marked.select(c("instrument_id").alias("__i"), c("day").alias("__m")).distinct()
    return n.join(m, (c("instrument_id") == c("__i")) & (F.abs(c("__m") - c("d")) < apart), "left_anti")


def case_rates(shaped: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Rates of the four patterns in each cohort."""
    f = fires()
    return shaped.groupBy(cohort).agg(F.count("*").alias("n"), *[F.count_if(x).alias(k) for k, x in f.items()])


def follow_through(calls: DataFrame, outcomes: DataFrame, posts: DataFrame) -> DataFrame:
    """Per channel: winners and how many were announced, losers and how many were mentioned or admitted.

    posts: call_id, kind. Outcomes are those of the likely reading; a result of exactly zero is a loss.
    """
    said = posts.groupBy("call_id").agg(F.count("*").alias("posts"), F.bool_or(c("kind").isin("target-hit", "profit")).alias("good"), F.bool_or(c("kind") == "stop-hit").alias("admitted"))
    t = calls.join(outcomes.where("move IS NOT NULL AND cls <> 'open'"), "call_id").join(said, "call_id", "left")
    win, lose = c("move") > 0, c("move") <= 0
    yes = lambda x: F.coalesce(x, F.lit(False))
    return t.groupBy("channel_id").agg(
        F.count_if(win).alias("winners"), F.count_if(win & yes(c("good"))).alias("winners_announced"),
        F.count_if(lose).alias("losers"), F.count_if(lose & c("posts").isNotNull()).alias("losers_mentioned"),
        F.count_if(lose & yes(c("admitted"))).alias("losers_admitted"), F.count_if(lose & c("posts").isNull()).alias("silent_losses"),
    )


def disputed(calls: DataFrame, outcomes: DataFrame, posts: DataFrame, bars: DataFrame) -> DataFrame:
    """Posts that claim a target or quote a price the instrument had not reached by then.

    posts: call_id, msg_id, until (last trading day on or before the post), claims_target, quoted.
    """
    t = posts.where("claims_target OR quoted IS NOT NULL").join(calls, "call_id").join(outcomes.where("entry_day IS NOT NULL").select("call_id", "entry_day", "entry_price"), "call_id")
    b = bars.select(c("instrument_id").alias("__i"), c("d").alias("__d"), "h", "l")
    hit = t.join(b, (c("instrument_id") == c("__i")) & c("__d").between(c("entry_day"), c("until")))
    g = hit.groupBy("call_id", "msg_id").agg(*[F.first(x).alias(x) for x in ("side", "targets", "claims_target", "quoted", "entry_price")], F.max("h").alias("top"), F.min("l").alias("low"))
    long = c("side") == "long"
    g = g.withColumn("reached", F.when(long, c("top")).otherwise(c("low")))
    short = lambda level: F.when(long, c("reached") < level * (1 - SLACK)).otherwise(c("reached") > level * (1 + SLACK))
    target = F.get("targets", F.lit(0))
    beyond = F.when(long, c("quoted") > c("entry_price")).otherwise(c("quoted") < c("entry_price"))
    unsupported = F.coalesce(c("claims_target") & short(target), F.lit(False))
    impossible = F.coalesce(short(c("quoted")) & beyond, F.lit(False))
    g = g.withColumn("why", F.when(unsupported, "unsupported").when(impossible, "impossible")).where("why IS NOT NULL")
    return g.select("call_id", "msg_id", "why", F.when(c("why") == "unsupported", target).otherwise(c("quoted")).alias("claimed"), "reached")
