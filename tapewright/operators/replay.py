"""Replay of calls on daily bars under three readings of what happened inside a day.

A bar's verdict depends on the entry and that bar alone, so the exit is the
first bar with a verdict: no state is carried, and no Python is needed. Bars
meet their calls in one equi join on the instrument with a bounded range of
days, and are gathered per call (at most the holding period). Everything after
that is array expressions; the three readings multiply rows, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import round2
from ..functions.plan import settle

# Fixed values of the replay rules.
TOLERANCE, TRIGGER_BARS, EARLY_MINUTES, EPS = 0.02, 3, 15, 0.003
SWING, POSITIONAL = 10, 60
READINGS = ("likely", "best", "worst")

c = F.col


def attach_bars(calls: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``bars``: of each call the bars from its first one on, as far as any rule can look, oldest first."""
    w = W.partitionBy("instrument_id").orderBy("d")
    b = bars.select(c("instrument_id").alias("__i"), "d", "o", "h", "l", "c", c("v").cast("long").alias("v"), F.lead("d", TRIGGER_BARS - 1).over(w).alias("third"), F.max("d").over(W.partitionBy("instrument_id")).alias("end"))
    # first bar: on the day, or up to two days later
    near = calls.join(b.select("__i", c("d").alias("d0"), F.coalesce("third", "end").alias("third")), (c("instrument_id") == c("__i")) & (c("d0") >= c("day")) & (c("d0") <= c("day") + 2), "left")
    first = near.groupBy("call_id").agg(F.min("d0").alias("d0"), F.min_by("third", "d0").alias("third"))
    keyed = calls.join(first, "call_id").withColumn("reach", F.greatest(c("third") + POSITIONAL, F.coalesce("expiry_day", F.lit(0))))
    hold = keyed.select("call_id", "instrument_id", "d0", "reach").join(b.drop("third", "end"), (c("instrument_id") == c("__i")) & (c("d") >= c("d0")) & (c("d") <= c("reach")))
    hold = hold.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("d", "o", "h", "l", "c", "v"))).alias("bars"))
    return keyed.join(hold, "call_id", "left").drop("d0", "third", "reach")


def _maybe(b: Column, level: Column, up: Column) -> Column:
    return F.when(up, b.h >= level).otherwise(b.l <= level)


def _sure(b: Column, level: Column, up: Column, high: Column, low: Column) -> Column:
    """Reached for certain after the entry, when the bar ranged from low to high before it; null range: all of it is after."""
    closed = F.when(up, b.c >= level).otherwise(b.c <= level)
    outside = F.when(up, level > high * (1 + EPS)).otherwise(level < low * (1 - EPS))
    return F.when(high.isNull(), _maybe(b, level, up)).otherwise(closed | (_maybe(b, level, up) & outside))


def _note(key: str, *args: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), (F.array(*[a.cast("string") for a in args]) if args else F.array().cast("array<string>")).alias("a"))


def _notes(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, note) for cond, note in pairs]))


def _exit(cls: str, k: Column, price: Column, basis: str) -> Column:
    return F.struct(F.lit(cls).alias("cls"), k.cast("int").alias("k"), price.cast("double").alias("price"), F.lit(basis).alias("basis"))


def replay(calls: DataFrame, bars: DataFrame, readings: tuple[str, ...] = READINGS) -> DataFrame:
    """One outcome per call and reading.

    calls: call_id, instrument_id, kind, side, entry_type, lo, hi, targets, stop,
    horizon, day, session, minutes_in, last_day, expiry_day, settlement, announced
    (null as false). Result: call_id, reading, cls, code, entry_day, entry_price,
    entry_basis, exit_day, exit_price, exit_basis, move, ret_pct, days_held, notes.
    """
    t = attach_bars(calls, bars).withColumn("reading", F.explode(F.array(*[F.lit(r) for r in readings])))
    # only the likely reading takes the channel's own announcement into account
    t = t.withColumn("best", (c("reading") == "best") | ((c("reading") == "likely") & F.coalesce("announced", F.lit(False))))
    t = t.withColumn("n", F.coalesce(F.size("bars"), F.lit(0))).withColumn("n", F.greatest("n", F.lit(0)))
    t = t.withColumn("up", c("side") == "long").withColumn("dir", F.when(c("up"), 1).otherwise(-1))
    t = t.withColumn("b0", F.get("bars", F.lit(0)))
    t = t.withColumn("live", (c("session") == "in-session") & (c("b0.d") == c("day"))).withColumn("early", c("live") & (F.coalesce("minutes_in", F.lit(10**6)) <= EARLY_MINUTES))
    t = t.withColumn("quoted", F.when(c("entry_type") == "range", (F.coalesce("lo", F.lit(0.0)) + F.coalesce("hi", F.lit(0.0))) / 2).when(c("entry_type") != "none", c("lo")))
    t = t.withColumn("breakout", c("quoted").isNotNull() & ((c("up") & (c("entry_type") == "above")) | (~c("up") & (c("entry_type") == "below"))))

    t = settle(t)
    # ---- entry
    window = F.when(c("horizon") == "intraday", 1).otherwise(TRIGGER_BARS)

    def touched(k: Column) -> Column:
        b = F.get("bars", k)
        high, low = F.when(c("early"), b.o).otherwise(b.h), F.when(c("early"), b.o).otherwise(b.l)
        inside = F.when(c("best"), _maybe(b, c("quoted"), c("up"))).otherwise(_sure(b, c("quoted"), c("up"), high, low))
        return F.when((k == 0) & c("live"), inside).otherwise(_maybe(b, c("quoted"), c("up")))

    ahead = F.when(c("n") > 0, F.sequence(F.lit(0), F.least(c("n"), window) - 1)).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("hit", F.when(c("breakout"), F.get(F.filter(ahead, touched), F.lit(0))))
    t = t.withColumn("i", F.coalesce("hit", F.lit(0))).withColumn("b", F.get("bars", c("i")))
    low_q, high_q = F.when(c("entry_type") == "range", F.coalesce("lo", "quoted")).otherwise(c("quoted")), F.when(c("entry_type") == "range", F.coalesce("hi", "quoted")).otherwise(c("quoted"))
    t = t.withColumn("traded", (high_q >= c("b.l") * (1 - TOLERANCE)) & (low_q <= c("b.h") * (1 + TOLERANCE)))
    t = t.withColumn("on_message", (c("i") == 0) & c("live"))
    t = t.withColumn("opened_beyond", c("breakout") & ~c("on_message") & F.when(c("up"), c("b.o") > c("quoted")).otherwise(c("b.o") < c("quoted")))
    none = c("quoted").isNull()
    t = t.withColumn(
        "code",
        F.when(c("n") == 0, "not-traded")
        .when(none & c("live") & (c("horizon") == "intraday"), "no-entry")
        .when(c("breakout") & c("hit").isNull(), "level-not-reached")
        .when(~none & ~c("breakout") & ~c("traded") & c("live"), "price-mismatch"),
    )
    clamped = F.least(F.greatest(c("quoted"), c("b.l")), c("b.h"))
    t = t.withColumn(
        "basis",
        F.when(none, F.when(c("live"), "close").otherwise("open")).when(c("breakout"), "trigger").when(c("traded"), "stated").otherwise("open"),
    )
    t = t.withColumn("entry", F.when(none & c("live"), c("b.c")).when(c("basis") == "open", c("b.o")).when(c("opened_beyond"), c("b.o")).otherwise(clamped))
    t = t.withColumn("scan", F.when(none & c("live"), c("i") + 1).otherwise(c("i")))
    t = t.withColumn("code", F.coalesce("code", F.when(~(c("entry") > 0), "not-traded")))
    # what the bar can have ranged over before the entry; null where all of it is after
    near = F.when(~c("on_message"), c("entry")).when(c("early"), F.when(c("up"), F.greatest("b.o", "entry")).otherwise(F.least("b.o", "entry")))
    t = t.withColumn(
        "before",
        F.when(c("basis") == "stated", F.when(c("early"), F.struct(F.greatest("b.o", "entry").alias("h"), F.least("b.o", "entry").alias("l"))).otherwise(F.struct(c("b.h").alias("h"), c("b.l").alias("l")))).when(
            (c("basis") == "trigger") & ~c("opened_beyond"), F.when(c("up"), F.struct(F.coalesce(near, "b.h").alias("h"), c("b.l").alias("l"))).otherwise(F.struct(c("b.h").alias("h"), F.coalesce(near, "b.l").alias("l")))
        ),
    )

    t = settle(t)
    # ---- levels and holding period
    t = t.withColumn("target", F.get(F.filter("targets", lambda x: c("dir") * (x - c("entry")) > 0), F.lit(0)))
    t = t.withColumn("stop_at", F.when(c("dir") * (c("entry") - c("stop")) > 0, c("stop")))
    derivative = c("kind") != "equity"
    t = t.withColumn("period", F.when((c("horizon") == "unspecified") & ~derivative, "swing").otherwise(c("horizon")))
    t = t.withColumn("entry_day", c("b.d"))
    t = t.withColumn(
        "hold",
        F.when(c("period") == "intraday", c("entry_day")).when(c("period") == "btst", c("entry_day") + 1).when(c("period") == "swing", c("entry_day") + SWING).when(c("period") == "positional", c("entry_day") + POSITIONAL).otherwise(F.coalesce(c("expiry_day"), c("entry_day") + SWING)),
    ).withColumn("hold", F.least("hold", "expiry_day"))

    t = settle(t)
    # ---- exit
    def verdict(k: Column) -> Column:
        b, d = F.get("bars", k), c("dir")
        later = k > c("i")
        high, low = F.when(~later, c("before.h")), F.when(~later, c("before.l"))
        t_maybe, s_maybe = _maybe(b, c("target"), c("up")), _maybe(b, c("stop_at"), ~c("up"))
        t_sure, s_sure = _sure(b, c("target"), c("up"), high, low), _sure(b, c("stop_at"), ~c("up"), high, low)
        hit_t = F.coalesce(F.when(c("best"), t_maybe).otherwise(t_sure), F.lit(False))
        hit_s = F.coalesce(F.when(c("best"), s_sure).otherwise(s_maybe), F.lit(False))
        beyond_t, beyond_s = F.coalesce(d * (b.o - c("target")) >= 0, F.lit(False)), F.coalesce(d * (b.o - c("stop_at")) <= 0, F.lit(False))
        next_open = (c("period") == "btst") & later
        at_expiry = c("expiry_day").isNotNull() & (b.d == c("expiry_day"))
        return (
            F.when(b.d > c("hold"), F.lit(None))
            .when(next_open & beyond_t, _exit("target", k, b.o, "next-open"))
            .when(next_open & beyond_s, _exit("stop", k, b.o, "next-open"))
            .when(next_open, _exit("horizon", k, b.o, "next-open"))
            .when(later & beyond_s, _exit("stop", k, b.o, "gap-open"))
            .when(later & beyond_t, _exit("target", k, b.o, "gap-open"))
            .when(hit_t & (~hit_s | c("best")), _exit("target", k, c("target"), "target"))
            .when(hit_s, _exit("stop", k, c("stop_at"), "stop"))
            .when((b.d == c("hold")) & at_expiry, _exit("expired", k, F.coalesce("settlement", b.c), "settlement"))
            .when(b.d == c("hold"), _exit("horizon", k, b.c, "close"))
        )

    steps = F.when(c("code").isNull() & (c("scan") < c("n")), F.sequence(c("scan"), c("n") - 1)).otherwise(F.array().cast("array<int>"))
    # the first verdict ends the search: bars after it are not looked at
    nothing = F.lit(None).cast("struct<cls:string,k:int,price:double,basis:string>")
    t = t.withColumn("out", F.aggregate(steps, nothing, lambda found, k: F.when(found.isNotNull(), found).otherwise(verdict(k).cast("struct<cls:string,k:int,price:double,basis:string>"))))
    t = settle(t)
    # nothing happened on any bar: settled, closed at the last price, or still running
    t = t.withColumn("k_last", F.greatest(c("i"), F.size(F.filter("bars", lambda b: b.d <= c("hold"))) - 1)).withColumn("b_last", F.get("bars", c("k_last")))
    settled = c("expiry_day").isNotNull() & (c("hold") == c("expiry_day")) & (c("expiry_day") <= c("last_day"))
    t = t.withColumn("quiet", c("code").isNull() & c("out").isNull())
    t = t.withColumn(
        "out",
        F.when(~c("quiet"), c("out"))
        .when(settled & c("settlement").isNotNull(), _exit("expired", F.lit(-1), c("settlement"), "settlement"))
        .when(settled, _exit("expired", c("k_last"), c("b_last.c"), "last-price"))
        .when(c("hold") > c("last_day"), _exit("open", c("k_last"), c("b_last.c"), "last-price"))
        .otherwise(_exit("horizon", c("k_last"), c("b_last.c"), "last-price")),
    )
    t = t.withColumn("out", F.when(c("code").isNull(), c("out")))
    t = settle(t)
    t = t.withColumn("exit_day", F.when(c("out.k") >= 0, F.get("bars", c("out.k")).d).otherwise(F.coalesce("expiry_day", "entry_day")))
    t = t.withColumn("raw_move", c("dir") * (c("out.price") - c("entry")))
    b_out, same_bar = F.get("bars", F.greatest(c("out.k"), F.lit(0))), c("out.k") == c("i")
    t_doubt = (c("out.basis") == "target") & same_bar & ~_sure(b_out, c("target"), c("up"), c("before.h"), c("before.l"))
    s_doubt = (c("out.basis") == "stop") & same_bar & ~_sure(b_out, c("stop_at"), ~c("up"), c("before.h"), c("before.l"))
    both = F.when(c("out.basis") == "target", F.when(same_bar, _sure(b_out, c("stop_at"), ~c("up"), c("before.h"), c("before.l"))).otherwise(_maybe(b_out, c("stop_at"), ~c("up")))).when(
        c("out.basis") == "stop", F.when(same_bar, _sure(b_out, c("target"), c("up"), c("before.h"), c("before.l"))).otherwise(_maybe(b_out, c("target"), c("up")))
    )
    entered = c("code").isNull()
    many = F.size("targets") > 0
    notes = _notes(
        ((c("n") > 0) & (c("b0.d") > c("day")), _note("nextTradedDay")),
        (entered & none & c("live"), _note("enteredAtClose")),
        (entered & none & ~c("live"), _note("enteredAtNextOpen")),
        (entered & c("opened_beyond"), _note("openedPast")),
        (entered & ~none & ~c("breakout") & ~c("traded"), _note("quotedNotTraded", round2(c("quoted")))),
        (entered & many & c("target").isNull(), _note("targetIgnored")),
        (entered & c("stop").isNotNull() & c("stop_at").isNull(), _note("stopIgnored")),
        (entered & (F.size("targets") > 1) & c("target").isNotNull(), _note("firstTarget")),
        (entered & (c("horizon") == "unspecified") & ~derivative, _note("noPeriodShare", F.lit(SWING))),
        (entered & (c("horizon") == "unspecified") & derivative, _note("noPeriodContract")),
        (entered & ~c("quiet") & F.coalesce(both, F.lit(False)), _note("bothSameDay")),
        (entered & ~F.coalesce(both, F.lit(False)) & F.coalesce(t_doubt, F.lit(False)), _note("targetDoubtful")),
        (entered & ~F.coalesce(both, F.lit(False)) & F.coalesce(s_doubt, F.lit(False)), _note("stopDoubtful")),
        (c("quiet") & (c("out.basis") == "settlement"), _note("settledAtExpiry")),
        (c("quiet") & (c("out.cls") == "expired") & (c("out.basis") == "last-price"), _note("closedAtLastPrice")),
        (c("quiet") & (c("out.cls") == "open"), _note("stillRunning")),
        (c("quiet") & (c("out.cls") == "horizon"), _note("noTradesLastDay")),
    )
    cls = F.when(c("code") == "level-not-reached", "not-triggered").when(c("code").isNotNull(), "unverifiable").otherwise(c("out.cls"))
    known = lambda x: F.when(entered, x)
    return settle(t.select(
        "call_id", "reading", cls.alias("cls"), "code",
        known(c("entry_day")).alias("entry_day"), known(round2(c("entry"))).alias("entry_price"), known(c("basis")).alias("entry_basis"),
        known(c("exit_day")).alias("exit_day"), round2(c("out.price")).alias("exit_price"), c("out.basis").alias("exit_basis"),
        known(round2(c("raw_move"))).alias("move"), known(round2(c("raw_move") / c("entry") * 100)).alias("ret_pct"), known(c("exit_day") - c("entry_day")).alias("days_held"),
        notes.alias("notes"),
    ))


def firm(outcomes: DataFrame) -> DataFrame:
    """Per call: whether best and worst reading agree on class, prices and exit day; null where neither entered."""
    key = F.struct("cls", "exit_price", "entry_price", "exit_day")
    wide = outcomes.groupBy("call_id").agg(*[F.max(F.when(c("reading") == r, key)).alias(r) for r in ("best", "worst")])
    entered = c("best.entry_price").isNotNull() | c("worst.entry_price").isNotNull()
    same = F.lit(True)
    for f in ("cls", "exit_price", "entry_price", "exit_day"):
        same = same & c(f"best.{f}").eqNullSafe(c(f"worst.{f}"))
    return wide.select("call_id", F.when(entered, same).alias("firm"))


def differing(outcomes: DataFrame) -> DataFrame:
    """Outcomes of the best and worst reading that differ from the likely one in class, prices or exit day."""
    likely = outcomes.where(c("reading") == "likely").select("call_id", *[c(f).alias(f"__{f}") for f in ("cls", "exit_price", "entry_price", "exit_day")])
    other = outcomes.where(c("reading") != "likely").join(likely, "call_id")
    same = F.lit(True)
    for f in ("cls", "exit_price", "entry_price", "exit_day"):
        same = same & c(f).eqNullSafe(c(f"__{f}"))
    return other.where(~same).select(*outcomes.columns)


def around(outcomes: DataFrame, calls: DataFrame, bars: DataFrame, margin: int = 6) -> DataFrame:
    """Per outcome the bars from six before the entry to six after the exit, counted in bars."""
    w = W.partitionBy("instrument_id").orderBy("d")
    b = bars.select(c("instrument_id").alias("__i"), "d", "o", "h", "l", "c", F.lead("d", margin).over(w).alias("after"), F.lag("d", margin).over(w).alias("before"))
    o = outcomes.where("entry_day IS NOT NULL").join(calls.select("call_id", "instrument_id"), "call_id")
    # a bar is in the slice unless more than six bars stand between it and the holding period
    hit = o.join(b, (c("instrument_id") == c("__i")) & (F.coalesce("after", F.lit(2**30)) >= c("entry_day")) & (F.coalesce("before", F.lit(-(2**30))) <= c("exit_day")))
    return hit.groupBy("call_id", "reading").agg(F.array_sort(F.collect_list(F.struct("d", "o", "h", "l", "c"))).alias("bars"))
