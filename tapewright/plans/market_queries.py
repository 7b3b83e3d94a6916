"""Queries over bars and calls, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.plan import written
from ..operators import bars as B
from ..operators import contracts, detect, ledger, linking, replay, report
from . import bindings as V

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and its SQL with the shared views in front."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql if sql.lstrip().upper().startswith("SELECT") and " FROM " in sql and "/*own*/" in sql else f"WITH {V.SQL_VIEWS}{sql}"
        return f

    return put


R4 = "floor({} * 10000 + 0.5) / 10000"


def r4(x, out: str):
    # past 9e14 a double has no fourth decimal, and its 10,000-fold is no long; infinite and undefined values stay
    return F.when(F.abs(x) < 9e14, F.floor(x * 10000 + 0.5) / 10000).otherwise((x * 10000 + 0.5) / 10000).alias(out)


@query("SELECT instrument_id, d::BIGINT AS d, o, h, l, c, v FROM bars")
def src_cash(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of every instrument."""
    return V.bars(spark, d).select("instrument_id", c("d").cast("long").alias("d"), "o", "h", "l", "c", "v")


@query("SELECT call_id, session, day::BIGINT AS day, minutes_in::BIGINT AS minutes_in FROM calls".replace("SELECT", " SELECT", 1))
def jn_calendar(spark, d):
    """Messages placed on the calendar: session and first day they can act on."""
    return V.calls(spark, d).select("call_id", "session", c("day").cast("long").alias("day"), c("minutes_in").cast("long").alias("minutes_in"))


@query("SELECT session, count(*) AS n FROM calls GROUP BY session")
def fn_session(spark, d):
    return V.calls(spark, d).groupBy("session").agg(F.count("*").alias("n"))


@query("SELECT post_id, until::BIGINT AS until FROM posts_u")
def jn_day_before(spark, d):
    """Last trading day on or before each post."""
    return V.posts(spark, d).select("post_id", c("until").cast("long").alias("until"))


@query("SELECT event_id, strftime(CAST(ts + INTERVAL 330 MINUTE AS DATE), '%d-%b-%Y') AS pretty, hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE) AS minutes FROM events")
def fn_ist(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", dates.pretty(dates.ist_date(c("ts"))).alias("pretty"), dates.ist_minutes(c("ts")).cast("long").alias("minutes"))


_SHAPES = """, w AS (SELECT *, row_number() OVER i - 1 AS rn,
  median(v) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN 25 PRECEDING AND 6 PRECEDING) AS base_vol,
  median(v) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS recent_vol,
  median(v * c) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS turnover,
  lag(c, 1) OVER i AS c1, lag(c, 6) OVER i AS c6, max(v) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS vb,
  max(c) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ca, max(v) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS va,
  max(h) OVER (PARTITION BY instrument_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS peak FROM bars7 WINDOW i AS (PARTITION BY instrument_id ORDER BY d)),
pk AS (SELECT w.instrument_id, w.rn, min(x.rn) AS prn FROM w JOIN w x ON x.instrument_id = w.instrument_id AND x.rn BETWEEN w.rn AND w.rn + 5 AND x.h = w.peak GROUP BY 1, 2),
fl AS (SELECT pk.instrument_id, pk.rn, min(x.c) AS trough, count(x.c) AS later, arg_min(x.rn, x.c) - any_value(prn) AS fall_days FROM pk LEFT JOIN w x ON x.instrument_id = pk.instrument_id AND x.rn BETWEEN prn + 1 AND prn + 10 GROUP BY 1, 2),
shapes AS (SELECT w.*, c1 / c6 - 1 AS pre_gain, CASE WHEN base_vol > 0 THEN vb / base_vol ELSE 0 END AS pre_volume, ca / c1 - 1 AS post_gain, CASE WHEN recent_vol > 0 THEN va / recent_vol ELSE 0 END AS post_volume,
  1 - coalesce(trough, peak) / peak AS fall, coalesce(fl.fall_days, 0) AS fall_days, later >= 5 AS complete FROM w JOIN fl USING (instrument_id, rn) WHERE w.rn >= 21)
"""
_COLS = ("base_vol", "recent_vol", "turnover", "pre_gain", "pre_volume", "post_gain", "post_volume")


@query(_SHAPES + "SELECT instrument_id, d, " + ", ".join(f"{R4.format(x)} AS {x}" for x in _COLS) + " FROM shapes")
def win_shapes(spark, d):
    """win_base_vol, win_recent_vol, win_turnover, win_pre, win_post, win_guard in one window pass."""
    s = B.shape_windows(V.bars(spark, d, sundays=True))
    return s.select("instrument_id", c("d").cast("long").alias("d"), *[r4(c(x), x) for x in _COLS])


@query(_SHAPES + f"SELECT instrument_id, d, {R4.format('peak')} AS peak, {R4.format('fall')} AS fall, fall_days::BIGINT AS fall_days, complete FROM shapes")
def win_peak_fall(spark, d):
    s = B.shape_windows(V.bars(spark, d, sundays=True))
    return s.select("instrument_id", c("d").cast("long").alias("d"), r4(c("peak"), "peak"), r4(c("fall"), "fall"), c("fall_days").cast("long").alias("fall_days"), "complete")


@query("SELECT instrument_id, coalesce(median(v), 0)::DOUBLE AS median_volume FROM bars GROUP BY 1")
def agg_median(spark, d):
    return V.bars(spark, d).groupBy("instrument_id").agg(F.coalesce(F.expr("percentile(v, 0.5)"), F.lit(0.0)).alias("median_volume"))


_FRACTIONS = """, fr AS (SELECT a, n - a AS b, a::DOUBLE / (n - a) AS f FROM range(3, 22) r(n), range(1, 21) q(a) WHERE a < n AND a <> n - a),
ad AS (SELECT instrument_id, d, CASE WHEN abs(o / lc - 1) > 0.21 THEN o / lc ELSE 1 END AS raw FROM (SELECT instrument_id, d, o, lag(c) OVER (PARTITION BY instrument_id ORDER BY d) AS lc FROM bars) WHERE lc > 0 AND o > 0),
sp AS (SELECT instrument_id, d, floor(coalesce(arg_min(f, (a + b) * 100 + a) FILTER (abs(f / raw - 1) < CASE WHEN a = 1 THEN 0.05 ELSE 0.015 END), any_value(raw)) * 100000 + 0.5) / 100000 AS factor FROM ad, fr WHERE raw <> 1 GROUP BY 1, 2)
"""


@query(_FRACTIONS + "SELECT instrument_id, d, factor FROM sp")
def win_adjust(spark, d):
    """fn_fraction as well: overnight changes of scale, snapped to simple fractions."""
    return B.split_factors(V.bars(spark, d)).select("instrument_id", c("d").cast("long").alias("d"), "factor")


@query(
    ", s AS (SELECT instrument_id, d FROM bars WHERE instrument_id % 10 = 0 AND d % 9 = 5), j AS (SELECT call_id, b.instrument_id, b.d, b.o, b.v, count(s.d) AS n FROM calls k JOIN bars b ON k.instrument_id = b.instrument_id AND b.d BETWEEN k.day AND k.day + 15 LEFT JOIN s ON s.instrument_id = b.instrument_id AND s.d > k.day AND s.d <= b.d GROUP BY ALL) "
    "SELECT call_id, d, " + R4.format("(o / pow(0.5, n))") + " AS o, floor(v * pow(0.5, n) + 0.5)::BIGINT AS v FROM j"
)
def jn_splits(spark, d):
    """Bars of each call restated to its day, under halvings on fixed days of every tenth instrument."""
    b = V.bars(spark, d)
    splits = b.where("instrument_id % 10 = 0 AND d % 9 = 5").select("instrument_id", "d", F.lit(0.5).alias("factor"))
    k = V.calls(spark, d).select("call_id", c("instrument_id").alias("__i"), "day")
    held = b.join(k, (c("instrument_id") == c("__i")) & c("d").between(c("day"), c("day") + 15)).drop("__i")
    return B.in_terms_of(held, splits).select("call_id", c("d").cast("long").alias("d"), r4(c("o"), "o"), c("v").cast("long").alias("v"))


# ---- replay

_REPLAY = """, bn AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY d) AS n FROM bars),
f0 AS (SELECT k.*, CASE WHEN up THEN 1 ELSE -1 END AS dir, (SELECT min(n) FROM bn b WHERE b.instrument_id = k.instrument_id AND b.d BETWEEN k.day AND k.day + 2) AS n0 FROM calls k),
f1 AS (SELECT f0.*, b.d AS d0, b.o AS o0, session = 'in-session' AND b.d = day AS live FROM f0 LEFT JOIN bn b ON b.instrument_id = f0.instrument_id AND b.n = n0),
f2 AS (SELECT f1.*, reading, reading = 'best' OR (reading = 'likely' AND announced) AS best, live AND coalesce(minutes_in, 999999) <= 15 AS early,
  CASE WHEN entry_type <> 'none' THEN lo END AS q, (up AND entry_type = 'above') OR (NOT up AND entry_type = 'below') AS brk FROM f1, (VALUES ('likely'), ('best'), ('worst')) r(reading)),
trg AS (SELECT call_id, reading, min(b.n) AS nh FROM f2 JOIN bn b ON b.instrument_id = f2.instrument_id AND b.n BETWEEN n0 AND n0 + CASE WHEN horizon = 'intraday' THEN 0 ELSE 2 END
  WHERE brk AND CASE WHEN b.n = n0 AND live AND NOT best THEN CASE WHEN up THEN b.c >= q OR (b.h >= q AND q > (CASE WHEN early THEN b.o ELSE b.h END) * 1.003) ELSE b.c <= q OR (b.l <= q AND q < (CASE WHEN early THEN b.o ELSE b.l END) * 0.997) END
    ELSE CASE WHEN up THEN b.h >= q ELSE b.l <= q END END GROUP BY 1, 2),
f3 AS (SELECT f2.*, coalesce(nh, n0) AS n1, nh, b.d AS entry_day, b.o, b.h, b.l, b.c, q >= b.l * 0.98 AND q <= b.h * 1.02 AS traded FROM f2 LEFT JOIN trg USING (call_id, reading) LEFT JOIN bn b ON b.instrument_id = f2.instrument_id AND b.n = coalesce(nh, n0)),
f4 AS (SELECT *, brk AND NOT (n1 = n0 AND live) AND CASE WHEN up THEN o > q ELSE o < q END AS beyond,
  CASE WHEN n0 IS NULL THEN 'not-traded' WHEN q IS NULL AND live AND horizon = 'intraday' THEN 'no-entry' WHEN brk AND nh IS NULL THEN 'level-not-reached' WHEN q IS NOT NULL AND NOT brk AND NOT traded AND live THEN 'price-mismatch' END AS code0,
  CASE WHEN q IS NULL THEN CASE WHEN live THEN 'close' ELSE 'open' END WHEN brk THEN 'trigger' WHEN traded THEN 'stated' ELSE 'open' END AS basis FROM f3),
f5 AS (SELECT *, CASE WHEN basis = 'close' THEN c WHEN basis = 'open' OR beyond THEN o ELSE least(greatest(q, l), h) END AS e FROM f4),
f6 AS (SELECT *, coalesce(code0, CASE WHEN NOT e > 0 THEN 'not-traded' END) AS code,
  CASE WHEN basis = 'stated' THEN CASE WHEN early THEN greatest(o, e) ELSE h END WHEN basis = 'trigger' AND NOT beyond THEN CASE WHEN NOT up THEN h WHEN NOT (n1 = n0 AND live) THEN e WHEN early THEN greatest(o, e) ELSE h END END AS bh,
  CASE WHEN basis = 'stated' THEN CASE WHEN early THEN least(o, e) ELSE l END WHEN basis = 'trigger' AND NOT beyond THEN CASE WHEN up THEN l WHEN NOT (n1 = n0 AND live) THEN e WHEN early THEN least(o, e) ELSE l END END AS bl,
  list_filter(targets, lambda x: dir * (x - e) > 0)[1] AS t, CASE WHEN dir * (e - stop) > 0 THEN stop END AS s, CASE WHEN horizon = 'unspecified' AND kind = 'equity' THEN 'swing' ELSE horizon END AS period FROM f5),
f7 AS (SELECT *, least(CASE period WHEN 'intraday' THEN entry_day WHEN 'btst' THEN entry_day + 1 WHEN 'swing' THEN entry_day + 10 WHEN 'positional' THEN entry_day + 60 ELSE expiry_day END, coalesce(expiry_day, 999999)) AS hold FROM f6),
x0 AS (SELECT f.call_id, f.reading, f.best, f.up, f.dir, f.t, f.s, f.period, f.hold, f.expiry_day, f.bh, f.bl, f.n1, b.n, b.d, b.o, b.h, b.l, b.c, b.n > f.n1 AS later FROM f7 f JOIN bn b ON b.instrument_id = f.instrument_id AND b.n >= f.n1 + CASE WHEN f.basis = 'close' THEN 1 ELSE 0 END AND b.d <= f.hold WHERE f.code IS NULL),
x1 AS (SELECT *, CASE WHEN up THEN h >= t ELSE l <= t END AS tm, CASE WHEN up THEN l <= s ELSE h >= s END AS sm,
  CASE WHEN later OR bh IS NULL THEN CASE WHEN up THEN h >= t ELSE l <= t END ELSE CASE WHEN up THEN c >= t OR (h >= t AND t > bh * 1.003) ELSE c <= t OR (l <= t AND t < bl * 0.997) END END AS ts,
  CASE WHEN later OR bh IS NULL THEN CASE WHEN up THEN l <= s ELSE h >= s END ELSE CASE WHEN up THEN c <= s OR (l <= s AND s < bl * 0.997) ELSE c >= s OR (h >= s AND s > bh * 1.003) END END AS ss FROM x0),
x2 AS (SELECT *, coalesce(CASE WHEN best THEN tm ELSE ts END, false) AS ht, coalesce(CASE WHEN best THEN ss ELSE sm END, false) AS hs, coalesce(dir * (o - t) >= 0, false) AS gt, coalesce(dir * (o - s) <= 0, false) AS gs FROM x1),
x3 AS (SELECT *, CASE WHEN period = 'btst' AND later THEN {'cls': CASE WHEN gt THEN 'target' WHEN gs THEN 'stop' ELSE 'horizon' END, 'price': o, 'basis': 'next-open'}
  WHEN later AND gs THEN {'cls': 'stop', 'price': o, 'basis': 'gap-open'} WHEN later AND gt THEN {'cls': 'target', 'price': o, 'basis': 'gap-open'}
  WHEN ht AND (NOT hs OR best) THEN {'cls': 'target', 'price': t, 'basis': 'target'} WHEN hs THEN {'cls': 'stop', 'price': s, 'basis': 'stop'}
  WHEN d = hold AND d = expiry_day THEN {'cls': 'expired', 'price': c, 'basis': 'settlement'} WHEN d = hold THEN {'cls': 'horizon', 'price': c, 'basis': 'close'} END AS v FROM x2),
x4 AS (SELECT call_id, reading, min_by(v, n) AS v, min_by(d, n) AS xd FROM x3 WHERE v IS NOT NULL GROUP BY 1, 2),
lb AS (SELECT f.call_id, f.reading, max_by(b.c, b.n) AS lc, max_by(b.d, b.n) AS ld FROM f7 f JOIN bn b ON b.instrument_id = f.instrument_id AND b.n >= f.n1 AND (b.d <= f.hold OR b.n = f.n1) WHERE f.code IS NULL GROUP BY 1, 2),
oc AS (SELECT f.*, CASE WHEN code = 'level-not-reached' THEN 'not-triggered' WHEN code IS NOT NULL THEN 'unverifiable' WHEN x4.v IS NOT NULL THEN x4.v.cls WHEN expiry_day IS NOT NULL AND hold = expiry_day AND expiry_day <= last_day THEN 'expired' WHEN hold > last_day THEN 'open' ELSE 'horizon' END AS cls,
  CASE WHEN code IS NULL THEN coalesce(x4.xd, ld) END AS exit_day, CASE WHEN code IS NULL THEN coalesce(x4.v.price, lc) END AS xp, CASE WHEN code IS NULL THEN coalesce(x4.v.basis, 'last-price') END AS exit_basis
  FROM f7 f LEFT JOIN x4 USING (call_id, reading) LEFT JOIN lb USING (call_id, reading)),
outcomes AS (SELECT call_id, reading, cls, code, CASE WHEN code IS NULL THEN entry_day END AS entry_day, CASE WHEN code IS NULL THEN floor(e * 100 + 0.5) / 100 END AS entry_price, CASE WHEN code IS NULL THEN basis END AS entry_basis, exit_day,
  floor(xp * 100 + 0.5) / 100 AS exit_price, exit_basis, CASE WHEN code IS NULL THEN floor(dir * (xp - e) * 100 + 0.5) / 100 END AS move, CASE WHEN code IS NULL THEN floor(dir * (xp - e) / e * 100 * 100 + 0.5) / 100 END AS ret_pct,
  CASE WHEN code IS NULL THEN exit_day - entry_day END AS days_held FROM oc)
"""
_OUT = "call_id, reading, cls, code, entry_day, entry_price, entry_basis, exit_day, exit_price, exit_basis, move, ret_pct, days_held"


def outcomes(spark, d, readings=replay.READINGS) -> DataFrame:
    k = V.calls(spark, d)
    return replay.replay(k, V.bars(spark, d).drop("dt"), readings)


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: c(n).cast("long") for n in names})


@query(_REPLAY + f"SELECT {_OUT} FROM outcomes")
def replay_outcomes(spark, d):
    """Every call under the three readings."""
    return _longs(outcomes(spark, d), "entry_day", "exit_day", "days_held").drop("notes")


@query(
    _REPLAY
    + ", p AS (SELECT call_id, max(struct_pack(a := cls, b := exit_price, c := entry_price, d := exit_day)) FILTER (reading = 'best') AS b, max(struct_pack(a := cls, b := exit_price, c := entry_price, d := exit_day)) FILTER (reading = 'worst') AS w, bool_or(entry_price IS NOT NULL) FILTER (reading <> 'likely') AS en FROM outcomes GROUP BY 1) "
    "SELECT call_id, CASE WHEN en THEN b IS NOT DISTINCT FROM w END AS firm FROM p"
)
def replay_firm(spark, d):
    return replay.firm(outcomes(spark, d))


@query(
    _REPLAY
    + f", k AS (SELECT * FROM outcomes WHERE reading = 'likely') SELECT {', '.join('o.' + x.strip() for x in _OUT.split(','))} FROM outcomes o JOIN k USING (call_id) WHERE o.reading <> 'likely' AND (o.cls IS DISTINCT FROM k.cls OR o.exit_price IS DISTINCT FROM k.exit_price OR o.entry_price IS DISTINCT FROM k.entry_price OR o.exit_day IS DISTINCT FROM k.exit_day)"
)
def set_diff_readings(spark, d):
    return _longs(replay.differing(outcomes(spark, d)), "entry_day", "exit_day", "days_held").drop("notes")


@query(_REPLAY + "SELECT reading, coalesce(code, cls) AS code, count(*) AS n FROM outcomes GROUP BY ALL")
def agg_codes(spark, d):
    return outcomes(spark, d).groupBy("reading", F.coalesce("code", "cls").alias("code")).agg(F.count("*").alias("n"))


@query(
    _REPLAY
    + ", s AS (SELECT o.call_id, o.reading, min(b.n) AS a, max(b.n) AS z, any_value(k.instrument_id) AS i FROM outcomes o JOIN calls k USING (call_id) JOIN bn b ON b.instrument_id = k.instrument_id AND b.d BETWEEN o.entry_day AND o.exit_day WHERE o.entry_day IS NOT NULL GROUP BY 1, 2) "
    "SELECT call_id, reading, count(*) AS n, floor(sum(b.c) * 100 + 0.5) / 100 AS total FROM s JOIN bn b ON b.instrument_id = i AND b.n BETWEEN a - 6 AND z + 6 GROUP BY 1, 2"
)
def win_mini_bars(spark, d):
    a = replay.around(outcomes(spark, d), V.calls(spark, d), V.bars(spark, d))
    return a.select("call_id", "reading", F.size("bars").cast("long").alias("n"), (F.floor(F.aggregate("bars", F.lit(0.0), lambda s, b: s + b.c) * 100 + 0.5) / 100).alias("total"))


# ---- ledger

_QUEUE = (
    _REPLAY
    + """, q0 AS (SELECT o.*, k.channel_id, k.kind, k.up, k.targets, k.stop, k.confidence, greatest(1, floor(10000 / o.entry_price)) AS qty FROM outcomes o JOIN calls k USING (call_id) WHERE o.cls NOT IN ('unverifiable', 'not-triggered') AND k.confidence <> 'low'),
q1 AS (SELECT *, CASE WHEN up THEN entry_price ELSE exit_price END * qty AS buy, CASE WHEN up THEN exit_price ELSE entry_price END * qty AS sell, list_filter(targets, lambda x: CASE WHEN up THEN x > entry_price ELSE x < entry_price END)[1] AS t,
  CASE WHEN CASE WHEN up THEN stop < entry_price ELSE stop > entry_price END THEN stop WHEN up THEN 0.0 END AS fl FROM q0),
q2 AS (SELECT *, qty * move - CASE WHEN kind = 'option' THEN 40 + sell * 0.0015 WHEN days_held = 0 THEN 40 + sell * 0.0003 ELSE (buy + sell) * 0.0012 END AS net, abs(entry_price - fl) / abs(t - fl) AS chance FROM q1)
"""
)


def queued(spark, d, params: DataFrame | None = None, readings=replay.READINGS) -> DataFrame:
    return ledger.queue(V.calls(spark, d).drop("day", "session"), outcomes(spark, d, readings).withColumn("lot", F.lit(1)), ledger.params_table(spark) if params is None else params)


@query(
    _QUEUE
    + """SELECT channel_id, reading, count(*) AS checked, count(*) FILTER (cls = 'target') AS target, count(*) FILTER (cls = 'stop') AS stop, count(*) FILTER (cls = 'expired') AS expired, count(*) FILTER (cls = 'horizon') AS horizon, count(*) FILTER (cls = 'open') AS open,
count(*) FILTER (cls = 'expired' AND exit_price <= entry_price * 0.05) AS expired_worthless, count(*) FILTER (net > 0) AS profitable, floor(count(*) FILTER (cls = 'target') / count(*) * 10000 + 0.5) / 10000 AS hit_rate,
floor(avg(chance) * 10000 + 0.5) / 10000 AS chance_hit_rate, floor(avg(CASE WHEN chance IS NOT NULL THEN (cls = 'target')::INT END) * 10000 + 0.5) / 10000 AS hit_rate_with_target, floor(floor(avg(coalesce(ret_pct, 0)) * 100 + 0.5) / 100 * 10 + 0.5) / 10 AS mean_return_pct, floor(floor(sum(net) * 100 + 0.5) / 100 + 0.5) AS flat_net FROM q2 GROUP BY 1, 2"""
)
def agg_record(spark, d):
    """agg_chance and agg_flat_net as well."""
    r = ledger.record(queued(spark, d))
    return r.drop("param_id").withColumns({x: F.floor(c(x) * 10000 + 0.5) / 10000 for x in ("hit_rate", "chance_hit_rate", "hit_rate_with_target")} | {"mean_return_pct": F.floor(c("mean_return_pct") * 10 + 0.5) / 10, "flat_net": F.floor(c("flat_net") + 0.5).cast("double")})


@query(
    _REPLAY
    + "SELECT channel_id, reading, count(*) AS calls, count(*) FILTER (cls = 'unverifiable') AS unverifiable, count(*) FILTER (cls = 'not-triggered') AS not_triggered, count(*) FILTER (cls NOT IN ('unverifiable', 'not-triggered') AND confidence = 'low') AS low_confidence, count(*) FILTER (cls NOT IN ('unverifiable', 'not-triggered') AND confidence <> 'low') AS queued FROM outcomes o JOIN calls k USING (call_id) GROUP BY 1, 2"
)
def agg_counts(spark, d):
    return ledger.counts(queued(spark, d)).drop("param_id")


@query(
    _QUEUE
    + """, g AS (SELECT channel_id, count(*) AS n, avg(chance) FILTER (reading = 'likely') AS chance, max(CASE WHEN reading = 'likely' THEN hr END) AS hit, max(hr) AS best, min(hr) AS worst FROM (SELECT *, count(*) FILTER (cls = 'target') OVER (PARTITION BY channel_id, reading) / count(*) OVER (PARTITION BY channel_id, reading) AS hr FROM q2) GROUP BY 1 HAVING count(*) FILTER (reading = 'likely') >= 30)
SELECT channel_id, floor(chance * 10000 + 0.5) / 10000 AS chance, floor(hit * 10000 + 0.5) / 10000 AS hit, floor(best * 10000 + 0.5) / 10000 AS best, floor(worst * 10000 + 0.5) / 10000 AS worst FROM g"""
)
def agg_field(spark, d):
    """Channels with 30 checked calls: chance, hit rate, and the best and worst over the readings."""
    r = ledger.record(queued(spark, d))
    likely = lambda x: F.max(F.when(c("reading") == "likely", c(x)))
    g = r.groupBy("channel_id").agg(likely("checked").alias("n"), likely("chance_hit_rate").alias("chance"), likely("hit_rate").alias("hit"), F.max("hit_rate").alias("best"), F.min("hit_rate").alias("worst"))
    return g.where("n >= 30").select("channel_id", *[r4(c(x), x) for x in ("chance", "hit", "best", "worst")])


def _account(rows: DataFrame) -> DataFrame:
    """Ratios of sums to six decimals: the last bits depend on the order of addition."""
    return rows.withColumns({x: F.floor(c(x) * 1_000_000 + 0.5) / 1_000_000 for x in ("hit_rate", "profitable_rate", "profit_factor")})


@query()
def ledger_lines(spark, d):
    """The funded fold: what is taken, what is not affordable, and the balance after each settlement."""
    return ledger.lines(queued(spark, d)).drop("raw_net", "raw_balance")


@query()
def ledger_account(spark, d):
    """agg_rates, win_drawdown, fn_compound, agg_band inputs: one row an account."""
    return _account(ledger.account(ledger.lines(queued(spark, d)))).withColumn("verdict", ledger.verdict())


@query()
def what_if(spark, d):
    """The accounts of the what-if grid under the likely reading."""
    return _account(ledger.account(ledger.lines(queued(spark, d, ledger.what_if(spark), ("likely",)))))


@query()
def agg_band(spark, d):
    return ledger.band(ledger.account(ledger.lines(queued(spark, d))))


@query()
def win_running(spark, d):
    """The balance in posting order over a floor at zero."""
    return ledger.running_balance(ledger.lines(queued(spark, d)))


@query()
def snk_calls_csv(spark, d):
    """The fifteen columns of the call list under the likely reading."""
    k = V.calls(spark, d).withColumn("text", F.concat(F.lit("SYM"), c("instrument_id").cast("string"))).withColumn("contract", c("text"))
    k = k.withColumn("entry", F.struct(c("entry_type").alias("type"), c("lo"), c("hi"))).select("call_id", "ts", "text", "contract", "side", "entry", "targets", "stop")
    o = written(outcomes(spark, d), "outcomes")
    q = ledger.queue(V.calls(spark, d).drop("day", "session"), o.where("reading = 'likely'").withColumn("lot", F.lit(1)), ledger.params_table(spark))
    return report.call_list(k, o.where("reading = 'likely'"), q, replay.firm(o), V.calendar(spark, d))


@query()
def snk_complaint(spark, d):
    """The account and the follow-through of the same outcomes: the replay is worked out once and read twice."""
    o = written(outcomes(spark, d, ("likely",)).drop("notes"), "outcomes")
    f = detect.follow_through(V.calls(spark, d), o, linked(spark, d).where("call_id IS NOT NULL"))
    q = ledger.queue(V.calls(spark, d).drop("day", "session"), o.withColumn("lot", F.lit(1)), ledger.params_table(spark))
    return report.complaint(ledger.account(ledger.lines(q)), f)


# ---- patterns

_CASE = """, m AS (SELECT DISTINCT instrument_id, d FROM shapes WHERE d % 7 = 3), o AS (SELECT instrument_id, d FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY instrument_id) AS n FROM bars7 WHERE instrument_id IN (SELECT instrument_id FROM m)) b WHERE k >= 20 AND k < n - 2 AND k % 5 = 0)
"""


@query(
    _SHAPES
    + ", fi AS (SELECT instrument_id, d, post_gain >= 0.08 AND post_volume >= 3 AS spike, fall >= 0.15 AS dump, pre_gain >= 0.1 AND pre_volume >= 3 AS pre_run, turnover > 0 AND turnover < 2500000 AS thin FROM shapes) "
    "SELECT instrument_id, d, unnest(list_filter([CASE WHEN thin THEN 'thin' END, CASE WHEN pre_run THEN 'pre-run' END, CASE WHEN spike AND dump THEN 'pump-shape' WHEN spike THEN 'spike' END], lambda x: x IS NOT NULL)) AS kind FROM fi"
)
def flags(spark, d):
    """Flags of every bar that has a shape."""
    s = B.shape_windows(V.bars(spark, d, sundays=True)).withColumn("call_id", F.struct("instrument_id", "d"))
    return detect.flags(s).select("call_id.instrument_id", c("call_id.d").cast("long").alias("d"), "kind")


@query(
    _SHAPES
    + ", j AS (SELECT k.call_id, min(b.d) AS d, any_value(k.instrument_id) AS i FROM calls k JOIN bars7 b ON b.instrument_id = k.instrument_id AND b.d >= k.day GROUP BY 1) "
    "SELECT call_id, floor(post_gain * 10000 + 0.5) / 10000 AS post_gain, floor(fall * 10000 + 0.5) / 10000 AS fall FROM j JOIN shapes s ON s.instrument_id = j.i AND s.d = j.d"
)
def flags_at_calls(spark, d):
    """Shapes at the first bar of each call."""
    s = detect.shapes_at(V.calls(spark, d), V.bars(spark, d, sundays=True).drop("dt"))
    return s.select("call_id", r4(c("post_gain"), "post_gain"), r4(c("fall"), "fall"))


@query(_SHAPES + "SELECT d % 7 = 3 AS marked, count(*) AS n, count(*) FILTER (post_gain >= 0.08 AND post_volume >= 3) AS spike, count(*) FILTER (post_gain >= 0.08 AND post_volume >= 3 AND fall >= 0.15) AS pump, count(*) FILTER (pre_gain >= 0.1 AND pre_volume >= 3) AS pre_run, count(*) FILTER (turnover > 0 AND turnover < 2500000) AS thin FROM shapes GROUP BY 1")
def agg_case(spark, d):
    s = B.shape_windows(V.bars(spark, d, sundays=True)).withColumn("marked", c("d") % 7 == 3)
    return detect.case_rates(s, "marked")


_LONG = """, lb AS (SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS dt, count(*) AS v FROM lineitem GROUP BY 1, 2), lcal AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS d FROM (SELECT DISTINCT dt FROM lb)),
m AS (SELECT DISTINCT l_suppkey AS instrument_id, d AS day FROM lineitem JOIN lcal ON lcal.dt = CAST(l_shipdate AS DATE) WHERE l_linenumber = 1 AND l_quantity = 50),
b AS (SELECT instrument_id, d, row_number() OVER (PARTITION BY instrument_id ORDER BY d) - 1 AS rn, count(*) OVER (PARTITION BY instrument_id) AS n FROM lb JOIN lcal USING (dt) WHERE instrument_id IN (SELECT instrument_id FROM m))
"""


@query(_LONG + "SELECT instrument_id, d FROM b WHERE rn >= 30 AND rn < n - 12 AND (rn - 30) % 5 = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.instrument_id = b.instrument_id AND abs(m.day - b.d) < 15)")
def jn_ordinary(spark, d):
    """Ordinary days of suppliers' histories of some years, at the operator's distances; every call is a mark."""
    return detect.ordinary_days(V.long_bars(spark, d), V.long_calls(spark, d)).select("instrument_id", c("d").cast("long").alias("d"))


# ---- linking

_LINK = """, t1 AS (SELECT p.post_id, min(k.call_id) AS x FROM posts p JOIN calls k ON k.channel_id = p.channel_id AND k.call_id = p.reply_to WHERE p.named IS NULL OR p.named = k.instrument_id GROUP BY 1),
t2 AS (SELECT p.post_id, max_by(k.call_id, (k.ts, k.call_id)) AS x FROM posts p JOIN calls k ON k.channel_id = p.channel_id AND k.instrument_id = p.named AND date_trunc('second', k.ts) <= date_trunc('second', p.ts) AND date_trunc('second', p.ts) - date_trunc('second', k.ts) <= INTERVAL 15 DAY GROUP BY 1),
t3 AS (SELECT p.post_id, max_by(k.call_id, (date_trunc('second', k.ts), k.call_id)) AS x FROM posts p JOIN calls k ON k.channel_id = p.channel_id AND date_trunc('second', k.ts) <= date_trunc('second', p.ts) AND date_trunc('second', p.ts) - date_trunc('second', k.ts) <= INTERVAL 1 DAY WHERE p.named IS NULL AND p.reply_to IS NULL GROUP BY 1),
linked AS (SELECT p.*, coalesce(t1.x, t2.x, t3.x) AS call_id FROM posts_u p LEFT JOIN t1 USING (post_id) LEFT JOIN t2 USING (post_id) LEFT JOIN t3 USING (post_id))
"""


def linked(spark, d) -> DataFrame:
    return linking.link_followups(V.posts(spark, d), V.calls(spark, d).withColumn("instrument", c("instrument_id")))


@query(_LINK + "SELECT post_id, call_id FROM linked")
def jn_followup(spark, d):
    """Result posts linked to the call on the named instrument or the channel's latest."""
    return linked(spark, d).select("post_id", "call_id")


@query(_LINK + "SELECT DISTINCT k.call_id FROM linked l JOIN calls k USING (call_id) WHERE CASE WHEN quoted IS NOT NULL THEN CASE WHEN up THEN quoted >= targets[1] * 0.99 ELSE quoted <= targets[1] * 1.01 END ELSE claims_target END")
def jn_announced(spark, d):
    return linking.announced(V.calls(spark, d), linked(spark, d).where("call_id IS NOT NULL")).select("call_id")


@query(
    _REPLAY
    + _LINK
    + """, g AS (SELECT call_id, count(*) AS posts, bool_or(kind IN ('target-hit', 'profit')) AS good, bool_or(kind = 'stop-hit') AS adm FROM linked WHERE call_id IS NOT NULL GROUP BY 1)
SELECT channel_id, count(*) FILTER (move > 0) AS winners, count(*) FILTER (move > 0 AND good) AS winners_announced, count(*) FILTER (move <= 0) AS losers, count(*) FILTER (move <= 0 AND posts IS NOT NULL) AS losers_mentioned, count(*) FILTER (move <= 0 AND adm) AS losers_admitted, count(*) FILTER (move <= 0 AND posts IS NULL) AS silent_losses
FROM outcomes o JOIN calls k USING (call_id) LEFT JOIN g USING (call_id) WHERE reading = 'likely' AND o.move IS NOT NULL AND cls <> 'open' GROUP BY 1"""
)
def agg_followthrough(spark, d):
    return detect.follow_through(V.calls(spark, d), outcomes(spark, d, ("likely",)), linked(spark, d).where("call_id IS NOT NULL"))


@query(
    _REPLAY
    + _LINK
    + """, j AS (SELECT l.call_id, l.post_id, any_value(k.up) AS up, any_value(k.targets[1]) AS t1, any_value(l.claims_target) AS ct, any_value(l.quoted) AS q, any_value(o.entry_price) AS e, max(b.h) AS top, min(b.l) AS low
FROM linked l JOIN calls k USING (call_id) JOIN outcomes o ON o.call_id = l.call_id AND reading = 'likely' AND o.entry_day IS NOT NULL JOIN bars b ON b.instrument_id = k.instrument_id AND b.d BETWEEN o.entry_day AND l.until WHERE l.claims_target OR l.quoted IS NOT NULL GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN up THEN top ELSE low END AS reached FROM j),
y AS (SELECT *, CASE WHEN ct AND CASE WHEN up THEN reached < t1 * 0.99 ELSE reached > t1 * 1.01 END THEN 'unsupported' WHEN q IS NOT NULL AND CASE WHEN up THEN reached < q * 0.99 AND q > e ELSE reached > q * 1.01 AND q < e END THEN 'impossible' END AS why FROM z)
SELECT call_id, post_id AS msg_id, why, CASE WHEN why = 'unsupported' THEN t1 ELSE q END AS claimed, reached FROM y WHERE why IS NOT NULL"""
)
def set_union_disputed(spark, d):
    """jn_follow_range as well: claims of targets and quotes that prices do not support."""
    p = linked(spark, d).where("call_id IS NOT NULL").withColumnRenamed("post_id", "msg_id")
    k = V.calls(spark, d).select("call_id", "instrument_id", "side", "targets")
    return detect.disputed(k, outcomes(spark, d, ("likely",)), p.select("call_id", "msg_id", "until", "claims_target", "quoted"), V.bars(spark, d).drop("dt"))


# ---- numbers

@query("SELECT o_orderkey, floor(o_totalprice * 100 + 0.5) / 100 AS r2, floor(o_totalprice * 100 + 0.5)::BIGINT AS paise, greatest(0, o_totalprice - 100000) AS ce, greatest(0, 100000 - o_totalprice) AS pe FROM orders")
def fn_round2(spark, d):
    """fn_paise and fn_intrinsic as well."""
    o, p = V.table(spark, d, "orders"), c("o_totalprice")
    return o.select("o_orderkey", numbers.round2(p).alias("r2"), numbers.paise(p).alias("paise"), numbers.intrinsic(p, F.lit(100000.0), F.lit("CE")).alias("ce"), numbers.intrinsic(p, F.lit(100000.0), F.lit("PE")).alias("pe"))


@query(
    "SELECT l_orderkey, l_linenumber, floor((CASE l_linenumber % 3 WHEN 0 THEN 40 + l_extendedprice * 0.0015 WHEN 1 THEN 40 + l_extendedprice * 0.0003 ELSE CASE WHEN l_returnflag = 'N' THEN 40 + l_extendedprice * 0.0003 ELSE (l_extendedprice + l_quantity) * 0.0012 END END) * 10000 + 0.5) / 10000 AS costs FROM lineitem"
)
def fn_costs(spark, d):
    t = V.table(spark, d, "lineitem")
    kind = F.when(c("l_linenumber") % 3 == 0, "option").when(c("l_linenumber") % 3 == 1, "future").otherwise("equity")
    return t.select("l_orderkey", "l_linenumber", r4(numbers.trading_costs(kind, c("l_quantity"), c("l_extendedprice"), c("l_returnflag") == "N"), "costs"))


@query(
    "SELECT c_custkey, CASE WHEN n < 0 THEN '−' ELSE '' END || '₹' || CASE WHEN length(s) <= 3 THEN s ELSE reverse(regexp_replace(reverse(left(s, length(s) - 3)), '(\\d\\d)(\\d)', '\\1,\\2', 'g')) || ',' || right(s, 3) END AS rupees FROM (SELECT c_custkey, n, abs(n)::BIGINT::VARCHAR AS s FROM (SELECT c_custkey, floor(c_acctbal + 0.5) AS n FROM customer))"
)
def fn_rupees(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", numbers.rupees(c("c_acctbal")).alias("rupees"))


def _option_tables(spark, d):
    """Users as option contracts: user u is the contract of symbol u % 30 that expires u // 30 weeks after the first."""
    user = V.table(spark, d, "events").select(c("user_id").alias("instrument_id")).distinct()
    of = lambda i: F.concat(F.lit("U"), (i % 30).cast("string"))
    expiry = F.date_add(F.lit("2024-01-07").cast("date"), (F.floor(c("instrument_id") / 30) * 7).cast("int"))
    kinds = user.select("instrument_id", of(c("instrument_id")).alias("symbol"), expiry.alias("expiry"), F.lit(1).alias("lot"), F.lit(True).alias("has_options"), F.lit(True).alias("has_futures"))
    bars = V.bars(spark, d).join(kinds, "instrument_id").withColumns({"strike": F.lit(20.0), "opt_type": F.lit("CE")})
    today = V.calendar(spark, d).select(c("d").alias("day"), c("dt").alias("today"))
    null = F.lit(None).cast("int")
    calls = V.calls(spark, d).drop("hi").withColumns({"symbol": of(c("instrument_id")), "hint_day": null, "hint_month": null, "hi": F.lit(None).cast("double"), "strike": F.lit(20.0), "opt_type": F.lit("CE")}).join(F.broadcast(today), "day")  # a row a trading day
    return calls, kinds, bars


_OPTIONS = """,
oc AS (SELECT call_id, 'U' || (instrument_id % 30) AS symbol, day, entry_type, lo, cal.dt AS today FROM calls JOIN cal ON cal.d = calls.day),
oe AS (SELECT DISTINCT 'U' || (user_id % 30) AS symbol, user_id AS instrument_id, DATE '2024-01-07' + CAST(7 * (user_id // 30) AS INTEGER) AS expiry FROM events),
cand AS (SELECT oc.*, oe.instrument_id, oe.expiry, row_number() OVER (PARTITION BY call_id ORDER BY expiry) AS rank FROM oc JOIN oe USING (symbol) WHERE expiry >= today),
tried AS (SELECT cand.*, coalesce(CASE WHEN b.l IS NULL THEN false WHEN entry_type = 'none' THEN true WHEN entry_type = 'above' THEN b.h >= lo * 0.98 AND b.l <= lo * 1.6 WHEN entry_type = 'below' THEN b.l <= lo * 1.02 AND b.h >= lo * 0.6 ELSE lo >= b.l * 0.98 AND lo <= b.h * 1.02 END, false) AS fits
  FROM cand LEFT JOIN bars b ON b.instrument_id = cand.instrument_id AND b.d = cand.day WHERE cand.rank <= 4 AND cand.instrument_id IN (SELECT instrument_id FROM bars)),
picked AS (SELECT call_id, symbol, expiry, fits FROM tried QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY NOT fits, rank) = 1),
xday AS (SELECT picked.*, coalesce((SELECT min(d) FROM cal WHERE dt >= expiry), last_day + greatest(1, floor((expiry - (SELECT max(dt) FROM cal)) * 5 / 7.0 + 0.5)))::INTEGER AS expiry_day FROM picked, lastd)
"""


@query(_OPTIONS + "SELECT call_id, symbol, expiry, fits, expiry_day FROM xday")
def jn_contract(spark, d):
    """prd_fits and fn_day_index too: the option that a call means, and the trading day on which it ends."""
    calls, kinds, bars = _option_tables(spark, d)
    got = contracts.options(calls, kinds, bars)
    return contracts.day_index(got, V.calendar(spark, d)).select("call_id", "symbol", "expiry", "fits", "expiry_day")


@query(_OPTIONS + ", sp AS (SELECT 'U' || (instrument_id % 30) AS symbol, d, min(c) AS price FROM bars GROUP BY 1, 2) SELECT call_id, CASE WHEN price IS NOT NULL THEN greatest(0, price - 20) END AS settlement FROM xday LEFT JOIN sp ON sp.symbol = xday.symbol AND sp.d = expiry_day")
def jn_settle(spark, d):
    """What each call's option is worth at the end."""
    calls, kinds, bars = _option_tables(spark, d)
    got = contracts.day_index(contracts.options(calls, kinds, bars), V.calendar(spark, d)).withColumns({"strike": F.lit(20.0), "opt_type": F.lit("CE")})
    return contracts.settlements(got, bars.groupBy("symbol", "d").agg(F.min("c").alias("price"))).select("call_id", "settlement")


@query(_OPTIONS + "SELECT call_id, symbol, expiry FROM cand WHERE rank = 1 AND instrument_id IN (SELECT instrument_id FROM bars)")
def jn_future(spark, d):
    """The nearest future of each call."""
    calls, kinds, bars = _option_tables(spark, d)
    return contracts.futures(calls, kinds, bars).select("call_id", "symbol", "expiry")


@query(", o AS (SELECT call_id, i, CASE WHEN (call_id + i) % 4 = 0 THEN lo END AS p, CASE WHEN call_id % 3 = 0 THEN 'open' ELSE 'stated' END AS basis, entry_type FROM calls, range(3) t(i)) SELECT call_id, CASE WHEN count(p) FILTER (basis <> 'open') = 1 AND first(entry_type) <> 'none' THEN 'I' || min(i) FILTER (p IS NOT NULL) END AS symbol FROM o GROUP BY 1")
def jn_unnamed(spark, d):
    """Calls whose index is not named, tried on three: the one that fits, if it is the only one."""
    index = spark.createDataFrame([(f"I{i}", "index") for i in range(3)] + [("S", "stock")], "symbol string, kind string")
    k = contracts.spread_unnamed(V.calls(spark, d).withColumn("symbol", F.lit("?")), index)
    i = F.substring("symbol", 2, 1).cast("int")
    o = k.select("call_id", F.lit("likely").alias("reading"), "symbol", "entry_type", F.when((c("call_id") + i) % 4 == 0, c("lo")).alias("entry_price"), F.when(c("call_id") % 3 == 0, "open").otherwise("stated").alias("entry_basis"))
    return contracts.inferred(o).select("call_id", "symbol")


# ---- what reports show


@query("SELECT kind, count(*) AS n FROM (/*own*/ {}) GROUP BY kind".format(SQL["flags"]), name="agg_flag_kinds")
def agg_flag_kinds(spark, d):
    return QUERIES["flags"](spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    _REPLAY
    + ", w AS (SELECT call_id, any_value(b) IS DISTINCT FROM any_value(w) AS doubtful FROM (SELECT call_id, max(struct_pack(a := cls, b := exit_price, c := entry_price, d := exit_day)) FILTER (reading = 'best') AS b, max(struct_pack(a := cls, b := exit_price, c := entry_price, d := exit_day)) FILTER (reading = 'worst') AS w, bool_or(entry_price IS NOT NULL) FILTER (reading <> 'likely') AS en FROM outcomes GROUP BY 1) WHERE en GROUP BY call_id),"
    " r AS (SELECT o.call_id, o.entry_price IS NOT NULL AND k.confidence <> 'low' AS replayed, o.cls, o.move, coalesce(w.doubtful, false) AS doubtful FROM outcomes o JOIN calls k USING (call_id) LEFT JOIN w USING (call_id) WHERE o.reading = 'likely')"
    " SELECT call_id, 'all' AS filter FROM r UNION ALL SELECT call_id, 'target' FROM r WHERE replayed AND cls = 'target' UNION ALL SELECT call_id, 'lost' FROM r WHERE replayed AND coalesce(move, 0) < 0 UNION ALL SELECT call_id, 'doubtful' FROM r WHERE doubtful UNION ALL SELECT call_id, 'unchecked' FROM r WHERE NOT replayed"
)
def flt_report(spark, d):
    """Which calls each of the report's filters shows."""
    o = written(outcomes(spark, d), "outcomes")
    likely = o.where("reading = 'likely'").select("call_id", "cls", "move", "entry_price").join(V.calls(spark, d).select("call_id", "confidence"), "call_id").join(replay.firm(o), "call_id", "left")
    return report.filtered(likely.withColumn("replayed", c("entry_price").isNotNull() & (c("confidence") != "low")))


@query(_LINK + "SELECT call_id, count(*) AS posts, max(quoted) FILTER (quoted > 0) AS quoted_max FROM linked WHERE call_id IS NOT NULL GROUP BY 1")
def agg_quoted_max(spark, d):
    return report.quoted_most(linked(spark, d))


@query("SELECT instrument_id, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, instrument_id LIMIT 3")
def topk_case(spark, d):
    """The three instruments with most calls."""
    return V.calls(spark, d).groupBy("instrument_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "instrument_id").limit(3)


@query("SELECT channel_id, call_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts, call_id) AS place FROM calls QUALIFY place BETWEEN 41 AND 140")
def lim_table(spark, d):
    """srt_messages too: each channel's calls in posting order, the page behind the first forty."""
    return report.page(V.calls(spark, d), ["channel_id"], ["ts", "msg_id"], 41, 140).select("channel_id", "call_id", c("place").cast("long").alias("place"))


@query("/*own*/ SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def set_dedupe_recos(spark, d):
    """Of a customer's orders of one priority the last, as of a scrip's recommendations at one time."""
    return report.one_recommendation(V.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderpriority"], "o_orderkey")


_NAMES = """/*own*/ SELECT scrip, coalesce(max(symbol) FILTER (p = n), min_by(symbol, seq) FILTER (starts_with(p, n) OR starts_with(n, p))) AS symbol FROM
(SELECT 'The ' || p_name || ' & ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' Co. (India) Ltd' ELSE ' Glass Limited' END AS scrip, upper(p_name) || ' AND ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' GLASS' END AS p FROM part) a,
(SELECT 'P' || p_partkey AS symbol, p_partkey AS seq, upper(p_name) || ' AND ' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ' WORKS' ELSE '' END AS n FROM part WHERE p_partkey % 5 <> 0) k GROUP BY 1"""


@query(_NAMES)
def jn_case_name(spark, d):
    """fn_plain as well: company names made of part names, written differently, to symbols. The SQL compares all pairs."""
    p, i = V.table(spark, d, "part"), c("p_partkey").cast("string")
    even = c("p_partkey") % 2 == 0
    asked = p.select(F.concat(F.lit("The "), c("p_name"), F.lit(" & "), i, F.when(even, " Co. (India) Ltd").otherwise(" Glass Limited")).alias("scrip"))
    k = p.where("p_partkey % 5 <> 0").select(F.concat(F.lit("P"), i).alias("symbol"), c("p_partkey").alias("seq"), F.concat(c("p_name"), F.lit(" & "), i, F.when(c("p_partkey") % 3 == 0, " Works Limited").otherwise(" Company")).alias("name"))
    return report.case_symbols(asked, k)


@query("/*own*/ SELECT reg_no, CASE WHEN s_suppkey % 3 = 0 THEN 'malformed' WHEN s_suppkey % 2 = 0 THEN 'found' ELSE 'missing' END AS state FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'INX' ELSE 'INH' END || lpad(s_suppkey::VARCHAR, 9, '0') AS reg_no FROM supplier)")
def jn_register_lookup(spark, d):
    s = V.table(spark, d, "supplier")
    no = F.concat(F.when(c("s_suppkey") % 3 == 0, "INX").otherwise("INH"), F.lpad(c("s_suppkey").cast("string"), 9, "0"))
    return report.lookup(s.select(no.alias("reg_no")), s.where("s_suppkey % 2 = 0").select(no.alias("reg_no")))


@query("/*own*/ SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'entered at ' || user_id || ' on day ' || event_id ELSE 'user ' || user_id || ' left' END AS text FROM events WHERE event_type = 'signup'")
def fn_note_text(spark, d):
    """Notes joined with the sentences of a language."""
    e = V.table(spark, d, "events").where("event_type = 'signup'")
    notes = e.select("event_id", F.when(c("event_id") % 2 == 0, "in").otherwise("out").alias("k"), F.array(c("user_id").cast("string"), c("event_id").cast("string")).alias("a"))
    said = spark.createDataFrame([("en", "in", "entered at {0} on day {1}"), ("en", "out", "user {0} left")], "lang string, k string, text string")
    return report.note_texts(notes, said).select("event_id", "text")


@query()
def agg_window_end(spark, d):
    """Where each channel's first twenty calls alone would leave the account."""
    first = report.page(V.calls(spark, d), ["channel_id"], ["ts", "msg_id"], 1, 20)
    return report.window_ends(ledger.lines(queued(spark, d)), first)
