"""Result posts and calls, balances in posting order, contracts at the edges."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tapewright.operators import contracts, instruments, ledger, linking

DAY0 = dt.datetime(2025, 1, 1)


def _posts(spark, rows):
    return spark.createDataFrame([(ch, p, DAY0 + dt.timedelta(hours=h), r, n) for ch, p, h, r, n in rows], "channel_id int, post_id long, ts timestamp, reply_to long, named string")


def _calls(spark, rows):
    return spark.createDataFrame([(ch, i, m, 0, DAY0 + dt.timedelta(hours=h), n) for ch, i, m, h, n in rows], "channel_id int, call_id string, msg_id long, pos int, ts timestamp, instrument string")


def test_post_numbers_repeat_between_channels(spark):
    calls = _calls(spark, [(1, "a", 1, 0, "X"), (2, "b", 1, 0, "X")])
    posts = _posts(spark, [(1, 7, 5, None, "X"), (2, 7, 5, None, "X"), (1, 8, 5, 1, None), (2, 8, 5, 1, None), (3, 7, 5, None, "X")])
    got = {(r.channel_id, r.post_id): r.call_id for r in linking.link_followups(posts, calls).collect()}
    assert got == {(1, 7): "a", (2, 7): "b", (1, 8): "a", (2, 8): "b", (3, 7): None}


def test_latest_call_like_all_pairs(spark):
    rng = random.Random(6)
    calls = [(rng.randrange(3), f"c{k}", k, rng.randrange(900), rng.choice("XYZ")) for k in range(80)]
    posts = [(rng.randrange(3), k, rng.randrange(900), rng.choice([None, None, rng.randrange(80)]), rng.choice(["X", "Y", None])) for k in range(120)]
    got = {r.post_id: r.call_id for r in linking.link_followups(_posts(spark, posts), _calls(spark, calls)).collect()}
    for ch, p, h, reply, named in posts:
        mine = sorted((ch_h, m, i, n) for c_, i, m, ch_h, n in calls if c_ == ch)
        same = [i for _, m, i, n in mine if m == reply and named in (None, n)]
        if not same and named:
            same = [i for t, _, i, n in mine if n == named and t <= h and h - t <= 15 * 24][-1:]
        if not same and named is None and reply is None:
            same = [i for t, _, i, _ in mine if t <= h][-1:]
            same = [i for t, _, i, _ in mine if i in same and h - t <= 24]
        assert got[p] == (same[0] if same else None)


def test_running_balance_like_a_fold(spark):
    rng = random.Random(1)
    nets = [rng.choice([-400.0, -90.0, 35.0, 120.0]) for _ in range(60)]
    rows = [(1, "likely", 0, str(k), k, 0, k, "taken", x, 500.0) for k, x in enumerate(nets)] + [(1, "likely", 0, "99", 99, 0, 99, "no-funds", None, 500.0)]
    df = spark.createDataFrame(rows, "channel_id int, reading string, param_id int, call_id string, msg_id long, pos int, posted long, status string, raw_net double, capital double")
    got = [r.balance for r in ledger.running_balance(df).orderBy("at").collect()]
    want, b = [], 500.0
    for x in nets:
        b = max(0.0, b + x)
        want.append(b)
    assert got == want and 0.0 in want


def test_days_past_the_data_and_fits(spark):
    cal = spark.createDataFrame([(k, dt.date(2025, 1, 1) + dt.timedelta(days=d)) for k, d in enumerate((0, 1, 2, 5, 6, 7, 8))], "d int, dt date")
    x = spark.createDataFrame([(dt.date(2025, 1, 4),), (dt.date(2025, 1, 9),), (dt.date(2025, 1, 10),), (dt.date(2025, 1, 23),), (None,)], "expiry date")
    got = {r.expiry: r.expiry_day for r in contracts.day_index(x, cal).collect()}
    assert [got[k] for k in (dt.date(2025, 1, 4), dt.date(2025, 1, 9), dt.date(2025, 1, 10), dt.date(2025, 1, 23), None)] == [3, 6, 7, 16, None]
    rows = [("none", None, None, 1.0, 2.0), ("above", 100.0, None, 60.0, 98.0), ("above", 100.0, None, 161.0, 170.0), ("below", 100.0, None, 102.0, 140.0), ("range", 100.0, 110.0, 112.0, 120.0), ("range", 100.0, 110.0, 113.0, 120.0), ("at", 100.0, None, None, None)]
    f = spark.createDataFrame(rows, "t string, lo double, hi double, l double, h double")
    got = [r[0] for r in f.select(contracts.fits(F.col("t"), F.col("lo"), F.col("hi"), F.col("l"), F.col("h"))).collect()]
    assert got == [True, True, False, True, True, False, False]


def test_unnamed_calls_meet_every_index(spark):
    calls = spark.createDataFrame([(k, contracts.UNNAMED, 1.0) for k in range(3)] + [(9, "X", 2.0)], "call_id long, symbol string, lo double")
    under = spark.createDataFrame([(f"I{k}", "index") for k in range(150)] * 2 + [("S", "stock")], "symbol string, kind string")
    got = contracts.spread_unnamed(calls, under)
    assert got.columns == calls.columns and got.count() == 3 * 150 + 1 and got.where("call_id = 1").select("symbol").distinct().count() == 150


def test_two_slips_in_short_words(spark):
    asked = spark.createDataFrame([("ABCDEF", 2), ("ABXCE", 2), ("AB", 2), ("ABCDEF", 1)], "word string, most int")
    targets = spark.createDataFrame([("ABXYEF",), ("ABCDFE",), ("B",), ("QQQQQQ",)], "target string")
    got = {(r.word, r.target) for r in instruments.within_edits(asked, targets).collect()}
    assert got == {("ABCDEF", "ABXYEF"), ("ABCDEF", "ABCDFE"), ("AB", "B"), ("ABXCE", "ABXYEF")}
