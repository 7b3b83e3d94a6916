"""Replay under three readings, case by case, and the account built on it."""

import pytest

from tapewright.operators import ledger, replay

CALLS = "call_id string, instrument_id int, kind string, side string, entry_type string, lo double, hi double, targets array<double>, stop double, horizon string, day int, session string, minutes_in int, last_day int, expiry_day int, settlement double, announced boolean"
BASE = dict(kind="option", side="long", entry_type="at", lo=100.0, hi=None, targets=[130.0], stop=80.0, horizon="unspecified", day=10, session="in-session", minutes_in=120, last_day=100, expiry_day=14, settlement=None, announced=None)
TWO = [(10, 140, 142, 85, 90), (11, 90, 95, 70, 72)]
SHARE = dict(kind="equity", expiry_day=None)
TRIGGER = dict(SHARE, entry_type="above", lo=500.0, targets=[520.0], stop=None)
CASES = {
    "message day": (TWO, {"best": ("target", 10, 130), "worst": ("stop", 11, None), "likely": ("stop", 11, None)}, {}),
    "announced": (TWO, {"likely": ("target", 10, 130)}, {"announced": True}),
    "close beyond target": ([(10, 95, 150, 92, 145)], {"best": ("target", 10, 130), "worst": ("target", 10, 130), "likely": ("target", 10, 130)}, {}),
    "early, high above open": ([(10, 98, 135, 90, 110)], {"worst": ("target", 10, 130)}, {"minutes_in": 3}),
    "early, open is the high": ([(10, 135, 135, 90, 95), (11, 95, 96, 60, 62)], {"worst": ("stop", 11, None)}, {"minutes_in": 3}),
    "both touched": ([(10, 100, 135, 75, 100)], {"best": ("target", 10, 130), "worst": ("stop", 10, 80)}, {"minutes_in": 2}),
    "never traded there": ([(10, 300, 320, 280, 310)], {"best": ("unverifiable", None, None)}, {}),
    "no entry, intraday": ([(10, 100, 120, 90, 110)], {"best": ("unverifiable", None, None)}, {"entry_type": "none", "lo": None, "horizon": "intraday"}),
    "later bar": ([(10, 100, 110, 95, 105), (11, 106, 131, 104, 128)], {"worst": ("target", 11, 130)}, {}),
    "gap through stop": ([(10, 100, 110, 95, 105), (11, 60, 65, 50, 55)], {"worst": ("stop", 11, 60)}, {}),
    "expiry settlement": ([(10 + k, 100, 101, 99, 100) for k in range(5)], {"best": ("expired", 14, 0)}, {"targets": [200.0], "stop": None, "settlement": 0.0}),
    "stops trading early": ([(10, 100, 101, 99, 100), (11, 100, 101, 99, 100)], {"best": ("expired", 14, 12)}, {"targets": [200.0], "stop": None, "settlement": 12.0}),
    "btst": ([(10, 100, 110, 95, 105), (11, 112, 140, 100, 101)], {"worst": ("horizon", 11, 112)}, {"horizon": "btst"}),
    "data ends": ([(10, 100, 110, 95, 105), (11, 105, 110, 100, 107)], {"best": ("open", 11, 107)}, {"last_day": 11, "expiry_day": 20}),
    "trigger never trades": ([(10 + k, 480, 490, 470, 485) for k in range(4)], {"best": ("not-triggered", None, None)}, TRIGGER),
    "trigger on day two": ([(10, 480, 495, 470, 490), (11, 492, 525, 488, 510)], {"worst": ("target", 11, 520)}, TRIGGER),
    "short": ([(10, 520, 521, 500, 505)], {"worst": ("target", 10, 514)}, dict(SHARE, side="short", entry_type="below", lo=519.0, targets=[514.0], stop=522.0, minutes_in=1)),
    "after hours, no price": ([(10, 480, 495, 470, 490)], {"best": ("target", 10, 490)}, dict(SHARE, entry_type="none", lo=None, session="after-close", targets=[490.0], stop=None)),
    "no period, share": ([(10 + k, 100, 101, 99, 100) for k in range(14)], {"best": ("horizon", 20, 100)}, dict(SHARE, targets=[200.0], stop=None)),
    "not traded": ([(20, 100, 101, 99, 100)], {"best": ("unverifiable", None, None)}, {}),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    names = [x.split()[0] for x in CALLS.split(", ")]
    calls = spark.createDataFrame([tuple({"call_id": n, "instrument_id": i, **BASE, **over}[k] for k in names) for i, (n, (_, _, over)) in enumerate(CASES.items())], CALLS)
    bars = spark.createDataFrame([(i, d, float(o), float(h), float(low), float(c), 1000) for i, (b, _, _) in enumerate(CASES.values()) for d, o, h, low, c in b], "instrument_id int, d int, o double, h double, l double, c double, v int")
    df = replay.replay(calls, bars).cache()
    return {(r.call_id, r.reading): r for r in df.collect()}, df


@pytest.mark.parametrize("name", CASES)
def test_case(outcomes, name):
    for reading, (cls, day, price) in CASES[name][1].items():
        r = outcomes[0][name, reading]
        assert r.cls == cls and (day is None or r.exit_day == day) and (price is None or r.exit_price == price)


def test_codes_notes_and_firm(outcomes):
    got, df = outcomes
    assert got["never traded there", "best"].code == "price-mismatch" and got["no entry, intraday", "best"].code == "no-entry"
    assert got["trigger never trades", "best"].code == "level-not-reached" and got["not traded", "best"].code == "not-traded"
    assert "bothSameDay" in [n.k for n in got["both touched", "best"].notes] and got["later bar", "worst"].ret_pct == 30
    firm = {r.call_id: r.firm for r in replay.firm(df).collect()}
    assert firm["message day"] is False and firm["later bar"] is True and firm["not traded"] is None
    assert {r.call_id for r in replay.differing(df).collect()} >= {"message day", "both touched"}


LINES = "call_id string, reading string, cls string, entry_day int, exit_day int, entry_price double, exit_price double, move double, ret_pct double, days_held int, lot int"


def accounts(spark, rows, *variants, confidence="high", targets=(130.0,), lot=50):
    calls = spark.createDataFrame([(1, str(r[0]), r[0], 0, "option", "long", list(targets), 80.0, confidence) for r in rows], "channel_id long, call_id string, msg_id long, pos int, kind string, side string, targets array<double>, stop double, confidence string")
    out = spark.createDataFrame([(str(i), "likely", cls, a, b, float(e), float(x), float(x - e), (x - e) / e * 100, b - a, lot) for i, a, b, e, x, cls in rows], LINES)
    q = ledger.queue(calls, out, ledger.params_table(spark, *variants))
    folded = ledger.lines(q).cache()
    return q, {r.call_id: r for r in folded.collect()}, ledger.account(folded).first()


def test_whole_lots(spark):
    q, line, acc = accounts(spark, [(1, 10, 10, 100, 130, "target")])
    assert (line["1"].lots, line["1"].quantity, line["1"].blocked, line["1"].gross) == (2, 100, 10_000, 3_000) and acc.hit_rate == 1
    r = ledger.record(q).first()
    assert r.checked == 1 and r.chance_hit_rate == pytest.approx(20 / 50)


def test_out_of_money(spark):
    _, line, acc = accounts(spark, [(1, 10, 10, 600, 0, "expired"), (2, 11, 11, 390, 0, "expired"), (3, 12, 12, 100, 130, "target")])
    assert line["1"].net == -30_040 and line["3"].status == "no-funds" and acc.out_of_money_day == 12 and acc.final_balance == 420


def test_exclusions(spark):
    rows = [(1, 10, 10, 100, 130, "target")]
    q = ledger.queue(*_pair(spark, rows, "low"), ledger.params_table(spark, {}, {"include_low_confidence": True}))
    got = {r.param_id: r for r in ledger.counts(q).collect()}
    assert (got[0].low_confidence, got[0].queued, got[1].queued) == (1, 0, 1)


def _pair(spark, rows, confidence):
    calls = spark.createDataFrame([(1, str(r[0]), r[0], 0, "option", "long", [130.0], 80.0, confidence) for r in rows], "channel_id long, call_id string, msg_id long, pos int, kind string, side string, targets array<double>, stop double, confidence string")
    out = spark.createDataFrame([(str(i), "likely", cls, a, b, float(e), float(x), float(x - e), 1.0, b - a, 50) for i, a, b, e, x, cls in rows], LINES)
    return calls, out


def test_loan(spark):
    _, _, acc = accounts(spark, [(1, 10, 10, 600, 100, "stop"), (2, 30, 31, 500, 100, "stop")], {"borrowed_fraction": 0.6})
    assert acc.own_money_gone_day == 10 and acc.owed == 30_900 and acc.net_worth < 0


def test_drawdown(spark):
    _, line, acc = accounts(spark, [(1, 10, 10, 100, 200, "target"), (2, 11, 11, 100, 0, "expired")])
    assert acc.max_drawdown_pct > 15 and sum(r.balance_after is not None for r in line.values()) == 2


def test_accounts_are_carried_from_batch_to_batch():
    """The streamed fold gives one result however its rows are cut into batches, and holds open positions only."""
    import random

    import pyarrow as pa

    rng, rows = random.Random(6), []
    for channel in (1, 2, 3):
        for k in range(200):
            price = rng.choice((40.0, 900.0, 7_000.0))
            out = price * rng.choice((0.2, 0.9, 1.3))
            rows.append(dict(channel_id=channel, reading="likely", param_id=0, capital=20_000.0, borrowed_fraction=0.0, loan_monthly_rate=0.03, call_id=f"{channel}.{k}", msg_id=k, pos=0, posted=k, kind="equity", side="long", cls="target",
                             entry_day=k // 3, exit_day=None if k % 50 == 0 else k // 3 + rng.randrange(6), entry_price=price, exit_price=out, move=out - price, days_held=0, lot=1, unit=price, wanted=max(1, int(4_000 // price))))
    whole = pa.RecordBatch.from_pylist(rows)
    one = [r for b in ledger._fold(iter([whole])) for r in b.to_pylist()]
    for size in (1, 7, 200, 333):
        cut = [r for b in ledger._fold((whole.slice(i, size) for i in range(0, len(rows), size)), most=5) for r in b.to_pylist()]
        assert cut == one
    assert len(one) == 600 and {r["status"] for r in one} == {"taken", "no-funds"} and [b.num_rows for b in ledger._fold(iter([]))] == [0]
