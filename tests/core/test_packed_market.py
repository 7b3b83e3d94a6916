"""The packed market: written, read back, and read in part."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tapewright.operators import replay
from tapewright.sources import market
from tapewright.sources import packed_source as S

DAY = dt.date(2025, 1, 2)


def _rows():
    rows = []
    for k, s in enumerate(("AB", "C&D", "E F")):
        rows += [("cash", s, None, None, None, d, 10.0 + d, 11.5 + d, 9.25 + d, 10.75 + d, 100 * d + k) for d in range(5)]
    for s in ("IX", "AB"):
        for w in range(3):
            e = DAY + dt.timedelta(days=7 * w)
            rows += [("option", s, e, 100.0 + 2.5 * k, t, d, 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 7 + d) for k in range(2) for t in ("CE", "PE") for d in range(3)]
            rows += [("future", s, e, None, None, d, 50.0, 51.0, 49.0, 50.5, 3) for d in range(4)]
        rows += [("spot", s, None, None, None, d, None, None, None, 77.7 + d, None) for d in range(6)]
    return rows


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("market"))
    days = spark.createDataFrame([(d, DAY + dt.timedelta(days=d)) for d in range(6)], "d int, dt date")
    names = spark.createDataFrame([("AB", "A and B", "EQ", 0, 4, False, [(3, 0.5)]), ("C&D", "C", "SM", 0, 4, True, [])], "symbol string, name string, series string, first_d int, last_d int, sme boolean, splits array<struct<d: int, factor: double>>")
    expiries = spark.createDataFrame([("IX", "index", DAY, 25)], "symbol string, kind string, expiry date, lot int")
    S.write_market(spark.createDataFrame(_rows(), S.SCHEMA).repartition(7), at, days, names, expiries)
    return at


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_all_kinds_come_back(spark, path):
    assert _sorted(S.market_bars(spark, path).collect()) == _sorted(_rows())
    files = sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".rkn"))
    assert len(files) == 3 + 2 * (3 + 1 + 1) and "cm/C_D.rkn" in files and "fo/IX/20250102.rkn" in files and not os.path.exists(f"{path}/_attempts/x")
    # the cash layout is what the plain decoder reads
    assert market.packed_bars(spark, f"{path}/cm/AB.rkn").count() == 5
    days, symbols, expiries = S.market_dimensions(spark, path)
    assert days.count() == 6 and {(r.symbol, r.sme, len(r.splits)) for r in symbols.collect()} == {("AB", False, 1), ("C&D", True, 0), ("E F", False, 0)}
    assert {(r.symbol, r.kind, r.lot) for r in expiries.where("has_options and has_futures").collect()} == {("IX", "index", 25), ("IX", "index", 0), ("AB", "stock", 0)}


def test_what_is_asked_for_chooses_files(spark, path):
    files = lambda **asked: [t[3] for t in S.PackedReader(path, 2, **({"kinds": [], "symbols": [], "since": "", "until": ""} | asked)).tables()]
    assert files(kinds=["option"], symbols=["IX"], until="2025-01-02") == ["fo/IX/20250102.rkn"]
    assert files(kinds=["cash"], symbols=["E F", "AB"]) == ["cm/AB.rkn", "cm/E_F.rkn"]
    assert files(symbols=["AB"], since="2025-01-10") == ["cm/AB.rkn", "fo/AB/20250116.rkn", "fo/AB/fut.rkn", "fo/AB/u.rkn"]
    some = S.market_bars(spark, path, ("option",), ("IX",), DAY, DAY, group=1)
    assert some.rdd.getNumPartitions() == 1
    assert _sorted(some.where("strike > 100").collect()) == _sorted(r for r in _rows() if r[:3] == ("option", "IX", DAY) and r[3] > 100)
    late = S.market_bars(spark, path, ("future",), since=DAY + dt.timedelta(days=1), group=1)
    assert late.count() == 2 * 2 * 4 and late.rdd.getNumPartitions() == 2


def test_one_frame_read_in_two_ways(spark, path):
    bars = S.market_bars(spark, path, group=1)
    cash, spot = bars.where("kind = 'cash'"), bars.where("kind = 'spot'")
    assert cash.unionByName(spot).count() == 15 + 12 and bars.count() == len(_rows()) and bars.rdd.getNumPartitions() == 13


def test_writing_again_replaces_and_keeps_one_index(spark, path, tmp_path):
    at = str(tmp_path)
    rows = [r for r in _rows() if r[1] == "AB"]
    for _ in range(2):
        S.write_market(spark.createDataFrame(rows, S.SCHEMA), at)
    S.write_market(spark.createDataFrame([r for r in _rows() if r[1] == "IX" and r[0] == "option"], S.SCHEMA), at)
    assert S.market_bars(spark, at).count() == len(rows) + 36 and len(json.load(open(f"{at}/fo/index.json"))["AB"]["x"]) == 3
    os.remove(f"{at}/cm/AB.rkn")  # named but gone: no bars
    assert S.market_bars(spark, at).where("kind = 'cash'").count() == 0
    with pytest.raises(Exception, match="two symbols of one file key"):
        S.write_market(spark.createDataFrame([("cash", s, None, None, None, 1, 1.0, 1.0, 1.0, 1.0, 1) for s in ("A&B", "A B")], S.SCHEMA), at)
    assert not os.path.exists(f"{at}/_attempts") or not os.listdir(f"{at}/_attempts")


def test_empty_market(spark, tmp_path):
    S.write_market(spark.createDataFrame([], S.SCHEMA), str(tmp_path))
    assert S.market_bars(spark, str(tmp_path)).collect() == []


def test_options_and_futures_are_replayed(spark, path):
    """A call on each contract, replayed on the bars that the reader gives."""
    b = S.market_bars(spark, path, ("option", "future"))
    key = F.concat_ws("|", "symbol", "expiry", "strike", "opt_type")
    calls = b.select(key.alias("instrument_id"), "kind").distinct().withColumns({
        "call_id": F.col("instrument_id"), "side": F.lit("long"), "entry_type": F.lit("none"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"),
        "targets": F.array(F.lit(900.0)), "stop": F.lit(None).cast("double"), "horizon": F.lit("unspecified"), "day": F.lit(0), "session": F.lit("before-open"),
        "minutes_in": F.lit(None).cast("int"), "last_day": F.lit(5), "expiry_day": F.lit(2), "settlement": F.lit(None).cast("double"), "announced": F.lit(False),
    })
    got = replay.replay(calls, b.select(key.alias("instrument_id"), "d", "o", "h", "l", "c", "v"), ("likely",)).collect()
    assert len(got) == 24 + 6 and {r.cls for r in got} == {"expired"} and all(r.exit_day == 2 for r in got)
    assert {(r.entry_price, r.exit_price) for r in got} == {(1.0, 1.5), (2.0, 2.5), (50.0, 50.5)}
