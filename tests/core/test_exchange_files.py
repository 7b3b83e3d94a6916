"""From downloaded exchange files to a packed market."""

import datetime as dt
import os
import zipfile

from tapewright.sources import exchange_files as X
from tapewright.sources import market
from tapewright.sources import packed_source as S

DAYS = ["20250102", "20250103", "20250106", "20250107"]


def _line(**values):
    f = [""] * 34
    for k, v in values.items():
        f[market.CSV[k]] = str(v)
    return ",".join(f)


def _cash(symbol, series, o, c, v=10, prev=None, name=None):
    return _line(type="STK", symbol=symbol, series=series, name=name or symbol.title(), o=o, h=max(o, c) + 1, l=min(o, c) - 1, c=c, prev=prev or o, v=v)


def _deal(kind, symbol, expiry, c, strike="", opt_type="", v=5, lot=50, under="", last=None):
    return _line(type=kind, symbol=symbol, expiry=expiry, strike=strike, opt_type=opt_type, o=c, h=c + 2, l=c - 2, c=c, last=last or c, v=v, lot=lot, under=under)


def _zip(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.csv", end.join(["header", *lines, ""]))
        z.writestr("second.csv", "not,read")


def test_files_in_market_out(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    cash = [
        [_cash("AB", "BE", 99, 98), _cash("AB", "EQ", 100, 101), _cash("AB", "EQ", 77, 77), _cash("C&D", "SM", 40, 41), _cash("E", "GB", 5, 5), "short,line"],
        [_cash("AB", "EQ", 102, 103, name="Old"), _cash("C&D", "SM", 42, 43), _cash("F", "EQ", 9, 9, v=0)],
        [_cash("AB", "EQ", 51, 52, prev=51.5, name="Ab Ltd"), _cash("C&D", "EQ", 44, 45)],  # a 1:1 bonus restates the last close
        [_cash("AB", "EQ", 53, 54)],
    ]
    for day, rows in zip(DAYS, cash):
        _zip(f"{raw}/cm/{day}.zip", rows)
    _zip(f"{raw}/fo/{DAYS[0]}.zip", [_deal("IDO", "IX", "2025-01-09", 20, 100, "CE", under=101.5), _deal("IDO", "IX", "2025-01-09", 30, 100, "PE", lot=0, under=999), _deal("STO", "AB", "2025-01-30", 4, 110, "CE"), _deal("IDF", "IX", "2025-01-30", 102, under=101.5)])
    _zip(f"{raw}/fo/{DAYS[1]}.zip", [_deal("IDO", "IX", "2025-01-09", 25, 100, "CE", v=0, under=103.25), _deal("IDO", "IX", "2025-01-09", 40, 100, "PE", lot=75, last=500), _deal("STO", "AB", "2025-01-30", 6, 110, "CE")], end="\r\n")
    _zip(f"{raw}/fo/20250104.zip", [_deal("IDF", "IX", "2025-01-30", 1)])  # no trading day
    os.makedirs(f"{raw}/bfo")
    with open(f"{raw}/bfo/{DAYS[0]}.csv", "w") as f:
        f.write("\r\n".join(["header", _deal("IDF", "SX", "2025-01-28", 700, under=690), _deal("STF", "AB", "2025-01-28", 1), _deal("IDF", "IX", "2025-01-28", 9, under=1)]))
    X.build(spark, raw, out, until=dt.date(2025, 1, 6), stock_options_from=dt.date(2025, 1, 3))
    days, symbols, expiries = S.market_dimensions(spark, out)
    assert [str(r.dt) for r in days.orderBy("d").collect()] == ["2025-01-02", "2025-01-03", "2025-01-06"]
    info = {r.symbol: r for r in symbols.collect()}
    assert set(info) == {"AB", "C&D"} and info["AB"].name == "Ab Ltd" and [(s.d, s.factor) for s in info["AB"].splits] == [(2, 0.5)]
    assert (info["C&D"].sme, info["C&D"].series, info["C&D"].first_d, info["C&D"].last_d, info["AB"].sme) == (True, "EQ", 0, 2, False)
    rows = S.market_bars(spark, out).collect()
    assert {(r.symbol, r.d, r.o, r.c) for r in rows if r.kind == "cash"} == {("AB", 0, 100.0, 101.0), ("AB", 1, 102.0, 103.0), ("AB", 2, 51.0, 52.0), ("C&D", 0, 40.0, 41.0), ("C&D", 1, 42.0, 43.0), ("C&D", 2, 44.0, 45.0)}
    assert {(r.symbol, str(r.expiry), r.strike, r.opt_type, r.d, r.c) for r in rows if r.kind == "option"} == {
        ("IX", "2025-01-09", 100.0, "CE", 0, 20.0), ("IX", "2025-01-09", 100.0, "PE", 0, 30.0), ("IX", "2025-01-09", 100.0, "PE", 1, 40.0), ("AB", "2025-01-30", 110.0, "CE", 1, 6.0)}
    assert {(r.symbol, str(r.expiry), r.d, r.c) for r in rows if r.kind == "future"} == {("IX", "2025-01-30", 0, 102.0), ("SX", "2025-01-28", 0, 700.0), ("IX", "2025-01-28", 0, 9.0)}
    # the first line of a day that has a value, of the first exchange; of untraded contracts too
    assert {(r.symbol, r.d, r.c) for r in rows if r.kind == "spot"} == {("IX", 0, 101.5), ("IX", 1, 103.25), ("SX", 0, 690.0)}
    assert {(r.symbol, r.kind, str(r.expiry), r.lot) for r in expiries.collect()} == {("IX", "index", "2025-01-09", 75), ("IX", "index", "2025-01-28", 50), ("IX", "index", "2025-01-30", 50), ("SX", "index", "2025-01-28", 50), ("AB", "stock", "2025-01-30", 50)}


def test_long_members_leave_in_batches(spark, tmp_path, monkeypatch):
    lines = [_cash(f"S{k}", "EQ", 10 + k % 9, 11) for k in range(20_000)]
    _zip(f"{tmp_path}/cm/BhavCopy_NSE_CM_20250102_F.zip", lines)
    _zip(f"{tmp_path}/cm/undated.zip", lines)
    files = X.folder(spark, f"{tmp_path}/cm", "zip").select("path", "content")
    got = X.file_lines(files)
    assert got.count() == 20_000 and got.select("day").distinct().count() == 1 and got.agg({"line_no": "max"}).first()[0] == 20_000
    assert X.folder(spark, f"{tmp_path}/none", "zip").count() == 0
    plan = X.trading_days(files)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("FileScan")[-1].split("Batched")[0] and X.trading_days(files).count() == 1
