"""Registers, annexures, equity curves and opening stretches, case by case."""

import json

import pytest

from tapewright.operators import curve
from tapewright.operators import messages as M
from tapewright.sources import reference_files as R


def _lines(spark, files):
    return spark.createDataFrame([(f, k, x) for f, rows in files.items() for k, x in enumerate(rows)], "file string, row int, line string")


def test_header_is_found_in_each_file(spark, tmp_path):
    files = {
        "a": ["Title, of it", "", 'No,NAME,"Registration No.",From,To', "1,\"One, Ltd\",inh000000001 ,2020,2025", "2,Two,INX9,,", "3,Three,INA000000003", "4,Last,INH000000001,2021,"],
        "b": ["number,name,registration no", "x,Four,ina000000004"],
    }
    got = {(r.file, r.reg_no): (r.name, r.valid_from, r.valid_to) for r in R.register(_lines(spark, files)).collect()}
    assert got == {("a", "INH000000001"): ("Last", "2021", ""), ("a", "INA000000003"): ("Three", "", ""), ("b", "INA000000004"): ("Four", "", "")}
    with pytest.raises(Exception, match="no header row in c"):
        R.register(_lines(spark, {"c": ["Name,From", "x,y"]})).collect()
    (tmp_path / "x.csv").write_text("t\r\nName,Registration No\r\nA,INH000000009")
    assert [(r.file, r.reg_no, r.name) for r in R.register(R.csv_lines(spark, str(tmp_path / "x.csv"))).collect()] == [("x.csv", "INH000000009", "A")]


def test_annexures_of_any_shape(spark):
    docs = [
        ("a", json.dumps({"pdf": 1, "rows": [{"page": 3, "recoDate": "2025-01-01", "scrip": "X Ltd", "recoTime": "9:15", "effDateT": "2025-01-02", "more": {"deep": [1]}}, {"page": "n/a", "Scrip Name": "Y", "reco_time": None}, {"page": 1}]})),
        ("b", "no json"), ("c", '{"rows": 5}'), ("d", "[]"), ("e", None), ("f", '{"rows": []}'),
    ]
    got = sorted(map(tuple, R.annexure(spark.createDataFrame(docs, "document string, value string")).collect()), key=repr)
    assert got == [("a", 3, "2025-01-01", "X Ltd", "9:15", "2025-01-02"), ("a", None, None, "Y", None, None)]
    own = R.annexure(spark.createDataFrame([("z", '{"rows": [{"Firma": "Q"}]}')], "document string, value string"), {"scrip": ("Firma",)})
    assert own.first().scrip == "Q"


def test_coverage_counts_each_thing_once(spark):
    rows = [("X", "d1", "t", "SX", True, "sme"), ("X", "d1", "t", "SX", True, "sme"), ("X", "d2", "t", "SX", False, "sme"), ("Y", "d1", "t", None, False, "main")]
    got = {r[0] if not r.whole else "all": r for r in R.coverage(spark.createDataFrame(rows, "scrip string, reco_date string, reco_time string, symbol string, measured boolean, board string"), "board").collect()}
    assert [got["all"][k] for k in ("rows", "recommendations", "scrips", "scrips_in_data", "measured", "not_measured", "stocks_measured")] == [4, 3, 2, 1, 1, 2, 1] and got["sme"].rows == 3


def test_descriptions_come_before_messages(spark):
    m = spark.createDataFrame([(1, 5, "INH000000001 INA000000002"), (1, 3, "ina000000002"), (2, 1, "none")], "channel_id int, msg_id int, text string")
    ch = spark.createDataFrame([(1, "by inh000000001"), (2, None), (3, "INAIFSC10001")], "channel_id int, description string")
    assert {(r.channel_id, r.reg_no, r.place, r.msg_id) for r in M.registrations(m, None, ch).collect()} == {(1, "INH000000001", "description", None), (1, "INA000000002", "message", 3), (3, "INAIFSC10001", "description", None)}
    assert {(r.reg_no, r.msg_id) for r in M.registrations(m, None).collect()} == {("INH000000001", 5), ("INA000000002", 3)}


LINES = "channel_id long, reading string, param_id int, call_id string, status string, net double, entry_day int, exit_day int, balance_after double, settled int, capital double"


def test_equity_moves_when_a_call_settles(spark):
    rows = [(1, "likely", 0, "a", "taken", 5.0, 2, 4, 105.0, 0, 100.0), (1, "likely", 0, "b", "taken", -2.0, 3, 4, 103.0, 1, 100.0), (1, "likely", 0, "c", "taken", 1.0, 3, 7, 104.0, 2, 100.0), (1, "likely", 0, "d", "no-funds", None, 3, None, None, None, 100.0),
            (2, "likely", 0, "e", "taken", 1.0, 5, 5, 51.0, 0, 50.0), (3, "likely", 0, "f", "no-funds", None, 1, None, None, None, 9.0)]
    t = spark.createDataFrame(rows, LINES)
    got = lambda **k: {ch: [(r.d, r.balance) for r in sorted(curve.equity_steps(t, **k).collect(), key=lambda r: r.d) if r.channel_id == ch] for ch in (1, 2, 3)}
    assert got() == {1: [(2, 100.0), (3, 100.0), (4, 103.0), (5, 103.0), (6, 103.0), (7, 104.0)], 2: [(5, 51.0)], 3: [(1, 9.0)]}
    assert [d for d, _ in got(until=8)[2]] == [5, 6, 7, 8] and got(until=8)[1][-1] == (8, 104.0)


def test_opening_stretch(spark):
    texts = ["hello", "BUY A", "up\n\n 5", " ", "hit", "more", "BUY B", "x", "BUY C", "BUY D"]
    m = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "channel_id long, msg_id long, text string")
    k = spark.createDataFrame([(1, 1, "1"), (1, 6, "6.1"), (1, 6, "6.2"), (1, 8, "8"), (1, 9, "9")], "channel_id long, msg_id long, call_id string")
    res = spark.createDataFrame([(1, 4)], "channel_id long, msg_id long")
    rows = [(1, "likely", 0, "1", "taken", 40.0, 0, 0, 0.0, 0, 100.0), (1, "likely", 0, "6.2", "taken", -90.0, 0, 0, 0.0, 0, 100.0), (1, "likely", 0, "8", "no-funds", None, 0, 0, 0.0, 0, 100.0)]
    got = [(r.msg_id, r.kind, r.text, r.balance, r.peak) for r in curve.opening(m, k, res, spark.createDataFrame(rows, LINES)).orderBy("msg_id").collect()]
    assert got == [(1, "call", "BUY A", 140.0, 140.0), (2, "other", "up 5", 140.0, 140.0), (4, "brag", "hit", 140.0, 140.0), (6, "call", "BUY B", 50.0, 140.0), (7, "other", "x", 50.0, 140.0), (8, "call", "BUY C", 50.0, 140.0)]
    short = curve.opening(m, k.where("msg_id = 1"), res, spark.createDataFrame(rows[:1], LINES), most=1).collect()
    assert sorted(r.msg_id for r in short) == [1, 2]
