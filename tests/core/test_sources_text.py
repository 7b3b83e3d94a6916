"""Sources, text rules and the entry point."""

import datetime
import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import text as T
from tapewright.operators import messages as M
from tapewright.sources import chats, market


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_packed_table_round_trip():
    cols = [[0, 5, 3, 2**40, -7], [-1, -2, -3, 0, 9]]
    assert [list(map(int, c)) for c in market.decode_table(market.encode_table(cols))] == cols
    with pytest.raises(ValueError):
        market.encode_table([[1], [1, 2]])
    with pytest.raises(ValueError):
        market.decode_table(__import__("gzip").compress(b"nope!"))


def test_packed_files(spark, tmp_path):
    (tmp_path / "TCS.rkn").write_bytes(market.encode_table([[0, 1], [100, 200], [110, 210], [90, 190], [105, 205], [7, 8]]))
    got = market.packed_bars(spark, f"file://{tmp_path}").orderBy("d").collect()
    assert [(r.key, r.d, r.o, r.v) for r in got] == [("TCS", 0, 1.0, 7), ("TCS", 1, 2.0, 8)]


def _line(**k):
    f = [""] * 34
    for name, v in k.items():
        f[market.CSV[name]] = str(v)
    return ",".join(f)


def test_exchange_files(spark):
    lines = [(0, _line(symbol="A", series="BE", name="a", o=10, h=11, l=9, c=10, prev=10, v=5)), (0, _line(symbol="A", series="EQ", name="a", o=20, h=21, l=19, c=20, prev=20, v=5)), (0, _line(symbol="B", series="XX", v=1)), (0, "short,line")]
    got = market.cash_bars(spark.createDataFrame(lines, "day int, line string")).collect()
    assert [(r.symbol, r.series, r.o) for r in got] == [("A", "EQ", 20.0)]
    fo = [(0, _line(type="IDO", symbol="N", expiry="2025-01-30", strike=100, opt_type="CE", o=5, h=6, l=4, c=99, last=5.5, under=101, v=3, lot=75)), (0, _line(type="STF", symbol="S", expiry="2025-01-30", o=5, h=6, l=4, c=5, last=5, v=3, lot=10))]
    d = market.derivative_bars(spark.createDataFrame(fo, "day int, line string"))
    assert {(r.symbol, r.kind, r.c) for r in d.collect()} == {("N", "option", 5.5), ("S", "future", 5.0)}
    assert market.contracts(d).where("symbol = 'N'").first().has_options and market.spot(d).first().price == 101


def test_candidate_expiries(spark):
    e = spark.createDataFrame([("N", datetime.date(2025, 10, x)) for x in (7, 14, 21, 28)] + [("N", datetime.date(2025, 11, 4))], "symbol string, expiry date")
    c = spark.createDataFrame([(1, "N", datetime.date(2025, 10, 8), None, None), (2, "N", datetime.date(2025, 10, 1), 15, 10), (3, "N", datetime.date(2025, 10, 1), None, 10)], "call_id int, symbol string, today date, hint_day int, hint_month int")
    got: dict = {}
    for r in market.candidate_expiries(c, e).orderBy("call_id", "rank").collect():
        got.setdefault(r.call_id, []).append(r.expiry.isoformat()[5:])
    assert got == {1: ["10-14", "10-21", "10-28", "11-04"], 2: ["10-14"], 3: ["10-28"]}


def test_whatsapp(spark):
    text = "12/09/25, 9:20 am - Asha: BUY TCS\nabove 100\n\n12/09/25, 9:30 pm - Asha: <Media omitted>\n[13/09/25, 12:05:11 AM] Asha: late\n99/99/25, 9:20 am - Asha: bad date"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id int, line_no int, line string")
    got = chats.whatsapp_export(lines).orderBy("msg_id").collect()
    assert [(r.text, r.has_photo) for r in got] == [("BUY TCS\nabove 100", False), ("", True), ("late", False)]
    assert got[0].ts == datetime.datetime(2025, 9, 12, 3, 50) and got[2].ts == datetime.datetime(2025, 9, 12, 18, 35, 11)
    assert chats.looks_like_whatsapp(lines).first().whatsapp


def test_pasted_text_and_pasted_chats(spark):
    chat = "12/09/25, 9:20 am - Asha: BUY TCS\nabove 100\n12/09/25, 9:30 pm - Asha: SOLD"
    df = spark.createDataFrame([(1, "one\n\n two \n\n\n"), (2, chat), (3, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.msg_id, r.text) for r in chats.pasted(df, "2025-01-01 00:00:00").collect())
    assert got == [(1, 1, "one"), (1, 2, "two"), (2, 1, "BUY TCS\nabove 100"), (2, 2, "SOLD")]


def test_telegram_export(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"name": "Ch", "messages": [{"id": 1, "type": "message", "date": "2025-01-01T10:00:00", "date_unixtime": "1735700400", "text": ["BUY ", {"type": "bold", "text": "TCS"}]}, {"id": 2, "type": "service", "date": "2025-01-01T10:00:00", "text": ""}, {"id": 3, "type": "message", "date": "2025-01-01T10:00:00", "text": "plain", "reply_to_message_id": 1, "photo": "a.jpg"}]}')
    got = chats.telegram_export(spark, f"file://{tmp_path}/r.json").orderBy("msg_id").collect()
    assert [(r.msg_id, r.text, r.reply_to, r.has_photo) for r in got] == [(1, "BUY TCS", None, False), (3, "plain", 1, True)]
    assert got[1].ts == datetime.datetime(2025, 1, 1, 4, 30)


def test_handles(spark):
    got = [one(spark, x, chats.handle) for x in ("@abcd", "t.me/abcd", "https://t.me/s/abcd", "no spaces here", "ab")]
    assert got == ["abcd", "abcd", "abcd", None, None]


def test_html(spark):
    assert one(spark, "a &amp; b<br/>c &#8377;5 &#x41; &what; <b>x</b></p> ", T.html_to_text) == "a & b\nc ₹5 A &what; x"


def test_normalise(spark):
    n = lambda x: one(spark, x, T.normalise).strip()
    assert n("बैंक निफ्टी 56800 कॉल खरीदें १२० के ऊपर") == "BANKNIFTY 56800 CE BUY 120 ABOVE"
    assert n("Nifty (24500) ce @ ₹1,24,500 tgt 50k") == "NIFTY 24500 CE @ 124500 TGT"
    assert n("don't buy tcs ke upar 100") == "TCS ABOVE 100"


def test_distance(spark):
    df = spark.createDataFrame([("abcd", "abdc"), ("abcd", "abcd"), ("abc", "xbcd"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(T.osa_distance("a", "b")).collect()] == [1, 0, 2, None]


@pytest.mark.parametrize("text, kind", [("TCS TARGET HIT", "target-hit"), ("SL HIT", "stop-hit"), ("BOOK PROFIT NOW", "profit"), ("EXIT", "exit"), ("NICE DAY", None)])
def test_follow_kinds(spark, text, kind):
    assert one(spark, text, M.follow_kind) == kind


def test_calls_from_text(spark):
    d = spark.createDataFrame([("NIFTY", "NIFTY", "index"), ("TCS", "TCS", "stock"), ("BANKNIFTY", "BANKNIFTY", "index")], "key string, symbol string, kind string")
    texts = ["BUY NIFTY 24000 CE ABOVE 100 TGT 130/150 SL 80", "Sell TCS at 130-40 target 100 SL 150 intraday", "NIFTY TARGET HIT", "good morning", "BUY TCS CMP 3500 TARGET 3600 DISCLAIMER none"]
    m = spark.createDataFrame([(1, i, datetime.datetime(2025, 1, 1), t, False) for i, t in enumerate(texts)], "channel_id int, msg_id int, ts timestamp, text string, has_photo boolean")
    got = {r.msg_id: r for r in M.read_calls(m, d).collect()}
    assert set(got) == {0, 1, 4}
    assert (got[0].symbol, got[0].kind, got[0].strike, got[0].opt_type, got[0].entry.type, got[0].entry.lo, got[0].targets, got[0].stop) == ("NIFTY", "option", 24000, "CE", "above", 100, [130, 150], 80)
    assert (got[1].side, got[1].horizon, got[1].entry.type, got[1].entry.hi, got[1].targets) == ("short", "intraday", "range", 140, [100])
    assert (got[4].kind, got[4].entry.lo, got[4].targets) == ("equity", 3500, [3600])


def test_imports_without_the_corpus_subpackage(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setattr(entry, "CORPUS", ("tapewright.not_there",))
    with pytest.warns(UserWarning):
        assert "agg_record" in entry.queries()
    assert "agg_record" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert np.__name__ in sys.modules
