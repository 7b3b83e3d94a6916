"""Transcripts, spoken numbers, streams, report rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.functions.say import say, say_column
from tapewright.operators import report
from tapewright.plans import market_queries, text_queries
from tapewright.sources import transcripts as S
from tapewright.streaming import tape

DAY = dt.date(2025, 12, 1)
CHAT = """Old post above the day
820 o 18:20
December 1
ALPHA GROUP
BUY BANKNIFTY 59400 PE At 380 SL PAID
TGT 600
824 o 10:09
ALPHA GROUP
BUY NIFTY 26500 PE At 190
791 o 10:15
ALPHA GROUP
BUY BANKNIFTY 59400 PE At 38...
CMP PRICE 600
729 o 11:01 am
BUY NIFTY 26500 PE At 190
791 o 10:15"""


def _read(spark, *texts, day=DAY):
    df = spark.createDataFrame([(i, t, day) for i, t in enumerate(texts)], "doc_id long, text string, day date")
    return [[r for r in S.transcripts(df).orderBy("doc_id", "msg_id").collect() if r.doc_id == i] for i in range(len(texts))]


def _guess(spark, text, today):
    got = S.guess_days(spark.createDataFrame([(1, text, today)], "doc_id long, text string, today date")).first()
    return got and got.day


def test_bubbles_replies_and_overlaps(spark):
    (got,) = _read(spark, CHAT)
    assert [(m.text, m.reply_to) for m in got] == [("BUY BANKNIFTY 59400 PE At 380 SL PAID\nTGT 600", None), ("BUY NIFTY 26500 PE At 190", None), ("CMP PRICE 600", 1)]
    assert got[0].ts == dt.datetime(2025, 12, 1, 4, 39) and _guess(spark, CHAT, dt.date(2026, 10, 2)) == DAY


def test_date_under_the_messages(spark):
    text = 'CMP PRICE 480" "100" POINT\nPROFIT 7000 RS/ 2 LOT\n821 © 14:41\nDecember 2, 2025'
    assert _guess(spark, text, dt.date(2026, 10, 2)) is None
    assert [m.ts for m in _read(spark, text)[0]] == [dt.datetime(2025, 12, 1, 9, 11)]


def test_dates_go_forward_and_bubbles_without_a_time_follow(spark):
    text = "first\n10:00\n30 December\nsecond\n1 January\nthird\n9:05 pm\n5/1/24\nfourth\n12.3K subscribers\nfifth\n0:10"
    (got,) = _read(spark, text)
    ist = lambda *a: dt.datetime(*a) - dt.timedelta(minutes=330)
    assert [(m.text, m.ts) for m in got] == [("first", ist(2025, 12, 1, 10)), ("second", ist(2025, 12, 30, 10, 1)), ("third", ist(2026, 1, 1, 21, 5)), ("fifth", ist(2024, 1, 5, 0, 10))]
    assert got[0].subscribers == "12.3K"


def test_quotes_of_quotes(spark):
    a, b = "BUY NIFTY 26500 PE AT 190 NOW", "CMP PRICE 250 BOOK HALF OF IT"
    (got,) = _read(spark, f"{a}\n10:00\n{a}\n{b}\n10:05\nx {b}\nEXIT ALL\n10:10")
    assert [(m.text, m.reply_to) for m in got] == [(a, None), (b, 1), ("EXIT ALL", 2)]


def test_untimed_text_is_split_at_blank_lines(spark):
    df = spark.createDataFrame([(1, "one\n\ntwo", DAY), (2, None, DAY)], "doc_id long, text string, day date")
    assert [(r.doc_id, r.msg_id, r.text) for r in S.transcripts(df).orderBy("msg_id").collect()] == [(1, 1, "one"), (1, 2, "two")]


@pytest.mark.parametrize("n, words", [(8435, "eight thousand four hundred and thirty-five"), (0, "zero"), (-20, "minus twenty"), (50_000, "fifty thousand"), (100_00_000, "one crore")])
def test_say(n, words):
    assert say(n) == words


def test_say_other_languages(spark):
    assert say(8435, "hi") == "आठ हज़ार चार सौ पैंतीस" and say(12.5, "ta") == "13"
    assert spark.range(1).select(say_column(F.lit(7.0), F.lit("en"))).first()[0] == "seven"


def test_stream_counts_selling(spark, tmp_path):
    rows = [(1, dt.datetime(2025, 1, 1, 10, 5), "JOIN OUR VIP GROUP"), (1, dt.datetime(2025, 1, 1, 10, 6), "hello")]
    spark.createDataFrame(rows, "channel_id long, ts timestamp, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel_id long, ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = tape.selling_per_hour(stream).writeStream.outputMode("complete").format("memory").queryName("selling").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.selling) for r in spark.sql("SELECT n, selling FROM selling").collect()] == [(2, 1)]


def test_ticker_and_codes(spark):
    m = spark.createDataFrame([(1, i, dt.datetime(2025, 1, 1, 0, i), t) for i, t in enumerate(["a", "b", "a", " "])], "channel_id int, msg_id int, ts timestamp, text string")
    assert sorted(r.line for r in report.ticker(m).collect()) == ["a", "b"]


@pytest.mark.parametrize("name", ["src_cash", "win_shapes", "flags", "agg_record", "fn_promo", "extract_calls"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    q, sql = (market_queries.QUERIES | text_queries.QUERIES)[name], (market_queries.SQL | text_queries.SQL)[name]
    got = q(spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    clean = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(clean, want))) == sorted(map(repr, map(clean, (tuple(r) for r in got.collect()))))
