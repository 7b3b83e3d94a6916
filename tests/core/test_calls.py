"""Instruments and levels read from messages."""

import datetime

import pytest

from tapewright.operators import instruments as I
from tapewright.operators import messages as M

SYMBOLS = [("TCS", "Tata Consultancy Services Limited", 0, 600), ("TVSMOTOR", "TVS Motor Company Limited", 0, 600), ("GANDHAR", "Gandhar Oil Refinery (India) Limited", 0, 600), ("RELIANCE", "Reliance Industries Limited", 0, 600), ("MCX", "Multi Commodity Exchange of India Limited", 0, 600), ("KAYNES", "Kaynes Technology India Limited", 0, 600), ("BSE", "BSE Limited", 0, 600), ("MANALIPETC", "Manali Petrochemicals Limited", 0, 600), ("IDEA", "Vodafone Idea Limited", 0, 600), ("ZOMATO", "Zomato Limited", 0, 300), ("ETERNAL", "Eternal Limited", 301, 600), ("ABCETF", "Abc Gold ETF", 0, 600)]
FO = [("NIFTY", "index"), ("BANKNIFTY", "index"), ("TCS", "stock"), ("TVSMOTOR", "stock"), ("RELIANCE", "stock"), ("KAYNES", "stock"), ("BSE", "stock")]


@pytest.fixture(scope="module")
def names(spark):
    d = I.dictionary(spark, spark.createDataFrame(SYMBOLS, "symbol string, name string, first_d int, last_d int"), spark.createDataFrame(FO, "symbol string, kind string"))
    return spark.createDataFrame(d.collect(), d.schema)


def messages(spark, texts, minutes=60, **more):
    rows = [(1, i, datetime.datetime(2025, 8, 12, 4) + datetime.timedelta(minutes=minutes * i), t, False, 400, more.get("reply_to", {}).get(i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "channel_id int, msg_id int, ts timestamp, text string, has_photo boolean, d int, reply_to int")


CASES = [
    ("Nifty 24500 ce 120 ke upar buy karo, target 150, sl 100", ("NIFTY", "option", "long", "above", 120, [150], 100, "high")),
    ("BUY BSE 3200 CE ABOVE 91 TRG 360/460/560 SL 60", ("BSE", "option", "long", "above", 91, [360, 460, 560], 60, "high")),
    ("BUY TCS CMP 3000 TARGET 1: 3100 TARGET 2: 3200 SL 2900", ("TCS", "equity", "long", "at", 3000, [3100, 3200], 2900, "high")),
    ("Bought #GANDHAR 247\nSL 1%\nTarget 4-6%", ("GANDHAR", "equity", "long", "at", 247, [256.88, 261.82], 244.53, "high")),
    ("BUY RELIANCE ABOVE 1300 TGT 20 POINTS SL 15 POINTS", ("RELIANCE", "equity", "long", "above", 1300, [1320], 1285, "high")),
    ("SELL TCS BELOW 100 TARGET 10 POINTS SL 5 %", ("TCS", "equity", "short", "below", 100, [90], 105, "high")),
    ("BUY KYNES 3450 CE 129 TRG 142-155-170 SL 90", ("KAYNES", "option", "long", "at", 129, [142, 155, 170], 90, "medium")),
    ("BUY TVSMOTORS @ 4396.8 SL 4344 TGT 4463", ("TVSMOTOR", "equity", "long", "at", 4396.8, [4463], 4344, "high")),
    ("Mcx sell below 3335\nTarget - 3325/ 3315\nSl- 3350\nIntraday\nRead everything to avoid any future conflict of interest.", ("MCX", "equity", "short", "below", 3335, [3325, 3315], 3350, "high")),
    ("BUY SEP 57100 PE @ 405 TGT 450 SL 380", ("?", "option", "long", "at", 405, [450], 380, "medium")),
    ("STOCK NAME = TVS MOTORS\nBUY ABOVE 2400 TGT 2450 SL 2380", ("TVSMOTOR", "equity", "long", "above", 2400, [2450], 2380, "high")),
    ("MANALIPETROCHEMICLS\nBUY AT 60 TGT 66 SL 58", ("MANALIPETC", "equity", "long", "at", 60, [66], 58, "medium")),
    ("BUY MANALIPETRO AT 60 TGT 66 SL 58", ("MANALIPETC", "equity", "long", "at", 60, [66], 58, "medium")),
    ("BUY ZOMATO AT 250 TGT 260 SL 240", ("ETERNAL", "equity", "long", "at", 250, [260], 240, "high")),
    ("BUY VODAFONE AT 8 TGT 9 SL 7", ("IDEA", "equity", "long", "at", 8, [9], 7, "medium")),
    ("BUY TCS ABOVE 147 TO 160-180-210 SL 120", ("TCS", "equity", "long", "above", 147, [160, 180, 210], 120, "high")),
    (" ".join(["WORD"] * 40) + " BUY TCS AT 3000 TGT 3100 SL 2950", ("TCS", "equity", "long", "at", 3000, [3100], 2950, "high")),
    ("BUY TCS AT 3000 TGT 2900 SL 0", ("TCS", "equity", "long", "at", 3000, [2900], None, "low")),
    ("Nifty need to manage above 24257/324 then perfect bullish formation.", None),
    ("NIFTY support 23500 resistance 24000, bank nifty looks weak below 54000", None),
    ("RELIANCE trading below support level. Next important zone near 1190-1220", None),
    ("CONTINUE POSTED OPTION IN ONLY BNF JUNE CE SINCE LAST 6 DAYS, EVERYONE BEARISH TGT 50K", None),
    ("a good idea to wait", None),
]


def test_inline_cases(spark, names):
    got = {r.msg_id: r for r in M.read_calls(messages(spark, [t for t, _ in CASES]), names).collect()}
    for i, (text, want) in enumerate(CASES):
        r = got.get(i)
        assert (r and (r.symbol, r.kind, r.side, r.entry.type, r.entry.lo, r.targets, r.stop, r.confidence)) == want, text


def test_several_calls_hints_and_notes(spark, names):
    texts = [
        "NIFTY 24000 CE BUY 100 TGT 120 SL 90\nBANKNIFTY 52000 PE BUY 200 TGT 240 SL 180",
        "BUY TCS AT 3000 TGT 3100 SL 2950\n\nSELL RELIANCE AT 1300 TGT 1250 SL 1320",
        "BUY NIFTY 25 SEP 24000 PE @ 100 TGT 120 SL 90", "BUY NIFTY SEPT26 24000 CE @ 100 TGT 120 SL 90", "BUY TCS AUG 3000 CE @ 100 TGT 120 SL 90", "BUY NIFTY MAY 24000 CE @ 100 TGT 120 SL 90",
        "BUY TCS 3000 CE AND 3100 CE @ 100 TGT 120 SL 90",
    ]
    rows = M.read_calls(messages(spark, texts), names).orderBy("msg_id", "pos").collect()
    assert [r.call_id for r in rows] == ["0.1", "0.2", "1.1", "1.2", "2", "3", "4", "5", "6"]
    assert [(r.symbol, r.strike, r.opt_type) for r in rows[:2]] == [("NIFTY", 24000, "CE"), ("BANKNIFTY", 52000, "PE")]
    assert [(r.hint_day, r.hint_month) for r in rows[4:8]] == [(25, 9), (None, None), (None, 8), (None, None)]
    assert rows[8].confidence == "low" and rows[8].notes == ["firstContract"]


def test_levels_without_a_name_are_inherited(spark, names):
    texts = ["BUY RELIANCE NOW", "ABOVE 1300 TGT 1350 SL 1290", "good morning", "ABOVE 7 TGT 10 SL 5", "ABOVE 1300 SL 1280 TGT 1400"]
    got = {r.msg_id: r for r in M.read_calls(messages(spark, texts, minutes=10, reply_to={4: 0}), names).collect()}
    assert set(got) == {1, 4} and got[1].symbol == got[4].symbol == "RELIANCE" and "fromEarlier" in got[1].notes and got[1].confidence == "medium"
    unread = {(r.msg_id, r.why) for r in M.unread(messages(spark, ["BUY NOW SL 5 TGT 9", "hello"]), names).collect()}
    assert unread == {(0, "no-instrument")}


def test_result_posts_name_their_instrument(spark, names):
    got = {r.msg_id: r for r in M.follow_ups(messages(spark, ["NIFTY 24000 CE TARGET HIT", "TCS 2140 PE 19 TO 68", "ALL TARGETS DONE"]), names).collect()}
    assert [(got[i].kind, got[i].symbol, got[i].strike, got[i].quoted) for i in range(3)] == [("target-hit", "NIFTY", 24000, None), ("profit", "TCS", 2140, 68), ("target-hit", None, None, None)]


def test_reposts_are_dropped(spark, names):
    kept, dropped = M.without_reposts(M.read_calls(messages(spark, ["BUY TCS AT 3000 TGT 3100 SL 2950"] * 3, minutes=600), names))
    assert sorted(r.msg_id for r in kept.collect()) == [0, 2] and dropped.first().reposts == 1


def test_edits_like_all_pairs(spark):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("ABC") for _ in range(rng.randrange(5, 14))) for _ in range(60)]
    targets = ["".join(rng.choice("ABC") for _ in range(rng.randrange(5, 14))) for _ in range(60)] + [w[1] + w[0] + w[2:] for w in words[:20]] + [w[:3] + w[4:-1] for w in words[20:40]]
    asked = spark.createDataFrame([(w, 1 + (len(w) >= 9)) for w in words], "word string, most int")
    got = {(r.word, r.target) for r in I.within_edits(asked, spark.createDataFrame([(t,) for t in targets], "target string")).collect()}
    from pyspark.sql import functions as F

    from tapewright.functions.text import osa_distance

    pairs = spark.createDataFrame([(w, 1 + (len(w) >= 9), t) for w in words for t in targets], "word string, most int, target string")
    want = {(r.word, r.target) for r in pairs.where(osa_distance("word", "target") <= F.col("most")).collect()}
    assert got == want and want


def test_name_keys(spark, names):
    keys = {(r.key, r.symbol, r.via) for r in names.collect()}
    assert ("TVSMOTOR", "TVSMOTOR", "ticker") in keys and ("VODAFONE", "IDEA", "name") in keys and ("GANDHAROILREFINERY", "GANDHAR", "name") in keys
    assert not any(k == "ABCGOLDETF" for k, _, v in keys if v == "name") and ("BNF", "BANKNIFTY", "alias") in keys


def test_tape_classes(spark):
    texts = ["BUY", "SL HIT", "EXIT NOW", "SURE SHOT JACKPOT", "JOIN OUR VIP GROUP", "DM ME AND PROFIT 50000", " ", "hello"]
    m = messages(spark, texts)
    calls = m.where("msg_id = 0").select("channel_id", "msg_id")
    got = {r.msg_id: r.cls for r in M.tape(m, calls, M.follow_ups(m)).collect()}
    assert [got[i] for i in range(8)] == ["call", "loss", "profit", "profit", "selling", "profit", "picture", "other"]
