"""Steps whose work must grow with the input, not faster, and must not pass through the driver."""

import datetime

from tapewright.operators import report
from tapewright.sources import market


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_not_broadcast(spark):
    asked = spark.createDataFrame([("The Red Bolt & 12 Co. (India) Ltd",), ("Red Bolt & 1 Glass Ltd",), ("Other",), ("Old Ring Ltd",)], "scrip string")
    known = spark.createDataFrame([("P1", 1, "Red Bolt & 1"), ("P12", 12, "Red Bolt & 12 Company"), ("P13", 13, "Red Bolt & 1 Glass Works"), ("P7", 7, "Old Ring"), ("P9", 9, "OLD RING Ltd"), ("P3", 3, "Old Ring Works")], "symbol string, seq long, name string")
    got = report.case_symbols(asked, known)
    assert {r.scrip: r.symbol for r in got.collect()} == {"The Red Bolt & 12 Co. (India) Ltd": "P12", "Red Bolt & 1 Glass Ltd": "P1", "Other": None, "Old Ring Ltd": "P9"}
    assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" in plan(got)


def test_expiries_are_sought_by_symbol_and_day(spark):
    day = datetime.date(2024, 1, 3)
    expiries = spark.createDataFrame([(s, day + datetime.timedelta(days=7 * k)) for s in "AB" for k in range(-2, 9)], "symbol string, expiry date")
    null = None
    rows = [(1, "A", day, null, null), (1, "B", day, null, null), (2, "A", day, null, null), (3, "A", day, null, 2), (4, "A", day, 10, 1), (5, "A", day + datetime.timedelta(days=60), null, null)]
    got = market.candidate_expiries(spark.createDataFrame(rows, "call_id int, symbol string, today date, hint_day int, hint_month int"), expiries)
    found: dict = {}
    for r in got.orderBy("rank").collect():
        found.setdefault((r.call_id, r.symbol), []).append(r.expiry)
    four = [day + datetime.timedelta(days=7 * k) for k in range(4)]
    # a call that is tried on two symbols has four expiries of each
    assert found[1, "A"] == found[1, "B"] == found[2, "A"] == four
    assert found[3, "A"] == [datetime.date(2024, 2, 28)] and found[4, "A"] == [datetime.date(2024, 1, 10)] and (5, "A") not in found
    assert "windowspecdefinition(call_id" not in plan(got)


def test_boundaries_are_taken_out_in_front(spark):
    from tapewright.functions import patterns as P

    assert P.led(r"\bA(?:\b|\|)[|(]|\bB\b") == r"\b(?:A(?:\b|\|)[|(]|B\b)" and P.led(r"\bA|B") == r"\bA|B"
    import re

    text = "JOIN OUR VIP GROUP NOW T.ME/+A @ X.Y-Z@UPI SURE SHOT 100 % FIXED PROFIT 5K PROFIT SL : PAID _DM DM HURRY"
    for _, pattern in P.PROMO:
        assert P.led(pattern) != pattern and [m.span() for m in re.finditer(pattern, text)] == [m.span() for m in re.finditer(P.led(pattern), text)]


def test_slips_are_sought_only_before_the_first_exact_name(spark, monkeypatch):
    from tapewright.operators import instruments as I

    asked = []
    monkeypatch.setattr(I, "near_names", lambda words, names, f=I.near_names: (asked.extend(r.word for r in words.collect()), f(words, names))[1])
    x = "struct<prio: int, key: string, n: int, mode: string, how: string, rest_at: int, phrase: string>"
    cand = lambda prio, key, mode: (prio, key, 1, mode, "action", 1, "")
    rows = [(1, None, cand(2, "RELIANCES", "exact")), (1, None, cand(5, "RELIANCEX", "near")), (2, None, cand(3, "INFOSYSTM", "near")), (2, None, cand(9, "RELIANCES", "exact"))]
    names = I.completed(spark.createDataFrame([("RELIANCES", "RELIANCES", "stock"), ("INFOSYSTEM", "INFOSYSTEM", "stock")], "key string, symbol string, kind string"))
    got = {r.msg_id: r.inst.symbol for r in I.resolve(spark.createDataFrame(rows, f"msg_id int, d int, x {x}"), names, ["msg_id"]).collect()}
    assert got == {1: "RELIANCES", 2: "INFOSYSTEM"} and asked == ["INFOSYSTM"]


def test_distances_of_a_batch():
    import random

    import pandas as pd

    from tapewright.functions.text import osa_distance

    def plain(x, y):
        t = [[i + j if i * j == 0 else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    r = random.Random(5)
    words = lambda: ["".join(r.choices("ab\0é", k=r.randint(0, 7))) for _ in range(3000)]
    a, b = words(), words()
    got = osa_distance.func(pd.Series([*a, None, "x", ""]), pd.Series([*b, "x", None, ""]))
    assert got[:3000].tolist() == [plain(x, y) for x, y in zip(a, b)] and got[3000:3002].isna().all() and got[3002] == 0

    # CPU seconds of these: 13 pair by pair, 0.8 in one table
    import time

    began = time.process_time()
    osa_distance.func(pd.Series(["SUPPLIER000012345"] * 100_000), pd.Series(["SUPPLIER000013254"] * 100_000))
    assert time.process_time() - began < 6


def test_a_name_is_a_candidate_once(spark):
    from pyspark.sql import functions as F

    from tapewright.functions import patterns as P
    from tapewright.operators import instruments as I

    t = spark.createDataFrame([("BUY NOW RELIANCES LTD TGT 15",), ("TODAY BUY SBIN CMP",), ("NIFTY 24500 CE BUY",), ("GOOD MORNING",)], "norm string")
    t = t.withColumns({"options": I.spots(F.col("norm"), P.OPTION, 2), "actions": I.spots(F.col("norm"), P.led(P.ACTION))})
    rows = I.with_marks(t).select("norm", F.explode(I.candidates()).alias("x")).select("norm", "x.*").collect()
    # the words BUY, NOW and RELIANCES lead to one name: it was asked for from each of them
    scanned = [(r.norm, r.key, r.n) for r in rows if r.how == "scan"]
    assert len(scanned) == len(set(scanned)) and ("BUY NOW RELIANCES LTD TGT 15", "RELIANCES", 1) in scanned
    # it counts where the first of them stands
    assert [r.rest_at for r in rows if r.how == "scan" and r.key == "RELIANCES"] == [len("BUY") + 1]
    assert {r.key for r in rows if r.mode == "near"} == {"RELIANCES", "RELIANCESLTD", "RELIANCESLTDTGT"}  # SBIN is too short for a slip
    option = [r for r in rows if r.how == "option" and r.key == "NIFTY"]
    assert [(r.mode, r.at) for r in option] == [("exact", 0), ("underlying", 0), ("exact", 0)] and "phrase" not in rows[0].asDict()


def test_equities_have_no_hint(spark):
    from pyspark.sql import functions as F

    from tapewright.operators import messages as M

    rows = [("equity", "BUY SBIN 25 SEP", 1.0), ("option", "NIFTY 25 SEP 24000 PE", 24000.0), ("future", "NIFTY FUT SEP EXPIRY", None)]
    t = spark.createDataFrame(rows, "kind string, norm string, strike double").withColumn("named", F.struct(F.col("norm").alias("phrase"), "strike"))
    got = {r.kind: (r.hint_day, r.hint_month) for r in M._hint(t).collect()}
    assert got == {"equity": (None, None), "option": (25, 9), "future": (None, 9)}


def test_coverage_holds_a_row_once(spark):
    import random

    from tapewright.sources import reference_files

    r = random.Random(3)
    pick = lambda *x: r.choice(x)
    rows = [(pick("a", "b", None), pick("A", "B", "C", None), pick("d1", "d2"), pick("t", None), pick("S1", "S2", None), pick(True, False, None)) for _ in range(60)]
    rows += [("z", "Z", "d1", "t", None, False)]
    got = reference_files.coverage(spark.createDataFrame(rows, "board string, scrip string, reco_date string, reco_time string, symbol string, measured boolean"), "board")
    count = lambda xs: len({x for x in xs if x is not None})

    def plain(board, whole):
        of = [x for x in rows if whole or x[0] == board]
        return (board, whole, len(of), count(x[1:4] for x in of), count(x[1] for x in of), count(x[1] for x in of if x[4]), count(x[1:4] for x in of if x[5]), count(x[1:4] for x in of if x[5] is False), count(x[4] for x in of if x[5]))

    assert set(map(tuple, got.collect())) == {plain(b, False) for b in ("a", "b", "z", None)} | {plain(None, True)}
    # distinct counts beside each other hold each row once for each of them, marked gid
    assert "gid" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_dealt_out_before_executors_have_come(spark):
    from tapewright.plans import text_queries as Q

    # a new cluster session reports two cores: the deal may not rest on them alone
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert Q._signups(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def _texts(n: int, asked: list[str] | None = None) -> list[str]:
    """Random texts of what the patterns ask for, and of what breaks words apart."""
    import random
    import re

    from tapewright.functions import patterns as P
    from tapewright.functions import text as T

    r = random.Random(11)
    often = 5 if asked else 1
    asked = asked or [p for _, p in P.PROMO] + [p for p, _ in T._REWRITES]
    words = sorted({w for p in asked for w in re.findall(r"[A-Z][A-Z.@/]*[A-Z]|[A-Z]", re.sub(r"\\[bsdSW]", " ", p.replace("\\/", "/").replace("\\.", ".")))}) * often
    words += ["T.ME/+", "T.ME/JOINCHAT", "TELEGRAM.ME/", "CHAT.WHATSAPP.COM/", "A/C NO", "1X RETURN", "12", "1,234", "1,23,456", "2)", "(15.5)", "100", "5K", "3 LAKH", "95 %", "RS.", "RS₹", "₹", "/-", "DON'T BUY", "LE LO", "BUY KARO", "KE UPAR", "NSECALL SBIN JAN 24.5", "A@YBL", "ABC.D@UPI", "टारगेट", "बाय", "२४", "é", "\x01", "!", "_", "ß", "ﬁ", "７"]
    return ["".join(r.choice(words) + r.choice(["", " ", " ", "\n", "  ", "\t", ",", ".", "-", ":"]) for _ in range(r.randint(1, 9))) for _ in range(n)]


def test_rewrites_are_left_out_only_where_they_change_nothing(spark):
    from pyspark.sql import functions as F

    from tapewright.functions import text as T

    rows = [(x,) for x in [*_texts(6000), "BUY SBIN @ 12.5 TGT 15", "", None]]
    t = spark.createDataFrame(rows, "text string").repartition(4).withColumn("norm", T.normalise(F.col("text")))
    plain = F.col("x")
    for pattern, to in T._REWRITES:
        plain = F.regexp_replace(plain, pattern, to)
    # what the rewrites are given: a text of ASCII that is upper-cased
    ascii_only = t.where(F.octet_length("text") == F.length("text")).withColumn("x", F.upper("text"))
    assert ascii_only.count() > 1500 and ascii_only.where(~F.col("norm").eqNullSafe(plain)).count() == 0
    # the guard finds some texts unchanged and others not
    guard = ascii_only.groupBy(F.col("x").rlike(T._changes()).alias("found")).agg(F.count("*").alias("n"), F.count_if(F.col("x") != F.col("norm")).alias("changed")).collect()
    assert {g.found: g.changed > 0 for g in guard} == {True: True, False: False}
    # the charset: all that is not on the list, of every plane
    allowed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\n .,/-+@%&:=>#$'()"
    every = spark.createDataFrame([(chr(i),) for i in [*range(0xD800), *range(0xE000, 0x11000)]], "x string").repartition(4)
    assert {r.x for r in every.where(~F.col("x").rlike(T._REWRITES[-2][0])).collect()} == set(allowed)


def test_every_cue_holds_one_of_its_words(spark):
    import re

    from pyspark.sql import functions as F

    from tapewright.functions import patterns as P
    from tapewright.operators import messages as M

    texts = []
    for kind, pattern in P.PROMO:
        own = _texts(8000, [pattern])
        hits = [x for x in own if re.search(pattern, x)]
        assert len(hits) > 30 and all(any(w in x for w in P.PROMO_WORDS[kind]) for x in hits), kind
        texts += own[:600]
    # the operator against the patterns themselves
    rows = [(1, i, x) for i, x in enumerate(texts) if x.isascii()]
    m = spark.createDataFrame(rows, "channel_id int, msg_id int, text string")
    from tapewright.functions.text import normalise

    both = {r.msg_id: r.norm + "\n" + r.up for r in m.select("msg_id", normalise(F.col("text")).alias("norm"), F.upper("text").alias("up")).collect()}
    want = {(i, kind, hit[0].strip(" ")[:60]) for i, x in both.items() if x.split("\n", 1)[1].strip(" ") for kind, pattern in P.PROMO if (hit := re.search(pattern, x, re.ASCII))}
    got = {(r.msg_id, r.kind, r.match) for r in M.cues(m).collect()}
    assert got == want and len(got) > 500


def test_a_complaint_replays_once(spark, monkeypatch):
    from tapewright.operators import detect, ledger, replay
    from tapewright.plans import bindings as V
    from tapewright.plans import market_queries as Q

    d, asked = "/root/testdata/sf0.001", []
    plain = replay.replay
    monkeypatch.setattr(replay, "replay", lambda *a: (asked.append(a), plain(*a))[1])
    got = Q.snk_complaint(spark, d).collect()
    assert len(asked) == 1 and len(got) > 0
    f = detect.follow_through(V.calls(spark, d), Q.outcomes(spark, d, ("likely",)), Q.linked(spark, d).where("call_id IS NOT NULL"))
    want = report.complaint(ledger.account(ledger.lines(Q.queued(spark, d, None, ("likely",)))), f).collect()
    assert sorted(got) == sorted(want)


def test_names_of_a_case_are_not_broadcast(spark, monkeypatch):
    from tapewright.plans import evidence_queries as Q

    monkeypatch.setattr(Q.R, "coverage", lambda rows, by: rows)
    rows = plan(Q.agg_coverage(spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin" not in rows and rows.count("SortMergeJoin") >= 2


def test_slips_are_told_by_their_places(spark):
    import random

    from pyspark.sql import functions as F

    from tapewright.functions.text import osa_distance
    from tapewright.operators import instruments as I

    r = random.Random(7)
    some = lambda: sorted({"".join(r.choices(abc, k=r.randint(0, 6))) for abc in ("AB", "ABC", "é\U0001f600\U0001f601") for _ in range(120)})
    asked = spark.createDataFrame([(x, 1 + r.randrange(2)) for x in some()], "word string, most int")
    targets = spark.createDataFrame([(x,) for x in some()], "target string")
    got = I.within_edits(asked, targets)
    want = asked.crossJoin(targets).where(osa_distance("word", "target") <= F.col("most")).select("word", "target")
    steps = plan(got)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 2500
    # no distance is worked out pair by pair in Python, what is left of names is not broadcast, and few bytes are dealt to many tasks
    assert "ArrowEvalPython" not in steps and "BroadcastHashJoin" not in steps and steps.count("REPARTITION_BY_NUM") == 4
