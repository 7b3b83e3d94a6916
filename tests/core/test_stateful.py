"""Streams with state equal the batch operators on the same rows, whatever order they arrive in."""

import datetime as dt
import random

import pytest

from tapewright.operators import linking
from tapewright.streaming import stateful

T0 = dt.datetime(2025, 3, 1, 9)
END = T0 + dt.timedelta(days=60)


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs ``of(streams...)`` over rows that arrive in files; a last row long after all others lets the watermark pass them."""
    stateful.prepare(spark)
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(of, tables, files=3):
        streams = []
        for n, (rows, schema) in enumerate(tables):
            folder = str(tmp_path / f"in{n}")
            for k in range(files):
                spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], schema).coalesce(1).write.mode("append").parquet(folder)
            streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        name = f"got{random.randrange(10**9)}"
        q = of(*streams).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.sql(f"SELECT * FROM {name}").collect()

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def _jumbled(rows, at, within=5):
    """Rows in an order of arrival in which none is more than ``within`` minutes behind the newest."""
    rng = random.Random(3)
    return sorted(rows, key=lambda r: r[at] + dt.timedelta(minutes=rng.random() * within))


def test_reposts_are_anchored_at_the_last_kept(spark, stream):
    schema = "channel_id long, msg_id long, ts timestamp, said string, note double"
    # 0 h kept, 10 h repost, 17 h repost, 20 h kept again (the first is 20 h ago): an anchor at the last seen would drop it
    rows = [(7, k, _at(60 * h), "a", 0.1 * k) for k, h in enumerate((0, 10, 17, 20, 37.9, 38.1, 200))]
    rng = random.Random(1)
    rows += [(rng.randrange(3), 100 + k, _at(k * 97 + rng.random()), rng.choice("abc"), None) for k in range(120)]
    rows = _jumbled(rows, 2)
    got = stream(lambda s: stateful.reposts(s, ["said"]), [([*rows, *[(c, 999, END, x, None) for c in (0, 1, 2, 7) for x in "abc"]], schema)])
    got = sorted((r.channel_id, r.msg_id, r.ts, r.said, r.note, r.repost) for r in got if r.msg_id != 999)
    want = sorted((r.channel_id, r.msg_id, r.ts, r.said, r.note, r.repost) for r in linking.reposts(spark.createDataFrame(rows, schema), ["said"]).collect())
    assert repr(got) == repr(want) and [r[5] for r in want if r[0] == 7] == [False, True, True, False, True, False, False]


def test_inheritance(spark, stream):
    schema = "channel_id long, msg_id long, ts timestamp, reply_to long, named string"
    rng, rows, now = random.Random(2), [], 0.0
    for k in range(150):
        now += rng.choice((1, 3, 7, 7.5, 8, 15))
        rows.append((k % 2, k, _at(now), rng.randrange(max(0, k - 40), k + 1) if k % 5 == 0 else None, rng.choice((None, None, "X", "Y"))))
    rows.append((0, 500, _at(now + 1), 3, None))
    got = stream(stateful.inherit, [([*_jumbled(rows, 2), (0, 999, END, None, None), (1, 999, END, None, None)], schema)])
    got = {(r.channel_id, r.msg_id): r.source for r in got if r.msg_id != 999}
    want = {(r.channel_id, r.msg_id): r.source for r in linking.inherit(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and 15 < sum(x is not None for x in want.values()) < 75


def test_linking_of_result_posts(spark, stream):
    posts_schema, calls_schema = "channel_id long, post_id long, ts timestamp, reply_to long, named string", "channel_id long, call_id string, msg_id long, pos int, ts timestamp, instrument string"
    rng = random.Random(4)
    calls = [(k % 2, f"c{k}", k, 1 + k % 2, _at(k * 700), rng.choice("XYZ")) for k in range(50)]
    posts = [(rng.randrange(2), k, _at(rng.randrange(60 * 24 * 26)), rng.randrange(50) if k % 6 == 0 else None, rng.choice((None, "X", "Y", "Q"))) for k in range(150)]
    posts += [(0, 900, _at(0), None, None), (0, 901, _at(2 * 700), None, "X")]  # the very second of a call
    # replies to calls that come later, or that are older than what the stream remembers, are left out: there the batch looks at all
    of = {m: t for _, _, m, _, t, _ in calls}
    posts = [p for p in posts if p[3] is None or dt.timedelta(0) <= p[2] - of[p[3]] <= dt.timedelta(days=14)]
    ends = [(c, 9999, END, None, None) for c in range(2)], [(c, "end", 9999, 1, END, "-") for c in range(2)]
    got = stream(stateful.link_followups, [([*_jumbled(posts, 2), *ends[0]], posts_schema), ([*_jumbled(calls, 4), *ends[1]], calls_schema)], files=1)
    got = {(r.channel_id, r.post_id): r.call_id for r in got if r.post_id != 9999}
    want = {(r.channel_id, r.post_id): r.call_id for r in linking.link_followups(spark.createDataFrame(posts, posts_schema), spark.createDataFrame(calls, calls_schema)).collect()}
    assert got == want and 20 < sum(x is not None for x in want.values()) < len(want)


def test_late_rows_and_silences(spark, stream):
    schema = "channel_id long, msg_id long, ts timestamp"
    days = lambda x: T0 + dt.timedelta(days=x)
    rows = [(1, 1, days(0)), (1, 2, days(0.5)), (1, 3, days(4)), (2, 10, days(4.05)), (1, 4, days(1.2)), (1, 5, days(4.9)), (1, 6, days(9)), (2, 7, days(9)), (2, 8, days(30))]
    got = stream(stateful.silences, [(rows, schema)], files=9)
    # 4 arrives two batches after the watermark has passed it, and is dropped: 2 stays the message after which it was quiet
    assert sorted(r.msg_id for r in got) == [2, 5, 6, 7, 10] and {r.ts for r in got if r.msg_id == 2} == {days(0.5)}
