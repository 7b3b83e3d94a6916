"""Shapes and flags of bars whose price is zero: gains over zero are infinite or undefined, as in SQL, and no error."""

import datetime
import math

import duckdb
import pytest

from tapewright.plans import market_queries as Q

START = datetime.datetime(2024, 1, 1, 6)
# instrument: the days, of 40, on which it trades at zero
ZERO = {1: {20}, 2: {20, 25}, 3: {30}, 4: set(range(28, 40)), 5: set(), 6: {39}}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("zero"))
    rows = [(100 * i + k, START + datetime.timedelta(days=k), i, "signup" if k in (22, 26, 31) else "view", 0.0 if k in zero else 10.0 + (7 * i + k * k) % 9 + k / 100) for i, zero in ZERO.items() for k in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and ((math.isnan(a) and math.isnan(b)) or (not math.isinf(a) and abs(a - b) < 1e-9)))


@pytest.mark.parametrize("name", ["win_shapes", "win_peak_fall", "flags", "flags_at_calls", "agg_case", "agg_flag_kinds"])
def test_zero_prices_as_in_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tables}/events.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, tables)
    cols = df.columns
    want = con.sql(Q.SQL[name]).select(", ".join(cols)).fetchall()
    key = lambda r: [str(x) for x in r]
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(want, key=key)
    assert len(got) == len(want) > 0
    assert all(_same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_they_are_infinite_and_undefined(spark, tables):
    s = Q.QUERIES["win_shapes"](spark, tables).collect()
    assert any(math.isinf(r.pre_gain) for r in s) and any(math.isnan(r.post_gain) for r in s)
    assert any(math.isnan(r.fall) for r in Q.QUERIES["win_peak_fall"](spark, tables).collect())
