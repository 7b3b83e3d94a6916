"""jn_ordinary on histories long enough for its distances: every call is a mark."""

import datetime

from tapewright.operators import detect
from tapewright.plans import bindings as V


def test_days_are_far_from_every_call(spark, tmp_path):
    start, rows = datetime.datetime(2024, 1, 1, 6), []
    for user in (1, 2, 3):
        rows += [(len(rows) + k, start + datetime.timedelta(days=k), user, "click", 10.0 + k % 7) for k in range(120)]
    # no call is divisible by 40; user 3 has none
    rows += [(40 * n + 1001, start + datetime.timedelta(days=day, hours=1), user, "signup", 11.0) for n, (user, day) in enumerate([(1, 3), (1, 60), (2, 33), (2, 90)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    marks = {(r.instrument_id, r.day) for r in V.calls(spark, str(tmp_path)).collect()}
    days: dict = {}
    for r in V.bars(spark, str(tmp_path), sundays=True).collect():
        days.setdefault(r.instrument_id, []).append(r.d)
    assert len(marks) == 4 and all(len(x) == 120 for x in days.values())
    want = {(i, sorted(x)[k]) for i, x in days.items() if any(m[0] == i for m in marks) for k in range(30, len(x) - 12, 5) if all(abs(m - sorted(x)[k]) >= 15 for j, m in marks if j == i)}
    found = detect.ordinary_days(V.bars(spark, str(tmp_path), sundays=True), V.calls(spark, str(tmp_path)))
    got = [(r.instrument_id, r.d) for r in found.collect()]
    assert {i for i, _ in got} == {1, 2} and set(got) == want and len(got) == len(want)
