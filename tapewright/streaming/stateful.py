"""Extension: the rules that carry state from message to message, as Structured Streaming with event-time timers.

Rows of a channel are held until the watermark has passed them, and then handled
in order of time, so that the order in which they arrive within the allowed
lateness does not matter and results equal the batch operators'. What a rule
remembers is bounded by time (18 hours, 15 minutes, 15 days, 24 hours); a row later than the
lateness is dropped by Spark before it gets here.

State is kept by RocksDB and changelog files in the query's checkpoint: a lost executor's is read back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

c = F.col
MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """The state store that these operators need; set it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them; ``step`` sees each once, in order of (t, rank).

    Input: at_micros, order_key (order among equals), rule_reads (what the rule reads, JSON), whole_row (the row itself, JSON).
    Output: row, and what ``step`` says of it as JSON; nothing where it says None. ``memory`` is the rule's own, kept as JSON.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, rank string, said string, row string")
        self.memory = handle.getValueState("memory", "v string")
        self.timer = handle.getValueState("timer", "at long")

    def close(self) -> None:
        pass

    def step(self, memory: dict, t: int, said: dict) -> dict | None:
        raise NotImplementedError

    def forget(self, memory: dict, now: int) -> int | None:
        """Drops what is too old at ``now``; the time at which something else will be, None if nothing is left."""
        return None

    def expired(self, memory: dict, now: int) -> Iterator[tuple[str, dict]]:
        """Rows that time itself brings about."""
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r for pdf in rows for r in pdf[["at_micros", "order_key", "rule_reads", "whole_row"]].itertuples(index=False, name=None)]
        for t, rank, said, row in held:
            self.waiting.appendValue((int(t), rank, said, row))
        if held:
            self._wake(min(r[0] for r in held))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], json.loads(r[1]))) if self.waiting.exists() else []
        ripe, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        out = []
        for t, _, said, row in ripe:
            out += self.expired(memory, t - 1)
            found = self.step(memory, t, json.loads(said))
            if found is not None:
                out.append((row, found))
        out += self.expired(memory, now)
        if ripe:
            self.waiting.put(later) if later else self.waiting.clear()
        again = self.forget(memory, now)
        self.memory.update((json.dumps(memory),)) if memory else self.memory.clear()
        ahead = [r[0] for r in later] + [again] * (again is not None)
        if ahead:
            self._wake(min(ahead))
        if out:
            yield pd.DataFrame([(row, json.dumps(found)) for row, found in out], columns=["row", "found"])

    def _wake(self, t: int) -> None:
        """One timer a key: at the earliest time that something is to be done."""
        at = -(-t // 1000)
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))


def _run(rows: DataFrame, by: list[str], lateness: str, rank: list, said: list, rule: InOrder, found: str) -> DataFrame:
    """``rows`` with the columns of the struct ``found`` that the rule adds."""
    schema = rows.schema
    packed = rows.withWatermark("ts", lateness).select(
        *by, "ts", F.unix_micros("ts").alias("at_micros"), F.to_json(F.array(*[c(x).cast("long") for x in rank])).alias("order_key"),
        F.to_json(F.struct(*said), {"ignoreNullFields": "false"}).alias("rule_reads"), F.to_json(F.struct(*schema.names), _JSON).alias("whole_row"),
    )
    out = packed.groupBy(*by).transformWithStateInPandas(rule, "row string, found string", "Append", "EventTime")
    return out.select(F.from_json("row", schema, _JSON).alias("r"), F.from_json("found", found).alias("f")).select("r.*", "f.*")


class _Reposts(InOrder):
    def __init__(self, span: int):
        self.span = span

    def step(self, memory, t, said):
        again = "kept" in memory and t - memory["kept"] <= self.span
        if not again:
            memory["kept"] = t
        return {"repost": again}

    def forget(self, memory, now):
        if "kept" in memory and now - memory["kept"] > self.span:
            memory.clear()
        return memory["kept"] + self.span + 1 if memory else None


def reposts(drafts: DataFrame, key: list[str], hours: int = 18, lateness: str = "10 minutes") -> DataFrame:
    """Adds ``repost``: within 18 hours of the last one kept with the same key, as ``operators.linking.reposts`` has it.

    drafts: channel_id, msg_id, ts and the key's columns. State: one time per key, for as long as it can matter.
    """
    return _run(drafts, ["channel_id", *key], lateness, ["msg_id"], ["msg_id"], _Reposts(hours * HOUR), "repost boolean")


class _Inherit(InOrder):
    def __init__(self, near: int, remembered: int):
        self.near, self.remembered = near, remembered

    def step(self, memory, t, said):
        by_msg = memory.setdefault("named", {})
        source = None
        if said["named"] is None:
            parent = by_msg.get(str(said["reply_to"]))
            before = memory.get("before")
            source = parent[1] if parent else before[1] if before and t // 1_000_000 - before[0] // 1_000_000 <= self.near // 1_000_000 else None
        else:
            by_msg[str(said["msg_id"])] = [t, said["named"]]
        memory["before"] = [t, said["named"]]
        return {"source": source}

    def forget(self, memory, now):
        kept = {k: v for k, v in memory.get("named", {}).items() if now - v[0] <= self.remembered}
        before = memory.get("before")
        memory.clear()
        if kept:
            memory["named"] = kept
        if before and now - before[0] <= self.near:
            memory["before"] = before
        ends = [v[0] + self.remembered + 1 for v in kept.values()] + [before[0] + self.near + 1] * ("before" in memory)
        return min(ends) if ends else None


def inherit(messages: DataFrame, minutes: int = 15, remembered_days: int = 15, lateness: str = "10 minutes") -> DataFrame:
    """Adds ``source``: the instrument of the message replied to (of the last 15 days), or else of the one just before within 15 minutes.

    messages: channel_id, msg_id, ts, reply_to, named (a string, null where none).
    """
    return _run(messages, ["channel_id"], lateness, ["msg_id"], ["msg_id", "reply_to", "named"], _Inherit(minutes * MINUTE, remembered_days * DAY), "source string")


class _Link(InOrder):
    """memory: calls of the last days in order, [second, msg_id, pos, call_id, instrument]."""

    def __init__(self, named: int, bare: int):
        self.named, self.bare = named, bare

    def step(self, memory, t, said):
        calls, second = memory.setdefault("calls", []), t // 1_000_000
        if said["is_call"]:
            calls.append([second, said["msg_id"], said["pos"], said["call_id"], said["named"]])
            return None
        name, reply = said["named"], said["reply_to"]
        fits = [x for x in calls if name is None or x[4] == name]
        hit = min((x for x in fits if reply is not None and x[1] == reply), key=lambda x: x[2], default=None)
        if hit is None and (name is not None or reply is None):
            span = self.named if name is not None else self.bare
            hit = max((x for x in fits if second - x[0] <= span // 1_000_000), key=lambda x: x[:3], default=None)
        return {"call_id": hit[3] if hit else None}

    def forget(self, memory, now):
        kept = [x for x in memory.get("calls", []) if now // 1_000_000 - x[0] <= self.named // 1_000_000]
        memory.clear()
        if kept:
            memory["calls"] = kept
        return (kept[0][0] + 1) * 1_000_000 + self.named if kept else None


def link_followups(followups: DataFrame, calls: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Adds ``call_id`` to a stream of result posts from a stream of calls, as ``operators.linking.link_followups`` does.

    followups: channel_id, post_id, ts, reply_to, named. calls: channel_id, call_id, msg_id, pos, ts, instrument. Both go
    through one keyed state as one stream, calls before posts of the same second; a channel remembers its calls of 15 days, replies find those too.
    """
    null = lambda kind: F.lit(None).cast(kind)
    p = followups.select("channel_id", "ts", c("post_id").cast("long").alias("post_id"), c("reply_to").cast("long").alias("reply_to"), c("named").cast("string").alias("named"), F.lit(False).alias("is_call"), null("long").alias("msg_id"), null("int").alias("pos"), null("string").alias("call"))
    k = calls.select("channel_id", "ts", null("long").alias("post_id"), null("long").alias("reply_to"), c("instrument").cast("string").alias("named"), F.lit(True).alias("is_call"), c("msg_id").cast("long").alias("msg_id"), c("pos").cast("int").alias("pos"), c("call_id").cast("string").alias("call"))
    both = k.unionByName(p).withColumn("after", (~c("is_call")).cast("int"))
    said: list[str | Column] = ["is_call", "msg_id", "pos", c("call").alias("call_id"), "named", "reply_to"]
    # calls of a second come before its posts: time goes by whole seconds here
    found = _run(both.withColumn("ts", F.date_trunc("second", "ts")), ["channel_id"], lateness, ["after", "msg_id", "pos", "post_id"], said, _Link(15 * DAY, DAY), "call_id string")
    return found.select("channel_id", "post_id", "ts", "reply_to", "named", "call_id")


class _Silence(InOrder):
    def __init__(self, span: int):
        self.span = span

    def expired(self, memory, now):
        if "last" in memory and not memory["told"] and now - memory["last"] >= self.span:
            memory["told"] = True
            yield memory["row"], {"silent_from": memory["last"]}

    def step(self, memory, t, said):
        memory.update(last=t, told=False, row=said["row"])
        return None

    def forget(self, memory, now):
        if memory.get("told"):
            memory.clear()
        return memory["last"] + self.span if memory else None


def silences(messages: DataFrame, hours: int = 24, lateness: str = "10 minutes") -> DataFrame:
    """A row (channel_id, msg_id, ts) for each last message that 24 hours without another have followed: what a timer alone brings about."""
    m = messages.select("channel_id", "msg_id", "ts")
    row = F.to_json(F.struct("channel_id", "msg_id", "ts"), _JSON).alias("row")
    return _run(m, ["channel_id"], lateness, ["msg_id"], [row], _Silence(hours * HOUR), "silent_from long").select("channel_id", "msg_id", "ts")
