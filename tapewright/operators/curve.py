"""An account over time, and the opening stretch of a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ledger import _KEYS
from .messages import quiet

c = F.col


def equity_steps(lines: DataFrame, until: int | Column | None = None) -> DataFrame:
    """Rows (account, d, balance): each account's balance at the end of every day from its first entry on.

    It moves only when a call settles, so each settlement holds until the next: spans of days, exploded. Nothing is joined with a
    calendar, and an account without a settlement stays where it began. ``until``: the last day shown, else that of the last settlement.
    """
    settled = lines.where("settled IS NOT NULL").groupBy(*_KEYS, c("exit_day").alias("d")).agg(F.max_by("balance_after", "settled").alias("balance"))
    first = lines.groupBy(*_KEYS).agg(F.min("entry_day").alias("d"), F.first("capital").alias("balance"))
    # a settlement on the first day replaces the beginning
    points = settled.withColumn("rank", F.lit(1)).unionByName(first.withColumn("rank", F.lit(0))).groupBy(*_KEYS, "d").agg(F.max_by("balance", "rank").alias("balance"))
    w = W.partitionBy(*_KEYS).orderBy("d")
    last = F.lit(until) if isinstance(until, int) else until if until is not None else F.max("d").over(W.partitionBy(*_KEYS))
    spans = points.withColumn("to", F.coalesce(F.lead("d").over(w) - 1, F.greatest(last, c("d"))))
    return spans.select(*_KEYS, F.explode(F.sequence("d", c("to").cast("int"))).alias("d"), "balance")


def opening(messages: DataFrame, calls: DataFrame, results: DataFrame, lines: DataFrame, most: int = 60, text: int = 96) -> DataFrame:
    """The opening stretch of each channel, message by message: from its first call to the first that the account cannot
    pay for, or ``most`` messages further where it can pay for all.

    messages: channel_id, msg_id, text. calls: channel_id, msg_id, call_id (one a message counts, the last). results: channel_id,
    msg_id of result posts. lines: of one account a channel. Of messages in a row that are no calls two are kept; blank ones are none.
    Result: channel_id, msg_id, kind (call, brag, other), text, call_id, status, net, balance (of the calls taken so far), peak.
    """
    of = W.partitionBy("channel_id").orderBy("msg_id")
    one = calls.groupBy("channel_id", "msg_id").agg(F.max_by(c("call_id").cast("string"), F.struct(F.length(c("call_id").cast("string")), c("call_id").cast("string"))).alias("call_id"))
    paid = lines.select("channel_id", c("call_id").cast("string").alias("call_id"), "status", "net", "capital")
    brags = results.select("channel_id", "msg_id").distinct().withColumn("bragged", F.lit(True))
    m = messages.withColumn("place", F.row_number().over(of)).join(one, ["channel_id", "msg_id"], "left").join(paid, ["channel_id", "call_id"], "left").join(brags, ["channel_id", "msg_id"], "left")
    span = m.groupBy("channel_id").agg(F.min(F.when(c("call_id").isNotNull(), c("place"))).alias("begin"), F.min(F.when(c("status") == "no-funds", c("place"))).alias("broke"), F.max("capital").alias("start"))
    t = m.join(span, "channel_id").where((c("place") >= c("begin")) & (c("place") <= F.coalesce("broke", c("begin") + most)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    kind = F.when(c("call_id").isNotNull(), "call").when(c("bragged"), "brag").otherwise("other")
    t = t.withColumn("cls", kind)
    so_far = of.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("balance", c("start") + F.coalesce(F.sum("net").over(so_far), F.lit(0.0))).withColumn("peak", F.greatest("start", F.max("balance").over(so_far)))
    line = F.left(F.regexp_replace("text", r"\s*\n\s*", " "), F.lit(text))
    return quiet(t).select("channel_id", "msg_id", c("cls").alias("kind"), line.alias("text"), "call_id", "status", "net", "balance", "peak")
