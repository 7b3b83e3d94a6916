"""Messages to calls: inherited instruments, reposts, result posts, announcements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col


def inherit(messages: DataFrame, minutes: int = 15) -> DataFrame:
    """Adds ``source``: the instrument of the message replied to, or else of the message just before within 15 minutes.

    messages: channel_id, msg_id, ts, reply_to, named (null where none). One hop, so one self join and one lag.
    """
    w = W.partitionBy("channel_id").orderBy("ts", "msg_id")
    before = F.lag(F.struct("ts", "named")).over(w)
    m = messages.withColumn("__b", before)
    parent = messages.select(c("channel_id").alias("__c"), c("msg_id").alias("__m"), c("named").alias("__named"))
    m = m.join(parent, (c("channel_id") == c("__c")) & (c("reply_to") == c("__m")), "left")
    near = F.when(c("ts").cast("timestamp").cast("long") - c("__b.ts").cast("timestamp").cast("long") <= 60 * minutes, c("__b.named"))
    return m.withColumn("source", F.when(c("named").isNull(), F.coalesce("__named", near))).drop("__b", "__c", "__m", "__named")


def previous_within(messages: DataFrame, minutes: int = 15) -> DataFrame:
    """Adds ``previous``: the message before in the channel, if it is at most 15 minutes old."""
    w = W.partitionBy("channel_id").orderBy("ts", "msg_id")
    gap = c("ts").cast("timestamp").cast("long") - F.lag("ts").over(w).cast("timestamp").cast("long")
    return messages.withColumn("previous", F.when(gap <= 60 * minutes, F.lag("msg_id").over(w)))


def reposts(drafts: DataFrame, key: list[str], hours: float = 18.0) -> DataFrame:
    """Adds ``repost``: within 18 hours of the last one kept with the same key.

    The anchor is the last *kept* draft, which no window frame expresses. The
    fold runs per key of one channel's identical calls, ordered by time.
    """
    schema = T.StructType([*drafts.schema.fields, T.StructField("repost", T.BooleanType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "msg_id"], kind="stable").reset_index(drop=True)
        anchor, out = None, []
        for ts in pdf.ts:
            again = anchor is not None and (ts - anchor).total_seconds() <= hours * 3600
            anchor = anchor if again else ts
            out.append(again)
        return pdf.assign(repost=out)

    return drafts.groupBy("channel_id", *key).applyInPandas(fold, schema)


def _latest(posts: DataFrame, calls: DataFrame, by: list[str], within: int, out: str) -> DataFrame:
    """Rows (channel_id, post_id, out): the latest call not after the post with the same ``by``, at most ``within`` seconds before.

    Both kinds of rows are put in order together and the last call is carried
    forward: an as-of join without pairs, linear in a busy channel's rows.
    """
    null = lambda kind: F.lit(None).cast(kind)
    k = calls.select(*by, null("long").alias("post_id"), c("__ct").alias("__t"), F.lit(0).alias("__after"), "__m", "__p", F.struct("call_id", "__ct").alias("__call"))
    p = posts.select(*by, c("post_id").cast("long").alias("post_id"), "__t", F.lit(1).alias("__after"), null("long").alias("__m"), null("int").alias("__p"), null(k.schema["__call"].dataType.simpleString()).alias("__call"))
    w = W.partitionBy(*by).orderBy("__t", "__after", "__m", "__p").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = k.unionByName(p).withColumn("__last", F.last("__call", ignorenulls=True).over(w)).where((c("__after") == 1) & (c("__t") - c("__last.__ct") <= within))
    return t.select("channel_id", "post_id", c("__last.call_id").alias(out))


def link_followups(followups: DataFrame, calls: DataFrame) -> DataFrame:
    """Adds ``call_id`` to result posts: a reply's call, the latest call on the named instrument, or the latest call at all.

    followups: channel_id, post_id, ts, reply_to, named. calls: channel_id, call_id, msg_id, pos, ts, instrument.
    Post numbers repeat between channels, so a post is known by both. A named
    post takes calls of 15 days, a bare one that is no reply those of one day.
    """
    seconds = c("ts").cast("timestamp").cast("long")
    f = followups.withColumn("__t", seconds)
    k = calls.select("channel_id", "call_id", c("msg_id").cast("long").alias("__m"), c("pos").cast("int").alias("__p"), seconds.alias("__ct"), c("instrument").alias("named"))
    day, key = 86_400, ["channel_id", "post_id"]
    asked = f.where("reply_to IS NOT NULL").select(*key, c("reply_to").cast("long").alias("__m"), c("named").alias("__named"))
    reply = asked.join(k, ["channel_id", "__m"]).where(c("__named").isNull() | (c("__named") == c("named"))).groupBy(*key).agg(F.min_by("call_id", "__p").alias("by_reply"))
    named = _latest(f.where("named IS NOT NULL"), k, ["channel_id", "named"], 15 * day, "by_name")
    bare = _latest(f.where("named IS NULL AND reply_to IS NULL"), k, ["channel_id"], day, "by_last")
    out = f
    for tier in (reply, named, bare):
        out = out.join(tier, key, "left")
    return out.withColumn("call_id", F.coalesce("by_reply", "by_name", "by_last")).drop("__t", "by_reply", "by_name", "by_last")


def announced(calls: DataFrame, posts: DataFrame) -> DataFrame:
    """Calls with a confirming post: a quote within one percent of or past the first target, or an unquoted target claim."""
    first = F.get("targets", F.lit(0))
    p = posts.select("call_id", "quoted", "claims_target")
    near = F.when(c("side") == "long", c("quoted") >= c("t1") * 0.99).otherwise(c("quoted") <= c("t1") * 1.01)
    k = calls.select("call_id", "side", first.alias("t1"))
    hit = p.join(k, "call_id").where(F.when(c("quoted").isNotNull(), near).otherwise(c("claims_target")))
    return calls.join(hit.select("call_id").distinct(), "call_id", "left_semi")
