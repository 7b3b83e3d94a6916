"""Extension: rules of the batch operators as Structured Streaming. The batch operators are the reference for results; rules with state of their own are in ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

c = F.col


def selling_per_hour(messages: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Selling cues per channel and hour of a message stream; late messages are taken up to the watermark."""
    found = messages.withWatermark("ts", lateness).where(F.trim("text") != "")
    both = F.concat(F.upper("text"), F.lit("\n"))
    selling = F.lit(False)
    for kind, pattern in P.PROMO:
        if kind in P.SELLING:
            selling = selling | both.rlike(P.bounded(pattern))
    return found.groupBy("channel_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.count_if(selling).alias("selling"))
