"""Text read from chat screenshots, as messages; set operations over all transcripts at once.

Lines are rows. A line is a date, a subscriber count, the end of a bubble (it
ends with a time) or text; running counts of what closes a bubble number the
bubbles, running counts of dates date them. The sender's name is a count over
bubbles, quotes above replies are a join on the beginnings of earlier messages,
and what overlapping shots show twice is one row by its mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.plan import settle, written
from ..functions.text import squash_unicode

c = F.col

# The shapes of date lines, of times at the end of a bubble, and of what surrounds messages.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_YEAR = r"(?:\s+(\d{4})(?:\s+\S{1,2}){0,3})?$"
DAY_FIRST = rf"(?i)^(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\.?,?{_YEAR}"
MONTH_FIRST = rf"(?i)^(?:[a-z]{{3,9}},?\s+)?{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?{_YEAR}"
NUMERIC = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
TIME_END = r"(?i)(?:^|\s)(\d{1,2}):(\d{2})(?:\s*([ap])\.?\s?m\.?)?(?:\s*\S{1,3})?\s*$"
VIEWS = r"(?i)(?:^|\s+)\d[\d.,]*\s*[km]?\s+(?:[^\p{L}\p{N}\s]{1,2}|[oOQ])\s*$"
COUNT = r"(?i)^\s*\d[\d.,]*\s*[km]?\s*$"
FOOTER = r"(?i)^(?:edited|[^\p{L}\p{N}])*$"
SUBSCRIBERS = r"(?i)([\d.,]+\s*[km]?)\s+(?:subscribers?|members?)\b"
ELLIPSIS = r"(?:…|\.{2,})\s*\S{0,2}\s*$"
MARKET = r"\b(?:buy|sell|book|profit|target|tgt|exit|hit|stop|loss|call|put|update|cmp|nifty|banknifty|sensex|paid|premium|join)\b"
OPENING, VOTES, QUOTE, SKIPS = 555, 3, 12, 4


def _letters(x: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0)), " "))


def _date_parts(line: Column) -> Column:
    """struct(y, m, d) of a line that is a date and nothing else; y is null where it is not written."""
    s = F.regexp_replace(line, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    g = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    month = F.coalesce(g(DAY_FIRST, 2), g(MONTH_FIRST, 1))
    m = F.coalesce(((F.instr(F.lit(MONTHS), F.lower(F.left(month, F.lit(3)))) + 3) / 4).cast("int"), g(NUMERIC, 2).cast("int"))
    d = F.coalesce(g(DAY_FIRST, 1), g(MONTH_FIRST, 2), g(NUMERIC, 1)).cast("int")
    written_year = F.coalesce(g(DAY_FIRST, 3), g(MONTH_FIRST, 3), g(NUMERIC, 3)).cast("int")
    y = F.when(F.length(g(NUMERIC, 3)) == 2, written_year + 2000).otherwise(written_year)
    parts = F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    return F.when(m.between(1, 12) & d.between(1, 31) & ~(m.isin(4, 6, 9, 11) & (d > 30)) & ~((m == 2) & (d > 29)), parts)


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, day, n, line, date): every line with its place and, where it is a date line, the date's parts."""
    t = docs.where("text IS NOT NULL").select("doc_id", "day", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    return settle(t.withColumn("line", F.regexp_replace("line", r"\s+$", "")).withColumn("date", _date_parts(c("line"))))


def guess_days(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, day): the first date line of each text if a line with a time follows it; the last such date not after ``today`` where no year is written.

    docs: doc_id, text, today.
    """
    t = lines_of(docs.withColumnRenamed("today", "day"))
    timed = c("date").isNull() & c("line").rlike(TIME_END)
    g = t.groupBy("doc_id", "day").agg(F.min_by("date", F.when(c("date").isNotNull(), c("n"))).alias("x"), F.min(F.when(c("date").isNotNull(), c("n"))).alias("at"), F.max(F.when(timed, c("n"))).alias("last"))
    year = F.year("day") - F.when(c("x.m") * 100 + c("x.d") > F.month("day") * 100 + F.dayofmonth("day"), 1).otherwise(0)
    return g.where(c("last") > c("at")).select("doc_id", F.make_date(F.coalesce("x.y", year), "x.m", "x.d").alias("day"))


def _with_dates(t: DataFrame) -> DataFrame:
    """Adds ``on``: the day that a line is under, its own where it is a date line.

    Dates go forward: one without a year is the first not before the date line
    above it. So a year starts at the last written one, or the stated day's,
    and goes up by one wherever a date is earlier in the year than the one
    before. If the first date is the stated day, what stands above it has none.
    """
    by = W.partitionBy("doc_id").orderBy("n")
    md = c("date.m") * 100 + c("date.d")
    stated = F.month("day") * 100 + F.dayofmonth("day")
    dates = t.where(c("date").isNotNull()).withColumns({"md": md, "era": F.count("date.y").over(by)})
    within = W.partitionBy("doc_id", "era").orderBy("n")
    back = c("date.y").isNull() & (c("md") < F.coalesce(F.lag("md").over(by), stated))
    dates = dates.withColumn("year", F.coalesce(F.first("date.y").over(within), F.year("day")) + F.sum(back.cast("int")).over(within))
    dates = dates.select("doc_id", "n", F.make_date("year", "date.m", "date.d").alias("at"))
    t = t.join(dates, ["doc_id", "n"], "left")
    before = F.last("at", ignorenulls=True).over(by)
    first = F.min_by("at", F.when(c("at").isNotNull(), c("n"))).over(W.partitionBy("doc_id"))
    return t.withColumn("on", F.coalesce(before, F.when(~F.coalesce(first == c("day"), F.lit(False)), c("day"))))


def bubbles(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, b, day, minute, n, line) of what bubbles say, in order, and rows (doc_id, subscribers).

    A date, a time or the end closes a bubble. A subscriber count voids what
    stands above it in its bubble. A bubble without a time comes a minute after
    the one before. In a text without any time, blank lines part the last bubble.
    """
    t = _with_dates(lines_of(docs))
    g = lambda i: F.nullif(F.regexp_extract("line", TIME_END, i), F.lit(""))
    hour, pm = g(1).cast("int"), F.lower(g(3))
    t = settle(t.withColumns({"is_date": c("date").isNotNull(), "is_count": c("date").isNull() & c("line").rlike(SUBSCRIBERS), "ends": c("line").rlike(TIME_END), "hour": F.when(pm.isNotNull() & (hour <= 12), hour % 12 + F.when(pm == "p", 12).otherwise(0)).otherwise(hour), "mins": g(2).cast("int"), "said": F.regexp_replace("line", TIME_END, "")}))
    t = t.withColumn("is_time", ~c("is_date") & ~c("is_count") & c("ends") & (c("hour") < 24) & (c("mins") < 60))
    every, by = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("n")
    counted = F.bool_or(c("ends") & c("said").rlike(VIEWS)).over(every)
    said = F.regexp_replace(F.regexp_replace("said", VIEWS, ""), r"\s+$", "")
    said = F.when(~said.rlike(FOOTER) & ~(counted & said.rlike(COUNT)), said)
    closes = F.coalesce(F.sum((c("is_date") | c("is_time")).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = settle(t.withColumns({"b": closes, "timed": F.bool_or("is_time").over(every), "content": F.when(c("is_time"), said).when(~c("is_date") & ~c("is_count"), c("line"))}))
    blank = F.sum((F.trim("line") == "").cast("int")).over(by)
    t = t.withColumns({"part": F.when(~c("timed") & (c("b") == F.max("b").over(every)), blank).otherwise(0), "void": F.max(F.when(c("is_count"), c("n"))).over(W.partitionBy("doc_id", "b"))})
    t = settle(t)
    counts = t.where("is_count").groupBy("doc_id").agg(F.regexp_replace(F.regexp_extract(F.max_by("line", "n"), SUBSCRIBERS, 1), r"\s+", "").alias("subscribers"))
    # a bubble's own lines, and the time that closed it
    kept = t.where((F.trim("content") != "") & (c("void").isNull() | (c("n") > c("void"))))
    ends = t.where("is_time").select("doc_id", "b", (c("hour") * 60 + c("mins")).alias("stated"))
    one = kept.groupBy("doc_id", "b", "part").agg(F.min("n").alias("first"), F.first("on").alias("on")).join(ends, ["doc_id", "b"], "left")
    order = W.partitionBy("doc_id").orderBy("first")
    one = one.withColumn("run", F.count("stated").over(order))
    in_run = W.partitionBy("doc_id", "run").orderBy("first")
    minute = F.coalesce(F.first("stated").over(in_run), F.lit(OPENING)) + F.row_number().over(in_run) - F.when(c("run") > 0, 1).otherwise(0)
    one = one.withColumns({"minute": minute, "k": F.row_number().over(order)}).select("doc_id", "b", "part", c("k").alias("bubble"), c("on").alias("__day"), "minute")
    rows = kept.select("doc_id", "b", "part", "n", c("content").alias("line")).join(one, ["doc_id", "b", "part"])
    return rows.select("doc_id", c("bubble").alias("b"), c("__day").alias("day"), "minute", "n", "line"), counts


def without_senders(rows: DataFrame) -> DataFrame:
    """Lines less the sender's name and marks without a word or a figure; adds ``is_last``.

    The sender: the words, with no figure and none of the market's, that stand above the text of most bubbles, three or more.
    """
    last = F.max("n").over(W.partitionBy("doc_id", "b"))
    t = settle(rows.withColumns({"words": _letters(c("line")), "figure": c("line").rlike(r"\d"), "lowest": last}))
    votes = t.where((c("n") < c("lowest")) & ~c("figure") & (c("words") != "") & ~c("words").rlike(MARKET)).groupBy("doc_id", "words").agg(F.count_distinct("b").alias("votes"), F.min("n").alias("first")).where(c("votes") >= VOTES)
    sender = votes.groupBy("doc_id").agg(F.min_by("words", F.struct(-c("votes"), "first")).alias("sender"))
    t = t.join(sender, "doc_id", "left").where(c("figure") | ((c("words") != "") & ~c("words").eqNullSafe(c("sender"))))
    return t.withColumn("is_last", c("n") == F.max("n").over(W.partitionBy("doc_id", "b"))).drop("words", "figure", "lowest", "sender")


def _messages(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """Rows (doc_id, b, day, minute, text, key, reply_b): bodies less quoted and cut lines; the first of each mark."""
    t = lines.join(quotes, ["doc_id", "b", "n"], "left")
    own = c("is_last") | (c("source").isNull() & ~c("line").rlike(ELLIPSIS))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("n", "line")))), lambda x: x.line), "\n")
    m = t.groupBy("doc_id", "b").agg(F.first("day").alias("day"), F.first("minute").alias("minute"), F.min_by("source", F.when(c("source").isNotNull(), c("n"))).alias("reply_b"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
    m = m.where("day IS NOT NULL AND text <> ''").withColumn("key", squash_unicode(c("text")))
    again = F.row_number().over(W.partitionBy("doc_id", "day", "minute", "reply_b", "key").orderBy("b"))
    return m.withColumn("__again", again).where("__again = 1").drop("__again")


def _quotes(lines: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows (doc_id, b, n, source): lines above the last that begin like an earlier message, and the latest such one.

    Up to SKIPS first marks may be misread; the fewest that do are skipped.
    """
    q = lines.where(~c("is_last")).withColumn("key", squash_unicode(F.regexp_replace("line", ELLIPSIS, "")))
    q = q.withColumn("skip", F.explode(F.sequence(F.lit(0), F.lit(SKIPS)))).withColumn("q", F.substring(c("key"), c("skip") + 1, F.length("key"))).where(F.length("q") >= QUOTE)
    q = q.select("doc_id", "b", "n", "skip", "q", F.left("q", F.lit(QUOTE)).alias("head"))
    m = messages.select("doc_id", c("b").alias("source"), c("key").alias("__key"), F.left("key", F.lit(QUOTE)).alias("head"))
    hit = q.join(m, ["doc_id", "head"]).where((c("source") < c("b")) & c("__key").startswith(c("q")))
    return hit.groupBy("doc_id", "b", "n").agg(F.min_by("source", F.struct("skip", -c("source"))).alias("source"))


def transcripts(docs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Messages of every transcript: doc_id, msg_id, ts, text, reply_to, subscribers. docs: doc_id, text, day (date).

    What a message says depends on which of its lines are quotes, and those on
    what earlier messages say. The first message is right at once, and each
    round makes right what rests on right ones, so the rounds end when quotes
    no longer change: two, where no quoted message quotes itself. Null texts
    give no rows.
    """
    rows, counts = bubbles(docs)
    lines = written(without_senders(rows), "transcript-lines")
    quotes = lines.select("doc_id", "b", "n", F.lit(None).cast("long").alias("source")).limit(0)
    last = None
    for _ in range(most_rounds):
        quotes = written(_quotes(lines, _messages(lines, quotes)), "transcript-quotes")
        now = quotes.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "b", "n", "source").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("quotes still change")
    m = _messages(lines, quotes).withColumn("msg_id", F.row_number().over(W.partitionBy("doc_id").orderBy("b")))
    m = written(m, "transcript-messages")
    of = m.select("doc_id", c("b").alias("reply_b"), c("msg_id").cast("long").alias("reply_to"))
    ts = F.timestamp_seconds(F.unix_date("day") * 86_400 + (c("minute") - 330) * 60)
    out = m.join(of, ["doc_id", "reply_b"], "left").join(counts, "doc_id", "left")
    return out.select("doc_id", c("msg_id").cast("long").alias("msg_id"), ts.alias("ts"), "text", "reply_to", "subscribers")
