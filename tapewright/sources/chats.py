"""Message sources: saved preview pages, export JSON, chat exports, pasted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import html_to_text

c = F.col
# Marks of the preview page and of the chat export's lines.
WRAP = '<div class="tgme_widget_message_wrap'
CHAT_LINE = r"(?i)^‎?\[?(\d{1,2})[/.](\d{1,2})[/.](\d{2,4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap]\.?\s?m\.?)?\]?\s*(?:-\s*)?([^:]{1,60}?):\s(.*)$"
OMITTED = r"(?i)<Media omitted>|image omitted|\.(jpg|png|webp) \(file attached\)"


def _pick(col: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, "(?s)" + pattern, 1), F.lit(""))


def preview_header(pages: DataFrame) -> DataFrame:
    """Columns of ``pages`` without html, plus title, subscribers, description and the cursor ``before``."""
    text = lambda p: html_to_text(_pick("html", p))
    before = F.coalesce(_pick("html", r'class="tme_messages_more[^"]*"[^>]*data-before="(\d+)"'), _pick("html", r'data-before="(\d+)"'))
    return pages.select(
        *[x for x in pages.columns if x != "html"],
        text(r"tgme_channel_info_header_title[^>]*>(.*?)</div>").alias("title"),
        text(r'<span class="counter_value">([^<]*)</span>\s*<span class="counter_type">subscribers?').alias("subscribers"),
        text(r"tgme_channel_info_description[^>]*>(.*?)</div>").alias("description"),
        before.cast("long").alias("before"),
    )


def preview_messages(pages: DataFrame) -> DataFrame:
    """One row per message block that has an id and a time; service notices are none."""
    parts = pages.select(*[x for x in pages.columns if x != "html"], F.posexplode(F.split("html", WRAP)).alias("__n", "p")).where("__n > 0").drop("__n")
    times = F.regexp_extract_all("p", F.lit(r'<time[^>]*datetime="([^"]+)"'), F.lit(1))
    num = lambda p: _pick("p", p).cast("long")
    meta = F.regexp_extract("p", r'(?s)class="tgme_widget_message_meta">(.*?)<a ', 1)
    out = parts.select(
        *[x for x in parts.columns if x != "p"],
        num(r'data-post="[^"/]+/(\d+)"').alias("msg_id"),
        F.to_timestamp(F.try_element_at(times, F.lit(-1))).alias("ts"),
        F.coalesce(html_to_text(_pick("p", r'<div class="tgme_widget_message_text js-message_text[^"]*"[^>]*>(.*?)</div>')), F.lit("")).alias("text"),
        c("p").rlike("tgme_widget_message_photo_wrap|tgme_widget_message_video|tgme_widget_message_document").alias("has_photo"),
        meta.contains("edited").alias("edited"),
        num(r'class="tgme_widget_message_reply[^"]*"[^>]*href="[^"]*/(\d+)"').alias("reply_to"),
        html_to_text(_pick("p", r"tgme_widget_message_forwarded_from_name[^>]*>(.*?)</(?:a|span)>")).alias("forwarded_from"),
        _pick("p", r'tgme_widget_message_views">([^<]*)<').alias("views"),
        F.regexp_like("p", F.lit(r"^[^>]*service_message")).alias("__service"),
    )
    return out.where("msg_id IS NOT NULL AND ts IS NOT NULL AND NOT __service").drop("__service")


def merge_pages(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Messages of both by id, the newer page's row where both have one."""
    both = newer.withColumn("__r", F.lit(0)).unionByName(older.withColumn("__r", F.lit(1)))
    w = W.partitionBy("msg_id").orderBy("__r")
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__r", "__k")


_EXPORT = "name string, messages array<struct<id: bigint, type: string, date: string, date_unixtime: string, text: string, reply_to_message_id: bigint, photo: string, file: string, edited: string, forwarded_from: string>>"


def flatten_text(c_: Column) -> Column:
    """Text that is a string, or a list of strings and objects with a text, joined."""
    items = F.from_json(c_, "array<string>")
    each = F.transform(items, lambda x: F.coalesce(F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))), x))
    return F.when(c_.startswith("["), F.array_join(each, "")).otherwise(c_)


def telegram_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a desktop export. Without a unix time the local clock is taken as UTC+5:30."""
    m = spark.read.schema(_EXPORT).option("multiLine", True).json(path).select("name", F.explode("messages").alias("m")).select("name", "m.*").where("type = 'message'")
    local = F.to_timestamp("date") - F.expr("INTERVAL '330' MINUTE")
    return m.select(
        c("id").alias("msg_id"), F.coalesce(F.timestamp_seconds(c("date_unixtime").cast("long")), local).alias("ts"), F.coalesce(flatten_text(c("text")), F.lit("")).alias("text"),
        F.coalesce("photo", "file").isNotNull().alias("has_photo"), c("edited").isNotNull().alias("edited"), c("reply_to_message_id").alias("reply_to"), "forwarded_from", c("name").alias("title"),
    )


def looks_like_whatsapp(lines: DataFrame) -> DataFrame:
    """Per document: two of the first forty lines are message starts. lines: doc_id, line_no, line."""
    return lines.groupBy("doc_id").agg((F.count_if((c("line_no") < 40) & c("line").rlike(CHAT_LINE)) >= 2).alias("whatsapp"))


def whatsapp_export(lines: DataFrame) -> DataFrame:
    """Messages of a chat export: a start line and the lines that continue it. lines: doc_id, line_no, line."""
    g = lambda i: F.regexp_extract("line", CHAT_LINE, i)
    hour = g(4).cast("int")
    pm = F.lower(g(7)).startswith("p")
    hour = F.when(g(7) == "", hour).when(pm & (hour < 12), hour + 12).when(~pm & (hour == 12), 0).otherwise(hour)
    year = F.when(F.length(g(3)) == 2, g(3).cast("int") + 2000).otherwise(g(3).cast("int"))
    sec = F.when(g(6) == "", 0).otherwise(g(6).cast("int"))
    made = F.expr("try_make_timestamp(y, mo, d, h, mi, s)") - F.expr("INTERVAL '330' MINUTE")
    t = lines.withColumn("is_start", c("line").rlike(CHAT_LINE))
    t = t.withColumns({"y": F.when(c("is_start"), year), "mo": F.expr(f"try_cast(regexp_extract(line, r'{CHAT_LINE}', 2) AS int)"), "d": F.expr(f"try_cast(regexp_extract(line, r'{CHAT_LINE}', 1) AS int)"), "h": F.when(c("is_start"), hour), "mi": F.when(c("is_start"), g(5).cast("int")), "s": F.when(c("is_start"), sec.cast("decimal(8,6)"))})
    t = t.withColumn("ts", F.when(c("is_start"), made)).where("NOT is_start OR ts IS NOT NULL")
    w = W.partitionBy("doc_id").orderBy("line_no")
    t = t.withColumn("msg_id", F.sum(c("is_start").cast("int")).over(w)).where("msg_id > 0 AND (is_start OR trim(line) <> '')")
    body = F.when(c("is_start"), F.trim(g(9))).otherwise(c("line"))
    media = c("is_start") & g(9).rlike(OMITTED)
    t = t.select("doc_id", "msg_id", "line_no", "ts", F.when(media, "").otherwise(body).alias("body"), media.alias("media"))
    m = t.groupBy("doc_id", "msg_id").agg(F.max("ts").alias("ts"), F.bool_or("media").alias("has_photo"), F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("b"))
    return m.select("doc_id", "msg_id", "ts", F.array_join(c("b.body"), "\n").alias("text"), "has_photo")


def pasted(texts: DataFrame, at: str) -> DataFrame:
    """Blocks between blank lines as messages of one time; texts that look like a chat export are read as one. texts: doc_id, text."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    chat = looks_like_whatsapp(lines).where("whatsapp").select("doc_id")
    told = whatsapp_export(lines.join(chat, "doc_id", "left_semi")).select("doc_id", c("msg_id").cast("int").alias("msg_id"), "ts", "text")
    plain = texts.join(chat, "doc_id", "left_anti")
    b = plain.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("n", "b")).withColumn("b", F.regexp_replace("b", r"^\s+|\s+$", "")).where("b <> ''")
    w = W.partitionBy("doc_id").orderBy("n")
    return b.select("doc_id", F.row_number().over(w).alias("msg_id"), F.to_timestamp(F.lit(at)).alias("ts"), c("b").alias("text")).unionByName(told)


def handle(x: Column) -> Column:
    """@name, t.me/name, https://t.me/s/name or a plain name; anything else is null."""
    return F.nullif(F.regexp_extract(F.trim(x), r"^(?:@|(?:https?://)?t\.me/(?:s/)?)?([A-Za-z][A-Za-z0-9_]{3,31})/?$", 1), F.lit(""))
