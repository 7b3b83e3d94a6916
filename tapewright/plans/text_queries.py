"""Queries over messages and documents, with SQL where its regular expressions reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.say import say_column
from ..operators import instruments as I
from ..operators import linking
from ..operators import messages as M
from ..operators import report
from ..sources import chats, transcripts
from . import bindings as V

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}
# cue phrases hung on rendered tips, by the event's number
PHRASES = ("", "JOIN OUR VIP GROUP NOW", "PAYMENT UPI ID : ABC", "DM FOR DETAILS", "T.ME/+ABCDEF", "SURE SHOT JACKPOT", "LIMITED SEATS HURRY", "ACCOUNT HANDLING AVAILABLE", "95 % ACCURACY")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _signups(spark: SparkSession, d: str) -> DataFrame:
    """Signups dealt to all cores: the table is one small file, and reading texts is much work a row.

    A cluster's session knows of two cores until its executors have come, hence the shuffle's partitions as well.
    """
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return V.table(spark, d, "events").where("event_type = 'signup'").repartition(parts, "event_id")


def tips(spark: SparkSession, d: str) -> DataFrame:
    """Signups as tip texts rendered from their numbers."""
    e, i = _signups(spark, d), c("event_id")
    v = F.floor(c("value") * 100 + 0.5) / 100 + 1
    num = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    text = F.concat(F.when(i % 2 == 0, "Buy ").otherwise("Sell "), F.lit("SYM"), c("user_id").cast("string"), F.lit(" @ "), num(v), F.lit(" TGT "), num(v + 3), F.lit(" SL "), num(v - 0.5), F.lit("\n"), F.element_at(F.array(*map(F.lit, PHRASES)), (i % len(PHRASES) + 1).cast("int")))
    return e.select((c("user_id") % 10).alias("channel_id"), i.alias("msg_id"), "ts", text.alias("text"), F.lit(False).alias("has_photo"), "user_id", v.alias("v"))


_TIPS = f"""tips AS (SELECT user_id % 10 AS channel_id, event_id AS msg_id, floor(value * 100 + 0.5) / 100 + 1 AS v, user_id, event_id % 2 = 0 AS up, ['{"', '".join(PHRASES)}'][event_id % {len(PHRASES)} + 1] AS phrase FROM events WHERE event_type = 'signup')"""
_KIND = "CASE phrase WHEN 'JOIN OUR VIP GROUP NOW' THEN ['join-link', 'paid-group'] WHEN 'PAYMENT UPI ID : ABC' THEN ['payment'] WHEN 'DM FOR DETAILS' THEN ['contact'] WHEN 'T.ME/+ABCDEF' THEN ['join-link'] WHEN 'SURE SHOT JACKPOT' THEN ['guarantee'] WHEN 'LIMITED SEATS HURRY' THEN ['urgency'] WHEN 'ACCOUNT HANDLING AVAILABLE' THEN ['account-handling'] ELSE [] END"


@query(f"WITH {_TIPS} SELECT channel_id, msg_id, unnest({_KIND}) AS kind FROM tips")
def fn_promo(spark, d):
    return M.cues(tips(spark, d)).select("channel_id", "msg_id", "kind")


@query(f"WITH {_TIPS}, k AS (SELECT channel_id, unnest({_KIND}) AS kind FROM tips), ch AS (SELECT DISTINCT channel_id FROM tips) SELECT channel_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}" for k, _ in P.PROMO) + " FROM ch LEFT JOIN k USING (channel_id) GROUP BY 1")
def agg_promo_kind(spark, d):
    return M.promo_kinds(tips(spark, d))


@query(f"WITH {_TIPS} SELECT channel_id, count(*) AS text_messages, count(*) FILTER (phrase NOT IN ('', 'SURE SHOT JACKPOT', '95 % ACCURACY')) AS selling_messages FROM tips GROUP BY 1")
def agg_promo_msgs(spark, d):
    return M.promo_messages(tips(spark, d))


@query(f"WITH {_TIPS} SELECT channel_id, msg_id, 95.0::DOUBLE AS percent FROM tips WHERE phrase LIKE '%ACCURACY'")
def flt_claim(spark, d):
    return M.claims(tips(spark, d))


@query(f"WITH {_TIPS} SELECT msg_id, 'SYM' || user_id AS symbol, CASE WHEN up THEN 'long' ELSE 'short' END AS side, v AS entry, round(v + 3, 2) AS target, round(v - 0.5, 2) AS stop FROM tips")
def extract_calls(spark, d):
    """prj_entry, prj_targets, prj_stop, prj_side_horizon, jn_dict: texts read back into the numbers they were made of."""
    names = V.table(spark, d, "events").select(F.concat(F.lit("SYM"), c("user_id").cast("string")).alias("key")).distinct()
    k = M.read_calls(tips(spark, d), names.select("key", c("key").alias("symbol"), F.lit("stock").alias("kind")))
    return k.select("msg_id", "symbol", "side", c("entry.lo").alias("entry"), F.round(c("targets")[0], 2).alias("target"), F.round(c("stop"), 2).alias("stop"))


def rule_texts(spark: SparkSession, d: str) -> DataFrame:
    """Signups as texts of ten shapes, one for each way in which an instrument and its levels can be written."""
    e, n = _signups(spark, d), c("event_id") % 10
    v = F.floor(c("value") * 100 + 0.5) / 100 + 10
    num = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    sym, p = F.concat(F.lit("SYM"), c("user_id").cast("string")), num(v)
    levels = F.concat(F.lit(" TGT "), num(v + 3), F.lit(" SL "), num(v - 2))
    shapes = [
        [F.lit("BUY NIFTY 24500 CE ABOVE "), p, F.lit(" TGT "), num(v + 3), F.lit("/"), num(v + 5), F.lit(" SL "), num(v - 2)],
        [F.lit("SELL "), sym, F.lit(" BELOW "), (c("user_id") + 100).cast("string"), F.lit(" TARGET 3 POINTS SL 5 %")],
        [F.lit("STOCK NAME = "), sym, F.lit("\nBUY ABOVE "), p, levels],
        [F.lit("BUY "), sym, F.lit(" AT "), p, levels, F.lit("\n\nSELL "), sym, F.lit(" AT "), p, F.lit(" TGT "), num(v - 3), F.lit(" SL "), num(v + 2)],
        [F.lit("BUY SEP 57100 PE @ "), p, levels],
        [F.lit("#"), sym, F.lit(" "), p, levels],
        [F.lit("BUY "), sym, F.lit(" AT 130-40 TGT 150 SL 120 btst")],
        [F.lit("BUY NIFTY 25 SEP 24000 PE @ "), p, levels],
        [F.lit("NIFTY 24000 CE BUY "), p, levels, F.lit("\nBANKNIFTY 52000 PE BUY "), p, levels],
        [F.lit("BUY "), sym, F.lit(" ABOVE "), p, F.lit(" TO "), num(v + 3), F.lit("-"), num(v + 5), F.lit("-"), num(v + 7), F.lit(" SL "), num(v - 2)],
    ]
    text = F.element_at(F.array(*[F.concat(*x) for x in shapes]), (n + 1).cast("int"))
    return e.select((c("user_id") % 10).alias("channel_id"), c("event_id").alias("msg_id"), "ts", text.alias("text"), F.lit(False).alias("has_photo"))


def _row(n, symbol, kind, strike, opt, side, etype, lo, t1, targets, stop, confidence, how, pos=1, hi="NULL", hint="NULL, NULL", horizon="unspecified", several=False):
    call = f"event_id::VARCHAR || '.{pos}'" if several else "event_id::VARCHAR"
    return f"SELECT {call} AS call_id, {symbol} AS symbol, '{kind}' AS kind, {strike}::DOUBLE AS strike, {opt} AS opt_type, '{side}' AS side, '{horizon}' AS horizon, '{etype}' AS entry, round({lo}, 2)::DOUBLE AS lo, {hi}::DOUBLE AS hi, {hint.split(', ')[0]}::INT AS hint_day, {hint.split(', ')[1]}::INT AS hint_month, round({t1}, 2)::DOUBLE AS target, {targets} AS n_targets, round({stop}, 2)::DOUBLE AS stop, '{confidence}' AS confidence, '{how}' AS how FROM e WHERE n = {n}"


_S, _O = "'SYM' || user_id", ("v", "v + 3", 1, "v - 2")
RULES_SQL = "WITH e AS (SELECT event_id, user_id, event_id % 10 AS n, floor(value * 100 + 0.5) / 100 + 10 AS v FROM events WHERE event_type = 'signup') " + " UNION ALL ".join([
    _row(0, "'NIFTY'", "option", 24500, "'CE'", "long", "above", "v", "v + 3", 2, "v - 2", "high", "option"),
    _row(1, _S, "equity", "NULL", "NULL", "short", "below", "user_id + 100", "user_id + 97", 1, "(user_id + 100) * 1.05", "high", "action"),
    _row(2, _S, "equity", "NULL", "NULL", "long", "above", *_O, "high", "label"),
    _row(3, _S, "equity", "NULL", "NULL", "long", "at", *_O, "high", "action", several=True),
    _row(3, _S, "equity", "NULL", "NULL", "short", "at", "v", "v - 3", 1, "v + 2", "high", "action", pos=2, several=True),
    _row(4, "'?'", "option", 57100, "'PE'", "long", "at", *_O, "medium", "option", hint="NULL, 9"),
    _row(5, _S, "equity", "NULL", "NULL", "long", "at", *_O, "medium", "tag"),
    _row(6, _S, "equity", "NULL", "NULL", "long", "range", 130, 150, 1, 120, "high", "action", hi="140", horizon="btst"),
    _row(7, "'NIFTY'", "option", 24000, "'PE'", "long", "at", *_O, "high", "option", hint="25, 9"),
    _row(8, "'NIFTY'", "option", 24000, "'CE'", "long", "at", *_O, "high", "option", several=True),
    _row(8, "'BANKNIFTY'", "option", 52000, "'PE'", "long", "at", *_O, "high", "option", pos=2, several=True),
    _row(9, _S, "equity", "NULL", "NULL", "long", "above", "v", "v + 3", 3, "v - 2", "high", "action"),
])


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    names = V.table(spark, d, "events").select(F.concat(F.lit("SYM"), c("user_id").cast("string")).alias("key"), F.lit("stock").alias("kind")).distinct()
    return names.unionByName(spark.createDataFrame([("NIFTY", "index"), ("BANKNIFTY", "index")], "key string, kind string")).withColumn("symbol", c("key"))


@query(RULES_SQL)
def prj_find_instrument(spark, d):
    """prj_find_named, prj_name_window, prj_kind, prj_by_contract, prj_paragraphs, prj_call_id, prj_entry, prj_targets, prj_stop,
    prj_expiry_hint, flt_is_call, prj_confidence: ten shapes of text read back into what they were made of."""
    k = M.read_calls(rule_texts(spark, d), _symbols(spark, d))
    r2 = lambda x: F.round(x, 2)
    return k.select("call_id", "symbol", "kind", "strike", "opt_type", "side", "horizon", c("entry.type").alias("entry"), r2("entry.lo").alias("lo"), "entry.hi", "hint_day", "hint_month", r2(c("targets")[0]).alias("target"), F.size("targets").alias("n_targets"), r2("stop").alias("stop"), "confidence", "how")


@query("WITH t AS (SELECT s_suppkey, 'SUPPLIER' || right(s_name, 9) AS name FROM supplier), a AS (SELECT left(name, 15) || right(name, 1) || substr(name, 16, 1) AS word, 1 + s_suppkey % 2 AS most FROM t) SELECT DISTINCT word, name AS target FROM a, t WHERE damerau_levenshtein(word, name) <= most")
def jn_fuzzy(spark, d):
    """Supplier names with two figures swapped against all names, one or two edits off; the SQL compares all pairs."""
    t = V.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("SUPPLIER"), F.right("s_name", F.lit(9))).alias("target"))
    word = F.concat(F.left("target", F.lit(15)), F.right("target", F.lit(1)), F.substring("target", 16, 1))
    return I.within_edits(t.select(word.alias("word"), (1 + c("s_suppkey") % 2).cast("int").alias("most")).distinct(), t.select("target").distinct())


@query("WITH p AS (SELECT 'T' || p_partkey || 'X' AS symbol, upper(p_brand || ' ' || p_partkey || 'Z ' || p_name) AS name FROM part), w AS (SELECT symbol, list_filter(regexp_split_to_array(name, '[^A-Z0-9&]+'), lambda x: x <> '') AS w FROM p), k AS (SELECT DISTINCT symbol, unnest([array_to_string(w, ''), array_to_string(w[1:2], '')]) AS key FROM w), one AS (SELECT key FROM k GROUP BY key HAVING count(*) = 1), f AS (SELECT w[1] AS key, min(symbol) AS symbol FROM w WHERE length(w[1]) >= 5 GROUP BY 1 HAVING count(*) = 1) SELECT key, symbol FROM k JOIN one USING (key) UNION SELECT key, symbol FROM f WHERE key NOT IN (SELECT key FROM k JOIN one USING (key))")
def prj_name_keys(spark, d):
    """agg_name_unique too: spellings of company names made of brands, numbers and part names."""
    p = V.table(spark, d, "part")
    sym = p.select(F.concat(F.lit("T"), c("p_partkey").cast("string"), F.lit("X")).alias("symbol"), F.concat_ws(" ", "p_brand", F.concat(c("p_partkey").cast("string"), F.lit("Z")), "p_name").alias("name"), F.lit(0).alias("first_d"), F.lit(9).alias("last_d"))
    none = spark.createDataFrame([], "symbol string, kind string")
    return I.dictionary(spark, sym, none, spark.createDataFrame([], "alias string, symbol string")).where("via = 'name'").select("key", "symbol")


@query()
def flt_unread(spark, d):
    names = V.table(spark, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("SYM"), c("user_id").cast("string")).alias("key")).distinct()
    return M.unread(tips(spark, d), names.select("key", c("key").alias("symbol"), F.lit("stock").alias("kind")))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|blockquote|pre)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g') AS stripped FROM pages")
def fn_html(spark, d):
    """Tags of raw pages stripped; entities are read by the same operator and tested apart."""
    return V.table(spark, d, "pages").select("page_id", F.regexp_replace(T.strip_tags(c("html")), r"\s+", " ").alias("stripped"))


@query(r"SELECT doc_id, regexp_replace(upper(source), '[^A-Z0-9&]', '', 'g') AS squashed, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(.{0,80}).*', '\1') AS line FROM documents")
def fn_oneline(spark, d):
    """fn_squash as well."""
    return V.table(spark, d, "documents").select("doc_id", T.squash(c("source")).alias("squashed"), T.one_line(c("text"), 80).alias("line"))


def _scrub_sql(x: str) -> str:
    for pattern, to in (
        (r"(?i)https?://t\.me/(?:\+|joinchat/)\S+", "t.me/+[link removed]"),
        (r"(?i)https?://(?:wa\.me|api\.whatsapp\.com)\S*", "wa.me/[number removed]"),
        (r"(?i)https?://chat\.whatsapp\.com/\S+", "chat.whatsapp.com/[link removed]"),
        (r"(?i)https?://\S+", "[link removed]"),
        (r"(?i)\bwww\.\S+", "[link removed]"),
        (r"(?i)\b[\w.-]{3,}@(ybl|okaxis|okhdfcbank|okicici|oksbi|paytm|upi|ibl|axl|apl)\b", r"[id removed]@\1"),
        (r"@[A-Za-z][A-Za-z0-9_]{3,}", "@[handle removed]"),
        (r"(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}\b", "[number removed]"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


@query(f"SELECT doc_id, {_scrub_sql('text')} AS t FROM documents")
def prj_scrub(spark, d):
    """All eight rules over every document; null texts stay null."""
    return V.table(spark, d, "documents").select("doc_id", T.scrub(c("text"), []).alias("t"))


@query("SELECT s_suppkey, 'INH' || lpad(s_suppkey::VARCHAR, 9, '0') AS reg_no, s_suppkey % 2 = 0 AS on_register FROM supplier")
def jn_register(spark, d):
    """Claimed numbers against a register that has every second one."""
    s = V.table(spark, d, "supplier")
    no = F.concat(F.lit("INH"), F.lpad(c("s_suppkey").cast("string"), 9, "0"))
    said = s.select(c("s_suppkey").alias("channel_id"), F.lit(1).alias("msg_id"), F.concat(F.lit("sebi registered "), F.lower(no), F.lit(" join")).alias("text"))
    register = s.where("s_suppkey % 2 = 0").select(no.alias("reg_no"), F.lit("research-analyst").alias("kind"), c("s_name").alias("name"), F.lit("2020").alias("valid_from"), F.lit("2030").alias("valid_to"))
    return M.registrations(said, register).select(c("channel_id").alias("s_suppkey"), "reg_no", "on_register")


@query("SELECT conv_id AS channel_id, turn AS msg_id, CASE WHEN turn % 3 <> 0 THEN lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS previous FROM conversations")
def win_prev_msg(spark, d):
    """Previous message at most 15 minutes before."""
    return linking.previous_within(V.messages(spark, d)).select("channel_id", "msg_id", "previous")


@query("WITH m AS (SELECT *, CASE WHEN turn % 5 = 0 THEN 'SYM' || turn END AS named, CASE WHEN turn % 4 = 1 THEN 0 END AS reply_to FROM conversations) SELECT m.conv_id AS channel_id, m.turn AS msg_id, CASE WHEN m.named IS NULL THEN coalesce(p.named, b.named) END AS source FROM m LEFT JOIN m p ON p.conv_id = m.conv_id AND p.turn = m.reply_to LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1 AND m.turn % 3 <> 0")
def jn_inherit(spark, d):
    m = V.messages(spark, d).withColumn("named", F.when(c("msg_id") % 5 == 0, F.concat(F.lit("SYM"), c("msg_id").cast("string")))).withColumn("reply_to", F.when(c("msg_id") % 4 == 1, 0))
    return linking.inherit(m).select("channel_id", "msg_id", "source")


@query("WITH RECURSIVE s AS (SELECT user_id % 10 AS channel_id, event_id % 5 AS k, event_id, ts, row_number() OVER (PARTITION BY user_id % 10, event_id % 5 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup'), r AS (SELECT channel_id, k, event_id, ts, n, ts AS anchor, false AS repost FROM s WHERE n = 1 UNION ALL SELECT s.channel_id, s.k, s.event_id, s.ts, s.n, CASE WHEN s.ts - r.anchor <= INTERVAL 18 HOUR THEN r.anchor ELSE s.ts END, s.ts - r.anchor <= INTERVAL 18 HOUR FROM r JOIN s ON s.channel_id = r.channel_id AND s.k = r.k AND s.n = r.n + 1) SELECT event_id AS msg_id, repost FROM r")
def win_repost(spark, d):
    """Reposts within 18 hours of the last one kept."""
    e = V.table(spark, d, "events").where("event_type = 'signup'").select((c("user_id") % 10).alias("channel_id"), c("event_id").alias("msg_id"), "ts", (c("event_id") % 5).alias("k"))
    return linking.reposts(e, ["k"]).select("msg_id", "repost")


@query("SELECT page_id, page_id AS msg_id, 'BUY & HOLD' || chr(10) || page_id AS text, page_id % 2 = 0 AS has_photo, CASE WHEN page_id % 3 = 0 THEN 7::BIGINT END AS reply_to FROM pages UNION ALL SELECT page_id, page_id + 1, '', false, NULL FROM pages")
def src_preview(spark, d):
    """Preview pages made from the page ids: a message with text, one without, and a service notice."""
    i = c("page_id").cast("string")
    block = lambda n, body: F.concat(F.lit(chats.WRAP + ' js-widget_message_wrap"><div data-post="ch/'), n, F.lit('">'), body, F.lit('<time datetime="2025-01-02T03:04:05+00:00"></time></div></div>'))
    one = F.concat(
        F.when(c("page_id") % 3 == 0, F.lit('<a class="tgme_widget_message_reply" href="https://t.me/ch/7">x</a>')).otherwise(F.lit("")),
        F.when(c("page_id") % 2 == 0, F.lit('<a class="tgme_widget_message_photo_wrap">')).otherwise(F.lit("")),
        F.lit('<div class="tgme_widget_message_text js-message_text" dir="auto">BUY &amp; <b>HOLD</b><br/>'), i, F.lit("</div>"),
    )
    notice = F.concat(F.lit(chats.WRAP + ' service_message"><div data-post="ch/9"><time datetime="2025-01-02T03:04:05+00:00"></time></div>'))
    html = F.concat(F.lit("<html>"), block(i, one), block((c("page_id") + 1).cast("string"), F.lit("")), notice)
    p = chats.preview_messages(V.table(spark, d, "pages").select("page_id", html.alias("html")))
    return p.select("page_id", "msg_id", "text", "has_photo", "reply_to")


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS msg_id, b AS text FROM (SELECT event_id AS doc_id, unnest(string_split('BUY SYM' || user_id || chr(10) || chr(10) || 'SL ' || event_id, chr(10) || chr(10))) AS b, generate_subscripts([1, 2], 1) AS n FROM events WHERE event_type = 'signup')")
def src_pasted(spark, d):
    e = V.table(spark, d, "events").where("event_type = 'signup'")
    t = e.select(c("event_id").alias("doc_id"), F.concat(F.lit("BUY SYM"), c("user_id").cast("string"), F.lit("\n\nSL "), c("event_id").cast("string")).alias("text"))
    return chats.pasted(t, "2025-01-01 00:00:00").select("doc_id", c("msg_id").cast("long").alias("msg_id"), "text")


@query("SELECT event_id AS msg_id, 'call' AS cls FROM events WHERE event_type = 'signup'")
def prj_tape(spark, d):
    """Every rendered tip is a call, whatever else it says."""
    names = V.table(spark, d, "events").select(F.concat(F.lit("SYM"), c("user_id").cast("string")).alias("key")).distinct()
    t = tips(spark, d)
    k = M.read_calls(t, names.select("key", c("key").alias("symbol"), F.lit("stock").alias("kind")))
    return M.tape(t, k, M.follow_ups(t)).select("msg_id", "cls")


@query("SELECT c_custkey, n, say FROM (SELECT c_custkey, c_custkey % 20 AS n, ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'][c_custkey % 20 + 1] AS say FROM customer)")
def fn_say(spark, d):
    t = V.table(spark, d, "customer").withColumn("n", c("c_custkey") % 20)
    return t.select("c_custkey", "n", say_column(c("n").cast("double"), F.lit("en")).alias("say"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS edits FROM part")
def fn_distance(spark, d):
    """A swap of neighbours is one edit, two replaced letters are two."""
    a = F.concat(F.lit("ABCD"), c("p_partkey").cast("string"))
    b = F.concat(F.when(c("p_partkey") % 2 == 0, "ABDC").otherwise("XYCD"), c("p_partkey").cast("string"))
    return V.table(spark, d, "part").select("p_partkey", T.osa_distance(a, b).alias("edits"))


@query()
def src_ocr_text(spark, d):
    """A transcript of three bubbles per supplier."""
    i = c("s_suppkey").cast("string")
    text = F.concat(F.lit("BUY SYM"), i, F.lit(" AT 100 SL 90 TARGET 120\n10:05\nBUY SYM"), i, F.lit(" AT 100...\nTARGET HIT\n11:30\nGOOD MORNING\n9:15 pm"))
    t = V.table(spark, d, "supplier").select(c("s_suppkey").alias("doc_id"), text.alias("text"), F.to_date(F.lit("2025-12-01")).alias("day"))
    return transcripts.transcripts(t)


@query("SELECT user_id % 10 AS channel_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type = 'signup' GROUP BY 1")
def agg_span(spark, d):
    return report.spans(tips(spark, d))


@query(f"WITH {_TIPS} SELECT channel_id, 95.0::DOUBLE AS percent FROM tips WHERE phrase LIKE '%ACCURACY' GROUP BY 1")
def agg_claimed(spark, d):
    """The highest accuracy that each channel claims."""
    return M.claims(tips(spark, d)).groupBy("channel_id").agg(F.max("percent").alias("percent"))


@query(f"WITH {_TIPS}, k AS (SELECT channel_id, msg_id, unnest({_KIND}) AS kind FROM tips) SELECT channel_id, kind, min(msg_id) AS msg_id FROM k GROUP BY 1, 2")
def top1_example(spark, d):
    """The first message with a cue of each kind."""
    return report.first_examples(M.cues(tips(spark, d))).select("channel_id", "kind", "msg_id")


@query("SELECT conv_id AS channel_id, string_agg(CASE turn % 6 WHEN 0 THEN 'c' WHEN 1 THEN 'p' WHEN 2 THEN 'l' WHEN 3 THEN 's' WHEN 4 THEN 'o' ELSE 'i' END, '' ORDER BY turn) AS letters, count(*) FILTER (turn % 6 = 0) AS call, count(*) FILTER (turn % 6 = 1) AS profit, count(*) FILTER (turn % 6 = 2) AS loss, count(*) FILTER (turn % 6 = 3) AS selling, count(*) FILTER (turn % 6 = 4) AS other, count(*) FILTER (turn % 6 = 5) AS picture FROM conversations GROUP BY 1")
def agg_tape(spark, d):
    """One letter a message, in order."""
    kinds = F.array(*map(F.lit, ("call", "profit", "loss", "selling", "other", "picture")))
    return report.tape_letters(V.messages(spark, d).select("channel_id", "msg_id", F.element_at(kinds, (c("msg_id") % 6 + 1).cast("int")).alias("cls")))


@query("SELECT user_id % 10 AS channel_id, count(*) FILTER (event_id % 3 = 0) AS no_stop, count(*) FILTER (event_id % 4 = 0) AS paywalled FROM events WHERE event_type = 'signup' GROUP BY 1")
def agg_tape_meta(spark, d):
    """Calls without a stop, and cues that sell levels."""
    e, i = V.table(spark, d, "events").where("event_type = 'signup'"), c("event_id")
    k = e.select((c("user_id") % 10).alias("channel_id"), F.when(i % 3 != 0, c("value")).alias("stop"), F.when(i % 4 == 0, "paywalled-levels").otherwise("contact").alias("kind"))
    return report.tape_meta(k, k)
