"""Rows of the reports: the call list, disputed posts, samples of the tape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import ist
from ..functions.text import one_line

c = F.col


def call_list(calls: DataFrame, outcomes: DataFrame, lines: DataFrame, firm: DataFrame, calendar: DataFrame) -> DataFrame:
    """The fifteen columns of the call list, one row a call, as text.

    calls: call_id, ts, text, contract, side, entry (type, lo, hi), targets, stop. lines: call_id, status, if_funded.
    """
    days = F.broadcast(calendar.select("d", c("dt").cast("string").alias("dt")))  # a row a trading day
    t = calls.join(outcomes, "call_id", "left").join(lines.select("call_id", "status", "if_funded"), "call_id", "left").join(firm, "call_id", "left")
    t = t.join(days.select(c("d").alias("entry_day"), c("dt").alias("entered_on")), "entry_day", "left").join(days.select(c("d").alias("exit_day"), c("dt").alias("exited_on")), "exit_day", "left")
    num = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    blank = lambda x: F.coalesce(x, F.lit(""))
    entry = F.when(c("entry.type") == "none", "").when(c("entry.type") == "range", F.concat(num(c("entry.lo")), F.lit("-"), num(c("entry.hi")))).otherwise(F.concat_ws(" ", "entry.type", num(c("entry.lo"))))
    return t.select(
        F.date_format(ist(c("ts")), "yyyy-MM-dd").alias("date"), F.date_format(ist(c("ts")), "HH:mm").alias("time_ist"), one_line(c("text"), 200).alias("message"), "contract",
        F.when(c("side") == "long", "buy").otherwise("sell").alias("side"), entry.alias("entry"), F.array_join(F.transform("targets", num), " / ").alias("target"), blank(num(c("stop"))).alias("stop_loss"),
        blank(c("entered_on")).alias("entered_on"), blank(num(c("entry_price"))).alias("entry_price"), blank(c("exited_on")).alias("exited_on"), blank(num(c("exit_price"))).alias("exit_price"),
        F.when(c("if_funded").isNotNull(), c("cls")).otherwise(blank(F.coalesce("code", "status"))).alias("result"), F.when(~c("firm"), "yes").otherwise("").alias("depends_on_reading"), F.lit("").alias("note"),
    )


def ticker(messages: DataFrame, most: int = 18) -> DataFrame:
    """The first distinct posts, in the order seen."""
    one = messages.groupBy("channel_id", one_line(c("text")).alias("line")).agg(F.min(F.struct("ts", "msg_id")).alias("at"))
    w = W.partitionBy("channel_id").orderBy("at")
    return one.where("line <> ''").withColumn("place", F.row_number().over(w)).where(c("place") <= most).drop("at")


def codes(queued: DataFrame) -> DataFrame:
    """Why calls were left unchecked, most frequent first."""
    why = F.when(c("status") == "low-confidence", "low-confidence").otherwise(c("code"))
    return queued.where("status <> 'queued'").groupBy(why.alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def worthless_exhibit(queued: DataFrame, firm: DataFrame) -> DataFrame:
    """Per channel the last call that expired worthless whatever the reading."""
    t = queued.join(firm.where("firm"), "call_id").where("cls = 'expired' AND exit_price <= entry_price * 0.05")
    return t.groupBy("channel_id").agg(F.max_by("call_id", F.struct("entry_day", "msg_id", "pos")).alias("call_id"))


def complaint(accounts: DataFrame, followed: DataFrame) -> DataFrame:
    """A plain-text summary per channel from its account and follow-through rows."""
    t = accounts.join(followed, "channel_id", "left")
    line = lambda label, col: F.concat(F.lit(label + ": "), F.coalesce(c(col).cast("string"), F.lit("not known")))
    return t.select("channel_id", "reading", F.concat_ws("\n", line("Calls taken", "taken"), line("Result", "net_result"), line("Balance at the end", "final_balance"), line("Losing calls", "losers"), line("of those never mentioned again", "silent_losses")).alias("draft"))


def spans(messages: DataFrame) -> DataFrame:
    """Messages per channel, and when the first and the last were posted."""
    return messages.groupBy("channel_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def filtered(rows: DataFrame) -> DataFrame:
    """Rows (filter, call_id): the calls that each filter of the report shows. rows: call_id, replayed, cls, move, firm."""
    replayed = F.coalesce("replayed", F.lit(False))
    tests = {"all": F.lit(True), "target": replayed & (c("cls") == "target"), "lost": replayed & (F.coalesce("move", F.lit(0.0)) < 0), "doubtful": c("firm").eqNullSafe(F.lit(False)), "unchecked": ~replayed}
    return rows.select("call_id", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in tests.items()]))).alias("filter"))


def page(rows: DataFrame, by: list[str], order: list, first: int, last: int) -> DataFrame:
    """Rows first to last, counted from 1, of each group in an order: what a table shows of it."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(c("place").between(first, last))


def first_examples(cues: DataFrame, most: int = 1) -> DataFrame:
    """Per channel and kind the first distinct matches, as they were first seen. cues: channel_id, msg_id, kind, match."""
    one = cues.groupBy("channel_id", "kind", "match").agg(F.min("msg_id").alias("msg_id"))
    return page(one, ["channel_id", "kind"], ["msg_id", "match"], 1, most)


def tape_letters(tape: DataFrame) -> DataFrame:
    """Per channel one letter a message, in posting order, and how many there are of each. tape: channel_id, msg_id, cls."""
    letter = {"call": "c", "profit": "p", "loss": "l", "selling": "s", "other": "o", "picture": "i"}
    x = F.element_at(F.create_map(*[F.lit(v) for kv in letter.items() for v in kv]), c("cls"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_id", x.alias("x")))), lambda r: r.x), "")
    return tape.groupBy("channel_id").agg(letters.alias("letters"), *[F.count_if(c("cls") == k).alias(k) for k in letter])


def tape_meta(calls: DataFrame, cues: DataFrame) -> DataFrame:
    """Per channel the calls without a stop, and the cues that sell levels."""
    k = calls.groupBy("channel_id").agg(F.count_if(c("stop").isNull()).alias("no_stop"))
    p = cues.groupBy("channel_id").agg(F.count_if(c("kind") == "paywalled-levels").alias("paywalled"))
    return k.join(p, "channel_id", "full").select("channel_id", F.coalesce("no_stop", F.lit(0)).alias("no_stop"), F.coalesce("paywalled", F.lit(0)).alias("paywalled"))


def quoted_most(linked: DataFrame) -> DataFrame:
    """Per call the posts about it, and the highest price they quote (null: none above zero)."""
    return linked.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("posts"), F.max(F.when(c("quoted") > 0, c("quoted"))).alias("quoted_max"))


def window_ends(lines: DataFrame, window: DataFrame) -> DataFrame:
    """Per account where the calls of ``window(call_id)`` alone would leave it: start and their net results, without a floor."""
    t = lines.where("status = 'taken'").join(window.select(c("call_id").cast("string").alias("call_id")).distinct(), "call_id")
    return t.groupBy("channel_id", "reading", "param_id").agg(F.round(F.first("capital") + F.sum("net")).alias("end"))


def note_texts(notes: DataFrame, templates: DataFrame) -> DataFrame:
    """Notes in words: ``{0}``, ``{1}`` .. of the language's template stand for the figures. notes: k, a (strings), and more; templates: lang, k, text."""
    t = notes.join(templates, "k")
    fill = F.aggregate(F.transform("a", lambda x, i: F.struct(F.concat(F.lit("{"), i.cast("string"), F.lit("}")).alias("mark"), x.alias("x"))), c("text"), lambda s, p: F.replace(s, p.mark, p.x))
    return t.withColumn("text", fill)


# ---- the case study: company names to symbols, and its recommendations


def plain_name(x):
    """A company name without what does not tell companies apart."""
    x = F.regexp_replace(F.upper(x), "&", " AND ")
    x = F.regexp_replace(x, r"\b(LIMITED|LTD|CO|COMPANY|INDIA|THE)\b|\(INDIA\)", " ")
    return F.trim(F.regexp_replace(x, "[^A-Z0-9]+", " "))


def case_symbols(asked: DataFrame, catalogue: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (scrip, symbol): by a list of known names, else by the equal plain name, else by the first of the
    catalogue that begins the name or is begun by it. asked: scrip. catalogue: symbol, name, seq. known: scrip, symbol.

    Beginnings are met by equality with exploded prefixes, never name by name; only lengths that the other side has
    are exploded. Both sides are large, and rows multiply in a way that size estimates do not see: the joins are
    merges, as a broadcast would pass a side whole through the driver.
    """
    a = asked.select("scrip", plain_name(c("scrip")).alias("p")).distinct()
    k = catalogue.select("symbol", "seq", plain_name(c("name")).alias("n"))

    def heads(df: DataFrame, x: str, other: DataFrame, y: str) -> DataFrame:
        size = F.greatest(F.lit(1), F.length(x))
        from_ = F.greatest(F.lit(1), c("__least"))
        cut = F.when(size >= from_, F.transform(F.sequence(from_, F.greatest(from_, size)), lambda i: F.left(c(x), i)))
        return df.crossJoin(F.broadcast(other.agg(F.min(F.length(y)).alias("__least")))).withColumn("__h", F.explode(cut)).drop("__least")  # one row

    # one row a plain name: the first of the catalogue, and the last; one row a beginning: the first that it begins
    named = k.groupBy("n").agg(F.min_by("symbol", "seq").alias("first"), F.min("seq").alias("seq"), F.max_by("symbol", "seq").alias("last"))
    begins = heads(k, "n", a, "p").groupBy("__h").agg(F.min_by("symbol", "seq").alias("first"), F.min("seq").alias("seq"))
    null = F.lit(None).cast(k.schema["symbol"].dataType)
    over = heads(a, "p", k, "n").join(named.hint("merge"), c("__h") == c("n")).select("scrip", F.when(c("p") == c("n"), c("last")).alias("exact"), "first", "seq")
    under = a.join(begins.hint("merge"), c("__h") == c("p")).select("scrip", null.alias("exact"), "first", "seq")
    none = a.select("scrip", null.alias("exact"), null.alias("first"), F.lit(None).cast(k.schema["seq"].dataType).alias("seq"))
    out = over.unionByName(under).unionByName(none).groupBy("scrip").agg(F.max("exact").alias("exact"), F.min_by("first", "seq").alias("begun"))
    if known is None:
        return out.select("scrip", F.coalesce("exact", "begun").alias("symbol"))
    by_hand = known.select("scrip", c("symbol").alias("__s")).join(catalogue.select(c("symbol").alias("__s"), F.lit(True).alias("__on")), "__s", "left")
    t = out.join(by_hand, "scrip", "left")
    return t.select("scrip", F.when(c("__s").isNotNull(), F.when(c("__on"), c("__s"))).otherwise(F.coalesce("exact", "begun")).alias("symbol"))


def one_recommendation(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[x for x in rows.columns if x not in key]), order).alias("x")).select(*key, "x.*")


def lookup(numbers: DataFrame, register: DataFrame) -> DataFrame:
    """Rows (reg_no, state): whether a number is well formed and on the register: found, missing or malformed."""
    t = numbers.join(register.select("reg_no", F.lit(True).alias("__on")).distinct(), "reg_no", "left")
    state = F.when(~c("reg_no").rlike(r"^IN[HA](\d{9}|IFSC\d{5})$"), "malformed").when(c("__on"), "found").otherwise("missing")
    return t.select("reg_no", state.alias("state"))
