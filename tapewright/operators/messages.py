"""What messages say: promotion cues, claims, registration numbers, result posts, and trade calls."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.plan import settle, written
from ..functions.text import found, normalise, numbers_in
from . import instruments as I
from . import linking

c = F.col


def _has(norm: Column, pattern: str) -> Column:
    """Whether a normalised text, which is ASCII, holds the pattern: Java's own word boundaries are right there, and much cheaper."""
    return norm.rlike(P.led(pattern))


def with_norm(messages: DataFrame) -> DataFrame:
    """Adds norm (what rules read, cut at a divider) and whole; empty and pinned messages are dropped."""
    m = messages.where(F.trim("text") != "").where(~F.substring("text", 1, 80).rlike(" pinned «| pinned a "))
    m = m.withColumn("whole", normalise(c("text")))
    cut = F.expr("regexp_instr(whole, '{}')".format(P.DIVIDER.replace("\\", "\\\\")))
    m = settle(m)
    return settle(m.withColumn("norm", F.when(cut > 21, F.substring(c("whole"), F.lit(1), cut - 1)).otherwise(c("whole"))))


def cues(messages: DataFrame) -> DataFrame:
    """Rows (channel_id, msg_id, kind, match): the first match of each kind in each message."""
    m = messages.where(F.trim("text") != "").select("channel_id", "msg_id", normalise(c("text")).alias("norm"), F.upper("text").alias("upper"))
    # worked out once a row, or each pattern would normalise the text again
    m = settle(m).withColumn("both", F.concat("norm", F.lit("\n"), "upper"))
    # words are sought once where both parts are the same; none of them holds a line break
    m = settle(m.select("channel_id", "msg_id", "both", F.when(c("norm") == c("upper"), c("norm")).otherwise(c("both")).alias("sought"), (F.octet_length("both") == F.length("both")).alias("ascii")))
    # Java's own word boundaries are right in ASCII, and much cheaper than those spelt out
    match = lambda pattern: F.regexp_extract("both", pattern, 0)
    holds = lambda kind: reduce(or_, [c("sought").contains(x) for x in P.PROMO_WORDS[kind]])
    first = lambda kind, pattern: F.when(holds(kind), F.when(c("ascii"), match(P.led(pattern))).otherwise(match(P.bounded(P.led(pattern))))).otherwise("")
    m = settle(m.select("channel_id", "msg_id", F.array(*[F.struct(F.lit(kind).alias("kind"), first(kind, pattern).alias("match")) for kind, pattern in P.PROMO]).alias("all")))
    return m.select("channel_id", "msg_id", F.explode(F.filter("all", lambda x: x.match != "")).alias("x")).select("channel_id", "msg_id", "x.kind", F.left(F.trim("x.match"), F.lit(60)).alias("match"))


def promo_kinds(messages: DataFrame) -> DataFrame:
    """Cues per kind and channel, kinds without any at zero."""
    by = cues(messages).groupBy("channel_id").agg(*[F.count_if(c("kind") == k).alias(k) for k, _ in P.PROMO])
    return messages.select("channel_id").distinct().join(by, "channel_id", "left").select("channel_id", *[F.coalesce(k, F.lit(0)).alias(k.replace("-", "_")) for k, _ in P.PROMO])


def promo_messages(messages: DataFrame) -> DataFrame:
    """Messages with text, and those that sell, per channel."""
    selling = cues(messages).where(c("kind").isin(*P.SELLING)).select("channel_id", "msg_id").distinct()
    text = messages.where(F.trim("text") != "").groupBy("channel_id").agg(F.count("*").alias("text_messages"))
    return text.join(selling.groupBy("channel_id").agg(F.count("*").alias("n")), "channel_id", "left").select("channel_id", "text_messages", F.coalesce("n", F.lit(0)).alias("selling_messages"))


def claims(messages: DataFrame) -> DataFrame:
    """Claimed accuracies from 50 to 100 percent."""
    m = with_norm(messages).withColumn("percent", F.coalesce(found(c("whole"), P.CLAIM_A, 1), found(c("whole"), P.CLAIM_B, 1)).cast("double"))
    return m.where("percent BETWEEN 50 AND 100").select("channel_id", "msg_id", "percent")


def registrations(messages: DataFrame, register: DataFrame | None, channels: DataFrame | None = None) -> DataFrame:
    """Each claimed number once per channel, where it comes first, with its row of the register; no register: on_register is null.

    register: reg_no, kind, name, valid_from, valid_to. channels: channel_id, description, which comes before all messages
    (msg_id null, place description).
    """
    numbers = lambda text: F.explode(F.regexp_extract_all(F.upper(text), F.lit(P.bounded(P.REG_NO)), F.lit(0))).alias("reg_no")
    nums = messages.select("channel_id", "msg_id", numbers("text"))
    if channels is not None:
        nums = nums.unionByName(channels.select("channel_id", F.lit(None).cast(messages.schema["msg_id"].dataType).alias("msg_id"), numbers("description")))
    one = nums.groupBy("channel_id", "reg_no").agg(F.min_by("msg_id", F.coalesce("msg_id", F.lit(-(1 << 62)))).alias("msg_id"), F.bool_or(c("msg_id").isNull()).alias("__d"))
    one = one.withColumn("place", F.when(c("__d"), "description").otherwise("message")).withColumn("msg_id", F.when(~c("__d"), c("msg_id"))).drop("__d")
    one = one.withColumn("type", F.when(c("reg_no").startswith("INH"), "research-analyst").otherwise("investment-adviser"))
    if register is None:
        return one.withColumn("on_register", F.lit(None).cast("boolean"))
    r = register.select("reg_no", c("kind").alias("type"), "name", "valid_from", "valid_to", F.lit(True).alias("__on"))
    return one.join(r, ["reg_no", "type"], "left").withColumn("on_register", c("__on").isNotNull()).drop("__on")


def mentions_without_number(messages: DataFrame) -> DataFrame:
    up = F.upper("text")
    return messages.groupBy("channel_id").agg((F.bool_or(up.rlike(P.REG_WORDS)) & ~F.bool_or(up.rlike(P.bounded(P.REG_NO)))).alias("mentions_without_number"))


def follow_kind(norm: Column) -> Column:
    """stop-hit, then target-hit or profit, then exit; null where none."""
    won = _has(norm, P.RESULT)
    profit = _has(norm, r"\bPROFIT|\bBOOK") & ~_has(norm, r"\b(?:HITS?|DONE|ACHIEVED|ACHIVED|GIVEN)\b")
    return F.when(_has(norm, P.STOPPED), "stop-hit").when(won, F.when(profit, "profit").otherwise("target-hit")).when(_has(norm, P.EXITED), "exit")


# ---- one text of a message -> one call

OPTION_DISTINCT = "size(array_distinct(transform(options, o -> concat(cast(o.g1 AS double), left(o.g2, 1)))))"


def segments(messages: DataFrame) -> DataFrame:
    """Rows (.., part, norm, options, actions): part 0 is the whole message, the others what it may be split into.

    A message is split at every line that names an option contract not named
    before, if there are two; else at blank lines. ``messages`` has norm.
    """
    lines = F.split("norm", "\n")
    contract = lambda x: F.transform(I.spots(x, P.OPTION, 2), lambda o: F.concat(o.g1.cast("double").cast("string"), F.left(o.g2, F.lit(1))))
    named = F.transform(lines, lambda x: F.when(x.rlike(r"\d\s*(?:STRIKE\s*)?(?:CE|PE|CALL|PUT)"), contract(x)).otherwise(F.array().cast("array<string>")))
    m = settle(messages.withColumns({"__l": lines, "__n": named}))
    first = F.filter(F.transform("__n", lambda x, i: F.when(F.size(F.array_except(x, F.flatten(F.slice("__n", 1, i)))) > 0, i)), lambda i: i.isNotNull())
    m = settle(m.withColumn("__s", first))
    upto = lambda k: F.coalesce(F.get("__s", k + 1), F.size("__l"))
    begin = lambda i, k: F.when(k == 0, 0).otherwise(i)
    by_contract = F.transform("__s", lambda i, k: F.array_join(F.slice("__l", begin(i, k) + 1, upto(k) - begin(i, k)), "\n"))
    blocks = F.filter(F.split("norm", r"\n\s*\n"), lambda x: F.trim(x) != "")
    parts = F.when(F.size("__s") > 1, by_contract).otherwise(blocks)
    m = settle(m.withColumn("__p", parts))
    m = m.withColumn("parts", F.when(F.size("__p") > 1, F.concat(F.array("norm"), "__p")).otherwise(F.array("norm")))
    m = m.select(*messages.columns, F.posexplode("parts").alias("part", "__seg")).drop("norm").withColumnRenamed("__seg", "norm")
    return settle(m.withColumns({"options": I.spots(c("norm"), P.OPTION, 2), "actions": I.spots(c("norm"), P.led(P.ACTION))}))


def with_instrument(texts: DataFrame, dictionary: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``named``, null where a text names nothing: symbol, of, via, words, how, strike, opt_type, rest_at, phrase, doubt, notes.

    An option whose index is not named is symbol "?". texts: by, d, norm, options, actions.
    """
    marked = settle(I.with_marks(texts.select(*by, "d", "norm", "options", "actions")))
    x = written(marked.select(*by, "d", F.explode(I.candidates()).alias("x")), "candidates")
    t = texts.join(I.resolve(x, I.completed(dictionary), by), by, "left")
    i, n_options = c("inst"), F.size("options")
    several = F.expr(OPTION_DISTINCT) > 1
    own = i["how"] == "option"
    borrowed = i.isNotNull() & ~own & (n_options > 0) & ~several
    unnamed = i.isNull() & (n_options > 0) & (F.size("actions") > 0) & (F.get("options", F.lit(0))["g1"].cast("double") >= 5000)
    at = F.when(own, i["at"]).when(borrowed | unnamed, 0)
    t = settle(t.withColumns({"__o": F.get("options", at), "__own": own, "__unnamed": unnamed, "__several": several}))
    i, o = c("inst"), c("__o")
    slip = i["mode"] == "underlying"
    notes = F.array_compact(F.array(F.when(slip, F.concat_ws(" ", F.lit("readAs"), i["key"], i["symbol"])), F.when(c("__own") & c("__several"), "firstContract"), F.when(c("__unnamed"), "indexUnnamed")))
    named = F.struct(
        F.when(c("__unnamed"), I.UNNAMED).otherwise(i["symbol"]).alias("symbol"), F.when(c("__unnamed"), "index").otherwise(i["kind"]).alias("of"),
        F.when(c("__unnamed"), "name").otherwise(i["via"]).alias("via"), F.when(c("__unnamed"), 0).otherwise(i["words"]).alias("words"),
        F.when(o.isNotNull(), "option").otherwise(i["how"]).alias("how"), o["g1"].cast("double").alias("strike"),
        F.when(o["g2"].startswith("C"), "CE").when(o.isNotNull(), "PE").alias("opt_type"),
        F.when(o.isNotNull(), o["upto"]).otherwise(i["rest_at"]).alias("rest_at"), F.when(c("__unnamed"), I.around_option(o)).otherwise(I.phrase(i)).alias("phrase"),
        F.when(c("__own") & c("__several"), "low").when(slip | c("__unnamed"), "medium").otherwise("high").alias("doubt"), notes.alias("notes"),
    )
    t = t.withColumn("named", F.when(i.isNotNull() | c("__unnamed"), named))
    return settle(t.drop("inst", "__o", "__own", "__unnamed", "__several"))


def _month(name: Column) -> Column:
    return ((F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.left(name, F.lit(3))) + 2) / 3).cast("int")


def _hint(m: DataFrame) -> DataFrame:
    """Adds hint_day and hint_month: the expiry that the text gives, of options and futures. Nothing else is searched for one."""
    phrase, n = c("named.phrase"), c("norm")
    has = c("kind") != "equity"
    either = lambda p, g: F.coalesce(found(phrase, p, g), found(n, p, g))
    said = {
        "__dd": either(P.DAY_MONTH, 1).cast("int"), "__dm": either(P.DAY_MONTH, 2),
        "__md": found(phrase, P.MONTH_DAY, 2).cast("int"), "__mm": found(phrase, P.MONTH_DAY, 1), "__mt": found(phrase, P.MONTH_DAY, 0),
        "__mo": F.coalesce(found(phrase, P.MONTH_ONLY[0], 1), found(n, P.MONTH_ONLY[1], 1), found(n, P.MONTH_ONLY[2], 1)),
    }
    m = settle(m.withColumns({k: F.when(has, x) for k, x in said.items()}))
    # a month and two digits written together are a month and a year
    year = c("__mt").rlike(r"[A-Z]\d") & c("__md").between(24, 29)
    first = c("__dd").between(1, 31)
    second = c("__md").between(1, 31) & ~c("__md").cast("double").eqNullSafe(c("named.strike")) & ~year
    day = F.when(first, c("__dd")).when(second, c("__md"))
    month = F.when(first, c("__dm")).when(second, c("__mm")).when(c("__mo") != "MAY", c("__mo"))
    return m.withColumns({"hint_day": F.when(has, day), "hint_month": F.when(has, _month(month))}).drop("__dd", "__dm", "__md", "__mm", "__mt", "__mo")


def _entry(m: DataFrame) -> DataFrame:
    """Adds entry, read from front: above, below, at or range, cmp, then a bare number."""
    front = c("front")
    num = lambda ps: F.coalesce(*[found(front, p, 1).cast("double") for p in ps])
    pair = lambda f: F.when(found(front, f, 1).isNotNull(), F.struct(found(front, f, 1).alias("x"), found(front, f, 2).alias("y")))
    m = settle(m.withColumns({"__above": num(P.ENTRY_ABOVE), "__below": num(P.ENTRY_BELOW)}))
    m = settle(m.withColumn("__pair", F.when(c("__above").isNull() & c("__below").isNull(), F.coalesce(*map(pair, P.ENTRY_AT)))))
    raw_x, raw_y = c("__pair.x"), c("__pair.y")
    whole = F.substring_index(raw_x, ".", 1)
    m = m.withColumns({"__x": raw_x.cast("double"), "__full": F.concat(F.left(whole, F.length(whole) - F.length(raw_y)), raw_y).cast("double"), "__short": F.length(raw_y) < F.length(whole)})
    x, full = c("__x"), c("__full")  # 130-40 means 130-140
    m = settle(m.withColumn("__y", F.when((raw_y.cast("double") < x) & c("__short") & (full > x) & (full <= x * 1.35), full).otherwise(raw_y.cast("double"))))
    lo, hi = F.least("__x", "__y"), F.greatest("__x", "__y")
    ranged = c("__y").isNotNull() & (c("__x") != c("__y")) & (hi <= lo * 1.35)
    kind = F.when(c("__above").isNotNull(), "above").when(c("__below").isNotNull(), "below").when(c("__x").isNull(), "none").when(ranged, "range").otherwise("at")
    low = F.coalesce("__above", "__below", F.when(ranged, lo).otherwise(c("__x")))
    entry = F.struct(kind.alias("type"), low.alias("lo"), F.when(kind == "range", hi).alias("hi"))
    return m.withColumn("entry", entry).drop("__above", "__below", "__pair", "__x", "__y", "__full", "__short")


def read_levels(texts: DataFrame) -> DataFrame:
    """Adds what a text says of its instrument ``named``: kind, side, horizon, expiry hint, entry, ref, targets, stop, stop_zero, has_action, levels."""
    n, i = c("norm"), c("named")
    m = texts.withColumns({"has_action": F.size("actions") > 0 if "actions" in texts.columns else _has(n, P.ACTION), "rest": F.substring(n, i["rest_at"], F.length(n))})
    m = settle(m.withColumn("soft", c("has_action") | i["strike"].isNotNull() | _has(n, P.TRADE_HEAD)))
    by_soft = lambda f: F.when(c("soft"), f(True)).otherwise(f(False))
    m = settle(m.withColumn("__at", by_soft(lambda soft: F.regexp_instr("rest", F.lit(P.level_start(soft))))))
    at = c("__at")
    head = F.left(n, i["rest_at"] - 1 + F.when(at > 0, at - 1).otherwise(F.least(F.length("rest"), F.lit(80))))
    m = settle(m.withColumns({"front": F.when(at > 0, F.left("rest", at - 1)).otherwise(c("rest")), "head": head}))
    head = c("head")
    future = _has(head, r"\bFUT\b|\bFUTURES?\b") & ~_has(head, r"\bCASH\b")
    stbt = _has(head, P.STBT)
    short = (_has(head, P.SHORT_SIDE) & ~_has(head, r"\b(?:BUY|BOUGHT|LONG)\b")) | stbt
    m = m.withColumns({
        "says_future": future,
        "kind": F.when(i["strike"].isNotNull(), "option").when(future | (i["of"] == "index"), "future").otherwise("equity"),
        "side": F.when(short, "short").otherwise("long"),
        "horizon": F.when(stbt | _has(n, P.BTST), "btst").when(_has(n, P.INTRADAY), "intraday").when(_has(n, P.POSITIONAL), "positional").when(_has(n, P.SWING), "swing").otherwise("unspecified"),
    })
    m = settle(_entry(_hint(settle(m))))
    m = m.withColumns({"ref": F.when(c("entry.type") == "range", (c("entry.lo") + c("entry.hi")) / 2).otherwise(c("entry.lo")), "way": F.when(c("side") == "long", 1).otherwise(-1)})
    lists = by_soft(lambda soft: F.arrays_zip(*[F.regexp_extract_all("rest", F.lit(P.target_level(soft)), F.lit(g)).alias(f"p{g}") for g in (1, 2)]))
    stop = by_soft(lambda soft: F.struct(found(c("rest"), P.stop_level(soft), 1).cast("double").alias("n"), F.regexp_extract("rest", P.stop_level(soft), 2).alias("away")))
    m = settle(m.withColumns({"__lists": lists, "__stop": stop}))
    to = found(c("front"), P.TARGETS_AFTER_TO, 1)

    def level(x: Column, away: Column, way: Column) -> Column:  # a price as it is, points or percent from the entry
        moved = F.when(away.contains("%"), c("ref") * (1 + way * x / 100)).otherwise(c("ref") + way * x)
        return F.when(F.coalesce(away, F.lit("")) == "", x).otherwise(F.floor(moved * 100 + 0.5) / 100)

    said = F.flatten(F.transform("__lists", lambda g: F.transform(numbers_in(g.p1), lambda x: level(x, g.p2, c("way")))))
    said = F.filter(said, lambda x: x.isNotNull())
    m = settle(m.withColumns({"__said": said, "__s": level(c("__stop.n"), c("__stop.away"), -c("way"))}))
    targets = F.when((F.size("__said") == 0) & c("entry.lo").isNotNull() & to.isNotNull(), numbers_in(to)).otherwise(c("__said"))
    m = settle(m.withColumn("__t", F.array_distinct(F.filter(targets, lambda x: (x > 0) & ~x.eqNullSafe(i["strike"])))))
    m = m.withColumns({
        "targets": F.when(c("side") == "long", F.array_sort("__t")).otherwise(F.reverse(F.array_sort("__t"))),
        "stop": F.nullif("__s", F.lit(0.0)), "stop_zero": F.coalesce(c("__s") == 0, F.lit(False)),
        "levels": (F.size("__t") > 0) | F.coalesce(c("__s") != 0, F.lit(False)),
    })
    return settle(m.drop("rest", "front", "head", "soft", "__at", "__lists", "__stop", "__said", "__s", "__t"))


def _is_call() -> Column:
    """Whether what was read is a call: enough levels for the way in which the instrument was named."""
    entry, levels, act, kind, how = c("entry.type") != "none", c("levels"), c("has_action"), c("kind"), c("named.how")
    index_future = (kind == "future") & (c("named.of") == "index")
    both = entry & levels
    return (
        (entry | levels | ((kind == "option") & act))
        & ((kind != "equity") | act | both)
        & (~index_future | ((how == "action") & (levels | (c("says_future") & entry))))
        & ((kind == "option") | ~how.isin("tag", "scan") | both)
        & ((kind == "option") | (F.length("norm") <= 600))
        & (~index_future | ~entry | (c("ref") >= 1000))
    )


def _notes_and_confidence(m: DataFrame) -> DataFrame:
    """Adds notes and confidence: every note lowers it, to low where a level is on the wrong side."""
    entry = c("entry.type") != "none"
    wrong_target = F.coalesce(c("way") * (F.get("targets", F.lit(0)) - c("ref")) <= 0, F.lit(False))
    wrong_stop = F.coalesce(c("way") * (c("ref") - c("stop")) <= 0, F.lit(False))
    part = (c("named.via") == "name") & (c("named.words") == 1)
    no_action = ~c("has_action") & (c("kind") != "option")
    told = ((part, "partName"), (c("stop_zero"), "stopZero"), (no_action, "noAction"), (~entry, "noEntry"), (~c("levels"), "noLevels"), (wrong_target, "targetWrongSide"), (wrong_stop, "stopWrongSide"))
    notes = F.concat("named.notes", F.array_compact(F.array(*[F.when(x, k) for x, k in told])))
    low = (c("named.doubt") == "low") | wrong_target | wrong_stop
    medium = (c("named.doubt") == "medium") | part | no_action | ~entry | ~c("levels")
    return m.withColumns({"notes": notes, "confidence": F.when(low, "low").when(medium, "medium").otherwise("high")})


KEY = ["channel_id", "msg_id"]


def _prepared(messages: DataFrame) -> DataFrame:
    m = with_norm(messages)
    have = {"d": F.lit(None).cast("int"), "reply_to": F.lit(None).cast("long"), "edited": F.lit(False)}
    return m.withColumns({k: v for k, v in have.items() if k not in m.columns})


def _results(m: DataFrame) -> DataFrame:
    """Adds has_stop, has_target, has_act, follow (the kind of result post, null where none) and quoted."""
    n = c("norm")
    m = settle(m.withColumns({"has_stop": _has(n, P.STOP_LEVEL), "has_target": _has(n, P.TARGET_LEVEL), "has_act": _has(n, P.ACTION), "__a": found(n, P.MOVE, 1).cast("double"), "__b": found(n, P.MOVE, 2).cast("double"), "__r": found(n, P.RUNNING, 1).cast("double"), "__k": follow_kind(n)}))
    bare = ~c("has_stop") & ~c("has_target") & ~c("has_act")
    running = F.when(bare, c("__r"))
    kind = F.coalesce(c("__k"), F.when(bare & (F.abs(c("__b") / c("__a") - 1) >= 0.025), "profit"), F.when(running.isNotNull(), "profit"))
    kind = F.when(~c("has_stop") | _has(n, P.LEADING_STATUS), kind)
    return settle(m.withColumns({"follow": kind, "quoted": F.coalesce("__b", running)}).drop("__a", "__b", "__r", "__k"))


def follow_ups(messages: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Result posts: kind, claims_target and quoted price; with a dictionary also the instrument that they name (symbol, strike, opt_type)."""
    m = _results(_prepared(messages)).where(c("follow").isNotNull())
    told = [c("follow").alias("kind"), ((c("follow") == "target-hit") & ~_has(c("norm"), P.ALMOST)).alias("claims_target"), "quoted"]
    if dictionary is None:
        return m.select(*KEY, *told)
    text = c("norm")
    for p in (P.RESULT, P.STOPPED, P.RUNNING):  # what tells the result is no part of a name; each is taken out once
        hit = F.regexp_instr(text, F.lit(p))
        text = F.when(hit > 0, F.concat(F.left(text, hit - 1), F.lit(" "), F.substring(text, hit + F.length(F.regexp_extract(text, p, 0)), F.length(text)))).otherwise(text)
        m = settle(m.withColumn("__text", text))
        text = c("__text")
    t = m.select(*KEY, "d", c("__text").alias("norm"))
    t = with_instrument(settle(t.withColumns({"options": I.spots(c("norm"), P.OPTION, 2), "actions": I.spots(c("norm"), P.led(P.ACTION))})), dictionary, KEY)
    return m.join(t.select(*KEY, "named"), KEY).select(*KEY, *told, "named.symbol", "named.strike", "named.opt_type")


def _drafts(m: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that each message's texts give before reposts are told (several if two parts or more are calls), and what each whole message names."""
    texts = written(segments(m), "segments")
    texts = written(with_instrument(texts, dictionary, [*KEY, "part"]), "named")
    own = _notes_and_confidence(read_levels(texts.where(c("named").isNotNull()))).where(_is_call())
    n = F.count_if(c("part") > 0).over(W.partitionBy(*KEY))
    own = own.withColumn("__n", n).where(F.when(c("__n") > 1, c("part") > 0).otherwise(c("part") == 0)).drop("__n")
    return own, texts.where("part = 0").select(*KEY, "named")


def read_calls(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Trade calls of messages: instrument, side, horizon, expiry hint, entry, targets, stop, confidence, notes.

    dictionary: ``instruments.dictionary``, or just key, symbol, kind. messages
    may have d (the trading day, for names that moved), reply_to and edited. A
    message gives one call, or one per part if two or more of its parts are
    calls; pos counts them and call_id is msg_id or msg_id.pos. Levels without
    a name take the instrument of the message replied to, or of the one before
    within 15 minutes. Result posts are no calls.
    """
    m = written(_results(_prepared(messages)), "messages")
    plain = m.where(c("follow").isNull())
    own, named = _drafts(plain, dictionary)
    # levels without a name: inherited over one hop; "before" is the message before of any kind
    every = m.select(*KEY, "ts", "reply_to").join(named, KEY, "left")
    bare = plain.where(c("has_stop") | c("has_target")).join(linking.inherit(every).where(c("named").isNull() & c("source").isNotNull()).select(*KEY, "source"), KEY)
    source = c("source").withField("rest_at", F.lit(1)).withField("doubt", F.lit("medium")).withField("notes", F.array(F.lit("fromEarlier")))
    bare = _notes_and_confidence(read_levels(bare.withColumns({"named": source, "part": F.lit(0)}).drop("source"))).where(_is_call())
    out = own.drop("options", "actions").unionByName(bare.select(*[x for x in own.columns if x not in ("options", "actions")]))
    w = W.partitionBy(*KEY)
    out = out.withColumns({"pos": F.row_number().over(w.orderBy("part")), "__n": F.count("*").over(w)})
    call_id = F.when(c("__n") > 1, F.concat_ws(".", c("msg_id").cast("string"), c("pos").cast("string"))).otherwise(c("msg_id").cast("string"))
    notes = F.when(c("edited"), F.concat("notes", F.array(F.lit("edited")))).otherwise(c("notes"))
    return out.select(
        "channel_id", "msg_id", call_id.alias("call_id"), "pos", "ts", "named.symbol", "kind", "named.strike", "named.opt_type", "side", "horizon",
        "hint_day", "hint_month", "entry", "targets", "stop", "confidence", notes.alias("notes"), "named.how",
    )


def without_reposts(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls less those posted again word for word within 18 hours of the last one kept, and the number dropped per channel."""
    said = F.to_json(F.struct("symbol", "strike", "opt_type", "side", "entry.lo", "entry.hi", "stop", "targets"))
    k = linking.reposts(calls.withColumn("__said", said), ["__said"]).drop("__said")
    return k.where("NOT repost").drop("repost"), k.where("repost").groupBy("channel_id").agg(F.count("*").alias("reposts"))


def unread(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pictures without text, and texts that look like calls but give none."""
    image = messages.where((F.trim(F.coalesce("text", F.lit(""))) == "") & c("has_photo")).select(*KEY, F.lit("image-only").alias("why"))
    m = written(_results(_prepared(messages)).where(c("follow").isNull()), "unread")
    looks = (F.length("norm") <= 600) & ((c("has_stop") & c("has_act")) | (_has(c("norm"), P.OPTION) & (c("has_stop") | c("has_target") | c("has_act"))))
    rest = m.where(looks).select(*KEY).join(read_calls(messages, dictionary), KEY, "left_anti")
    return image.unionByName(rest.select(*KEY, F.lit("no-instrument").alias("why")))


def tape(messages: DataFrame, calls: DataFrame, posts: DataFrame) -> DataFrame:
    """Each message's class: call, loss, profit, selling, picture, other, the first that holds.

    A result post of any kind but a stopped one counts as profit, and so does boasting of profits or certainty.
    """
    said = cues(messages).groupBy(*KEY).agg(F.bool_or(c("kind").isin(*P.SELLING)).alias("sell"), F.bool_or(~c("kind").isin(*P.SELLING)).alias("boast"))
    k = calls.select(*KEY).distinct().withColumn("is_call", F.lit(True))
    p = posts.groupBy(*KEY).agg(F.bool_or(c("kind") == "stop-hit").alias("loss"), F.lit(True).alias("result"))
    t = messages.join(k, KEY, "left").join(p, KEY, "left").join(said, KEY, "left")
    cls = F.when(c("is_call"), "call").when(c("loss"), "loss").when(c("result") | c("boast"), "profit").when(c("sell"), "selling").when(F.trim("text") == "", "picture").otherwise("other")
    return t.select(*KEY, cls.alias("cls"))


def quiet(tape_rows: DataFrame, most: int = 2) -> DataFrame:
    """At most two messages in a row that are no calls: gaps and islands."""
    w = W.partitionBy("channel_id").orderBy("msg_id")
    t = tape_rows.withColumn("island", F.sum((c("cls") == "call").cast("int")).over(w))
    t = t.withColumn("place", F.row_number().over(W.partitionBy("channel_id", "island", c("cls") == "call").orderBy("msg_id")))
    return t.where((c("cls") == "call") | (c("place") <= most)).drop("island", "place")
