"""Which instrument a text names: a dictionary of names, candidate names with their place, and the joins between them.

Nothing here walks a text name by name. Every place where a name may stand
gives candidate keys with a priority (behind an option's strike, after a label,
beside an action word, a tag, the first words); all candidates of all texts
meet the dictionary in one equi join, misspelt ones in a join on what is left
of a name when letters are deleted, and the least priority that was found wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import patterns as P
from ..functions.plan import settle, written
from ..functions.text import squash

c = F.col
UNNAMED = "?"
#: Name sources in the order they count.
RANK = {"ticker": 0, "alias": 1, "name": 2}
#: Names of fewer letters are not sought with slips: in a dictionary, and among underlyings.
LONG, SHORT = 8, 5
#: Tasks that names are dealt to before letters are deleted, at most: a name is a few bytes, what is left of it many rows.
DEALT = 48
DICTIONARY = "key string, symbol string, kind string, via string, rank int, first_d int, last_d int, seq int, long boolean, in_fo boolean"


def dictionary(spark: SparkSession, symbols: DataFrame, underlyings: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows (key, symbol, kind, via, rank, first_d, last_d, seq, long, in_fo): every spelling and what it may mean.

    symbols: symbol, name, first_d, last_d (its first and last trading day).
    underlyings: symbol, kind (index or stock). aliases: alias, symbol; the
    built-in list if none is given. A company's name gives three keys: all its
    words without noise words and, of more than two, the first two; and its
    first word of five letters or more. Such a key counts only if it points at
    one company, and no ticker or alias has it.
    """
    made = lambda mapping, cols: spark.createDataFrame(list(mapping.items()), cols)
    aliases = made(N.STOCK_ALIASES, "alias string, symbol string") if aliases is None else aliases
    fo = underlyings.select("symbol", c("kind").alias("fo_kind")).dropDuplicates(["symbol"])
    info = symbols.select("symbol", "name", c("first_d").cast("int").alias("first_d"), c("last_d").cast("int").alias("last_d")).dropDuplicates(["symbol"])
    known = info.join(fo, "symbol", "full")
    ticker = known.select(squash(c("symbol")).alias("key"), "symbol", F.lit("ticker").alias("via"))
    alias = aliases.join(info.select("symbol"), "symbol").select(squash(c("alias")).alias("key"), "symbol", F.lit("alias").alias("via"))
    taken = ticker.unionByName(alias)

    w = F.filter(F.split(F.regexp_replace(F.upper("name"), r"\(.*?\)", " "), "[^A-Z0-9&]+"), lambda x: (x != "") & ~x.isin(*N.words(N.NAME_NOISE)))
    company = known.where(c("name").isNotNull() & ~F.upper("name").rlike(P.bounded(N.FUND))).withColumn("w", w).where(F.size("w") > 0)
    full = company.withColumn("key", F.explode(F.array_distinct(F.array(F.array_join("w", ""), F.when(F.size("w") > 2, F.array_join(F.slice("w", 1, 2), "")).otherwise(F.array_join("w", ""))))))
    one = full.groupBy("key").agg(F.collect_set(F.struct("symbol", (c("fo_kind").isNotNull()).alias("fo"))).alias("all"), F.count_distinct("name").alias("names"))
    n_fo = F.size(F.filter("all", lambda x: x.fo))
    one = one.where((F.size("all") == 1) | (c("names") == 1) | (n_fo == 1)).select("key", F.explode(F.when((F.size("all") > 1) & (n_fo > 0), F.filter("all", lambda x: x.fo)).otherwise(c("all"))).alias("x"))
    full = one.select("key", "x.symbol", F.lit("name").alias("via")).join(taken.select("key").distinct(), "key", "left_anti")
    first = company.where(F.length(c("w")[0]) >= 5).groupBy(c("w")[0].alias("key")).agg(F.count("*").alias("n"), F.first("symbol").alias("symbol")).where("n = 1")
    first = first.select("key", "symbol", F.lit("name").alias("via")).join(taken.unionByName(full).select("key").distinct(), "key", "left_anti")

    keys = taken.withColumn("long", (c("via") == "ticker") & (F.length("symbol") >= LONG)).unionByName(full.withColumn("long", F.length("key") >= LONG)).unionByName(first.withColumn("long", F.lit(False)))
    keys = keys.where(F.length("key") >= 2).withColumn("rank", F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[c("via")])
    keys = keys.groupBy("key", "symbol").agg(F.min_by("via", "rank").alias("via"), F.min("rank").alias("rank"), F.bool_or("long").alias("long"))
    span = known.select("symbol", "first_d", "last_d", "fo_kind")
    later = made(N.SUCCESSORS, "symbol string, next string")
    out = keys.join(span, "symbol").withColumn("seq", c("rank"))
    moved = keys.join(later, "symbol").join(span.select(c("symbol").alias("next"), "first_d", "last_d", "fo_kind"), "next").drop("symbol").withColumnRenamed("next", "symbol")
    out = out.unionByName(moved.withColumns({"via": F.lit("alias"), "seq": F.lit(9), "long": F.lit(False)}))
    out = out.select("key", "symbol", F.when(c("fo_kind") == "index", "index").otherwise("stock").alias("kind"), "via", "rank", "first_d", "last_d", "seq", "long", c("fo_kind").isNotNull().alias("in_fo"))
    index = made(N.INDEX_ALIASES, "key string, symbol string").join(fo, "symbol", "left")
    index = index.select("key", "symbol", F.lit("index").alias("kind"), F.when(c("key") == c("symbol"), "ticker").otherwise("alias").alias("via"), F.lit(-1).alias("rank"), F.lit(None).cast("int").alias("first_d"), F.lit(None).cast("int").alias("last_d"), F.lit(-1).alias("seq"), F.lit(False).alias("long"), c("fo_kind").isNotNull().alias("in_fo"))
    return out.unionByName(index)


def completed(names: DataFrame) -> DataFrame:
    """A dictionary of fewer columns (key, symbol, kind) with the others at their defaults: tickers, traded always."""
    default = {"via": F.lit("ticker"), "rank": F.lit(0), "first_d": F.lit(None).cast("int"), "last_d": F.lit(None).cast("int"), "seq": F.lit(0), "long": F.length("key") >= LONG, "in_fo": F.lit(True)}
    return names.select("key", "symbol", "kind", *[c(k) if k in names.columns else v.alias(k) for k, v in default.items()])


# ---- misspelt names
_OF_WORD, _OF_TARGET = [("__r", *(f"__{side}_{k}" for k in ("n", "first", "second", "a", "b"))) for side in ("word", "target")]


def _remains(df: DataFrame, word: str, two: Column, to: tuple[str, ...]) -> DataFrame:
    """A row for every way to delete one letter of a word or none, and two where ``two`` holds: adds, under the names ``to``, what is
    left, how many are deleted, their places from 0 (the word's length stands for none), and their letters."""
    rest, n, first, second, a, b = to
    x, size = c(word), F.length(word)
    places = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(i.alias("i"), F.when(two & (i < size), F.sequence(i + 1, size)).otherwise(F.array(size)).alias("js")))
    out = df.select("*", F.explode(places).alias("__p")).select("*", c("__p.i").alias(first), F.explode("__p.js").alias(second)).drop("__p")
    i, j = c(first), c(second)
    left = F.concat(F.left(x, i), F.substring(x, i + 2, j - i - 1), F.substring(x, j + 2, size))
    letter = lambda at: F.ascii(F.substring(x, at + 1, F.lit(1)))  # noqa: E731  its code point
    return out.withColumns({rest: left, n: (i < size).cast("int") + (j < size).cast("int"), a: letter(i), b: letter(j)})


def _near_enough() -> Column:
    """Whether a word and a target that leave the same are ``most`` edits apart by these deletions.

    A deletion on one side alone is an edit. One on either side are one edit together if they stand for one another: at one place, a
    letter for another; or as a swap, with the word's first letter of two deleted and the target's second, which are the same.
    Edits do not overlap: nothing deleted stands between the two letters of a swap.
    """
    n, i1, i2, a1, a2 = map(c, _OF_WORD[1:])
    m, j1, j2, b1, b2 = map(c, _OF_TARGET[1:])
    yes = F.lit(True)
    pair = lambda i, j, a, b, free: (i == j) | ((i + 1 == j) & (a == b) & free)  # noqa: E731  places among what is left
    other = lambda i, j, a, b: (i != j) | (a != b)  # noqa: E731  a letter for itself is no edit: such words meet with fewer deletions
    word_free, target_free = i2 != i1 + 1, j1 != j2 - 1
    one_two = pair(i1, j1, a1, b1, yes) | pair(i1, j2 - 1, a1, b2, target_free)
    two_one = pair(i1, j1, a1, b1, word_free) | pair(i2 - 1, j1, a2, b1, yes)
    two_two = pair(i1, j1, a1, b1, word_free) & other(i1, j1, a1, b1) & pair(i2, j2, a2, b2, target_free) & other(i2, j2, a2, b2)
    many = F.when((n == 2) & (m == 2), two_two).when(n == 1, one_two).otherwise(two_one)
    return F.when(n + m <= c("most"), True).when((n == 1) & (m == 1), pair(i1, j1, a1, b1, yes)).when(c("most") < 2, False).otherwise(many)


def within_edits(asked: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (word, target) of ``asked(word, most)`` and ``targets(target)`` at most ``most`` (1 or 2) edits apart, a swap being one.

    An equi join on what is left when letters are deleted, which the places and letters of the deletions verify; never all against all.
    Few bytes of names leave many rows: they are dealt over the shuffle's partitions, as sizes would leave them in one task, and never broadcast.
    """
    spark = asked.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by the name itself the deal would be left out behind a distinct; each task of it writes for all parts of the join
    dealt = lambda df, of: df.repartition(min(parts, DEALT), F.hash(of))
    a = _remains(dealt(asked.select("word", "most"), "word"), "word", c("most") > 1, _OF_WORD)
    b = _remains(dealt(targets.select("target"), "target"), "target", F.lit(True), _OF_TARGET)
    met = a.repartition(parts, "__r").join(b.repartition(parts, "__r").hint("merge"), "__r").where(_near_enough())
    return met.select("word", "target").distinct()


def near_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (word, symbol, kind) for those of ``asked(word)`` of LONG letters or more that are a slip away from, or the
    beginning of, long keys of one symbol alone. Twelve letters or more may slip twice; beginnings count only without slips."""
    w = asked.where(F.length("word") >= LONG).select("word", F.when(F.length("word") >= 12, 2).otherwise(1).alias("most")).distinct()
    long = names.where("long").select(c("key").alias("target"), "symbol").distinct()
    slip = within_edits(w, long.select("target").distinct())
    heads = long.select("target", F.explode(F.transform(F.sequence(F.lit(LONG), F.greatest(F.lit(LONG), F.length("target"))), lambda n: F.left("target", n))).alias("word"))
    clipped = w.join(slip.select("word").distinct(), "word", "left_anti").join(heads, "word").select("word", "target")
    hit = slip.unionByName(clipped).join(names.select(c("key").alias("target"), "symbol").distinct(), "target")
    return hit.groupBy("word").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").select("word", "symbol", F.lit("stock").alias("kind"))


def near_underlyings(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (word, symbol, kind) for words of five letters or more that one underlying's ticker alone is an edit away from (nine or more: two).

    A word without such a ticker is asked again without its last S.
    """
    fo = names.where(c("in_fo") & (c("via") == "ticker")).select("symbol", "kind", squash(c("symbol")).alias("target")).dropDuplicates(["symbol"])
    w = asked.where(F.length("word") >= SHORT).select("word", F.when(F.length("word") >= 9, 2).otherwise(1).alias("most")).distinct()
    whole = within_edits(w, fo.select("target").distinct())
    rest = w.join(whole.select("word").distinct(), "word", "left_anti").where(c("word").endswith("S"))
    cut = rest.select(c("word").alias("full"), F.expr("left(word, length(word) - 1)").alias("word"), "most")
    again = within_edits(cut.select("word", "most"), fo.select("target").distinct()).join(cut.select("full", "word"), "word").select(c("full").alias("word"), "target")
    hit = whole.unionByName(again).join(fo, "target")
    return hit.groupBy("word").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol"), F.min("kind").alias("kind")).where("n = 1").drop("n")


# ---- where names may stand

TOKEN = r"(?:[A-Z&][A-Z0-9&]*|\d+[A-Z][A-Z0-9&]*)(?:-[A-Z]+)?"
DATE_TOKEN = rf"^\d{{1,2}}(?:ST|ND|RD|TH)?(?:{P.MONTH[1:-1]})?\d{{0,4}}$"
LABEL = r"\b(?:STOCK|SCRIPT?|SCRIP|SYMBOL)\s*(?:NAME)?\s*[:=]\s*([^\n]+)"
TAG = r"[#$]([A-Z&0-9][A-Z0-9&-]+)"


def tokens(x: Column) -> Column:
    return F.filter(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(DATE_TOKEN))


def _filler(t: Column) -> Column:
    return t.isin(*N.words(N.FILLER))  # a lookup in a set


def _key(words: Column) -> Column:
    """Tokens as a key: of what ``squash`` takes out they can have hyphens only."""
    return F.replace(F.array_join(words, ""), F.lit("-"), F.lit(""))


def _bound(x: Column, f) -> Column:
    """f(x), an array, with x worked out once: the lambda's variable stands for it."""
    return F.flatten(F.transform(F.array(x), f))


def spots(x: Column, pattern: str, groups: int = 0) -> Column:
    """All matches of a pattern in a normalised text: array of (at, upto, g1, ..): first place, the place behind, and groups."""
    # each match goes on where the last one ended; without \G a text's rest without a match would be tried from each of its places
    lead = F.lit(rf"\G(?s)(.*?)(?:{pattern})")
    got = F.arrays_zip(*[F.regexp_extract_all(x, lead, F.lit(i)).alias(f"p{i}") for i in range(groups + 2)])

    def placed(every: Column) -> Column:
        end = lambda i: F.aggregate(F.slice(every, 1, i + 1), F.lit(1), lambda n, m: n + F.length(m.p0))
        return F.transform(every, lambda m, i: F.struct((end(i) - F.length(m.p0) + F.length(m.p1)).alias("at"), end(i).alias("upto"), *[m[f"p{g + 1}"].alias(f"g{g}") for g in range(1, groups + 1)]))

    none = F.array().cast("array<struct<at: int, upto: int" + "".join(f", g{g}: string" for g in range(1, groups + 1)) + ">>")
    return F.when(x.rlike(pattern), _bound(got, placed)).otherwise(none)  # most texts have none, which one search tells


def _candidate(prio, key: Column, n, mode: str, how: str, rest: Column, at) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(prio).cast("int").alias("prio"), key.alias("key"), lit(n).cast("int").alias("n"), F.lit(mode).alias("mode"), F.lit(how).alias("how"), rest.cast("int").alias("rest_at"), lit(at).cast("int").alias("at"))


def _ending(words: Column, prio, how: str, rest: Column, at) -> Column:
    """Names of three words down to one that end the words; first as they stand, then without filler words, if there are any."""

    def of(t: Column, i: Column) -> Column:
        tail = lambda n: F.slice(t, F.size(t) - n + 1, n)
        key = lambda n: F.when(F.size(t) >= n, _key(tail(n)))
        return F.when(F.size(t) > 0, F.array(*[_candidate(prio + i * 3 + 3 - n, F.when(~_filler(F.try_element_at(t, F.lit(-1))), key(1)) if n == 1 else key(n), n, "exact", how, rest, at) for n in (3, 2, 1)])).otherwise(_none())

    less = lambda w: _bound(F.filter(w, lambda t: ~_filler(t)), lambda f: F.when(F.size(f) < F.size(w), F.array(w, f)).otherwise(F.array(w)))
    return _bound(words, lambda w: F.flatten(F.transform(less(w), of)))


def _starting(words: Column, prio, how: str, rest: Column, at, modes: tuple) -> Column:
    """Names of three words down to one that start the words behind leading filler words."""

    def of(t: Column) -> Column:
        key = lambda n: F.when(F.size(t) >= n, _key(F.slice(t, 1, n)))
        return F.when(F.size(t) > 0, F.array(*[_candidate(prio + 3 * k + 3 - n, key(n), n, mode, how, rest, at) for k, mode in enumerate(modes) for n in (3, 2, 1)])).otherwise(_none())

    def behind(w: Column) -> Column:
        first = F.array_position(F.transform(w, lambda t: ~_filler(t)), F.lit(True)).cast("int")
        return F.when(first > 0, F.slice(w, F.greatest(first, F.lit(1)), 3)).otherwise(F.array().cast("array<string>"))

    return _bound(words, lambda w: _bound(behind(w), of))


def with_marks(texts: DataFrame) -> DataFrame:
    """Adds what candidates are read from beside options and actions: label, tag and the first line, with their places."""
    norm = c("norm")
    t = settle(texts.withColumns({"label_at": F.regexp_instr(norm, F.lit(LABEL)), "tag_at": F.regexp_instr(norm, F.lit(TAG))}))
    at = lambda place, pattern, group: F.when(c(place) > 0, F.regexp_extract(norm, pattern, group)).otherwise("")
    return t.withColumns({"label": at("label_at", LABEL, 0), "labelled": at("label_at", LABEL, 1), "tag": at("tag_at", TAG, 0), "first_line": first_line()})


def first_line() -> Column:
    return F.substring_index(F.regexp_replace("norm", r"^\s+|\s+$", ""), "\n", 1)


def _between(a, b) -> Column:
    return F.substring("norm", a, F.greatest(b - a, F.lit(0)))


def _one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def around_option(o: Column) -> Column:
    return _between(_one(o["at"] - 40), o["upto"] + 22)


def phrase(i: Column) -> Column:
    """The words about a candidate, in which hints of it are sought: worked out of what counted alone, not of every candidate."""
    option, action = F.get("options", i["at"]), F.get("actions", i["at"])
    how = lambda x: i["how"] == x
    other = F.when(how("label"), F.regexp_extract("norm", LABEL, 0)).when(how("tag"), F.regexp_extract("norm", TAG, 0)).when(how("scan"), first_line())
    return F.when(how("option"), around_option(option)).when(how("action"), _between(_one(action["at"] - 40), action["at"] + 60)).otherwise(other)


def candidates() -> Column:
    """All candidate names of a text that can mean something: (prio, key, n, mode, how, rest_at, at), prio in the order in
    which they count, at the number of the option or action beside which they stand.

    Reads norm, options, actions and the columns of ``with_marks``.
    """
    norm = c("norm")

    def at_option(o: Column, i: Column) -> Column:
        last = lambda w: F.try_element_at(F.filter(w, lambda t: ~_filler(t)), F.lit(-1))
        return _bound(
            _between(_one(o["at"] - 60), o["at"]),
            lambda before: F.concat(
                _bound(tokens(F.substring_index(before, "\n", -1)), lambda w: F.concat(_ending(w, i * 100, "option", o["upto"], i), F.array(_candidate(i * 100 + 20, squash(last(w)), 1, "underlying", "option", o["upto"], i)))),
                _ending(tokens(before), i * 100 + 10, "option", o["upto"], i),
            ),
        )

    def at_action(a: Column, i: Column) -> Column:
        base, rest = i * 100 + 2_000_000, a["upto"]
        after = F.substring_index(F.substring(norm, a["upto"], F.length(norm)), "\n", 1)
        before = F.substring_index(_between(F.lit(1), a["at"]), "\n", -1)
        above = lambda b: F.substring_index(F.rtrim(_between(F.lit(1), a["at"] - F.length(b)), F.lit(" \t\n\x0b\f\r")), "\n", -1)
        return F.concat(
            _starting(tokens(after), base, "action", rest, i, ("exact", "near")),
            _bound(before, lambda b: F.concat(_ending(tokens(b), base + 10, "action", rest, i), _starting(tokens(above(b)), base + 20, "action", rest, i, ("exact", "near")))),
        )

    def scan(words: Column) -> Column:
        # names behind a filler word are those behind the word after it: they are taken once, where they count first
        anew = lambda i: (i == 0) | ~_filler(F.get(words, i - 1))
        at_word = lambda t, i: F.when(anew(i), _starting(F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))), i * 10 + 4_000_000, "scan", F.instr(norm, t) + F.length(t), 0, ("strict",))).otherwise(_none())
        return F.flatten(F.transform(F.slice(words, 1, 8), at_word))

    tag, tag_end = squash(c("tag")), c("tag_at") + F.length("tag")
    every = F.concat(
        F.flatten(F.transform("options", at_option)),
        F.when(c("label_at") > 0, _starting(tokens(c("labelled")), 1_000_000, "label", c("label_at") + F.length("label"), 0, ("exact", "near"))).otherwise(_none()),
        F.flatten(F.transform("actions", at_action)),
        F.when(c("tag_at") > 0, F.array(*[_candidate(3_000_000 + k, tag, 1, mode, "tag", tag_end, 0) for k, mode in enumerate(("exact", "near"))])).otherwise(_none()),
        _bound(tokens(c("first_line")), scan),
    )
    # shorter words are no slips of anything
    return F.filter(every, lambda x: F.length(x.key) >= F.when(x.mode == "near", LONG).when(x.mode == "underlying", SHORT).otherwise(1))


_CANDIDATE = "array<struct<prio: int, key: string, n: int, mode: string, how: string, rest_at: int, at: int>>"


def _none() -> Column:
    return F.array().cast(_CANDIDATE)


def resolve(found: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by`` the instrument of its first candidate that means one: struct ``inst``.

    found: by, d (trading day, null: any), x (a candidate). A name is read as
    what trades on the day (ten days either way), else as its successor, else
    as what once had the name. In running text ("strict") tickers that are
    words, of two letters, or single words of company names do not count.
    """
    outside = list(N.OFF_EXCHANGE)
    n = names.select(c("key").alias("__key"), "symbol", "kind", "via", "rank", "first_d", "last_d", "seq", "in_fo")
    exact = found.where("x.mode IN ('exact', 'strict')").join(n, c("x.key") == c("__key"))
    alive = F.coalesce((c("d") >= c("first_d") - 10) & (c("d") <= c("last_d") + 10), F.lit(True))
    strict = (c("x.mode") == "strict") & (c("x.n") == 1)
    refused = strict & (c("rank") >= 0) & (c("x.key").isin(*N.words(N.WORD_TICKERS)) | (F.length("x.key") <= 2) | (c("via") == "name"))
    refused = refused | ((c("x.mode") == "strict") & (c("rank") < 0) & c("symbol").isin(*outside) & ~c("in_fo"))
    exact = exact.where(~refused & (alive | (c("seq") < 9))).withColumn("order", F.struct(F.when(alive & (c("seq") < 9), 0).when(alive, 1).otherwise(2).alias("a"), "seq", "symbol"))
    inst = F.struct("symbol", "kind", "via", c("x.n").alias("words"), c("x.how").alias("how"), c("x.mode").alias("mode"), c("x.key").alias("key"), c("x.prio").alias("prio"), *[c(f"x.{k}").alias(k) for k in ("rest_at", "at") if k in found.schema["x"].dataType.names])
    best = lambda t: t.groupBy(*by).agg(F.min(F.struct(F.struct("x.prio", "order").alias("at"), inst.alias("inst"))).alias("b"))
    exact = written(best(exact), "exact")
    # only what counts before a text's first exact name can still mean something else; each asked spelling is sought once
    open_ = found.where("x.mode IN ('near', 'underlying')").join(exact.select(*by, c("b.at.prio").alias("__prio")), by, "left").where("__prio IS NULL OR x.prio < __prio").drop("__prio")
    open_ = written(open_, "slips")
    slips = open_.where("x.mode = 'near'").select(c("x.key").alias("word")).distinct()
    fo_slips = open_.where("x.mode = 'underlying'").select(c("x.key").alias("word")).distinct()
    fuzzy = near_names(slips, names).withColumn("mode", F.lit("near")).unionByName(near_underlyings(fo_slips, names).withColumn("mode", F.lit("underlying")))
    slipped = open_.join(fuzzy.withColumnRenamed("mode", "__mode"), (c("x.key") == c("word")) & (c("x.mode") == c("__mode")))
    slipped = slipped.select(*by, "x", F.struct(F.lit(0).alias("a"), F.lit(0).alias("seq"), "symbol").alias("order"), "symbol", "kind", F.lit("name").alias("via"))
    return exact.unionByName(best(slipped)).groupBy(*by).agg(F.min_by("b.inst", "b.at").alias("inst"))
