"""Queries over reference files, equity curves and opening stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curve, ledger
from ..operators import messages as M
from ..sources import reference_files as R
from . import bindings as V
from .ledger_sql import _ACCOUNT, _CENTS, _with
from .market_queries import queued

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _register_lines(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as two register files of different layout, each with titles above its header and rows that are none."""
    s = V.table(spark, d, "supplier")
    no = F.concat(F.when(c("s_suppkey") % 5 == 0, "XX").when(c("s_suppkey") % 2 == 0, "inh").otherwise("INA"), F.lpad(c("s_suppkey").cast("string"), 9, "0"))
    a = s.where("s_suppkey % 3 <> 0").select(F.lit("ra.csv").alias("file"), (c("s_suppkey") + 10).cast("int").alias("row"), F.concat_ws(",", c("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit(', Ltd"')), F.concat(F.lit(" "), no), F.lit("2020"), F.lit("2025")).alias("line"))
    b = s.where("s_suppkey % 3 = 0").select(F.lit("ia.csv").alias("file"), (c("s_suppkey") + 10).cast("int").alias("row"), F.concat_ws(",", F.lit("2026"), no, F.lit("x"), "s_name").alias("line"))
    heads = [("ra.csv", 0, "Register of advisers"), ("ra.csv", 1, ",,Validity,,"), ("ra.csv", 2, "Sr. No.,Name,Registration No.,From,To"), ("ia.csv", 0, ""), ("ia.csv", 1, "TO,Registration  No,Name of contact,NAME")]
    return spark.createDataFrame(heads, "file string, row int, line string").unionByName(a).unionByName(b)


@query(
    """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'ia.csv' ELSE 'ra.csv' END AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'INH' ELSE 'INA' END || lpad(s_suppkey::VARCHAR, 9, '0') AS reg_no, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ', Ltd' END AS name,
CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '2020' END AS valid_from, CASE WHEN s_suppkey % 3 = 0 THEN '2026' ELSE '2025' END AS valid_to FROM supplier WHERE s_suppkey % 5 <> 0"""
)
def src_register(spark: SparkSession, d: str) -> DataFrame:
    """A register of two layouts, read by the headers found in it."""
    return R.register(_register_lines(spark, d))


@query(
    """SELECT s_suppkey AS channel_id, 'INH' || lpad(s_suppkey::VARCHAR, 9, '0') AS reg_no, CASE WHEN s_suppkey % 4 = 0 THEN 'description' ELSE 'message' END AS place, CASE WHEN s_suppkey % 4 <> 0 THEN 7 END::BIGINT AS msg_id, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AS on_register FROM supplier
UNION ALL SELECT s_suppkey, 'INA' || lpad(s_suppkey::VARCHAR, 9, '0'), 'message', 8, s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 FROM supplier"""
)
def set_dedupe_regs(spark: SparkSession, d: str) -> DataFrame:
    """Numbers claimed in descriptions and messages, each where it comes first, against the register as it was read."""
    s = V.table(spark, d, "supplier")
    key = F.lpad(c("s_suppkey").cast("string"), 9, "0")
    said = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("msg_id"), F.concat(F.lit(f"sebi reg {p}"), key, F.lit(f" and {q}"), key).alias("text")) for n, p, q in ((7, "inh", "INH"), (8, "ina", "inh"), (9, "INA", "INH"))]))
    messages = s.select(c("s_suppkey").alias("channel_id"), said.alias("m")).select("channel_id", "m.*")
    channels = s.select(c("s_suppkey").alias("channel_id"), F.when(c("s_suppkey") % 4 == 0, F.concat(F.lit("we are INH"), key)).alias("description"))
    kind = F.when(c("file") == "ra.csv", "research-analyst").otherwise("investment-adviser")
    return M.registrations(messages, R.register(_register_lines(spark, d)).withColumn("kind", kind), channels).select("channel_id", "reg_no", "place", c("msg_id").cast("long").alias("msg_id"), "on_register")


@query(
    """WITH r AS (SELECT c_name AS scrip, c_custkey, strftime(o_orderdate, '%Y-%m-%d') AS reco_date, o_orderpriority AS reco_time, CASE WHEN c_custkey % 3 <> 0 THEN 'S' || c_custkey END AS symbol, CASE WHEN c_custkey % 5 = 0 THEN 'sme' ELSE 'main' END AS board FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT *, symbol IS NOT NULL AND reco_date >= '1996-01-01' AS measured FROM r)
SELECT board, grouping(board) = 1 AS whole, count(*) AS rows, count(DISTINCT (scrip, reco_date, reco_time)) AS recommendations, count(DISTINCT scrip) AS scrips, count(DISTINCT scrip) FILTER (symbol IS NOT NULL) AS scrips_in_data, count(DISTINCT (scrip, reco_date, reco_time)) FILTER (measured) AS measured,
count(DISTINCT (scrip, reco_date, reco_time)) FILTER (NOT measured) AS not_measured, count(DISTINCT symbol) FILTER (measured) AS stocks_measured FROM m GROUP BY GROUPING SETS ((board), ())"""
)
def agg_coverage(spark: SparkSession, d: str) -> DataFrame:
    """src_case too: orders as annexures in JSON, one a day, every second row under other names; what of them the prices cover, by board and in all."""
    # names grow with the customers: both joins are merges, as a broadcast would hold all of them in the driver
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), "c_name").hint("merge"), "o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    plain = F.to_json(F.struct((c("o_orderkey") % 37).alias("page"), c("c_name").alias("scrip"), day.alias("recoDate"), c("o_orderpriority").alias("recoTime"), day.alias("effDateT")))
    other = F.to_json(F.struct(F.lit(None).cast("int").alias("page"), c("c_name").alias("Scrip Name"), day.alias("reco_date"), c("o_orderpriority").alias("reco_time"), F.array("o_totalprice").alias("amounts")))
    text = F.when(c("o_orderkey") % 2 == 0, plain).otherwise(other)
    # a day's orders are a document; a few of them a task, however few bytes they are before they are text
    documents = o.repartition(400, day).groupBy(day.alias("document")).agg(F.concat(F.lit('{"pdf": "x", "rows": ['), F.array_join(F.collect_list(text), ","), F.lit("]}")).alias("value"))
    symbols = V.table(spark, d, "customer").select(c("c_name").alias("scrip"), F.when(c("c_custkey") % 3 != 0, F.concat(F.lit("S"), c("c_custkey").cast("string"))).alias("symbol"), F.when(c("c_custkey") % 5 == 0, "sme").otherwise("main").alias("board"))
    rows = R.annexure(documents).join(symbols.hint("merge"), "scrip")
    return R.coverage(rows.withColumn("measured", c("symbol").isNotNull() & (c("reco_date") >= "1996-01-01")), "board")


@query(
    _with()
    + f""", pts AS (SELECT {_ACCOUNT}, exit_day AS d, {_CENTS.format("max_by(raw_balance, settled)")} AS balance, 1 AS rank FROM lines WHERE settled IS NOT NULL GROUP BY channel_id, reading, param_id, exit_day UNION ALL SELECT {_ACCOUNT}, min(entry_day), any_value(capital), 0 FROM lines GROUP BY channel_id, reading, param_id),
one AS (SELECT {_ACCOUNT}, d, max_by(balance, rank) AS balance FROM pts GROUP BY channel_id, reading, param_id, d),
span AS (SELECT {_ACCOUNT}, min(d) AS lo, max(d) AS hi FROM one GROUP BY channel_id, reading, param_id),
grid AS (SELECT {_ACCOUNT}, unnest(range(lo, hi + 1)) AS d FROM span)
SELECT g.channel_id, g.reading, g.param_id, g.d::INTEGER AS d, one.balance FROM grid g ASOF JOIN one ON g.channel_id = one.channel_id AND g.reading = one.reading AND g.param_id = one.param_id AND g.d >= one.d"""
)
def win_equity_step(spark: SparkSession, d: str) -> DataFrame:
    """The balance of every account at the end of every day."""
    return curve.equity_steps(ledger.lines(queued(spark, d)))


@query(
    _with(readings="o.reading = 'likely'")
    + f""", msgs AS (SELECT user_id % 10 AS channel_id, event_id AS msg_id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE event_type || ' ' || user_id END AS text, event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS place FROM events),
hj AS (SELECT m.*, k.call_id, l.status, CASE WHEN l.status = 'taken' THEN {_CENTS.format("l.raw_net")} END AS net FROM msgs m LEFT JOIN calls k ON k.call_id = m.msg_id LEFT JOIN lines l ON l.call_id = k.call_id),
sp AS (SELECT channel_id, min(place) FILTER (call_id IS NOT NULL) AS b, min(place) FILTER (status = 'no-funds') AS broke FROM hj GROUP BY 1),
ht AS (SELECT hj.*, CASE WHEN call_id IS NOT NULL THEN 'call' WHEN event_type = 'purchase' THEN 'brag' ELSE 'other' END AS kind FROM hj JOIN sp USING (channel_id) WHERE place BETWEEN b AND coalesce(broke, b + 60) AND trim(text) <> ''),
hb AS (SELECT *, 50000 + coalesce(sum(net) OVER w, 0) AS balance, sum((kind = 'call')::INT) OVER w AS island FROM ht WINDOW w AS (PARTITION BY channel_id ORDER BY msg_id)),
hp AS (SELECT *, greatest(50000, max(balance) OVER (PARTITION BY channel_id ORDER BY msg_id)) AS peak, row_number() OVER (PARTITION BY channel_id, island, kind = 'call' ORDER BY msg_id) AS nth FROM hb)
SELECT channel_id, msg_id, kind, text, call_id::VARCHAR AS call_id, status, {_CENTS.format("net")} AS net, {_CENTS.format("balance")} AS balance, {_CENTS.format("peak")} AS peak FROM hp WHERE kind = 'call' OR nth <= 2"""
)
def agg_hero(spark: SparkSession, d: str) -> DataFrame:
    """The opening stretch of every channel: calls with the account behind them, and two at most of the posts between."""
    e, i = V.table(spark, d, "events"), c("event_id")
    said = F.when(i % 13 == 0, " ").otherwise(F.concat(c("event_type"), F.lit("\n"), c("user_id").cast("string")))
    messages = e.select((c("user_id") % 10).alias("channel_id"), i.alias("msg_id"), said.alias("text"))
    results = e.where("event_type = 'purchase'").select((c("user_id") % 10).alias("channel_id"), i.alias("msg_id"))
    o = curve.opening(messages, V.calls(spark, d).select("channel_id", "msg_id", "call_id"), results, ledger.lines(queued(spark, d, readings=("likely",))))
    return o.withColumns({x: F.floor(c(x) * 100 + 0.5) / 100 for x in ("net", "balance", "peak")})
