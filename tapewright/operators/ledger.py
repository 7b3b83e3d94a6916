"""From outcomes to a follower's account: the record, the funded fold, loans and what-if grids.

Measures that need no balance are plain aggregations. Only affordability feeds
back into the balance, so only that is a fold: one account per (channel, reading,
parameter set), streamed in the order of entry. Its state is the money and the
open positions.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import DAY_SALE, DELIVERY, FLAT_FEE, FUTURE_SALE, FUTURES_MARGIN, OPTION_SALE, compound, round2, trading_costs

c = F.col
#: The follower assumed where nothing else is said.
DEFAULTS = {"capital": 50_000.0, "stake_fraction": 0.2, "borrowed_fraction": 0.0, "loan_monthly_rate": 0.03, "include_low_confidence": False}


def params_table(spark: SparkSession, *variants: dict) -> DataFrame:
    """Rows (param_id, capital, stake_fraction, ...): the defaults, or each variant over them."""
    rows = [{"param_id": i, **DEFAULTS, **v} for i, v in enumerate(variants or ({},))]
    schema = "param_id int, capital double, stake_fraction double, borrowed_fraction double, loan_monthly_rate double, include_low_confidence boolean"
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in schema.split(", ")) for r in rows], schema)


def what_if(spark: SparkSession) -> DataFrame:
    """The grid of the what-if panel: capitals, stakes and borrowed shares."""
    grid = [{"capital": float(k)} for k in (10_000, 20_000, 50_000, 100_000, 200_000, 500_000)]
    grid += [{"stake_fraction": s} for s in (0.05, 0.1, 0.2, 0.5, 1.0)]
    grid += [{"borrowed_fraction": b} for b in (0.0, 0.3, 0.6, 0.9)]
    return params_table(spark, *grid)


def queue(calls: DataFrame, outcomes: DataFrame, params: DataFrame) -> DataFrame:
    """Every call of every reading and parameter set with its status, stake sizing and result as if funded.

    calls: channel_id, call_id, msg_id, pos, kind, side, targets, stop, confidence.
    outcomes: call_id, reading, cls, entry/exit day and price, move, ret_pct, days_held, lot.
    """
    p = F.broadcast(params)  # a few dozen rows by construction
    t = calls.join(outcomes, "call_id").crossJoin(p)
    t = t.withColumn("status", F.when(c("cls") == "unverifiable", "unverifiable").when(c("cls") == "not-triggered", "not-triggered").when((c("confidence") == "low") & ~c("include_low_confidence"), "low-confidence").otherwise("queued"))
    lot = F.when(c("kind") == "equity", 1).otherwise(F.coalesce("lot", F.lit(1)))
    t = t.withColumn("lot", lot).withColumn("unit", F.when(c("kind") == "future", c("entry_price") * FUTURES_MARGIN).otherwise(c("entry_price")) * c("lot"))
    t = t.withColumn("wanted", F.greatest(F.lit(1), F.floor(c("capital") * c("stake_fraction") / c("unit"))).cast("long"))
    quantity = c("wanted") * c("lot")
    long = c("side") == "long"
    buy = quantity * F.when(long, c("entry_price")).otherwise(c("exit_price"))
    sell = quantity * F.when(long, c("exit_price")).otherwise(c("entry_price"))
    t = t.withColumn("if_funded", F.when(c("status") == "queued", quantity * c("move") - trading_costs(c("kind"), buy, sell, c("days_held") == 0)))
    target = F.get(F.filter("targets", lambda x: F.when(long, x > c("entry_price")).otherwise(x < c("entry_price"))), F.lit(0))
    right_side = F.when(long, c("stop") < c("entry_price")).otherwise(c("stop") > c("entry_price"))
    floor = F.when(right_side, c("stop")).when(long, 0.0)
    return t.withColumn("chance", F.when(c("status") == "queued", F.abs(c("entry_price") - floor) / F.abs(target - floor)))


def record(queued: DataFrame, keys: tuple[str, ...] = ("channel_id", "reading", "param_id")) -> DataFrame:
    """The record call by call, as if the stake were always there: one aggregation, combined on the map side."""
    posted = F.unix_micros(c("ts").cast("timestamp")) if "ts" in queued.columns else c("msg_id").cast("long")
    q = queued.where("status = 'queued'").withColumn("posted", posted).withColumn("pos", c("pos").cast("int")).withColumn("msg_id", c("msg_id").cast("long"))
    n = lambda cond: F.count_if(cond)
    return q.groupBy(*keys).agg(
        F.count("*").alias("checked"),
        *[n(c("cls") == k).alias(k) for k in ("target", "stop", "expired", "horizon", "open")],
        n((c("cls") == "expired") & (c("exit_price") <= c("entry_price") * 0.05)).alias("expired_worthless"),
        n(c("if_funded") > 0).alias("profitable"),
        (n(c("cls") == "target") / F.count("*")).alias("hit_rate"),
        F.avg("chance").alias("chance_hit_rate"),
        F.avg(F.when(c("chance").isNotNull(), (c("cls") == "target").cast("double"))).alias("hit_rate_with_target"),
        round2(F.avg(F.coalesce("ret_pct", F.lit(0.0)))).alias("mean_return_pct"),
        round2(F.sum("if_funded")).alias("flat_net"),
    )


def counts(queued: DataFrame, keys: tuple[str, ...] = ("channel_id", "reading", "param_id")) -> DataFrame:
    """How many calls have each status before any money is counted."""
    return queued.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.count_if(c("status") == s).alias(s.replace("-", "_")) for s in ("unverifiable", "not-triggered", "low-confidence", "queued")])


def _costs(kind: str, buy: float, sell: float, same_day: bool) -> float:
    if kind == "option":
        return FLAT_FEE + sell * OPTION_SALE
    if kind == "future" or same_day:
        return FLAT_FEE + sell * (FUTURE_SALE if kind == "future" else DAY_SALE)
    return (buy + sell) * DELIVERY


def _cents(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


_KEYS = ("channel_id", "reading", "param_id")
_KEPT = ("capital", "borrowed_fraction", "loan_monthly_rate")
_LINES = "channel_id long, reading string, param_id int, call_id string, msg_id long, pos int, posted long, status string, cls string, quantity long, lots long, blocked double, gross double, costs double, net double, raw_net double, entry_day int, exit_day int, balance_after double, raw_balance double, settled int, capital double, borrowed_fraction double, loan_monthly_rate double"
_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in _LINES.split(", ")])


class _Account:
    """One follower's money: a heap of open positions by exit. A call's line is complete once its position is closed,
    so what is held at any time are the positions that the money pays for, not the account's calls."""

    def __init__(self, r: dict):
        self.head = {k: r[k] for k in (*_KEYS, *_KEPT)}
        self.balance, self.tied, self.open, self.order, self.settled = float(r["capital"]), 0.0, [], 0, 0

    def close(self, until: float) -> Iterator[dict]:
        """Lines of the positions that end up to a day, in order of exit and entry."""
        while self.open and self.open[0][0] <= until:
            _, _, net, held, line = heapq.heappop(self.open)
            self.balance = max(0.0, self.balance + net)
            self.tied -= held
            yield line | {"balance_after": _cents(self.balance), "raw_balance": self.balance, "settled": self.settled}
            self.settled += 1

    def enter(self, r: dict) -> Iterator[dict]:
        """Lines that the next call completes: of positions closed by its day, and its own where it cannot be paid for."""
        yield from self.close(r["entry_day"])
        self.order += 1
        free = self.balance - (self.tied if self.open else 0.0)
        line = self.head | {k: r[k] for k in ("call_id", "msg_id", "pos", "posted")} | {"status": "no-funds", "entry_day": int(r["entry_day"])}
        if r["unit"] > free:
            yield line
            return
        units = max(1, min(r["wanted"], int(free // r["unit"]))) if r["wanted"] * r["unit"] > free else r["wanted"]
        quantity = units * r["lot"]
        bought, sold = (r["entry_price"], r["exit_price"]) if r["side"] == "long" else (r["exit_price"], r["entry_price"])
        gross = quantity * r["move"]
        costs = _costs(r["kind"], quantity * bought, quantity * sold, r["days_held"] == 0)
        held, exit_day = units * r["unit"], int(r["entry_day"] if r["exit_day"] is None else r["exit_day"])
        lots = None if r["kind"] == "equity" else units
        line |= {"status": "taken", "cls": r["cls"], "quantity": quantity, "lots": lots, "blocked": _cents(held), "gross": _cents(gross), "costs": _cents(costs), "net": _cents(gross - costs), "raw_net": gross - costs, "exit_day": exit_day}
        heapq.heappush(self.open, (exit_day, self.order, gross - costs, held, line))
        self.tied += held


def _fold(batches: Iterator[pa.RecordBatch], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Accounts of a partition one after the other, each carried from batch to batch; rows come by account and in order of entry."""
    account, key, out = None, None, []
    for b in batches:
        for r in b.to_pylist():
            if (mine := tuple(r[k] for k in _KEYS)) != key:
                out += account.close(math.inf) if account else ()
                account, key = _Account(r), mine
            out += account.enter(r)
            if len(out) >= most:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out = []
    out += account.close(math.inf) if account else ()
    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def lines(queued: DataFrame) -> DataFrame:
    """Ledger lines of the funded fold: taken or no-funds, with the balance after each settlement.

    Spark deals accounts out and sorts each by entry (spilling if need be); a task streams them and holds the open positions of one.
    """
    need = [*_KEYS, *_KEPT, "call_id", "msg_id", "pos", "posted", "kind", "side", "cls", "entry_day", "exit_day", "entry_price", "exit_price", "move", "days_held", "lot", "unit", "wanted"]
    posted = F.unix_micros(c("ts").cast("timestamp")) if "ts" in queued.columns else c("msg_id").cast("long")
    q = queued.where("status = 'queued'").withColumn("posted", posted).withColumn("pos", c("pos").cast("int")).withColumn("msg_id", c("msg_id").cast("long")).withColumn("call_id", c("call_id").cast("string")).withColumn("lot", c("lot").cast("long"))
    ordered = q.select(*need).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "entry_day", c("msg_id").asc_nulls_last(), c("pos").asc_nulls_last())
    return ordered.mapInArrow(_fold, _LINES)


def account(folded: DataFrame) -> DataFrame:
    """One row per account from its lines: balances, rates, drawdown, loan."""
    keys = ["channel_id", "reading", "param_id"]
    w = W.partitionBy(*keys).orderBy("settled").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = folded.withColumn("peak", F.when(c("settled").isNotNull(), F.greatest(c("capital"), F.max("raw_balance").over(w))))
    t = t.withColumn("down", F.when(c("peak") > 0, (c("peak") - c("raw_balance")) / c("peak") * 100))
    taken = c("status") == "taken"
    won, lost = F.sum(F.when(taken & (c("raw_net") > 0), c("raw_net"))), F.sum(F.when(taken & (c("raw_net") <= 0), -c("raw_net")))
    out = t.groupBy(*keys).agg(
        F.first("capital").alias("start_balance"),
        F.coalesce(F.max_by("raw_balance", "settled"), F.first("capital")).alias("raw_final"),
        F.count_if(taken).alias("taken"),
        F.count_if(c("status") == "no-funds").alias("no_funds"),
        F.count_if(taken & (c("raw_net") > 0)).alias("profitable"),
        F.count_if(taken & (c("cls") == "target")).alias("target"),
        won.alias("won"),
        lost.alias("lost"),
        round2(F.coalesce(F.max("down"), F.lit(0.0))).alias("max_drawdown_pct"),
        F.min(F.when(c("status") == "no-funds", c("entry_day"))).alias("out_of_money_day"),
        F.min("entry_day").alias("first_day"),
        F.max_by("exit_day", "settled").alias("last_day"),
        (F.first("capital") * F.first("borrowed_fraction")).alias("borrowed"),
        F.min_by("exit_day", F.when((c("borrowed_fraction") > 0) & (c("raw_balance") < c("capital") * c("borrowed_fraction")), c("settled"))).alias("own_money_gone_day"),
        F.first("loan_monthly_rate").alias("rate"),
    )
    owed = F.when(c("borrowed") > 0, compound(c("borrowed"), c("rate"), c("first_day"), F.coalesce("last_day", "first_day")))
    share = lambda x: F.when(c("taken") > 0, x / c("taken"))
    return out.select(
        *keys, "start_balance", round2(c("raw_final")).alias("final_balance"), round2(c("raw_final") - c("start_balance")).alias("net_result"),
        "taken", "no_funds", "profitable", share(c("target")).alias("hit_rate"), share(c("profitable")).alias("profitable_rate"),
        F.when(c("lost") > 0, F.coalesce("won", F.lit(0.0)) / c("lost")).alias("profit_factor"), "max_drawdown_pct", "out_of_money_day",
        round2(owed).alias("owed"), F.when(c("borrowed") > 0, c("own_money_gone_day")).alias("own_money_gone_day"), round2(c("raw_final") - owed).alias("net_worth"),
    )


def running_balance(folded: DataFrame) -> DataFrame:
    """The displayed balance: net results in posting order over a floor at zero.

    A sum that is stopped at zero is the plain running sum, lifted by as much
    as it has been below what the account began with: two windows, no fold.
    """
    keys = ["channel_id", "reading", "param_id"]
    w = W.partitionBy(*keys).orderBy("posted", "msg_id", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = folded.where("status = 'taken'").withColumn("sum", F.sum("raw_net").over(w))
    t = t.withColumns({"balance": c("sum") + F.greatest(c("capital"), F.max(-c("sum")).over(w)), "at": F.row_number().over(W.partitionBy(*keys).orderBy("posted", "msg_id", "pos")) - 1})
    return t.select(*keys, "at", "call_id", round2(c("balance")).alias("balance"))


def band(accounts: DataFrame) -> DataFrame:
    """Lowest and highest final balance over the readings."""
    return accounts.groupBy("channel_id", "param_id").agg(F.min("final_balance").alias("final_low"), F.max("final_balance").alias("final_high"))


def verdict() -> Column:
    """nothing, ahead or behind, of an account row."""
    return F.when(c("taken") == 0, "nothing").when(c("final_balance") > c("start_balance"), "ahead").otherwise("behind")
