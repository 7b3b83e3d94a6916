"""SQL of the funded ledger: the fold as a recursive query whose state is the balance and the list of open positions."""

from __future__ import annotations

from . import bindings as V
from .market_queries import _REPLAY

#: (param_id, capital, stake_fraction, borrowed_fraction), in the order of ``ledger.params_table`` and ``ledger.what_if``.
_DEFAULT = "params AS (SELECT 0 AS param_id, 50000.0::DOUBLE AS capital, 0.2::DOUBLE AS stake, 0.0::DOUBLE AS borrowed_fraction)"
_GRID = """params AS (SELECT (row_number() OVER (ORDER BY block, k) - 1)::INTEGER AS param_id, CASE WHEN block = 0 THEN x ELSE 50000 END::DOUBLE AS capital, CASE WHEN block = 1 THEN x ELSE 0.2 END::DOUBLE AS stake, CASE WHEN block = 2 THEN x ELSE 0 END::DOUBLE AS borrowed_fraction
  FROM (SELECT 0 AS block, unnest([10000, 20000, 50000, 100000, 200000, 500000]::DOUBLE[]) AS x, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS k
    UNION ALL SELECT 1, unnest([0.05, 0.1, 0.2, 0.5, 1.0]::DOUBLE[]), generate_subscripts([1, 2, 3, 4, 5], 1) UNION ALL SELECT 2, unnest([0.0, 0.3, 0.6, 0.9]::DOUBLE[]), generate_subscripts([1, 2, 3, 4], 1)))"""
_CENTS = "floor(({}) * 100 + 0.5) / 100"
_SIX = "floor(({}) * 1000000 + 0.5) / 1000000"
_ACCOUNT = "channel_id, reading, param_id"
_SOLD = "units * CASE WHEN up THEN exit_price ELSE unit END"
_COSTS = f"CASE WHEN kind = 'option' THEN 40 + {_SOLD} * 0.0015 WHEN days_held = 0 THEN 40 + {_SOLD} * 0.0003 ELSE (units * CASE WHEN up THEN unit ELSE exit_price END + {_SOLD}) * 0.0012 END"

_LEDGER = """,
lq AS (SELECT k.channel_id, o.reading, p.param_id, p.capital, p.borrowed_fraction, o.call_id, k.ts, k.kind, k.up, o.cls, o.entry_day, coalesce(o.exit_day, o.entry_day) AS exit_day, o.entry_price AS unit, o.exit_price, o.move, o.days_held,
  greatest(1, floor(p.capital * p.stake / o.entry_price))::BIGINT AS wanted, row_number() OVER (PARTITION BY k.channel_id, o.reading, p.param_id ORDER BY o.entry_day, o.call_id) AS ord
  FROM outcomes o JOIN calls k USING (call_id), params p WHERE o.cls NOT IN ('unverifiable', 'not-triggered') AND k.confidence <> 'low' AND {readings}),
rec AS (
  SELECT DISTINCT channel_id, reading, param_id, 0::BIGINT AS ord, capital AS balance, []::STRUCT(x BIGINT, o BIGINT, net DOUBLE, held DOUBLE)[] AS held, NULL::BIGINT AS units, NULL::DOUBLE AS net FROM lq
  UNION ALL
  SELECT channel_id, reading, param_id, ord, balance, CASE WHEN units IS NULL THEN still ELSE list_append(still, struct_pack(x := exit_day, o := ord, net := net, held := units * unit)) END, units, net
  FROM (SELECT *, units * move - CASE WHEN kind = 'option' THEN 40 + units * sold * 0.0015 WHEN days_held = 0 THEN 40 + units * sold * 0.0003 ELSE (units * bought + units * sold) * 0.0012 END AS net
    FROM (SELECT *, CASE WHEN up THEN unit ELSE exit_price END AS bought, CASE WHEN up THEN exit_price ELSE unit END AS sold,
        CASE WHEN unit > free THEN NULL WHEN wanted * unit > free THEN greatest(1, least(wanted, floor(free / unit)::BIGINT)) ELSE wanted END AS units
      FROM (SELECT *, balance - coalesce(list_sum(list_transform(still, lambda p: p.held)), 0) AS free
        FROM (SELECT l.*, list_filter(r.held, lambda p: p.x > l.entry_day) AS still,
            list_reduce(list_transform(list_sort(list_filter(r.held, lambda p: p.x <= l.entry_day)), lambda p: p.net), lambda a, x: greatest(0.0::DOUBLE, a + x), r.balance) AS balance
          FROM rec r JOIN lq l ON l.channel_id = r.channel_id AND l.reading = r.reading AND l.param_id = r.param_id AND l.ord = r.ord + 1))))),
led AS (SELECT l.*, r.units, r.net AS raw_net, CASE WHEN r.units IS NULL THEN 'no-funds' ELSE 'taken' END AS status FROM lq l JOIN rec r USING (channel_id, reading, param_id, ord)),
settled AS (SELECT channel_id, reading, param_id, ord, row_number() OVER w - 1 AS settled, list_reduce(list(raw_net) OVER w, lambda a, x: greatest(0.0::DOUBLE, a + x), capital) AS raw_balance FROM led WHERE status = 'taken' WINDOW w AS (PARTITION BY channel_id, reading, param_id ORDER BY exit_day, ord)),
lines AS (SELECT led.*, settled, raw_balance FROM led LEFT JOIN settled USING (channel_id, reading, param_id, ord)),
peaks AS (SELECT *, greatest(capital, max(raw_balance) OVER (PARTITION BY channel_id, reading, param_id ORDER BY settled)) AS peak FROM lines WHERE settled IS NOT NULL),
acc0 AS (SELECT channel_id, reading, param_id, any_value(capital) AS start_balance, any_value(borrowed_fraction) AS bf, coalesce(max_by(raw_balance, settled) FILTER (settled IS NOT NULL), any_value(capital)) AS raw_final, count(*) FILTER (status = 'taken') AS taken, count(*) FILTER (status = 'no-funds') AS no_funds,
  count(*) FILTER (raw_net > 0) AS profitable, count(*) FILTER (status = 'taken' AND cls = 'target') AS target, sum(raw_net) FILTER (raw_net > 0) AS won, sum(-raw_net) FILTER (raw_net <= 0) AS lost, min(entry_day) FILTER (status = 'no-funds') AS out_of_money_day, min(entry_day) AS first_day,
  max_by(exit_day, settled) FILTER (settled IS NOT NULL) AS last_day, min_by(exit_day, settled) FILTER (raw_balance < capital * borrowed_fraction) AS gone FROM lines GROUP BY 1, 2, 3),
downs AS (SELECT channel_id, reading, param_id, max((peak - raw_balance) / peak * 100) FILTER (peak > 0) AS down FROM peaks GROUP BY 1, 2, 3),
acc AS (SELECT *, CASE WHEN bf > 0 THEN start_balance * bf * pow(1.03, greatest(1, ceil((coalesce(last_day, first_day) - first_day) / 21))) END AS owed FROM acc0 LEFT JOIN downs USING (channel_id, reading, param_id))
"""
_ACCOUNT_OUT = f"""{_ACCOUNT}, start_balance, {_CENTS.format("raw_final")} AS final_balance, {_CENTS.format("raw_final - start_balance")} AS net_result, taken, no_funds, profitable,
{_SIX.format("CASE WHEN taken > 0 THEN target / taken END")} AS hit_rate, {_SIX.format("CASE WHEN taken > 0 THEN profitable / taken END")} AS profitable_rate, {_SIX.format("CASE WHEN lost > 0 THEN coalesce(won, 0) / lost END")} AS profit_factor,
{_CENTS.format("coalesce(down, 0)")} AS max_drawdown_pct, out_of_money_day::INTEGER AS out_of_money_day, {_CENTS.format("owed")} AS owed, (CASE WHEN bf > 0 THEN gone END)::INTEGER AS own_money_gone_day, {_CENTS.format("raw_final - owed")} AS net_worth"""


def _with(params: str = _DEFAULT, readings: str = "true") -> str:
    # RECURSIVE is of the whole WITH clause; the views in front are not
    return f"WITH RECURSIVE {V.SQL_VIEWS}{_REPLAY}, {params}{_LEDGER.replace('{readings}', readings)}"


SQL = {
    "ledger_lines": _with()
    + f"""SELECT {_ACCOUNT}, call_id::VARCHAR AS call_id, call_id::BIGINT AS msg_id, 0::INTEGER AS pos, epoch_us(ts) AS posted, status, CASE WHEN status = 'taken' THEN cls END AS cls, units AS quantity, CASE WHEN kind <> 'equity' THEN units END AS lots, {_CENTS.format("units * unit")} AS blocked,
{_CENTS.format("units * move")} AS gross, {_CENTS.format(_COSTS)} AS costs, {_CENTS.format("raw_net")} AS net, entry_day::INTEGER AS entry_day, CASE WHEN status = 'taken' THEN exit_day END::INTEGER AS exit_day, {_CENTS.format("raw_balance")} AS balance_after, settled::INTEGER AS settled,
capital, borrowed_fraction, 0.03::DOUBLE AS loan_monthly_rate FROM lines""",
    "ledger_account": _with() + f"SELECT {_ACCOUNT_OUT}, CASE WHEN taken = 0 THEN 'nothing' WHEN {_CENTS.format('raw_final')} > start_balance THEN 'ahead' ELSE 'behind' END AS verdict FROM acc",
    "what_if": _with(_GRID, "o.reading = 'likely'") + f"SELECT {_ACCOUNT_OUT} FROM acc",
    "agg_band": _with() + f"SELECT channel_id, param_id, min({_CENTS.format('raw_final')}) AS final_low, max({_CENTS.format('raw_final')}) AS final_high FROM acc GROUP BY 1, 2",
    "win_running": _with()
    + f", r AS (SELECT {_ACCOUNT}, call_id, row_number() OVER w - 1 AS place, list_reduce(list(raw_net) OVER w, lambda a, x: greatest(0.0::DOUBLE, a + x), capital) AS b FROM lines WHERE status = 'taken' WINDOW w AS (PARTITION BY {_ACCOUNT} ORDER BY ts, call_id)) SELECT {_ACCOUNT}, place::INTEGER AS \"at\", call_id::VARCHAR AS call_id, {_CENTS.format('b')} AS balance FROM r",
    "agg_window_end": _with()
    + f", first AS (SELECT call_id FROM calls QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY ts, call_id) <= 20) SELECT {_ACCOUNT}, round(any_value(capital) + sum({_CENTS.format('raw_net')})) AS \"end\" FROM lines JOIN first USING (call_id) WHERE status = 'taken' GROUP BY {_ACCOUNT}",
}
