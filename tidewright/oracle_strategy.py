"""DuckDB SQL that says again what the strategy operators compute, for comparison. Not used by any operator."""

from __future__ import annotations

from .oracle_series import _RSI, _SUPER, O, P, SERIES, W, div, ema, full, grid, indicator_tables
from .plans.config import PRESETS, Rule, Strategy

#: Fee schedule and lots of the fixture series: NSE_FO_STOCK, lot size 100.
LOT = 100


def values_of(preset: str) -> list[str]:
    """Tables that end in x(ticker, i, date, close, x0, x1, ...)."""
    rows = "SELECT s.ticker, s.i, s.date, s.close"
    join = lambda *names: "".join(f" LEFT JOIN {n} ON {n}.ticker = s.ticker AND {n}.i = s.i" for n in names)
    if preset == "golden_cross":
        return [f"x AS MATERIALIZED ({rows}, {full(f'avg(close) {W(50)}', 50)} AS x0, {full(f'avg(close) {W(200)}', 200)} AS x1 FROM s)"]
    if preset == "rsi_mean_reversion":
        return [*_RSI, f"x AS MATERIALIZED ({rows}, rs.v AS x0 FROM s{join('rs')})"]
    if preset == "bollinger_bounce":
        return [f"x AS MATERIALIZED ({rows}, {indicator_tables('bb_pct_b')[3]['value']} AS x0 FROM s)"]
    if preset == "macd_crossover":
        return [ema("e", "s", "close", 12), ema("f", "s", "close", 26), f"x AS MATERIALIZED ({rows}, e.v - f.v AS x0 FROM s{join('e', 'f')})"]
    if preset == "supertrend":
        return [*_SUPER, f"x AS MATERIALIZED ({rows}, sd.v AS x0 FROM s{join('sd')})"]
    if preset == "triple_ma":
        return [ema("e", "s", "close", 9), ema("f", "s", "close", 21), ema("g", "s", "close", 55), f"x AS MATERIALIZED ({rows}, e.v AS x0, f.v AS x1, g.v AS x2 FROM s{join('e', 'f', 'g')})"]
    return [f"x AS MATERIALIZED ({rows}, {indicator_tables('ts_momentum')[3]['value']} AS x0 FROM s)"]


def _rule(k: int, r: Rule) -> str:
    now, before = f"x{r.indicator}", f"lag(x{r.indicator}) {O}"
    bound = f"{float(r.threshold or 0)!r}e0"
    t, tb = (f"x{r.reference}", f"lag(x{r.reference}) {O}") if r.reference is not None else (bound, bound)
    fired = {
        "crosses_above": f"{before} <= {tb} AND {now} > {t}", "crosses_below": f"{before} >= {tb} AND {now} < {t}", "is_above": f"{now} > {t}", "is_below": f"{now} < {t}",
        "between": f"{now} >= {bound} AND {now} <= {t if r.reference is not None else '100'}",
    }[r.condition]
    yes = 1 if r.direction == "long" or (r.direction == "both" and r.condition in ("crosses_above", "is_above")) else -1
    other = f"WHEN {now} IS NOT NULL AND {before} IS NOT NULL AND {t} IS NOT NULL THEN {-yes}" if r.direction == "both" and r.is_level else ""
    return f"CASE WHEN {now} IS NOT NULL AND {before} IS NOT NULL AND coalesce({fired}, false) THEN {yes} {other} ELSE 0 END AS r{k}"


def signal_tables(values: list[str], rules: tuple[Rule, ...], logic: str, rebalance: str) -> list[str]:
    """Tables that end in sg(ticker, i, date, close, signal)."""
    raw = "r AS MATERIALIZED (SELECT *, " + ", ".join(_rule(k, r) for k, r in enumerate(rules)) + " FROM x)"
    held = [f"r{k}" if logic == "or" and r.is_level else f"coalesce(last_value(nullif(r{k}, 0) IGNORE NULLS) {P}, 0)" for k, r in enumerate(rules)]
    hold = "h AS MATERIALIZED (SELECT ticker, i, date, close, " + ", ".join(f"{x} AS h{k}" for k, x in enumerate(held)) + " FROM r)"
    names = [f"h{k}" for k in range(len(rules))]
    if logic == "or":
        signal = f"coalesce({', '.join(f'nullif({x}, 0)' for x in reversed(names))}, 0)"
    else:
        some = lambda v: "(" + " OR ".join(f"{x} = {v}" for x in names) + ")"
        signal = f"CASE WHEN {some(1)} AND NOT {some(-1)} THEN 1 WHEN {some(-1)} AND NOT {some(1)} THEN -1 ELSE 0 END"
    tables = [*values, raw, hold, f"s0 AS MATERIALIZED (SELECT ticker, i, date, close, {signal} AS signal FROM h)"]
    if rebalance == "daily":
        return [*tables, "sg AS MATERIALIZED (SELECT * FROM s0)"]
    if rebalance == "monthly":
        due = f"du AS (SELECT *, coalesce(date_trunc('month', date) <> date_trunc('month', lag(date) {O}), true) AS due FROM s0)"
        return [*tables, due, f"sg AS MATERIALIZED (SELECT ticker, i, date, close, last_value(CASE WHEN due THEN signal END IGNORE NULLS) {P} AS signal FROM du)"]
    rule = "(isodow(n.date) = 1 OR n.date - e.last >= 7)" if rebalance == "weekly" else "(n.date - e.last >= 14)"
    walk = (
        "sg(ticker, i, date, close, signal, last) AS (SELECT ticker, i, date, close, signal, date FROM s0 WHERE i = 0 UNION ALL "
        f"SELECT n.ticker, n.i, n.date, n.close, CASE WHEN {rule} THEN n.signal ELSE e.signal END, CASE WHEN {rule} THEN n.date ELSE e.last END FROM sg e JOIN s0 n ON n.ticker = e.ticker AND n.i = e.i + 1)"
    )
    return [*tables, walk]


#: Fixed values by instrument class: exchange share, tax on sales, slippage base, threshold in lots, large.
FEES = {"NSE_FO_STOCK": ("0.0000183", "0.000125", 2, 50, 8), "MCX_SINGLE": ("0.000026", "0.0001", 3, 10, 10), "MCX_INDEX": ("0.000026", "0", 4, 20, 12)}


def _leg(sells: str, lots: str, kind: str) -> str:
    exchange, tax, base, edge, large = FEES[kind]
    value = f"(({lots}) * {LOT}e0 * close)"
    slip = f"CASE WHEN ({lots}) <= {edge} THEN {base}e0 ELSE {base}e0 + least((({lots}) - {edge}e0) / {edge}e0, 1e0) * {large - base}e0 END"
    return f"CASE WHEN ({lots}) > 0 AND {value} > 0 THEN 20e0 + {value} * {exchange}e0 + {value} * CASE WHEN {sells} THEN {tax}e0 ELSE 0.00002e0 END + (20e0 + {value} * {exchange}e0) * 0.18e0 + {value} * ({slip}) / 1e4 ELSE 0 END"


def daily_tables(tables: list[str], kind: str = "NSE_FO_STOCK") -> list[str]:
    """Tables that end in dy: signal, lots, gross_pnl, cost, net_pnl, cumulative, drawdown."""
    sized = f"CASE WHEN i >= 20 AND signal <> 0 AND risk > 0 THEN CAST(greatest(floor(500000e0 / risk), 1) AS BIGINT) ELSE 0 END"
    one, both = _leg("now < bef", "abs(now - bef)", kind), f"{_leg('bef > 0', 'abs(bef)', kind)} + {_leg('now < 0', 'abs(now)', kind)}"
    return [
        *tables,
        f"rt AS (SELECT ticker, i, date, close, signal, coalesce({div(f'close - lag(close) {O}', f'lag(close) {O}', '0')}, 0) AS ret FROM sg)",
        f"rk AS (SELECT *, close * {LOT}e0 * greatest(stddev_samp(ret) {W(20)}, 0.01e0) * 1.65e0 AS risk FROM rt)",
        f"lt AS MATERIALIZED (SELECT ticker, i, date, close, signal, {sized} AS lots FROM rk)",
        f"ps AS (SELECT *, signal * lots AS now, coalesce(lag(signal * lots) {O}, 0) AS bef, coalesce(lag(signal * lots) {O} * {LOT}e0 * (close - lag(close) {O}), 0) AS gross_pnl FROM lt)",
        f"cs AS (SELECT *, CASE WHEN now = bef OR close <= 0 THEN 0 WHEN now * bef < 0 THEN {both} ELSE {one} END AS cost FROM ps)",
        f"nt AS MATERIALIZED (SELECT *, gross_pnl - cost AS net_pnl, sum(gross_pnl - cost) {P} AS cumulative FROM cs)",
        f"dy AS MATERIALIZED (SELECT *, cumulative - max(cumulative) {P} AS drawdown FROM nt)",
    ]


def trade_tables(tables: list[str]) -> list[str]:
    """Tables that end in tl."""
    return [
        *daily_tables(tables),
        f"ch AS (SELECT *, CASE WHEN coalesce(signal <> lag(signal) {O}, true) THEN 1 ELSE 0 END AS ch FROM dy)",
        f"rn AS (SELECT *, sum(ch) {P} AS run FROM ch)",
        "ru AS (SELECT ticker, run, any_value(signal) AS signal, min(date) AS entry_date, arg_min(close, date) AS entry_price, arg_min(lots, date) AS lots, max(date) AS ld, arg_max(close, date) AS lc FROM rn GROUP BY ticker, run)",
        "ex AS (SELECT *, coalesce(lead(entry_date) OVER (PARTITION BY ticker ORDER BY run), ld) AS exit_date, coalesce(lead(entry_price) OVER (PARTITION BY ticker ORDER BY run), lc) AS exit_price FROM ru)",
        f"tl AS MATERIALIZED (SELECT ticker, entry_date, exit_date, CASE WHEN signal = 1 THEN 'long' ELSE 'short' END AS direction, lots, entry_price, exit_price, signal * lots * {LOT}e0 * (exit_price - entry_price) AS pnl, "
        "CASE WHEN entry_price = 0 THEN 0 ELSE (exit_price - entry_price) / entry_price * 100 * signal END AS pnl_pct, greatest(exit_date - entry_date, 1) AS duration_days FROM ex WHERE signal <> 0)",
    ]


def _half(x: str, d: int) -> str:
    return f"floor(({x}) * 1e{d} + 0.5e0) / 1e{d}"


def metrics_sql(tables: list[str]) -> str:
    root = "sqrt(252e0)"
    parts = [
        *trade_tables(tables),
        "pk AS (SELECT *, greatest(coalesce(max(cumulative) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS pb, min(date) OVER (PARTITION BY ticker) AS fd FROM dy)",
        f"pd AS (SELECT *, greatest(pb, cumulative) AS pk, coalesce(last_value(CASE WHEN cumulative > pb THEN date END IGNORE NULLS) {P}, fd) AS pdt FROM pk)",
        "dd AS (SELECT ticker, pk - cumulative AS depth, (pk - cumulative) / (1e6 + pk) * 100 AS pct, date - pdt AS days FROM pd QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pk - cumulative DESC, date) = 1)",
        "ng AS (SELECT ticker, sum(net_pnl) FILTER (net_pnl < 0) / count(*) AS m FROM dy GROUP BY ticker)",
        "dl AS (SELECT d.ticker, count(*) AS n, sum(net_pnl) AS total, avg(net_pnl) AS mean, coalesce(stddev_samp(net_pnl), 0) AS std, sum(cost) AS costs, coalesce(sqrt(sum((net_pnl - m) ** 2) FILTER (net_pnl < 0) / (count(*) - 1)), 0) AS down FROM dy d JOIN ng USING (ticker) GROUP BY d.ticker)",
        "tr2 AS (SELECT ticker, count(*) AS nt, count(*) FILTER (pnl > 0) AS w, count(*) FILTER (pnl <= 0) AS l, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gp, coalesce(-sum(pnl) FILTER (pnl <= 0), 0) AS gl, avg(duration_days) AS hd, max(pnl) AS bt, min(pnl) AS wt FROM tl GROUP BY ticker)",
        "wl AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY entry_date) - row_number() OVER (PARTITION BY ticker, pnl > 0 ORDER BY entry_date) AS g FROM tl)",
        "sk AS (SELECT ticker, coalesce(max(n) FILTER (win), 0) AS cw, coalesce(max(n) FILTER (NOT win), 0) AS cl FROM (SELECT ticker, pnl > 0 AS win, g, count(*) AS n FROM wl GROUP BY ALL) GROUP BY ticker)",
        "al AS (SELECT dl.*, depth, pct, days, coalesce(nt, 0) AS nt, coalesce(w, 0) AS w, coalesce(l, 0) AS l, coalesce(gp, 0) AS gp, coalesce(gl, 0) AS gl, coalesce(hd, 0) AS hd, coalesce(bt, 0) AS bt, coalesce(wt, 0) AS wt, coalesce(cw, 0) AS cw, coalesce(cl, 0) AS cl, total * 252 / n AS yr FROM dl JOIN dd USING (ticker) LEFT JOIN tr2 USING (ticker) LEFT JOIN sk USING (ticker) WHERE n >= 2)",
    ]
    win, loss = div("gp", "w", "0"), div("gl", "l", "0")
    four = {"sharpe": f"({div('mean', 'std', '0')}) * {root}", "sortino": f"({div('mean', 'down', '0')}) * {root}", "calmar": div("yr", "depth", "0"), "max_dd_pct": "CASE WHEN depth > 0 THEN -pct ELSE 0 END",
            "total_return_pct": "total / 1e6 * 100", "annual_return_pct": "yr / 1e6 * 100", "payoff_ratio": div(win, loss, "0")}
    two = {"max_dd_inr": "-depth", "total_pnl": "total", "win_rate_pct": div("100e0 * w", "nt", "0"), "avg_hold_days": "hd", "avg_trade_pnl": div("total", "nt", "0"), "best_trade": "bt", "worst_trade": "wt",
           "avg_win": win, "avg_loss": loss, "gross_profit": "gp", "gross_loss": "gl", "total_costs": "costs"}
    shown = [f"{_half(x, 4)} AS {k}" for k, x in four.items()] + [f"{_half(x, 2)} AS {k}" for k, x in two.items()]
    factor = f"CASE WHEN gl = 0 THEN CASE WHEN gp > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE {_half('gp / gl', 4)} END AS profit_factor"
    tail = "CAST(CASE WHEN depth > 0 THEN days ELSE 0 END AS BIGINT) AS max_dd_duration_days, nt AS num_trades, cw AS max_consec_wins, cl AS max_consec_losses"
    return f"WITH RECURSIVE {SERIES}, {', '.join(parts)} SELECT ticker, {', '.join(shown)}, {factor}, {tail} FROM al"


def preset_tables(preset: str) -> list[str]:
    s = PRESETS[preset]
    return signal_tables(values_of(preset), s.rules, s.logic, s.rebalance)


#: Two moving averages: the values that the rule, combination and rebalancing queries look at.
SAMPLE_VALUES = [f"x AS MATERIALIZED (SELECT s.ticker, s.i, s.date, s.close, {full(f'avg(close) {W(20)}', 20)} AS x0, {full(f'avg(close) {W(50)}', 50)} AS x1, {full(div(f'(close - min(low) {W(20)}) * 100', f'max(high) {W(20)} - min(low) {W(20)}', '50'), 20)} AS x2 FROM s)"]


def sample_tables(s: Strategy) -> list[str]:
    return signal_tables(SAMPLE_VALUES, s.rules, s.logic, s.rebalance)


def select(tables: list[str], columns: str, source: str) -> str:
    return f"WITH RECURSIVE {SERIES}, {', '.join(tables)} SELECT {columns} FROM {source}"


DAILY = ", ".join(["ticker", "date"] + [f"{grid(x, 2)} AS {x}" for x in ("gross_pnl", "cost", "net_pnl", "cumulative", "drawdown")] + ["lots", "signal"])
TRADES = ", ".join(["ticker", "entry_date", "exit_date", "direction", "lots", "duration_days"] + [f"{grid(x)} AS {x}" for x in ("entry_price", "exit_price", "pnl", "pnl_pct")])
