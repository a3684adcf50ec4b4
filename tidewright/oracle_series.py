"""DuckDB SQL that says again what the series operators compute, for comparison. Not used by any operator."""

from __future__ import annotations

#: Fixtures: bars by part type and by supplier, and the suppliers' instrument list.
_BARS = """
SELECT {name} AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(px, struct_pack(a := l_orderkey, b := l_linenumber, c := px)) AS open,
       max(px) AS high, min(px) AS low, arg_max(px, struct_pack(a := l_orderkey, b := l_linenumber, c := px)) AS close, sum(l_quantity) AS volume
FROM (SELECT *, 1000 + l_extendedprice / l_quantity / 100 AS px FROM lineitem) JOIN {dim} GROUP BY ALL
"""
BARS_TYPE = _BARS.format(name="p_type", dim="part ON l_partkey = p_partkey")
BARS_SUPPLIER = _BARS.format(name="s_name", dim="supplier ON l_suppkey = s_suppkey")
INSTRUMENTS = """
SELECT s_name AS ticker, r_name AS sector, CAST(25 * (1 + s_suppkey % 8) AS INT) AS lot_size,
       CASE s_suppkey % 3 WHEN 0 THEN 'NSE_FO_STOCK' WHEN 1 THEN 'MCX_SINGLE' ELSE 'MCX_INDEX' END AS instrument_class
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

SERIES = f"bars AS MATERIALIZED ({BARS_TYPE}), s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM bars)"
O = "OVER (PARTITION BY ticker ORDER BY date)"
P = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


def W(p: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, p: int) -> str:
    return f"CASE WHEN i >= {p - 1} THEN {x} END"


def div(a: str, b: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) = 0 THEN {otherwise} END"


def grid(x: str, digits: int = 4) -> str:
    """x on the grid on which results are compared; see queries.HALF."""
    return f"floor(({x}) * 1e{digits} + 0.503e0) / 1e{digits}"


def ema(name: str, src: str, x: str, p: int) -> str:
    return (
        f"{name}(ticker, i, v) AS (SELECT ticker, CAST({p - 1} AS BIGINT), avg({x}) FROM {src} WHERE i < {p} GROUP BY ticker HAVING count(*) = {p} "
        f"UNION ALL SELECT n.ticker, n.i, n.{x} * (2e0 / {p + 1}) + e.v * (1 - 2e0 / {p + 1}) FROM {name} e JOIN {src} n ON n.ticker = e.ticker AND n.i = e.i + 1)"
    )


def wilder(name: str, src: str, x: str, p: int, first: int) -> str:
    return (
        f"{name}(ticker, i, v) AS (SELECT ticker, CAST({first + p - 1} AS BIGINT), avg({x}) FROM {src} WHERE i BETWEEN {first} AND {first + p - 1} GROUP BY ticker HAVING count({x}) = {p} "
        f"UNION ALL SELECT n.ticker, n.i, (e.v * {p - 1} + n.{x}) / {p} FROM {name} e JOIN {src} n ON n.ticker = e.ticker AND n.i = e.i + 1)"
    )


def zeroed(name: str, line: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT s.ticker, s.i, coalesce(l.v, 0) AS x FROM s LEFT JOIN {line} l ON l.ticker = s.ticker AND l.i = s.i)"


#: key -> (more tables, columns of s, joins, outputs); see sql().
Parts = tuple[list[str], str, list[str], dict[str, str]]
INDICATORS: dict[str, Parts] = {}


def _plain(key: str, **outputs: str) -> None:
    INDICATORS[key] = ([], "", [], outputs)


def _weights(p: int) -> str:
    return f"[{', '.join(f'{2 * (k + 1)}e0 / {p * (p + 1)}' for k in range(p))}]"


def _wma(x: str, p: int) -> str:
    return f"CASE WHEN count({x}) {W(p)} = {p} THEN list_inner_product(list({x}) {W(p)}, {_weights(p)}) END"


_mid = lambda p: f"(max(high) {W(p)} + min(low) {W(p)}) / 2"
_tp = "(high + low + close) / 3"
_mf = div("((close - low) - (high - close)) * volume", "high - low", "0")

_plain("sma", value=full(f"avg(close) {W(20)}", 20))
_plain("wma", value=f"CASE WHEN i >= 19 THEN list_inner_product(list(close) {W(20)}, CASE WHEN i >= 19 THEN {_weights(20)} ELSE list_transform(list(close) {W(20)}, lambda y: 0e0) END) END")
INDICATORS["hull_ma"] = (
    [f"h AS (SELECT *, coalesce(2 * CASE WHEN i >= 9 THEN list_sum(list_transform(list_zip(list(close) {W(10)}, {_weights(10)}), lambda z: z[1] * z[2])) END - CASE WHEN i >= 19 THEN list_sum(list_transform(list_zip(list(close) {W(20)}, {_weights(20)}), lambda z: z[1] * z[2])) END, 0) AS raw FROM s)"],
    "h", [], {"value": f"CASE WHEN i >= 22 THEN list_sum(list_transform(list_zip(list(raw) {W(4)}, {_weights(4)}), lambda z: z[1] * z[2])) END"},
)
_plain("wma", value=f"CASE WHEN i >= 19 THEN list_sum(list_transform(list_zip(list(close) {W(20)}, {_weights(20)}), lambda z: z[1] * z[2])) END")
_plain("vwma", value=full(div(f"sum(close * volume) {W(20)}", f"sum(volume) {W(20)}", "close"), 20))
INDICATORS["ichimoku"] = (
    [f"k AS (SELECT *, {full(_mid(9), 9)} AS t, {full(_mid(26), 26)} AS b, {full(_mid(52), 52)} AS c FROM s)"],
    "k", [], {"tenkan": "t", "kijun": "b", "span_a": f"lag((t + b) / 2, 26) {O}", "span_b": f"lag(c, 26) {O}", "chikou": f"lead(close, 26) {O}"},
)
_plain("linear_regression", value=full(f"regr_intercept(close, i) {W(20)} + regr_slope(close, i) {W(20)} * i", 20))
_plain("donchian", middle=full(_mid(20), 20), upper=full(f"max(high) {W(20)}", 20), lower=full(f"min(low) {W(20)}", 20))
INDICATORS["cci"] = (
    [f"t AS (SELECT *, {_tp} AS tp FROM s), m AS (SELECT *, avg(tp) {W(20)} AS m, list(tp) {W(20)} AS l FROM t)"],
    "m", [], {"value": full(div("tp - m", "0.015e0 * list_sum(list_transform(l, lambda y: abs(y - m))) / 20", "0"), 20)},
)
_plain("roc", value=div(f"(close - lag(close, 12) {O}) * 100", f"lag(close, 12) {O}", "0"))
_plain("ts_momentum", value=div(f"(close - lag(close, 126) {O}) * 100", f"lag(close, 126) {O}", "0"))
_plain("williams_r", value=full(div(f"(max(high) {W(14)} - close) * -100", f"max(high) {W(14)} - min(low) {W(14)}", "-50"), 14))
_plain("momentum", value=f"close - lag(close, 10) {O}")
_plain("awesome_osc", value=full(f"avg((high + low) / 2) {W(5)} - avg((high + low) / 2) {W(34)}", 34))
_up, _lo = f"(avg(close) {W(20)} + 2 * stddev_pop(close) {W(20)})", f"(avg(close) {W(20)} - 2 * stddev_pop(close) {W(20)})"
_plain("bollinger", middle=full(f"avg(close) {W(20)}", 20), upper=full(_up, 20), lower=full(_lo, 20))
_plain("bb_pct_b", value=full(div(f"close - {_lo}", f"{_up} - {_lo}"), 20))
_plain("bb_width", value=full(div(f"({_up} - {_lo}) * 100", f"avg(close) {W(20)}"), 20))
INDICATORS["hist_vol"] = ([f"g AS (SELECT *, ln(close / pc) AS r FROM s)"], "g", [], {"value": f"CASE WHEN i >= 20 THEN stddev_samp(r) {W(20)} * sqrt(252) * 100 END"})
_plain("std_dev", value=full(f"stddev_pop(close) {W(20)}", 20))
_plain("obv", value=f"sum(CASE WHEN i = 0 THEN volume ELSE sign(close - pc) * volume END) {P}")
INDICATORS["obv"] = (["g AS (SELECT *, CASE WHEN i = 0 THEN volume ELSE sign(close - pc) * volume END AS f FROM s)"], "g", [], {"value": f"sum(f) {P}"})
_plain("vol_sma", value=full(f"avg(volume) {W(20)}", 20))
_plain("accum_dist", value=f"sum({_mf}) {P}")
_plain("cmf", value=full(div(f"sum({_mf}) {W(20)}", f"sum(volume) {W(20)}", "0"), 20))
INDICATORS["mfi"] = (
    [f"t AS (SELECT *, {_tp} AS tp FROM s), g AS (SELECT *, lag(tp) {O} AS ptp FROM t), f AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS u, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS d FROM g)"],
    "f", [], {"value": f"CASE WHEN i >= 14 THEN CASE WHEN sum(d) {W(14)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(u) {W(14)} / sum(d) {W(14)}) END END"},
)
_plain("vwap", value=div(f"sum({_tp} * volume) {P}", f"sum(volume) {P}", "close"))
INDICATORS["pivot_points"] = (
    [f"g AS (SELECT *, lag(high) {O} AS h, lag(low) {O} AS l FROM s), q AS (SELECT *, (h + l + pc) / 3 AS pp FROM g)"],
    "q", [], {"pp": "pp", "r1": "2 * pp - l", "s1": "2 * pp - h", "r2": "pp + h - l", "s2": "pp - h + l", "r3": "h + 2 * (pp - l)", "s3": "l - 2 * (h - pp)"},
)
_plain("price_vs_high_low", value=full(div(f"(close - min(low) {W(20)}) * 100", f"max(high) {W(20)} - min(low) {W(20)}", "50"), 20))
_plain("z_score", value=full(div(f"close - avg(close) {W(20)}", f"stddev_pop(close) {W(20)}", "0"), 20))
_plain("pct_from_high", value=full(div(f"(close - max(high) {W(52)}) * 100", f"max(high) {W(52)}", "0"), 52))
_plain("support_resistance", support=full(f"min(low) {W(20)}", 20), resistance=full(f"max(high) {W(20)}", 20))
_plain("close_price", value="close")

_tr = "CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END"
TR = f"tr AS MATERIALIZED (SELECT *, {_tr} AS tr, high - low AS hl FROM s)"


def _lines(key: str, tables: list[str], names: list[str], **outputs: str) -> None:
    INDICATORS[key] = (tables, "s", names, outputs)


_lines("ema", [ema("e", "s", "close", 20)], ["e"], value="e.v")
_lines("dema", [ema("e", "s", "close", 20), zeroed("z", "e"), ema("f", "z", "x", 20)], ["e", "f"], value="CASE WHEN s.i >= 38 THEN 2 * e.v - f.v END")
_lines("tema", [ema("e", "s", "close", 20), zeroed("z", "e"), ema("f", "z", "x", 20), zeroed("y", "f"), ema("g", "y", "x", 20)], ["e", "f", "g"], value="CASE WHEN s.i >= 57 THEN 3 * e.v - 3 * f.v + g.v END")
_CH = "d AS MATERIALIZED (SELECT ticker, i, coalesce(close - pc, 0) AS x, abs(coalesce(close - pc, 0)) AS a, greatest(coalesce(close - pc, 0), 0) AS u, greatest(coalesce(pc - close, 0), 0) AS w FROM s)"
_RSI = [_CH, wilder("gu", "d", "u", 14, 1), wilder("gd", "d", "w", 14, 1), "rs AS MATERIALIZED (SELECT gu.ticker, gu.i, CASE WHEN gd.v = 0 THEN 100 ELSE 100 - 100 / (1 + gu.v / gd.v) END AS v FROM gu JOIN gd ON gu.ticker = gd.ticker AND gu.i = gd.i)"]
_lines("rsi", _RSI, ["rs"], value="rs.v")
_lines(
    "stoch_rsi",
    [*_RSI, "r1 AS (SELECT ticker, i, v, max(v) OVER w AS hi, min(v) OVER w AS lo, count(*) OVER w AS n FROM rs WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))",
     "r2 AS (SELECT ticker, i, CASE WHEN hi = lo THEN 50 ELSE (v - lo) / (hi - lo) * 100 END AS v FROM r1 WHERE n = 14)",
     "r3 AS (SELECT * FROM (SELECT ticker, i, avg(v) OVER w AS v, count(*) OVER w AS n FROM r2 WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3)",
     "r4 AS (SELECT * FROM (SELECT ticker, i, avg(v) OVER w AS v, count(*) OVER w AS n FROM r3 WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3)"],
    ["r3", "r4"], k="r3.v", d="r4.v",
)


def _signalled(key: str, line: str) -> None:
    tables = [ema("e", "s", "close", 12), ema("f", "s", "close", 26), f"l AS MATERIALIZED (SELECT f.ticker, f.i, {line} AS v FROM e JOIN f ON e.ticker = f.ticker AND e.i = f.i)", zeroed("z", "l"), ema("g", "z", "x", 9)]
    _lines(key, tables, ["l", "g"], **{key: "l.v", "signal": "CASE WHEN s.i >= 33 THEN g.v END", "histogram": "CASE WHEN s.i >= 33 THEN l.v - g.v END"})


_signalled("macd", "e.v - f.v")
_signalled("ppo", "(e.v - f.v) * 100 / f.v")
_lines("tsi", [_CH, ema("e", "d", "x", 25), zeroed("z", "e"), ema("f", "z", "x", 13), ema("g", "d", "a", 25), zeroed("y", "g"), ema("h", "y", "x", 13)], ["f", "h"], value="CASE WHEN s.i >= 37 THEN " + div("f.v * 100", "h.v") + " END")
_lines("atr", [TR, wilder("a", "tr", "tr", 14, 0)], ["a"], value="a.v")
_lines("keltner", [TR, ema("e", "s", "close", 20), wilder("a", "tr", "tr", 10, 0)], ["e", "a"], middle="e.v", upper="e.v + 2 * a.v", lower="e.v - 2 * a.v")
_lines("chaikin_vol", [TR, ema("e", "tr", "hl", 10), "l AS (SELECT ticker, i, v, lag(v, 10) OVER (PARTITION BY ticker ORDER BY i) AS b FROM e)"], ["l"], value=div("(l.v - l.b) * 100", "l.b"))
_lines(
    "adx",
    [TR, f"mv AS MATERIALIZED (SELECT *, high - lag(high) {O} AS u, lag(low) {O} - low AS d FROM tr)",
     "dm AS MATERIALIZED (SELECT *, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS m FROM mv)",
     wilder("wt", "dm", "tr", 14, 1), wilder("wp", "dm", "p", 14, 1), wilder("wm", "dm", "m", 14, 1),
     f"di AS (SELECT wt.ticker, wt.i, {div('wp.v * 100', 'wt.v', '0')} AS p, {div('wm.v * 100', 'wt.v', '0')} AS m FROM wt JOIN wp ON wt.ticker = wp.ticker AND wt.i = wp.i JOIN wm ON wt.ticker = wm.ticker AND wt.i = wm.i)",
     f"dx AS MATERIALIZED (SELECT *, {div('abs(p - m) * 100', 'p + m', '0')} AS x FROM di)", wilder("ax", "dx", "x", 14, 14)],
    ["dx", "ax"], adx="ax.v", plus_di="dx.p", minus_di="dx.m",
)
_lines(
    "heikin_ashi",
    ["hc AS MATERIALIZED (SELECT *, (open + high + low + close) / 4 AS hc FROM s)",
     "ho(ticker, i, v, hc) AS (SELECT ticker, i, (open + close) / 2, hc FROM hc WHERE i = 0 UNION ALL SELECT n.ticker, n.i, (e.v + e.hc) / 2, n.hc FROM ho e JOIN hc n ON n.ticker = e.ticker AND n.i = e.i + 1)"],
    ["ho"], ha_close="ho.hc", ha_open="ho.v", ha_high="CASE WHEN s.i = 0 THEN s.high ELSE greatest(s.high, ho.v, ho.hc) END", ha_low="CASE WHEN s.i = 0 THEN s.low ELSE least(s.low, ho.v, ho.hc) END",
)
_SUPER = [
    TR, wilder("a", "tr", "tr", 10, 0),
    "bd AS MATERIALIZED (SELECT s.ticker, s.i, s.close, s.pc, (s.high + s.low) / 2 + 3 * a.v AS up, (s.high + s.low) / 2 - 3 * a.v AS lo FROM s JOIN a ON a.ticker = s.ticker AND a.i = s.i)",
    """st(ticker, i, up, lo, dir) AS (SELECT ticker, i, up, lo, 0 FROM bd WHERE i = 9 UNION ALL
       SELECT ticker, i, u, l, CASE WHEN dir = 1 THEN CASE WHEN close < l THEN -1 ELSE 1 END ELSE CASE WHEN close > u THEN 1 ELSE -1 END END
       FROM (SELECT n.ticker, n.i, n.close, e.dir, CASE WHEN n.pc < e.up THEN least(n.up, e.up) ELSE n.up END AS u, CASE WHEN n.pc > e.lo THEN greatest(n.lo, e.lo) ELSE n.lo END AS l
             FROM st e JOIN bd n ON n.ticker = e.ticker AND n.i = e.i + 1))""",
    "sd AS (SELECT ticker, i, CASE WHEN i >= 10 THEN CAST(dir AS DOUBLE) END AS v, CASE WHEN i >= 10 THEN CASE WHEN dir = 1 THEN lo ELSE up END END AS l FROM st)",
]
_lines("supertrend", _SUPER, ["sd"], direction="sd.v", supertrend="sd.l")
_lines(
    "parabolic_sar",
    [f"hl AS MATERIALIZED (SELECT ticker, i, high, low, lag(high) {O} AS h1, lag(low) {O} AS l1, lag(high, 2) {O} AS h2, lag(low, 2) {O} AS l2, lead(high) {O} AS nx FROM s)",
     """sar(ticker, i, v, up, af, ep) AS (SELECT ticker, i, CASE WHEN nx > high THEN low ELSE high END, nx > high, 0.02e0, CASE WHEN nx > high THEN high ELSE low END FROM hl WHERE i = 0 AND nx IS NOT NULL UNION ALL
        SELECT ticker, i, CASE WHEN flip THEN ep ELSE c END, up <> flip, CASE WHEN flip THEN 0.02e0 WHEN more THEN least(af + 0.02e0, 0.2e0) ELSE af END,
               CASE WHEN flip THEN CASE WHEN up THEN low ELSE high END WHEN more THEN CASE WHEN up THEN high ELSE low END ELSE ep END
        FROM (SELECT *, CASE WHEN up THEN low < c ELSE high > c END AS flip, CASE WHEN up THEN high > ep ELSE low < ep END AS more
              FROM (SELECT n.*, e.up, e.af, e.ep, CASE WHEN e.up THEN least(e.v + e.af * (e.ep - e.v), n.l1, coalesce(n.l2, n.l1)) ELSE greatest(e.v + e.af * (e.ep - e.v), n.h1, coalesce(n.h2, n.h1)) END AS c
                    FROM sar e JOIN hl n ON n.ticker = e.ticker AND n.i = e.i + 1)))"""],
    ["sar"], value="sar.v",
)


def indicator_tables(key: str) -> tuple[str, str, str, dict[str, str]]:
    """Tables to add, what to select from, joins, outputs."""
    tables, source, lines, outputs = INDICATORS[key]
    source = source or "s"
    joins = "".join(f" LEFT JOIN {x} ON {x}.ticker = s.ticker AND {x}.i = s.i" for x in lines)
    return ", ".join([SERIES, *tables]), source, joins, outputs


def indicator_sql(key: str, digits: int = 4) -> str:
    tables, source, joins, outputs = indicator_tables(key)
    shown = ", ".join(f"{grid(x, digits)} AS {o}" for o, x in outputs.items())
    return f"WITH RECURSIVE {tables} SELECT {source}.ticker, {source}.date, {shown} FROM {source}{joins}"
