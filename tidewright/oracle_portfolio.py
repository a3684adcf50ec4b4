"""DuckDB SQL that says again what the factor and portfolio operators compute, for comparison. Not used by any operator."""

from __future__ import annotations

from .operators.factors import DIRECTION, FACTORS, PRESETS
from .oracle_series import BARS_SUPPLIER, BARS_TYPE, INSTRUMENTS, O, P, grid

#: The fixture's stand-in for fundamentals, in SQL that both engines read.
FUNDAMENTALS = """
SELECT s_name AS ticker, CAST(CASE WHEN s_suppkey % 7 <> 0 THEN 5 + s_suppkey % 40 END AS DOUBLE) AS pe, s_acctbal / 2000 AS pb, CAST(s_suppkey % 13 AS DOUBLE) / 20 AS roe,
       s_acctbal / 10000 AS rev_growth, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 29 END AS DOUBLE) / 10 AS de FROM supplier
"""

_S = f"b AS MATERIALIZED ({BARS_SUPPLIER}), s AS MATERIALIZED (SELECT *, lag(close) {O} AS pc, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM b)"
PROXY = [
    _S,
    "dr AS (SELECT date, avg(CASE WHEN pc > 0 THEN close / pc - 1 END) AS r FROM s GROUP BY date)",
    "px AS MATERIALIZED (SELECT date, 100 * exp(sum(CASE WHEN rn = 1 THEN 0 ELSE ln(1 + coalesce(r, 0)) END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS level FROM (SELECT *, row_number() OVER (ORDER BY date) AS rn FROM dr))",
]
_ret = lambda x, p: f"coalesce(CASE WHEN {p} <> 0 THEN {x} / {p} - 1 WHEN {p} = 0 THEN 0 END, 0)"
_at = lambda k: f"max(CASE WHEN back = {k} THEN close END)"
_chg = lambda e, s: f"CASE WHEN {_at(s)} > 0 THEN {_at(e)} / {_at(s)} - 1 END"
FACTOR_TABLES = [
    *PROXY,
    f"m AS (SELECT s.*, level AS market, lag(level) OVER (PARTITION BY ticker ORDER BY s.date) AS pm FROM s LEFT JOIN px ON px.date = s.date)",
    f"rr AS (SELECT *, {_ret('close', 'pc')} AS r, {_ret('market', 'pm')} AS mr FROM m)",
    f"""pf AS MATERIALIZED (SELECT ticker, CASE WHEN count(*) >= 253 THEN {_chg(22, 253)} END AS mom12_1, CASE WHEN count(*) >= 127 THEN {_chg(22, 127)} END AS mom6_1,
        CASE WHEN count(*) >= 253 THEN stddev_samp(r) FILTER (back <= 252) * sqrt(252) END AS low_vol, CASE WHEN count(*) >= 6 THEN -({_chg(1, 6)}) END AS short_rev,
        CASE WHEN count(*) >= 253 AND count(*) FILTER (back <= 252 AND mr < 0) >= 2 THEN regr_slope(r, mr) FILTER (back <= 252 AND mr < 0) END AS low_beta,
        CASE WHEN count(*) >= 21 THEN avg((high - low) / close) FILTER (back <= 21 AND close > 0) END AS low_disp FROM rr GROUP BY ticker)""",
    f"fu AS ({FUNDAMENTALS})",
    "fa AS MATERIALIZED (SELECT * FROM pf LEFT JOIN fu USING (ticker))",
    "lf AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, {f} AS value FROM fa" for f in FACTORS) + ")",
    "mo AS (SELECT factor, avg(value) AS mu, stddev_pop(value) AS sd FROM lf GROUP BY factor)",
    "cl AS (SELECT lf.*, sd, CASE WHEN value IS NOT NULL THEN greatest(least(value, mu + 3 * sd), mu - 3 * sd) END AS c FROM lf JOIN mo USING (factor))",
    "mo2 AS (SELECT factor, avg(c) AS mu2, stddev_pop(c) AS sd2 FROM cl GROUP BY factor)",
    "zs AS MATERIALIZED (SELECT ticker, factor, value, coalesce(CASE WHEN sd > 0 AND sd2 > 0 THEN (c - mu2) / sd2 END, 0) AS z FROM cl JOIN mo2 USING (factor))",
    "dn AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {d})" for f, d in DIRECTION.items()) + ") t(factor, d))",
    f"ins AS ({INSTRUMENTS})",
]


def score_tables(preset: str) -> list[str]:
    weights = ", ".join(f"('{f}', {w!r}e0)" for f, w in zip(FACTORS, PRESETS[preset], strict=True) if w)
    return [*FACTOR_TABLES, f"wt AS (SELECT * FROM (VALUES {weights}) t(factor, w))", "co AS (SELECT ticker, factor, z, w * d * z AS contribution FROM zs JOIN wt USING (factor) JOIN dn USING (factor))", "sc AS (SELECT ticker, sum(contribution) AS score FROM co GROUP BY ticker)"]


def select(tables: list[str], columns: str, source: str) -> str:
    return f"WITH RECURSIVE {', '.join(tables)} SELECT {columns} FROM {source}"


#: The portfolio fixture: six part types, weights k / 21 and sectors of two by name order.
MEMBERS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SECTORS = ["A", "A", "B", "B", "C", "C"]
_T = f"b AS MATERIALIZED ({BARS_TYPE})"
WEIGHTS = "wt AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {k} / 21e0)" for k, t in enumerate(MEMBERS, 1)) + ") t(ticker, weight))"
EVEN = "wt AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', 1 / 6e0)" for t in MEMBERS) + ") t(ticker, weight))"
RETURNS = [_T, f"rt AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, row_number() {O} AS n, CASE WHEN lag(close) {O} > 0 THEN close / lag(close) {O} - 1 END AS ret FROM b) WHERE n > 1)"]
ALIGNED = [
    *RETURNS,
    "tt AS (SELECT ticker, coalesce(ret, 0) AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS t FROM rt)",
    "al AS MATERIALIZED (SELECT * FROM tt WHERE t <= (SELECT min(n) FROM (SELECT max(t) AS n FROM tt GROUP BY ticker)))",
    "st AS MATERIALIZED (SELECT ticker, avg(ret) * 252 AS mu, stddev_samp(ret) * sqrt(252) AS sigma FROM al GROUP BY ticker)",
    "cv AS MATERIALIZED (SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr FROM al a JOIN al b ON a.t = b.t GROUP BY ALL)",
    "sk AS (SELECT i, j, (1 - a) * cov + CASE WHEN i = j THEN a * av ELSE 0 END AS cov FROM cv, (SELECT avg(cov) AS av, greatest(least(count(*) / (count(*) + (SELECT max(t) FROM al)::DOUBLE), 0.5e0), 0.01e0) AS a FROM cv WHERE i = j))",
    "an AS MATERIALIZED (SELECT i, j, cov * 252 AS cov FROM sk)",
    WEIGHTS,
    "sw AS MATERIALIZED (SELECT i, any_value(wi.weight) AS wi, sum(cov * wj.weight) AS sw FROM an JOIN wt wi ON wi.ticker = i JOIN wt wj ON wj.ticker = j GROUP BY i)",
    "iv AS (SELECT ticker, 1 / sigma AS v FROM st)",
]
SERIES = [
    _T, WEIGHTS,
    "ix AS MATERIALIZED (SELECT * FROM b WHERE date IN (SELECT date FROM b GROUP BY date HAVING count(*) = 6))",
    f"ir AS (SELECT *, lag(close) {O} AS pc FROM ix)",
    "pr AS MATERIALIZED (SELECT date, sum(weight * CASE WHEN pc > 0 THEN close / pc - 1 ELSE 0 END) AS ret FROM ir JOIN wt USING (ticker) WHERE pc IS NOT NULL GROUP BY date)",
    "eq AS MATERIALIZED (SELECT date, ret, 100 * product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM pr)",
    "dd AS MATERIALIZED (SELECT *, (max(equity) OVER w - equity) / max(equity) OVER w AS dd, CASE WHEN equity >= max(equity) OVER w THEN 1 ELSE 0 END AS hi FROM eq WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))",
]
_w126 = "OVER (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"
_r126 = f"count(*) {_w126} = 126"
ROLLING_VOL = f"date, {grid(f'CASE WHEN {_r126} THEN stddev_samp(ret) {_w126} * sqrt(252) END')} AS volatility"
ROLLING_SHARPE = f"date, {grid(f'CASE WHEN {_r126} THEN (avg(ret) {_w126} - 0.06e0 / 252) / stddev_samp(ret) {_w126} * sqrt(252) END')} AS sharpe"
RISK = ", ".join(f"{grid(x)} AS {k}" for k, x in {
    "ann_volatility": "stddev_samp(ret) * sqrt(252)", "sharpe": "(avg(ret) - 0.06e0 / 252) / stddev_samp(ret) * sqrt(252)", "sortino": "avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252)", "max_drawdown": "max(dd)", "calmar": "avg(ret) * 252 / max(dd)",
}.items())
EPISODES = [
    *SERIES,
    "g AS (SELECT *, sum(hi) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM dd)",
    "ep AS (SELECT g, min(date) AS peak_date, max(equity) AS pk, min(equity) AS lo, arg_min(date, (equity, date)) AS trough_date FROM g GROUP BY g)",
    "er AS (SELECT *, lead(peak_date) OVER (ORDER BY g) AS recovery_date FROM ep)",
]


def histogram(tables: list[str], source: str, column: str, buckets: str) -> str:
    parts = [
        *tables, f"hx AS MATERIALIZED (SELECT {column} AS x FROM {source})",
        f"he AS MATERIALIZED (SELECT lo, hi, k, (hi - lo) / k AS w FROM (SELECT min(x) AS lo, max(x) AS hi, CAST({buckets} AS INT) AS k FROM hx))",
        "hc AS (SELECT CAST(least(floor((x - lo) / w), k - 1) AS INT) AS bucket, count(*) AS n FROM hx, he GROUP BY ALL)",
        "hs AS (SELECT CAST(unnest(range(0, k)) AS INT) AS bucket, lo, w, hi, k FROM he)",
    ]
    return select(parts, f"hs.bucket AS bucket, {grid('lo + hs.bucket * w')} AS low, {grid('CASE WHEN hs.bucket = k - 1 THEN hi ELSE lo + (hs.bucket + 1) * w END')} AS high, coalesce(n, 0) AS n", "hs LEFT JOIN hc ON hc.bucket = hs.bucket")


def dca(frequency: str) -> str:
    pays = f"(row_number() {O} - 1) % 5 = 0" if frequency == "weekly" else f"coalesce(date_trunc('month', date) <> date_trunc('month', lag(date) {O}), true)"
    parts = [_T, f"py AS (SELECT *, CASE WHEN {pays} THEN 1 ELSE 0 END AS pay FROM b)", "pp AS (SELECT *, 1000000e0 * pay / sum(pay) OVER (PARTITION BY ticker) AS part FROM py)"]
    return select(parts, f"ticker, date, {grid(f'sum(part) {P}', 2)} AS invested, {grid(f'sum(part / close) {P} * close', 2)} AS value", "pp")


LUMP = select([_T], f"ticker, date, {grid(f'1000000e0 * close / first_value(close) {P}', 2)} AS value", "b")


def annualized(frequency: str) -> str:
    pays = f"coalesce(date_trunc('{frequency.removesuffix('ly')}', date) <> date_trunc('{frequency.removesuffix('ly')}', lag(date) {O}), true)"
    parts = [_T, f"py AS (SELECT *, CASE WHEN {pays} THEN 1 ELSE 0 END AS pay FROM b)", "pp AS (SELECT *, 1000000e0 * pay / sum(pay) OVER (PARTITION BY ticker) AS part FROM py)"]
    return select(parts, f"ticker, {grid('pow(sum(part / close) * arg_max(close, date) / sum(part), 252e0 / count(*)) - 1')} AS annualized", "pp GROUP BY ticker")


def _nested(source: str, *steps: str) -> str:
    """A query that adds one column after the other, each of those before."""
    for step in steps:
        source = f"(SELECT *, {step} FROM {source})"
    return source


_TIMES = "list_transform(cov, lambda r: list_dot_product(r, {0}))"
_CLIP = "list_transform({0}, lambda v: greatest(0e0, least(v, 0.25e0)))"
_SUM_TO_1 = "CASE WHEN list_sum({0}) >= 1e-15 THEN list_transform({0}, lambda v: v / list_sum({0})) ELSE list_transform({0}, lambda v: 1e0 / n) END"
_CAP = "list_transform(list_zip({0}, list_transform(same, lambda r: list_dot_product(r, {0}))), lambda p: p[1] * CASE WHEN p[2] > 0.4e0 THEN 0.4e0 / p[2] ELSE 1e0 END)"
#: The members' covariances, returns, deviations and who shares a sector, as lists in one row.
_LISTS = """mx AS MATERIALIZED (SELECT (SELECT list(r ORDER BY i) FROM (SELECT i, list(cov ORDER BY j) AS r FROM an GROUP BY i)) AS cov,
    (SELECT list(mu ORDER BY ticker) FROM st) AS mu, (SELECT list(sigma ORDER BY ticker) FROM st) AS sigma, (SELECT list(ticker ORDER BY ticker) FROM st) AS names,
    (SELECT list(r ORDER BY t) FROM (SELECT a.ticker AS t, list(CASE WHEN a.sector = b.sector THEN 1e0 ELSE 0e0 END ORDER BY b.ticker) AS r FROM se a, se b GROUP BY a.ticker)) AS same,
    (SELECT count(*) FROM st) AS n, pt, {goal} AS goal FROM {points})"""
_EQUAL = "list_transform(names, lambda x: 1e0 / n)"


def _descent(value: str, slope: str) -> str:
    """Projected gradient steps from equal weights for each row (pt) of mx, as a recursive table; value and slope are of weights {0} with cov * {0} as {1}."""
    start = _nested("mx", f"{_EQUAL} AS w", f"{_TIMES.format('w')} AS cw")
    step = _nested(
        "(SELECT * FROM it JOIN mx USING (pt) WHERE step < 1000 AND NOT stop)", f"{_TIMES.format('w')} AS cw", f"{slope.format('w', 'cw')} AS slope", "list_transform(list_zip(w, slope), lambda p: p[1] - rate * p[2]) AS x",
        f"{_CLIP.format('x')} AS x1", f"{_CAP.format('x1')} AS x2", f"{_SUM_TO_1.format('x2')} AS tried", f"{_TIMES.format('tried')} AS ct", f"{value.format('tried', 'ct')} AS value", "sqrt(list_dot_product(slope, slope)) < 1e-8 AS small",
    )
    return f"""it(pt, step, w, rate, best, stop) AS (SELECT pt, 0, w, 0.01e0, {value.format('w', 'cw')}, false FROM {start}
    UNION ALL SELECT pt, step + 1, CASE WHEN value < best THEN tried ELSE w END, rate * CASE WHEN value < best THEN 1e0 ELSE 0.95e0 END * CASE WHEN (step + 1) % 100 = 0 THEN 0.5e0 ELSE 1e0 END, least(value, best), small FROM {step})"""


def _per_risk(reward: str, free: str) -> str:
    vol = "sqrt(greatest(list_dot_product({0}, {1}), 1e-15))"
    over = f"(list_dot_product({{0}}, {reward}) - {free})"
    return _descent(f"-{over} / {vol}", f"list_transform(list_zip({{1}}, {reward}), lambda p: {over} * p[1] / {vol} ** 3 - p[2] / {vol})")


def _parity() -> str:
    """Weights in proportion to one over the marginal risk, clipped, until they stay."""
    step = _nested(
        "(SELECT * FROM it, mx WHERE step < 1000 AND NOT stop)", f"{_TIMES.format('w')} AS cw", "sqrt(greatest(list_dot_product(w, cw), 1e-15)) AS vol", "list_transform(cw, lambda v: CASE WHEN v / vol > 1e-15 THEN vol / v ELSE 0e0 END) AS inv",
        "list_transform(inv, lambda v: v / list_sum(inv)) AS x", f"{_CLIP.format('x')} AS x1", f"{_SUM_TO_1.format('x1')} AS new", "list_max(list_transform(list_zip(new, w), lambda p: abs(p[1] - p[2]))) AS moved",
    )
    return f"it(step, w, stop) AS (SELECT 0, {_EQUAL}, false FROM mx UNION ALL SELECT step + 1, new, moved < 1e-8 FROM {step})"


#: The iterative methods' walks; the weights of their last row are projected once more.
_WALKS = {
    "risk_parity": _parity(),
    "min_variance": _descent("list_dot_product({0}, {1})", "list_transform({1}, lambda v: 2 * v)"),
    "max_sharpe": _per_risk("mu", "0.06e0"),
    "max_diversification": _per_risk("sigma", "0e0"),
    "target_vol": _per_risk("mu", "0.06e0"),  # scaled to the target and back to a sum of 1
}


def optimised(method: str) -> str:
    """Weights of a method, clipped at 0.25, sectors scaled down to 0.4, then summing to 1; the iterative ones walk in a recursive table."""
    closed = {"equal": "SELECT ticker, 1e0 / count(*) OVER () AS w FROM st", "inverse_vol": "SELECT ticker, v / sum(v) OVER () AS w FROM iv"}
    start = closed.get(method, "SELECT unnest(names) AS ticker, unnest(w) AS w FROM (SELECT w, names FROM it, mx ORDER BY step DESC LIMIT 1)")
    walk = [_LISTS.format(goal="0e0", points="range(1) r(pt)"), _WALKS[method]] if method in _WALKS else []
    sectors = "se AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{s}')" for t, s in zip(MEMBERS, SECTORS, strict=True)) + ") t(ticker, sector))"
    parts = [
        *ALIGNED, sectors, *walk, f"w0 AS ({start})",
        "w1 AS (SELECT ticker, sector, greatest(least(w, 0.25e0), 0e0) AS w FROM w0 JOIN se USING (ticker))",
        "w2 AS (SELECT ticker, w * CASE WHEN sum(w) OVER (PARTITION BY sector) > 0.4e0 THEN 0.4e0 / sum(w) OVER (PARTITION BY sector) ELSE 1e0 END AS w FROM w1)",
        "w3 AS MATERIALIZED (SELECT ticker, w / sum(w) OVER () AS w FROM w2)",
        "cw AS MATERIALIZED (SELECT i AS ticker, any_value(a.w) AS w, sum(cov * b.w) AS sw FROM an JOIN w3 a ON a.ticker = i JOIN w3 b ON b.ticker = j GROUP BY i)",
        "fg AS (SELECT sum(cw.w * mu) AS r, sum(cw.w * sigma) AS ws, sqrt(sum(cw.w * sw)) AS vol FROM cw JOIN st USING (ticker))",
    ]
    figures = {"weight": "w", "risk_contribution": "w * sw / (vol * vol)", "expected_return": "r", "volatility": "vol", "sharpe": "(r - 0.06e0) / vol", "diversification_ratio": "ws / vol"}
    return select(parts, "'all' AS portfolio_id, ticker, " + ", ".join(f"{grid(x)} AS {k}" for k, x in figures.items()), "cw, fg")


def frontier(points: int = 25) -> str:
    """Least variance with a penalty on missing each target return, by volatility, none within 0.001 of the last kept."""
    off = "(list_dot_product({0}, mu) - goal)"
    goal = f"(SELECT min(mu) FROM st) + pt * ((SELECT max(mu) FROM st) - (SELECT min(mu) FROM st)) / {points - 1}"
    walk = _descent(f"list_dot_product({{0}}, {{1}}) + 100 * {off} ** 2", f"list_transform(list_zip({{1}}, mu), lambda p: 2 * (p[1] + 100 * {off} * p[2]))")
    last = _nested(
        "(SELECT mx.*, w FROM (SELECT pt, arg_max(w, step) AS w FROM it GROUP BY pt) JOIN mx USING (pt))", f"{_CLIP.format('w')} AS x1", f"{_CAP.format('x1')} AS x2", f"{_SUM_TO_1.format('x2')} AS z", f"{_TIMES.format('z')} AS cz",
        "sqrt(greatest(list_dot_product(z, cz), 0e0)) AS vol", "list_dot_product(z, mu) AS reward",
    )
    sectors = "se AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{s}')" for t, s in zip(MEMBERS, SECTORS, strict=True)) + ") t(ticker, sector))"
    parts = [
        *ALIGNED, sectors, _LISTS.format(goal=goal, points=f"range({points}) r(pt)"), walk,
        f"po AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vol, pt) AS k, vol, reward, z FROM {last})",
        "kp(k, point, vol) AS (SELECT k, 0, vol FROM po WHERE k = 1 UNION ALL SELECT * FROM (SELECT po.k, kp.point + 1, po.vol FROM kp JOIN po ON po.k > kp.k AND po.vol - kp.vol > 0.001e0 ORDER BY po.k LIMIT 1))",
    ]
    weights = f"list_transform(z, lambda v: {grid('v')})"
    return select(parts, f"'all' AS portfolio_id, point, {grid('reward')} AS return, {grid('po.vol')} AS volatility, {grid('(reward - 0.06e0) / po.vol')} AS sharpe, {weights} AS weights", "kp JOIN po USING (k)")


#: Prices of a unit of return in variance that the registered query asks for.
SLOPES = [0.0, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0]


def frontier_at() -> str:
    """Least variance less slope times return, weights between 0 and 0.25: what a member gains another gives, the pair of the most different gradients first, until none differ."""
    step = _nested(
        "(SELECT * FROM it JOIN mx USING (pt) WHERE step < 3000 AND NOT stop)", f"list_transform(list_zip({_TIMES.format('w')}, mu), lambda p: p[1] - goal * p[2]) AS g",
        "list_transform(list_zip(g, w), lambda p: CASE WHEN p[2] < 0.25e0 - 1e-13 THEN p[1] ELSE 1e300 END) AS up", "list_transform(list_zip(g, w), lambda p: CASE WHEN p[2] > 1e-13 THEN p[1] ELSE -1e300 END) AS down",
        "list_position(up, list_min(up)) AS i, list_position(down, list_max(down)) AS j", "g[j] - g[i] < 1e-11 AS even",
        "CASE WHEN even THEN 0e0 ELSE least((g[j] - g[i]) / (cov[i][i] + cov[j][j] - 2 * cov[i][j]), 0.25e0 - w[i], w[j]) END AS t", "list_transform(range(1, n + 1), lambda k: w[k] + CASE WHEN k = i THEN t WHEN k = j THEN -t ELSE 0e0 END) AS moved",
    )
    walk = f"it(pt, step, w, stop) AS (SELECT pt, 0, {_EQUAL}, false FROM mx UNION ALL SELECT pt, step + 1, moved, even FROM {step})"
    last = _nested("(SELECT mx.*, w FROM (SELECT pt, arg_max(w, step) AS w FROM it GROUP BY pt) JOIN mx USING (pt))", f"{_TIMES.format('w')} AS cw", "list_dot_product(w, mu) AS reward, sqrt(list_dot_product(w, cw)) AS vol")
    sectors = "se AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{s}')" for t, s in zip(MEMBERS, SECTORS, strict=True)) + ") t(ticker, sector))"
    goal = f"CAST({SLOPES}[pt + 1] AS DOUBLE)"
    parts = [*ALIGNED, sectors, _LISTS.format(goal=goal, points=f"range({len(SLOPES)}) r(pt)"), walk, f"po AS (SELECT goal, reward, vol, unnest(names) AS ticker, unnest(w) AS w FROM {last})"]
    return select(parts, f"'all' AS portfolio_id, {grid('goal')} AS slope, ticker, {grid('w')} AS weight, {grid('reward')} AS return, {grid('vol')} AS volatility", "po")
