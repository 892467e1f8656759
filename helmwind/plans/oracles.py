"""DuckDB SQL of the registered queries, written from their definitions and not from their plans."""

from __future__ import annotations

_CLOSES = """
c AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 4) AS close
      FROM orders GROUP BY 1, 2),
x AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) * 100, 4) AS rf_raw, round(avg(l_quantity), 4) AS qty
      FROM lineitem GROUP BY 1),
raw AS (SELECT c.series_id, c.date, c.close, x.rf_raw, x.qty FROM c ASOF LEFT JOIN x ON c.date >= x.date)"""

_BACK = "PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_AHEAD = "PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
_W = "PARTITION BY series_id ORDER BY date"


def _clean(start: str | None = None) -> str:
    """CTEs from raw to the clean panel p."""
    within = f"AND date >= DATE '{start}'" if start else ""
    return f"""filled AS (SELECT series_id, date, close, qty,
             coalesce(last_value(rf_raw IGNORE NULLS) OVER ({_BACK}), first_value(rf_raw IGNORE NULLS) OVER ({_AHEAD})) AS rf_raw
           FROM raw),
ret AS (SELECT *, rf_raw / 100 / 252 AS rf, close / lag(close) OVER ({_W}) - 1 AS ret FROM filled),
live AS (SELECT *, ret - rf AS excess_ret FROM ret WHERE ret IS NOT NULL {within}),
p AS (SELECT series_id, date, close, rf_raw, rf, ret, excess_ret, last_value(qty IGNORE NULLS) OVER ({_BACK}) AS qty,
        CAST(row_number() OVER ({_W}) - 1 AS INTEGER) AS pos FROM live)"""


_PANEL = f"{_CLOSES}, {_clean()}"

_DIRTY = f"""d AS (SELECT o_orderpriority AS series_id, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS close, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 400) / 100.0 END AS rf_raw,
        CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS qty FROM orders),
k AS (SELECT * FROM d WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY o_orderkey DESC) = 1),
raw AS (SELECT * FROM k WHERE close IS NOT NULL), {_clean("1993-01-01")}"""

_ONE_SERIES = f"""c AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY 1),
x AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) * 100, 4) AS rf_raw, round(avg(l_quantity), 4) AS qty FROM lineitem GROUP BY 1),
raw AS (SELECT 'ALL' AS series_id, c.date, c.close, CASE WHEN day(c.date) % 3 <> 0 THEN x.rf_raw END AS rf_raw,
          CASE WHEN day(c.date) % 3 <> 0 THEN x.qty END AS qty FROM c ASOF LEFT JOIN x ON c.date >= x.date
        WHERE day(c.date) % 7 <> 0 AND day(c.date) % 5 <> 0), {_clean("1993-01-01")}"""

_CLEAN_COLUMNS = "series_id, date, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("close", "rf_raw", "rf", "ret", "excess_ret", "qty"))

_GAPS = f"""{_CLOSES},
g AS (SELECT series_id, date, CASE WHEN day(date) % 5 <> 0 THEN close END AS close,
        CASE WHEN day(date) % 3 <> 0 THEN rf_raw END AS rf_raw, CASE WHEN day(date) % 3 <> 0 THEN qty END AS qty FROM raw)"""

_MONTHLY = f"""{_CLOSES},
m AS (SELECT date, rf_raw, CASE WHEN month(date) % 2 = 0 THEN qty END AS qty FROM x WHERE day(date) = 1)"""


def _ewm(value: str, source: str = "p") -> str:
    """Exponentially weighted means at three halflives by a triangular join, as columns e5, e20, e60 of CTE e."""
    parts = ", ".join(
        f"sum(b.v * power(0.5, (a.pos - b.pos) / {h}.0)) / sum(CASE WHEN b.v IS NOT NULL THEN power(0.5, (a.pos - b.pos) / {h}.0) END) AS e{h}"
        for h in (5, 10, 20, 60)
    )
    return f"""SELECT a.series_id, a.date, a.pos, {parts}
               FROM {source} a JOIN (SELECT series_id, pos, {value} AS v FROM {source}) b
                 ON a.series_id = b.series_id AND b.pos <= a.pos GROUP BY 1, 2, 3"""


_MOMENTS = f"""{_PANEL}, em AS ({_ewm("ret")}), ed AS ({_ewm("power(least(ret, 0), 2)")}), es AS ({_ewm("ret * ret")})"""


def _three(expression: str, source: str) -> str:
    columns = ", ".join(f"round({expression.format(h=h)}, 6) AS hl_{h}" for h in (5, 20, 60))
    return f"WITH {_MOMENTS} SELECT series_id, date, {columns} FROM {source}"


_SORTINO = "CASE WHEN sqrt(ed.e{h}) <> 0 THEN em.e{h} / sqrt(ed.e{h}) END"
_LOGDD = "CASE WHEN ed.e{h} > 0 THEN ln(sqrt(ed.e{h})) END"
_VOLLOG = "CASE WHEN es.e{h} > 0 THEN ln(sqrt(es.e{h})) END"
_JOINED = "em JOIN ed USING (series_id, date, pos)"


def _r(expression: str, name: str) -> str:
    return f'round({expression}, 6) AS "{name}"'


_PAPER = [_r("sqrt(ed.e10)", "DD_10"), _r(_SORTINO.format(h=20), "sortino_20"), _r(_SORTINO.format(h=60), "sortino_60")]
_EXAMPLE = [
    _r(e.format(h=h), f"{n}_{h}") for h in (5, 20, 60) for e, n in (("em.e{h}", "ret"), (_LOGDD, "DD-log"), (_SORTINO, "sortino"))
]


def _frame(w: int) -> str:
    return f"{_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW"


def _rolling(expression: str, w: int) -> str:
    return f"CASE WHEN count(ret) OVER ({_frame(w)}) = {w} THEN {expression.format(f=f'OVER ({_frame(w)})')} END"


_EXTRA_BASE = f"""{_MOMENTS},
k AS (SELECT p.series_id, p.date, p.pos, p.ret, em.e5 AS m5, em.e20 AS m20, em.e60 AS m60,
        sqrt(ed.e5) AS d5, sqrt(ed.e10) AS d10, sqrt(ed.e20) AS d20, sqrt(ed.e60) AS d60,
        {", ".join(f"{_VOLLOG.format(h=h)} AS v{h}" for h in (5, 20, 60))},
        CASE WHEN ret > -1 THEN ln(1 + ret) END AS lr
      FROM p JOIN em USING (series_id, date, pos) JOIN ed USING (series_id, date, pos) JOIN es USING (series_id, date, pos))"""
_EXTRA = (
    [_r(e.format(h=h), f"{n}_{h}") for h in (5, 20, 60) for e, n in (("m{h}", "ret"), ("CASE WHEN d{h} <> 0 THEN m{h} / d{h} END", "sortino"))]
    + [_r("ret", "ret-simple"), _r("lr", "ret-log"), _r("abs(ret)", "ret-abs"), _r("ret * ret", "ret-sq")]
    + [_r(f"CASE WHEN lr IS NOT NULL THEN sum(lr) OVER ({_BACK}) END", "ret-cumlog")]
    + [
        _r(_rolling(e, w), f"{n}_{w}")
        for w in (5, 20, 60)
        for e, n in (
            ("stddev_samp(ret) {f}", "std"),
            ("var_samp(ret) {f}", "var"),
            ("avg(abs(ret)) {f}", "mad"),
            ("sqrt(avg(ret * ret) {f})", "rms"),
        )
    ]
    + [_r(f"v{h}", f"vol-log_{h}") for h in (5, 20, 60)]
    + [_r(f"v{h} - lag(v{h}, {h}) OVER ({_W})", f"vol-chg_{h}") for h in (5, 20, 60)]
    + [_r(f"v{a} - v{b}", f"vol-ratio_{a}-{b}") for a, b in ((5, 20), (20, 60))]
    + [_r(f"d{h}", f"DD_{h}") for h in (5, 10, 20, 60)]
)

_RULE = f"""{_PANEL},
v AS (SELECT series_id, date, ret, rf, CASE WHEN count(ret) OVER ({_frame(20)}) = 20 THEN stddev_samp(ret) OVER ({_frame(20)}) END AS vol FROM p),
g AS (SELECT series_id, date, ret, rf, CAST(vol > avg(vol) OVER ({_frame(60)}) AS INTEGER) AS regime FROM v WHERE vol IS NOT NULL)"""


def _strategy(name: str, delay: int = 1, buy: float = 10, sell: float = 10, bull: float = 1.0, rest: float = 0.0, source: str = "g", key: str = "") -> str:
    """CTEs of a strategy table called ``name``."""
    w = f"PARTITION BY series_id{key} ORDER BY date"
    return f"""{name}_w AS (SELECT *, coalesce(lag(CASE WHEN regime = 0 THEN {bull}::DOUBLE ELSE {rest}::DOUBLE END, {delay + 1}) OVER ({w}), {bull}::DOUBLE) AS weight FROM {source}),
{name}_d AS (SELECT *, coalesce(weight - lag(weight) OVER ({w}), 0) AS change FROM {name}_w),
{name}_c AS (SELECT *, greatest(change, 0) AS bought, greatest(-change, 0) AS sold, abs(change) AS traded,
               greatest(change, 0) * {buy} / 1e4 + greatest(-change, 0) * {sell} / 1e4 AS cost FROM {name}_d),
{name} AS (SELECT *, ret AS bh, weight * ret + (1 - weight) * rf - cost AS jm FROM {name}_c)"""


def _metrics(rows: str, keys: str) -> str:
    """CTE t of the metrics, from rows (series_id, keys, date, r, rf, weight, traded, cost)."""
    part = f"PARTITION BY series_id, {keys}"
    return f"""wealth AS (SELECT *, product(1 + r) OVER ({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth,
              quantile_cont(r, 0.05) OVER ({part}) AS tail FROM {rows}),
dd AS (SELECT *, wealth / max(wealth) OVER ({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM wealth),
a AS (SELECT series_id, {keys}, power(product(1 + r), 252.0 / count(*)) - 1 AS ret, stddev_samp(r) * sqrt(252.0) AS vol,
        avg(r - rf) * 252 AS excess, min(drawdown) AS mdd, avg(CASE WHEN r <= tail THEN r END) AS es,
        sum(traded) / 2 * 252.0 / count(*) AS turnover, avg(weight) AS leverage, avg(cost) * 252 AS cost FROM dd GROUP BY series_id, {keys}),
t AS (SELECT series_id, {keys}, unnest(['Return', 'Volatility', 'Sharpe', 'MDD', 'Calmar', 'ES_0.05', 'Turnover', 'Leverage', 'Cost']) AS metric,
        unnest([ret, vol, CASE WHEN vol > 0 THEN excess / vol END, mdd, CASE WHEN mdd < 0 THEN excess / abs(mdd) END, es, turnover, leverage, cost]) AS value
      FROM a)"""


def _long(tables: dict[str, str]) -> str:
    """CTE rows: buy and hold of the first table and each table's strategy."""
    first = next(iter(tables))
    parts = [f"SELECT series_id, 'B & H' AS strategy, date, bh AS r, rf, 1.0 AS weight, 0.0 AS traded, 0.0 AS cost FROM {first}"]
    parts += [f"SELECT series_id, '{label}', date, jm, rf, weight, traded, cost FROM {name}" for name, label in tables.items()]
    return f"rows_ AS ({' UNION ALL '.join(parts)})"


_PERFORMANCE = f"WITH {_RULE}, {_strategy('s')}, {_long({'s': 'rule'})}, {_metrics('rows_', 'strategy')}"

_ANCHORS = f"""{_PANEL},
marks AS (SELECT series_id, make_date(y, mo, 1) AS target FROM (SELECT series_id, min(year(date)) AS lo, max(year(date)) AS hi FROM p GROUP BY 1),
            LATERAL (SELECT unnest(range(lo, hi + 1)) AS y), (VALUES (1), (7)) AS months(mo)),
hits AS (SELECT marks.series_id, target, min(date) AS date FROM marks JOIN p ON p.series_id = marks.series_id AND p.date >= target GROUP BY 1, 2),
anchor AS (SELECT DISTINCT hits.series_id, hits.date, p.pos FROM hits JOIN p ON p.series_id = hits.series_id AND p.date = hits.date
           WHERE p.pos > 0 AND hits.date - target <= 45)"""

_SCHEDULE = f"""{_ANCHORS},
sched AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY pos) AS INTEGER) AS refit_id, date AS refit_date, pos,
            CAST(least(750, pos) AS INTEGER) AS win,
            CAST(coalesce(lead(pos) OVER (PARTITION BY series_id ORDER BY pos), n) AS INTEGER) AS seg_end
          FROM anchor JOIN (SELECT series_id, count(*) AS n FROM p GROUP BY 1) USING (series_id) WHERE pos >= 250)"""

_ONLINE = f"""{_RULE},
l AS (SELECT series_id, date, row_number() OVER ({_W}) AS n,
        0.5 * (power(abs(ret) / 3 - 0.6, 2) + power(rf * 1000 - 0.5, 2)) - 0.5 * (power(abs(ret) / 3 - 0.2, 2) + power(rf * 1000 - 0.1, 2)) AS gap
      FROM g),
f AS (SELECT series_id, date, n, gap AS d FROM l WHERE n = 1
      UNION ALL
      SELECT l.series_id, l.date, l.n, least(greatest(f.d, -0.4), 0.4) + l.gap FROM f JOIN l ON l.series_id = f.series_id AND l.n = f.n + 1)"""

_STREAM = f"""{_MOMENTS},
refit AS (SELECT * FROM (VALUES (0, DATE '0001-01-01', DATE '1997-01-02', 0.1, 0.1, 1.0, 0.6), (1, DATE '1997-01-02', DATE '1999-07-01', 0.0, 0.1, 0.8, 0.5),
            (2, DATE '1999-07-01', DATE '9999-01-01', 0.2, 0.2, 1.2, 0.7)) AS r(r, since, till, a0, b0, a1, b1)),
seg AS (SELECT series_id, r, min(pos) AS low, max(pos) AS high, any_value(a0) AS a0, any_value(b0) AS b0, any_value(a1) AS a1, any_value(b1) AS b1
        FROM em JOIN refit ON date >= since AND date < till GROUP BY 1, 2),
l AS (SELECT em.series_id, r, date, pos, e5, e20, e60, pos >= low AS own, pos = greatest(low - 60, 0) AS head,
        0.5 * (power(e5 - a1, 2) + power(e20 - b1, 2)) - 0.5 * (power(e5 - a0, 2) + power(e20 - b0, 2)) AS gap
      FROM em JOIN seg ON em.series_id = seg.series_id AND pos BETWEEN low - 60 AND high),
f AS (SELECT *, gap AS d FROM l WHERE head
      UNION ALL
      SELECT l.*, least(greatest(f.d, -1.0), 1.0) + l.gap FROM f JOIN l ON l.series_id = f.series_id AND l.r = f.r AND l.pos = f.pos + 1)"""


def _fit_round(r: int, centers: str) -> str:
    """CTEs of one round of the jump-model fit: losses l, costs with back-pointers f, the path p and its centres c."""
    return f"""l{r} AS (SELECT s.series_id, s.n, 0.5 * (power(x0 - c00, 2) + power(x1 - c01, 2)) AS l0, 0.5 * (power(x0 - c10, 2) + power(x1 - c11, 2)) AS l1
      FROM s JOIN {centers} c USING (series_id)),
f{r} AS (SELECT series_id, n, l0 AS v0, l1 AS v1, 0 AS b0, 1 AS b1 FROM l{r} WHERE n = 1
      UNION ALL
      SELECT l.series_id, l.n, least(f.v0, f.v1 + 0.4) + l.l0, least(f.v1, f.v0 + 0.4) + l.l1,
        CASE WHEN f.v0 <= f.v1 + 0.4 THEN 0 ELSE 1 END, CASE WHEN f.v1 <= f.v0 + 0.4 THEN 1 ELSE 0 END
      FROM f{r} f JOIN l{r} l ON l.series_id = f.series_id AND l.n = f.n + 1),
k{r} AS (SELECT series_id, n, b0, b1, v0, v1, max(n) OVER (PARTITION BY series_id) AS last FROM f{r}),
p{r} AS (SELECT series_id, n, CASE WHEN v1 < v0 THEN 1 ELSE 0 END AS state, CASE WHEN v1 < v0 THEN b1 ELSE b0 END AS before FROM k{r} WHERE n = last
      UNION ALL
      SELECT k.series_id, k.n, p.before, CASE WHEN p.before = 1 THEN k.b1 ELSE k.b0 END
      FROM p{r} p JOIN k{r} k ON k.series_id = p.series_id AND k.n = p.n - 1),
c{r} AS (SELECT s.series_id, coalesce(avg(CASE WHEN state = 0 THEN x0 END), any_value(c00)) AS c00, coalesce(avg(CASE WHEN state = 0 THEN x1 END), any_value(c01)) AS c01,
        coalesce(avg(CASE WHEN state = 1 THEN x0 END), any_value(c10)) AS c10, coalesce(avg(CASE WHEN state = 1 THEN x1 END), any_value(c11)) AS c11
      FROM s JOIN p{r} USING (series_id, n) JOIN {centers} c USING (series_id) GROUP BY s.series_id)"""


_FIT = f"""{_RULE},
s AS (SELECT series_id, date, ret, abs(ret) / 3 AS x0, rf * 1000 AS x1, row_number() OVER ({_W}) AS n FROM g),
c0 AS (SELECT DISTINCT series_id, 0.2 AS c00, 0.1 AS c01, 0.6 AS c10, 0.5 AS c11 FROM s),
{_fit_round(1, "c0")}, {_fit_round(2, "c1")}, {_fit_round(3, "c2")},
turned AS (SELECT s.series_id, coalesce(sum(CASE WHEN state = 1 THEN ret END), 0) > coalesce(sum(CASE WHEN state = 0 THEN ret END), 0) AS turn
           FROM s JOIN p3 USING (series_id, n) GROUP BY 1),
costs AS (SELECT series_id, least(v0, v1) AS objective FROM k3 WHERE n = last)"""

_DENSITIES = f"""{_PANEL},
l AS (SELECT series_id, date, pos, -0.5 * power(ret / 0.3, 2) - ln(0.3) AS e0, -0.5 * power((ret - 0.1) / 0.8, 2) - ln(0.8) AS e1 FROM p)"""
_LATER = "greatest({v}.v0 + ln(0.95), {v}.v1 + ln(0.1)) + l.e0, greatest({v}.v0 + ln(0.05), {v}.v1 + ln(0.9)) + l.e1"
_WINDOWS = f"""{_DENSITIES},
v AS (SELECT a.series_id, a.date, a.pos AS last, l.pos AS k, ln(0.6) + l.e0 AS v0, ln(0.4) + l.e1 AS v1
      FROM l a JOIN l ON l.series_id = a.series_id AND l.pos = a.pos - least(60, a.pos) + 1 WHERE a.pos >= 40
      UNION ALL
      SELECT v.series_id, v.date, v.last, l.pos, {_LATER.format(v="v")} FROM v JOIN l ON l.series_id = v.series_id AND l.pos = v.k + 1 WHERE v.k < v.last),
d AS (SELECT series_id, date, last AS pos, CAST(v1 > v0 AS INTEGER) AS state FROM v WHERE k = last)"""

_LASSO = """m AS (SELECT DISTINCT l_linenumber AS line FROM lineitem), sup AS (SELECT DISTINCT l_suppkey FROM lineitem),
q AS (SELECT sup.l_suppkey, m.line, coalesce(sum(l_quantity), 0) AS quantity
      FROM sup CROSS JOIN m LEFT JOIN lineitem ON lineitem.l_suppkey = sup.l_suppkey AND l_linenumber = m.line GROUP BY 1, 2),
sc AS (SELECT l_suppkey, line, greatest(quantity / avg(quantity) OVER (PARTITION BY l_suppkey) - 0.9, 0) AS score FROM q),
g AS (SELECT l_suppkey, list(score) AS s, max(score) AS top, list_reverse_sort(list_distinct(list(score)))[2] AS second FROM sc GROUP BY 1),
b AS (SELECT l_suppkey, s, top, 0 AS i, 0.0::DOUBLE AS lo,
        CASE WHEN second >= 1e-8 AND list_sum(s) > sqrt(3.0) * sqrt(list_sum([x * x for x in s])) THEN second ELSE 0 END AS hi FROM g
      UNION ALL
      SELECT l_suppkey, s, top, i + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
      FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum([greatest(x - (lo + hi) / 2, 0) for x in s])
              <= sqrt(3.0) * sqrt(list_sum([power(greatest(x - (lo + hi) / 2, 0), 2) for x in s])) AS fits FROM b WHERE i < 60)),
w AS (SELECT sc.l_suppkey, line, CASE WHEN top <= 0 THEN 1.0 WHEN line IN (2, 5) THEN greatest(score, 1e-3 * top) ELSE greatest(score - hi, 0) END AS raw
      FROM sc JOIN b USING (l_suppkey) WHERE i = 60)"""


def _one(expression: str) -> str:
    return f"WITH {_PANEL} SELECT series_id, date, round({expression}, 6) AS value FROM p"


ORACLE_SQL: dict[str, str] = {
    "load_panel": f"""WITH {_PANEL} SELECT series_id, date, round(close, 8) AS close, round(rf_raw, 8) AS rf_raw, round(rf, 8) AS rf,
        round(ret, 8) AS ret, round(excess_ret, 8) AS excess_ret, round(qty, 8) AS qty FROM p""",
    "to_numeric": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_totalprice END AS value FROM orders",
    "to_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
    "rf_to_daily": f"""WITH {_CLOSES} SELECT date, round(rf_raw / 100 / 252, 12) AS annual_percent, round(rf_raw / 252, 12) AS annual_decimal,
        round(rf_raw, 12) AS daily FROM x""",
    "dedup_last": """SELECT series_id, date, close, o_orderkey FROM (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
        o_totalprice AS close, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS n
        FROM orders) WHERE n = 1""",
    "fill_rf": f"""WITH {_GAPS} SELECT series_id, date, coalesce(last_value(rf_raw IGNORE NULLS) OVER ({_BACK}),
        first_value(rf_raw IGNORE NULLS) OVER ({_AHEAD})) AS rf FROM g""",
    "fill_extra": f"WITH {_GAPS} SELECT series_id, date, last_value(qty IGNORE NULLS) OVER ({_BACK}) AS qty FROM g",
    "returns": f"""WITH {_CLOSES}, r AS (SELECT series_id, date, close / lag(close) OVER ({_W}) - 1 AS ret, rf_raw / 100 / 252 AS rf FROM raw)
        SELECT series_id, date, round(ret, 8) AS ret, round(ret - rf, 8) AS excess_ret FROM r""",
    "date_filter": f"""WITH {_PANEL} SELECT series_id, date, round(ret, 8) AS ret FROM p
        WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'""",
    "validate_panel": f"""WITH {_GAPS} SELECT series_id, count(*) AS n_rows, count(*) FILTER (date IS NULL) AS bad_dates,
        count(date) - count(DISTINCT date) AS repeated_dates, count(*) FILTER (close IS NULL) AS missing_close,
        count(*) FILTER (rf_raw IS NULL) AS missing_rf, count(*) FILTER (close <= 0) AS bad_close FROM g GROUP BY 1""",
    "extra_table": f"WITH {_MONTHLY} SELECT date, rf_raw, qty FROM m",
    "clean_panel": f"WITH {_DIRTY} SELECT {_CLEAN_COLUMNS} FROM p",
    "load_market_data": f"WITH {_ONE_SERIES} SELECT {_CLEAN_COLUMNS} FROM p",
    "load_excel": f"WITH {_ONE_SERIES} SELECT {_CLEAN_COLUMNS} FROM p",
    "load_extra_table": f"""WITH {_CLOSES} SELECT 'ALL' AS series_id, date, CASE WHEN day(date) % 3 <> 0 THEN rf_raw END AS rf_raw,
        CASE WHEN day(date) % 2 <> 0 THEN qty END AS qty FROM x WHERE day(date) % 7 <> 0""",
    "regimes_rule": f"""WITH {_RULE}, {_strategy('s')} SELECT g.series_id, g.date, g.regime, round(p.close, 8) AS close, round(p.rf_raw, 8) AS rf_raw,
        round(p.rf, 8) AS rf, round(p.ret, 8) AS ret, round(p.excess_ret, 8) AS excess_ret, round(p.qty, 8) AS qty,
        round(s.weight, 8) AS weight, round(s.jm, 8) AS strategy_ret FROM g JOIN p USING (series_id, date) JOIN s USING (series_id, date)""",
    "selection_of_weights": f"""WITH {_CLOSES}, w AS (SELECT 'qty' AS feature, greatest(qty - 25, 0) AS weight FROM x
          UNION ALL SELECT 'rf_raw', greatest(rf_raw - 5, 0) FROM x)
        SELECT 'ALL' AS series_id, feature, round(avg(weight), 8) AS mean_weight, round(avg(CAST(weight > 0 AS DOUBLE)), 8) AS selected_share,
          feature = 'qty' AS pinned FROM w GROUP BY feature""",
    "sample_data": f"""WITH {_CLOSES}, u AS (SELECT series_id, date, close,
            (CAST('0x' || substr(md5(CAST(date AS VARCHAR) || '|0|1'), 1, 7) AS BIGINT) + 0.5) / 268435456.0 AS u1,
            (CAST('0x' || substr(md5(CAST(date AS VARCHAR) || '|0|2'), 1, 7) AS BIGINT) + 0.5) / 268435456.0 AS u2,
            close / lag(close) OVER ({_W}) - 1 AS ret FROM c),
        w AS (SELECT series_id, date, close, round(least(greatest(sum(sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * 0.02) OVER ({_BACK}) * 0.5 + 3, 0.1), 6.0), 3) AS rf_raw,
            CASE WHEN count(ret) OVER ({_frame(20)}) = 20 THEN round(stddev_samp(ret) OVER ({_frame(20)}) * sqrt(252.0) * 100, 3) END AS vol FROM u)
        SELECT series_id, date, round(close, 6) AS close, rf_raw, first_value(vol IGNORE NULLS) OVER ({_AHEAD}) AS vol FROM w""",
    "left_join": f"WITH {_MONTHLY} SELECT series_id, date, close, m.rf_raw, m.qty FROM c LEFT JOIN m USING (date)",
    "asof_join": f"""WITH {_MONTHLY}, a AS (SELECT c.series_id, c.date, c.close, b.rf_raw FROM c ASOF LEFT JOIN
        (SELECT date, rf_raw FROM m WHERE rf_raw IS NOT NULL) b ON c.date >= b.date)
        SELECT a.series_id, a.date, a.close, a.rf_raw, b.qty FROM a ASOF LEFT JOIN (SELECT date, qty FROM m WHERE qty IS NOT NULL) b ON a.date >= b.date""",
    "common_period": f"WITH {_RULE} SELECT series_id, date FROM g WHERE regime = 1 AND dayofweek(date) <> 0",
    "anchors": f"WITH {_ANCHORS} SELECT series_id, date, pos FROM anchor",
    "refit_schedule": f"WITH {_SCHEDULE} SELECT series_id, refit_id, refit_date, pos, win, seg_end FROM sched",
    "training_windows": f"""WITH {_SCHEDULE} SELECT p.series_id, refit_id, p.date, p.pos AS row_pos FROM p JOIN sched
        ON p.series_id = sched.series_id AND p.pos >= sched.pos - win AND p.pos < seg_end""",
    "ewm_mean": _three("em.e{h}", "em"),
    "ewm_dd": _three("sqrt(ed.e{h})", "ed"),
    "ewm_vol": _three("sqrt(es.e{h})", "es"),
    "ewm_sortino": _three(_SORTINO, _JOINED),
    "features_paper": f"WITH {_MOMENTS} SELECT series_id, date, {', '.join(_PAPER)} FROM {_JOINED}",
    "features_example": f"WITH {_MOMENTS} SELECT series_id, date, {', '.join(_EXAMPLE)} FROM {_JOINED}",
    "features_extra": f"WITH {_EXTRA_BASE} SELECT series_id, date, {', '.join(_EXTRA)} FROM k",
    "build_features": f"""WITH {_MOMENTS}, f AS (SELECT series_id, date, pos, {', '.join(_PAPER)} FROM {_JOINED})
        SELECT series_id, date, "DD_10", sortino_20, sortino_60 FROM f
        WHERE pos >= 60 AND "DD_10" IS NOT NULL AND sortino_20 IS NOT NULL AND sortino_60 IS NOT NULL""",
    "transform_raw": _one("qty"),
    "transform_ewm": f"WITH {_PANEL}, eq AS ({_ewm('qty')}) SELECT series_id, date, round(e20, 6) AS value FROM eq",
    "transform_diff": _one(f"qty - lag(qty, 5) OVER ({_W})"),
    "transform_pct": _one(f"qty / lag(qty) OVER ({_W}) - 1"),
    "transform_log": _one("ln(qty)"),
    "transform_logdiff": _one(f"ln(qty) - lag(ln(qty), 2) OVER ({_W})"),
    "custom_features": f"""WITH {_MOMENTS}, q AS (SELECT series_id, date, pos, qty, qty - lag(qty, 5) OVER ({_W}) AS d5, ln(qty) AS lq FROM p),
        f AS (SELECT series_id, date, pos, {', '.join(_PAPER)}, {_r("qty", "qty")}, {_r("d5", "qty_diff5")}, {_r("lq", "qty_log")}
              FROM {_JOINED} JOIN q USING (series_id, date, pos))
        SELECT * EXCLUDE (pos) FROM f WHERE pos >= 60 AND "DD_10" IS NOT NULL AND sortino_20 IS NOT NULL AND sortino_60 IS NOT NULL
          AND qty IS NOT NULL AND qty_diff5 IS NOT NULL AND qty_log IS NOT NULL""",
    "build_weights": f"WITH {_RULE}, {_strategy('s', 3, bull=0.9, rest=0.2)} SELECT series_id, date, regime, round(weight, 8) AS weight FROM s",
    "trade_legs": f"""WITH {_RULE}, {_strategy('s', rest=0.3)} SELECT series_id, date, round(bought, 6) AS bought, round(sold, 6) AS sold,
        round(traded, 6) AS traded FROM s""",
    "strategy": f"""WITH {_RULE}, {_strategy('s', buy=5, sell=15)} SELECT series_id, date, regime, round(weight, 8) AS weight,
        round(bought, 8) AS bought, round(sold, 8) AS sold, round(traded, 8) AS traded, round(cost, 8) AS cost, round(rf, 8) AS rf,
        round(bh, 8) AS bh, round(jm, 8) AS jm FROM s""",
    "max_drawdown": f"""WITH {_PANEL}, w AS (SELECT series_id, date, product(1 + ret) OVER ({_BACK}) AS wealth FROM p),
        d AS (SELECT series_id, wealth / max(wealth) OVER ({_BACK}) - 1 AS dd FROM w)
        SELECT series_id, round(min(dd), 8) AS max_drawdown FROM d GROUP BY 1""",
    "performance": f"{_PERFORMANCE} SELECT series_id, strategy, metric, round(value, 5) AS value FROM t",
    "performance_table": f"""WITH {_RULE}, {_strategy('s')}, {_strategy('z', 5)}, {_long({'s': 'rule', 'z': 'slow'})}, {_metrics('rows_', 'strategy')}
        SELECT series_id, metric, round(max(CASE WHEN strategy = 'B & H' THEN value END), 5) AS hold,
          round(max(CASE WHEN strategy = 'rule' THEN value END), 5) AS rule, round(max(CASE WHEN strategy = 'slow' THEN value END), 5) AS slow
        FROM t GROUP BY 1, 2""",
    "performance_fmt": f"""{_PERFORMANCE} SELECT series_id, strategy, metric, CASE WHEN value IS NULL THEN 'nan'
        WHEN metric = 'Sharpe' THEN printf('%.2f', value) WHEN metric = 'Cost' THEN printf('%.2f', value * 100) || '%'
        ELSE printf('%.1f', value * 100) || '%' END AS text FROM t WHERE metric IN ('Volatility', 'MDD', 'Turnover', 'Leverage', 'Sharpe', 'Cost')""",
    "regime_summary": f"""WITH {_RULE}, h AS (SELECT *, coalesce(regime <> lag(regime) OVER ({_W}), false) AS shift FROM g)
        SELECT series_id, min(date) AS start, max(date) AS "end", count(*) AS n_days, round(avg(CAST(regime = 1 AS INTEGER)), 8) AS bear_share,
          count(*) FILTER (shift) AS n_shifts, round(count(*) FILTER (shift) / count(*) * 252.0, 8) AS shifts_per_year FROM h GROUP BY 1""",
    "delay_robustness": f"""WITH {_RULE}, days AS (SELECT series_id, date FROM g WHERE date >= DATE '1996-01-01'),
        b AS (SELECT g.series_id, 'rule' AS model, date, ret, rf, regime FROM g SEMI JOIN days USING (series_id, date)
              UNION ALL SELECT g.series_id, 'anti', date, ret, rf, 1 - regime FROM g SEMI JOIN days USING (series_id, date)),
        {', '.join(_strategy(f's{d}', d, source='b', key=', model') for d in (1, 5, 10))},
        rows_ AS ({' UNION ALL '.join(f"SELECT series_id, model, CAST({d} AS INTEGER) AS delay, date, jm AS r, rf, weight, traded, cost FROM s{d}" for d in (1, 5, 10))}
          UNION ALL SELECT series_id, 'B & H', NULL, date, ret, rf, 1.0, 0.0, 0.0 FROM g SEMI JOIN days USING (series_id, date)),
        {_metrics('rows_', 'model, delay')}
        SELECT series_id, model, delay, metric, round(value, 5) AS value FROM t WHERE metric IN ('Return', 'Sharpe', 'Calmar')""",
    "median_filter": f"""WITH {_RULE} SELECT series_id, date, regime, CAST(avg(regime) OVER ({_frame(6)}) > 0.5 AS INTEGER) AS smooth FROM g""",
    "cumret_curve": f"""WITH {_RULE}, {_strategy('s')} SELECT series_id, date, round(sum(bh - rf) OVER ({_BACK}), 6) AS bh_cum,
        round(sum(jm - rf) OVER ({_BACK}), 6) AS jm_cum, (min(weight) OVER (PARTITION BY series_id) < max(weight) OVER (PARTITION BY series_id)
          AND weight <= min(weight) OVER (PARTITION BY series_id) + 1e-9) AS shaded FROM s""",
    "annualize_center": f"""WITH {_MOMENTS}, f AS (SELECT sqrt(ed.e10) AS a, {_SORTINO.format(h=20)} AS b, {_SORTINO.format(h=60)} AS c FROM {_JOINED})
        SELECT 'DD_10' AS feature, round(avg(a) * sqrt(2 * 252.0), 6) AS value FROM f
        UNION ALL SELECT 'sortino_20', round(avg(b) * sqrt(252.0 / 2), 6) FROM f UNION ALL SELECT 'sortino_60', round(avg(c) * sqrt(252.0 / 2), 6) FROM f""",
    "streaming_online": f"""WITH RECURSIVE {_STREAM.strip()} SELECT series_id, date, round(e5, 6) AS mean_5, round(e20, 6) AS mean_20,
        round(e60, 6) AS mean_60, CAST(d < 0 AS INTEGER) AS regime FROM f WHERE own""",
    "jm_fit": f"""WITH RECURSIVE {_FIT.strip()} SELECT s.series_id, s.date, CAST(CASE WHEN turn THEN 1 - state ELSE state END AS INTEGER) AS state,
        round(CASE WHEN state = 0 THEN c00 ELSE c10 END, 6) AS center_0, round(CASE WHEN state = 0 THEN c01 ELSE c11 END, 6) AS center_1,
        round(objective, 6) AS objective
        FROM s JOIN p3 USING (series_id, n) JOIN c3 USING (series_id) JOIN turned USING (series_id) JOIN costs USING (series_id)""",
    "viterbi_online": f"""WITH RECURSIVE {_DENSITIES.strip()}, v AS (SELECT series_id, date, pos, ln(0.6) + e0 AS v0, ln(0.4) + e1 AS v1 FROM l WHERE pos = 0
        UNION ALL SELECT l.series_id, l.date, l.pos, {_LATER.format(v="v")} FROM v JOIN l ON l.series_id = v.series_id AND l.pos = v.pos + 1)
        SELECT series_id, date, CAST(v1 > v0 AS INTEGER) AS state FROM v""",
    "viterbi_trailing": f"WITH RECURSIVE {_WINDOWS.strip()} SELECT series_id, date, state FROM d",
    "hmm_decode": f"""WITH RECURSIVE {_WINDOWS.strip()} SELECT d.series_id, d.date, state AS state_raw,
        CAST(avg(state) OVER (PARTITION BY d.series_id ORDER BY d.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) > 0.5 AS INTEGER) AS regime,
        p.date AS refit_date FROM d JOIN p ON p.series_id = d.series_id AND p.pos = 40 + 21 * ((d.pos - 40) // 21)""",
    "lasso_weights": f"""WITH RECURSIVE {_LASSO} SELECT l_suppkey, line,
        round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY l_suppkey)), 6) AS weight FROM w""",
    "jm_online": f"WITH RECURSIVE {_ONLINE.strip()} SELECT series_id, date, CAST(d < 0 AS INTEGER) AS regime FROM f",
}
ORACLE_SQL["jm_online_sql"] = ORACLE_SQL["jm_online"]
ORACLE_SQL["selection_ranks"] = f"""WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, line AS feature, round(weight, 8) AS mean_weight,
    CAST(weight > 0 AS DOUBLE) AS selected_share FROM ({ORACLE_SQL["lasso_weights"]}))
    SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mean_weight DESC, feature) AS INTEGER) AS place FROM r"""
ORACLE_SQL["csv_sink"] = ORACLE_SQL["strategy"]
ORACLE_SQL["load_with_extras"] = f"""WITH {_ONE_SERIES.replace("'ALL'", "'series'")}, e AS (SELECT date, qty FROM x WHERE day(date) = 1)
    SELECT series_id, p.date, {", ".join(f"round({c}, 8) AS {c}" for c in ("close", "rf_raw", "rf", "ret", "excess_ret"))}, round(e.qty, 8) AS slow_qty
    FROM p ASOF LEFT JOIN e ON p.date >= e.date"""
_SCALED = ", ".join(
    f"""avg(least(greatest({c}, m_{c} - 1.5 * s_{c}), m_{c} + 1.5 * s_{c})) FILTER (pos < 750) OVER (PARTITION BY series_id) AS mm_{c},
    stddev_pop(least(greatest({c}, m_{c} - 1.5 * s_{c}), m_{c} + 1.5 * s_{c})) FILTER (pos < 750) OVER (PARTITION BY series_id) AS ss_{c}"""
    for c in ("ret", "rf_raw")
)
ORACLE_SQL["scaled_features"] = f"""WITH {_PANEL},
    a AS (SELECT *, {", ".join(f"avg({c}) FILTER (pos < 750) OVER (PARTITION BY series_id) AS m_{c}, stddev_pop({c}) FILTER (pos < 750) OVER (PARTITION BY series_id) AS s_{c}" for c in ("ret", "rf_raw"))} FROM p),
    b AS (SELECT *, {_SCALED} FROM a)
    SELECT series_id, date, {", ".join(f"round((least(greatest({c}, m_{c} - 1.5 * s_{c}), m_{c} + 1.5 * s_{c}) - mm_{c}) / ss_{c}, 6) AS z_{n}" for c, n in (("ret", "ret"), ("rf_raw", "rf")))} FROM b"""
ORACLE_SQL["sparse_weights"] = f"""WITH RECURSIVE {_RULE.strip()},
    f AS (SELECT series_id, regime, unnest(['size', 'ret', 'rate', 'square']) AS feature, unnest([abs(ret), ret, rf * 1000, ret * ret / 4]) AS v FROM g),
    st AS (SELECT series_id, feature, regime, avg(v) AS c, count(*) AS n FROM f GROUP BY 1, 2, 3),
    al AS (SELECT series_id, feature, avg(v) AS m FROM f GROUP BY 1, 2),
    bc AS (SELECT st.series_id, st.feature, sum(n * power(c - m, 2)) AS bcss FROM st JOIN al USING (series_id, feature) GROUP BY 1, 2),
    sc AS (SELECT series_id, feature, bcss / max(bcss) OVER (PARTITION BY series_id) AS score FROM bc),
    ls AS (SELECT series_id, list(score) AS s, list_reverse_sort(list_distinct(list(score)))[2] AS second FROM sc GROUP BY 1),
    b AS (SELECT series_id, s, 0 AS i, 0.0::DOUBLE AS lo,
            CASE WHEN second >= 1e-8 AND list_sum(s) > sqrt(1.5) * sqrt(list_sum([x * x for x in s])) THEN second ELSE 0 END AS hi FROM ls
          UNION ALL
          SELECT series_id, s, i + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
          FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum([greatest(x - (lo + hi) / 2, 0) for x in s])
                  <= sqrt(1.5) * sqrt(list_sum([power(greatest(x - (lo + hi) / 2, 0), 2) for x in s])) AS fits FROM b WHERE i < 60)),
    w AS (SELECT series_id, feature, score, CASE WHEN feature = 'rate' THEN greatest(score, 1e-3) ELSE greatest(score - hi, 0) END AS raw
          FROM sc JOIN b USING (series_id) WHERE i = 60)
    SELECT series_id, feature, round(score, 6) AS score, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY series_id)), 6) AS weight FROM w"""
