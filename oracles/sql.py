"""One SQL statement per query, written on its own: joins and window sums where the queries use
folds over arrays. Statements share named sub-selects and end in the layout of the query."""

from __future__ import annotations

from cashtide.functions import normality
from cashtide.plans.catalog import LAYOUTS

# ---- shared sub-selects ----------------------------------------------------------------------

CURRENCY = (
    "CASE o_custkey % 20 WHEN 0 THEN 'usd' WHEN 1 THEN NULL WHEN 2 THEN 'AUD' ELSE 'aud' END"
)
DESCRIPTION = """CASE o_orderpriority WHEN '1-URGENT' THEN 'iv league - Booking'
    WHEN '2-HIGH' THEN ' Subscription update ' WHEN '3-MEDIUM' THEN 'Subscription creation'
    WHEN '5-LOW' THEN 'Package initiation' END"""
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Failed' END"

CHARGES = f"""charges AS (
    SELECT o_orderkey AS id, o_custkey AS payer, o_orderdate AS created,
           CAST(o_totalprice AS DECIMAL(18,2)) AS amount, {STATUS} AS status,
           {CURRENCY} AS currency, {DESCRIPTION} AS description
    FROM orders)"""

CATEGORY = """CASE WHEN trim(coalesce(description, '')) = '' THEN 'one_time'
    WHEN regexp_matches(description, 'IV League', 'i') THEN 'league'
    WHEN trim(description) IN ('Subscription update', 'Subscription creation') THEN 'recurring'
    ELSE 'one_time' END"""

CLEAN = f"""{CHARGES}, clean AS (
    SELECT id, payer, created, amount, {CATEGORY} AS category, description
    FROM charges WHERE status = 'Paid' AND lower(coalesce(currency, 'aud')) = 'aud'
      AND created >= TIMESTAMP '1995-01-01')"""

_MONTH = "CAST(date_trunc('month', created) AS DATE)"

SUMS = {
    "category": f"""{CLEAN}, sums AS (
        SELECT category AS series_id, {_MONTH} AS month, sum(amount) AS y FROM clean GROUP BY 1, 2)""",
    "group": f"""{CLEAN}, sums AS (
        SELECT c_mktsegment || '|' || n_name AS series_id, {_MONTH} AS month, sum(amount) AS y
        FROM clean JOIN customer ON payer = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2)""",
    "payer": f"""{CLEAN}, sums AS (
        SELECT payer AS series_id, {_MONTH} AS month, sum(amount) AS y FROM clean GROUP BY 1, 2)""",
}

SPAN = """span AS (
    SELECT least(DATE '2001-07-01', max(month)) AS last_month,
           date_diff('month', DATE '1995-01-01', least(DATE '2001-07-01', max(month))) + 1 AS n
    FROM sums)"""


def filled(kind: str) -> str:
    """Every month of every series."""
    return f"""{SUMS[kind]}, {SPAN},
    calendar AS (
        SELECT CAST(DATE '1995-01-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS month, i AS idx
        FROM span, range(n) r(i)),
    filled AS (
        SELECT s.series_id, c.month, c.idx, coalesce(CAST(x.y AS DOUBLE), 0.0) AS y
        FROM (SELECT DISTINCT series_id FROM sums) s CROSS JOIN calendar c
        LEFT JOIN sums x ON x.series_id = s.series_id AND x.month = c.month)"""


HAMPEL = """medians AS (
        SELECT *, median(y) OVER (PARTITION BY series_id ORDER BY month
                                  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median
        FROM filled),
    deviations AS (SELECT *, abs(y - median) AS deviation FROM medians),
    mads AS (
        SELECT *, median(deviation) OVER (PARTITION BY series_id ORDER BY month
                                          ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mad
        FROM deviations),
    flags AS (SELECT *, deviation > (3.0::DOUBLE * 1.4826::DOUBLE) * mad AS flagged FROM mads),
    outliers AS (SELECT series_id, month, idx FROM flags WHERE flagged),
    breaks AS (SELECT series_id, min(month) AS break_month FROM outliers GROUP BY 1)"""

NO_OUTLIERS = "outliers AS (SELECT series_id, month, idx FROM filled WHERE FALSE)"

# Training parts: all months, or one part per backtest origin.
TRAIN_ALL = "training AS (SELECT f.series_id, s.n AS o, f.idx, f.y FROM filled f, span s)"
TRAIN_CV = """origins AS (
        SELECT n - 12 - 3 * i AS o FROM span, range(8) r(i) WHERE n - 12 - 3 * i >= 24),
    training AS (SELECT f.series_id, g.o, f.idx, f.y FROM filled f JOIN origins g ON f.idx < g.o)"""


BOUNDS = """greatest(yhat - 1.28::DOUBLE * spread, 0.0) AS lo80, yhat + 1.28::DOUBLE * spread AS hi80,
        greatest(yhat - 1.96::DOUBLE * spread, 0.0) AS lo95, yhat + 1.96::DOUBLE * spread AS hi95"""


def paths(horizon: int, backtest: bool = False) -> str:
    """Forecasts of all models from ``training``, with ``outliers`` left out of the level."""
    ladder = (
        "CASE WHEN n2 >= 2 THEN c2 WHEN n3 >= 1 THEN c3 ELSE TRUE END"
        if backtest
        else "CASE WHEN n1 >= 3 THEN c1 WHEN n2 >= 2 THEN c2 ELSE c3 END"
    )
    return f"""parts AS (SELECT DISTINCT series_id, o FROM training),
    steps AS (SELECT CAST(i AS INTEGER) AS step FROM range(1, {horizon + 1}) r(i)),
    changes AS (
        SELECT a.series_id, a.o, sqrt(avg((a.y - b.y) * (a.y - b.y))) AS sigma
        FROM training a JOIN training b
          ON b.series_id = a.series_id AND b.o = a.o AND b.idx = a.idx - 12
        GROUP BY 1, 2),
    naive AS (
        SELECT t.series_id, t.o, 'seasonal_naive' AS model, s.step, t.y AS yhat,
               c.sigma * sqrt(floor((s.step - 1) / 12) + 1) AS spread
        FROM training t JOIN steps s ON t.idx = t.o - 12 + (s.step - 1) % 12
        JOIN changes c ON c.series_id = t.series_id AND c.o = t.o),
    demand AS (
        SELECT *, idx - coalesce(lag(idx) OVER w, 0) AS gap, row_number() OVER w AS k,
               count(*) OVER (PARTITION BY series_id, o) AS m
        FROM training WHERE y > 0 WINDOW w AS (PARTITION BY series_id, o ORDER BY idx)),
    smoothed AS (
        SELECT series_id, o, any_value(m) AS m, sum(y) AS total, stddev_pop(y) AS deviation,
               sum(y * weight) AS size, sum(gap * weight) AS gap
        FROM (SELECT *, CASE WHEN k = 1 THEN pow(0.85::DOUBLE, m - 1)
                             ELSE 0.15::DOUBLE * pow(0.85::DOUBLE, m - k) END AS weight FROM demand)
        GROUP BY 1, 2),
    rates AS (
        SELECT p.series_id, p.o, s.m, s.deviation,
               CASE WHEN coalesce(s.m, 0) < 2 THEN coalesce(s.total, 0.0) / p.o
                    WHEN s.gap > 0 THEN s.size / s.gap ELSE s.size END AS rate
        FROM parts p LEFT JOIN smoothed s ON s.series_id = p.series_id AND s.o = p.o),
    croston AS (
        SELECT series_id, o, 'croston' AS model, step, rate AS yhat,
               CASE WHEN m > 1 THEN deviation ELSE rate * 0.5 END AS spread
        FROM rates, steps),
    rungs AS (
        SELECT t.*, t.idx >= 15 AND t.y > 0 AND u.idx IS NULL AS c1, t.idx >= 15 AND t.y > 0 AS c2,
               t.y > 0 AS c3
        FROM training t LEFT JOIN outliers u ON u.series_id = t.series_id AND u.idx = t.idx),
    counted AS (
        SELECT *, count(*) FILTER (c1) OVER p AS n1, count(*) FILTER (c2) OVER p AS n2,
               count(*) FILTER (c3) OVER p AS n3
        FROM rungs WINDOW p AS (PARTITION BY series_id, o)),
    learnt AS (
        SELECT *, row_number() OVER (PARTITION BY series_id, o ORDER BY idx DESC) - 1 AS age
        FROM counted WHERE {ladder}),
    levels AS (
        SELECT p.series_id, p.o, coalesce(l.level, 0.0) AS level,
               CASE WHEN l.used > 1 THEN l.deviation ELSE coalesce(l.level, 0.0) * 0.5 END AS spread
        FROM parts p LEFT JOIN (
            SELECT series_id, o, count(*) AS used, stddev_pop(y) AS deviation,
                   sum(y * pow(0.75::DOUBLE, age)) / sum(pow(0.75::DOUBLE, age)) AS level
            FROM learnt GROUP BY 1, 2) l ON l.series_id = p.series_id AND l.o = p.o),
    level AS (
        SELECT series_id, o, 'level' AS model, step, level AS yhat, spread FROM levels, steps),
    paths AS (
        SELECT series_id, o, model, step, yhat, {BOUNDS}
        FROM (SELECT * FROM naive UNION ALL SELECT * FROM croston UNION ALL SELECT * FROM level))"""


DATED = """dated AS (
    SELECT p.*, CAST(s.last_month + to_months(p.step) AS DATE) AS month FROM paths p, span s)"""

ROUTED = """forecast AS (
    SELECT * FROM dated WHERE (series_id, model) IN
        (('league', 'croston'), ('recurring', 'seasonal_naive'), ('one_time', 'level')))"""

TOTAL = """total AS (
    SELECT step, month, round(sum(yhat), 2) AS total, round(sum(lo80), 2) AS lo80,
           round(sum(hi80), 2) AS hi80, round(sum(lo95), 2) AS lo95, round(sum(hi95), 2) AS hi95,
           round(sum(lo80), 2) AS bear, round(sum(yhat), 2) AS base, round(sum(hi80), 2) AS bull
    FROM forecast GROUP BY 1, 2)"""


def stream_forecast(horizon: int) -> str:
    """The three streams by their stand-in routes, and their total."""
    return ", ".join(
        (filled("category"), NO_OUTLIERS, TRAIN_ALL, paths(horizon), DATED, ROUTED, TOTAL)
    )


def timeline(horizon: int, display: bool) -> str:
    """History and forecast of the total, or of the display groups."""
    name = "CASE WHEN series_id = 'league' THEN 'league' ELSE 'subscriptions' END" if display else "'total'"
    return f"""{stream_forecast(horizon)},
    line AS (
        SELECT {name} AS series_id, month, 'actual' AS kind, round(sum(y), 2) AS y,
               NULL::DOUBLE AS bear, NULL::DOUBLE AS bull FROM filled GROUP BY 1, 2
        UNION ALL
        SELECT {name}, month, 'forecast', round(sum(yhat), 2), round(sum(lo80), 2),
               round(sum(hi80), 2) FROM forecast GROUP BY 1, 2),
    aged AS (
        SELECT *, max(month) FILTER (kind = 'actual') OVER (PARTITION BY series_id) AS last_actual,
               CASE WHEN kind = 'actual'
                    THEN row_number() OVER (PARTITION BY series_id, kind ORDER BY month DESC)
                    ELSE row_number() OVER (PARTITION BY series_id, kind ORDER BY month) END AS age
        FROM line)"""


def backtest(kind: str) -> str:
    """Backtest rows, scores, selection and evaluation."""
    return f"""{filled(kind)}, {NO_OUTLIERS}, {TRAIN_CV}, {paths(12, backtest=True)},
    results AS (
        SELECT p.series_id, p.model, p.o AS train_end, p.step, f.month, f.y, p.yhat,
               CASE WHEN p.model = 'level' THEN p.lo80 END AS lo80,
               CASE WHEN p.model = 'level' THEN p.hi80 END AS hi80
        FROM paths p JOIN filled f ON f.series_id = p.series_id AND f.idx = p.o + p.step - 1),
    scales AS (
        SELECT a.series_id, nullif(avg(abs(a.y - b.y)), 0) AS scale
        FROM filled a JOIN filled b ON b.series_id = a.series_id AND b.idx = a.idx - 12 GROUP BY 1),
    scores AS (
        SELECT r.series_id, r.model, count(*) AS n, avg(abs(r.y - r.yhat)) / any_value(s.scale) AS mase,
               sqrt(avg((r.y - r.yhat) * (r.y - r.yhat))) AS rmse,
               avg((hi80 - lo80) + CASE WHEN r.y < lo80 THEN 10 * (lo80 - r.y)
                                        WHEN r.y > hi80 THEN 10 * (r.y - hi80) ELSE 0 END) AS winkler80
        FROM results r JOIN scales s ON s.series_id = r.series_id GROUP BY 1, 2),
    chosen AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (
                PARTITION BY series_id
                ORDER BY mase NULLS LAST, CASE model WHEN 'level' THEN 0 ELSE 1 END) AS place
            FROM scores WHERE model IN ('level', 'croston')) WHERE place = 1),
    evaluation AS (
        SELECT c.series_id, c.model, round(c.mase, 4) AS mase, round(c.rmse, 2) AS rmse,
               round(c.winkler80, 2) AS winkler80, round(b.mase, 4) AS baseline_mase,
               coalesce(c.mase < b.mase, FALSE) AS beats_baseline
        FROM chosen c LEFT JOIN scores b
          ON b.series_id = c.series_id AND b.model = 'seasonal_naive')"""


def chosen_forecast(kind: str, horizon: int) -> str:
    """Forecast by the model the backtest selects."""
    return f"""{backtest(kind)},
    forecast AS (
        WITH {TRAIN_ALL}, {paths(horizon)}
        SELECT p.*, CAST(s.last_month + to_months(p.step) AS DATE) AS month
        FROM paths p JOIN chosen c ON c.series_id = p.series_id AND c.model = p.model, span s)"""


BASELINE_CALM = """calm AS (
    SELECT series_id, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_all,
           CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(*) FILTER (y > 0), 0)
               AS mean_positive,
           median(y) FILTER (y > 0) AS median_positive
    FROM filled WHERE month >= DATE '1996-04-01' GROUP BY 1)"""

REQUESTS = """requests AS (
        SELECT o_orderkey AS request_id, CAST(o_orderkey % 26 AS INTEGER) AS horizon,
               CASE o_custkey % 4 WHEN 0 THEN 80 WHEN 1 THEN 95 WHEN 2 THEN 90 ELSE 80 END AS level,
               o_orderdate AS asked_at
        FROM orders),
    valid AS (SELECT * FROM requests WHERE horizon BETWEEN 1 AND 24 AND level IN (80, 95))"""


def served() -> str:
    return f"""{stream_forecast(24)}, {REQUESTS},
    served AS (
        SELECT v.request_id, v.horizon, v.level, v.asked_at, t.step, t.month, t.total AS yhat,
               CASE WHEN v.level = 95 THEN t.lo95 ELSE t.lo80 END AS lo,
               CASE WHEN v.level = 95 THEN t.hi95 ELSE t.hi80 END AS hi
        FROM valid v JOIN total t ON t.step <= v.horizon)"""


def psi_of(samples: str) -> str:
    """PSI per column from ``(col, value, period)`` rows."""
    return f"""samples AS ({samples}),
    counts AS (
        SELECT col, value, count(*) FILTER (period = 'reference') AS n_ref,
               count(*) FILTER (period = 'current') AS n_cur
        FROM samples WHERE value IS NOT NULL GROUP BY 1, 2),
    sizes AS (SELECT col, sum(n_ref) AS a_ref, sum(n_cur) AS a_cur FROM counts GROUP BY 1),
    shares AS (
        SELECT c.col, greatest(n_ref / a_ref, 1e-6) AS r, greatest(n_cur / a_cur, 1e-6) AS q,
               a_ref, a_cur
        FROM counts c JOIN sizes s ON s.col = c.col),
    psi AS (
        SELECT col AS "column", sum((q - r) * ln(q / r)) AS psi, count(*) AS "values",
               max(a_ref) AS reference_rows, max(a_cur) AS current_rows
        FROM shares GROUP BY 1)"""


NUMBER_SAMPLES = """
    SELECT 'value' AS col, CAST(value AS DOUBLE) AS v,
           CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS period
    FROM events
    UNION ALL
    SELECT 'user_id', CAST(user_id AS DOUBLE),
           CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END
    FROM events"""

# Values of the reference period at the ranks of nine tenths are edges; a value's bin counts the edges below it.
BINNED = f"""numbers AS (SELECT * FROM ({NUMBER_SAMPLES}) WHERE v IS NOT NULL),
    ranked AS (
        SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS place, count(*) OVER (PARTITION BY col) AS n
        FROM numbers WHERE period = 'reference'),
    edges AS (
        SELECT DISTINCT col, v AS edge FROM ranked JOIN range(1, 10) r(i)
        ON place = CAST(ceil((i / 10.0::DOUBLE) * n) AS BIGINT)),
    edge_lists AS (SELECT col, list(edge) AS edges FROM edges GROUP BY 1),
    binned AS (
        SELECT n.col, CAST(len(list_filter(e.edges, lambda edge: edge < n.v)) AS VARCHAR) AS value, n.period
        FROM numbers n JOIN edge_lists e ON e.col = n.col)"""

EVENT_SAMPLES = """
    SELECT 'event_type' AS col, event_type AS value,
           CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS period
    FROM events
    UNION ALL
    SELECT 'k', json_extract_string(props, '$.k'),
           CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END
    FROM events"""

RAW = f"""raw AS (
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 113 = 0 THEN NULL ELSE {STATUS} END AS status,
               CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 101 = 0 THEN NULL
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
               CASE WHEN o_orderkey % 103 = 0 THEN 'not a date'
                    WHEN o_orderkey % 107 = 0 THEN '2099-01-01 00:00:00'
                    WHEN o_orderkey % 109 = 0 THEN NULL
                    ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created
        FROM orders),
    judged AS (
        SELECT *, status IS NULL AS r1, amount IS NULL AS r2,
               amount IS NOT NULL AND try_cast(amount AS DOUBLE) IS NULL AS r3,
               created IS NULL AS r4,
               created IS NOT NULL AND try_cast(created AS TIMESTAMP) IS NULL AS r5,
               coalesce(year(try_cast(created AS TIMESTAMP)) < 1996
                        OR try_cast(created AS TIMESTAMP) > TIMESTAMP '2001-07-01', FALSE) AS r6
        FROM raw)"""

RULES = (
    ("status_present", "status", "r1"),
    ("amount_present", "amount", "r2"),
    ("amount_numeric", "amount", "r3"),
    ("created_present", "created", "r4"),
    ("created_timestamp", "created", "r5"),
    ("created_in_range", "created", "r6"),
)

FLAT_CURRENCY = f"CASE WHEN o_custkey % 20 = 3 THEN 'jpy' ELSE {CURRENCY} END"
_MINOR = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _major(minor: str) -> str:
    return f"CASE WHEN o_custkey % 20 = 3 THEN CAST({minor} AS DOUBLE) ELSE ({minor}) / 100.0::DOUBLE END"


_NO_TEXT, _NO_NUMBER = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
_METADATA = ("OrgName", "OrgCode", "Invoice number", "Site URL", "Order Type", "Payment Type",
             "Product Type", "Product", "Access Plan", "Order ID")


def _snapshot(values: dict[str, str]) -> str:
    numbers = {"Converted Amount", "Converted Amount Refunded", "Amount Refunded", "Fee", "Taxes On Fee"}
    names = [entry.partition("~")[0] for entry in LAYOUTS["charge_flatten"]]
    columns = [
        f"""{values.get(name, _NO_NUMBER if name in numbers else _NO_TEXT)} AS "{name}" """
        for name in names
    ]
    return "SELECT " + ", ".join(columns) + " FROM orders"


FLATTEN = _snapshot(
    {
        "id": "CAST(o_orderkey AS VARCHAR)",
        "Created date (UTC)": "strftime(o_orderdate, '%Y-%m-%d 00:00:00')",
        "Amount": _major(_MINOR),
        "Amount Refunded": _major(f"CASE WHEN o_orderkey % 11 = 0 THEN {_MINOR} ELSE 0 END"),
        "Currency": FLAT_CURRENCY,
        "Captured": "o_orderkey % 7 <> 0",
        "Description": DESCRIPTION,
        "Fee": _major("o_orderkey % 1000"),
        "Refunded date (UTC)": "CASE WHEN o_orderkey % 11 = 0 THEN "
        "strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d 00:00:00') ELSE '' END",
        "Status": "CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' ELSE 'Disputed' END",
        "Seller Message": "CASE WHEN o_orderkey % 4 = 0 THEN 'Payment complete.' END",
        "Taxes On Fee": _major("nullif(o_orderkey % 5 + o_orderkey % 3, 0)"),
        "Invoice ID": "'in_' || o_orderkey",
        "OrgName (metadata)": "'org-' || (o_custkey % 50)",
        "Order ID (metadata)": "CAST(o_orderkey AS VARCHAR)",
    }
)

MINIMISED = _snapshot(
    {
        "id": "CAST(o_orderkey AS VARCHAR)",
        "Created date (UTC)": "strftime(o_orderdate, '%Y-%m-%d 00:00:00')",
        "Amount": "o_totalprice",
        "Currency": CURRENCY,
        "Description": DESCRIPTION,
    }
)

GROUP = filled("group")
CATEGORIES = filled("category")
GROUP_FLAGS = f"{GROUP}, {HAMPEL}"
GROUP_BACKTEST = backtest("group")


def baseline(yhat: str, source: str) -> str:
    return f"""WITH {GROUP}, {NO_OUTLIERS}, {TRAIN_ALL}, {paths(24)}
    SELECT series_id, step, CAST(last_month + to_months(step) AS DATE) AS month, {yhat} AS yhat
    FROM {source}"""


_WIDE = """SELECT month, sum(y) FILTER (series_id = 'league') AS league,
       sum(y) FILTER (series_id = 'recurring') AS recurring,
       sum(y) FILTER (series_id = 'one_time') AS one_time FROM filled GROUP BY 1"""
_SCENARIO_SUMS = "round(sum(bear), 2) AS bear, round(sum(base), 2) AS base, round(sum(bull), 2) AS bull"
_QUARTERS = f"""SELECT year(month) AS year, quarter(month) AS quarter, count(*) AS months,
       {_SCENARIO_SUMS} FROM total GROUP BY 1, 2"""
_PCT = "({new} - {old}) / nullif({old}, 0) * 100"


def pct(new: str, old: str) -> str:
    return _PCT.format(new=new, old=old)


# Autocorrelations of any (id, o, idx, y) rows.
def autocorrelation(rows: str, max_lag: int) -> str:
    return f"""centred AS (
        SELECT id, idx, y, y - avg(y) OVER (PARTITION BY id) AS d,
               count(*) OVER (PARTITION BY id) AS n
        FROM ({rows})),
    power AS (
        SELECT id, any_value(n) AS n,
               CASE WHEN sum(d * d) > sum(y * y) * 1e-24 THEN sum(d * d) END AS p
        FROM centred GROUP BY 1),
    lags AS (SELECT i AS lag FROM range(0, {max_lag + 1}) r(i)),
    products AS (
        SELECT a.id, l.lag, sum(a.d * b.d) AS c
        FROM centred a CROSS JOIN lags l JOIN centred b ON b.id = a.id AND b.idx = a.idx + l.lag
        GROUP BY 1, 2),
    acf AS (SELECT c.id, c.lag, p.n, c.c / p.p AS r FROM products c JOIN power p ON p.id = c.id)"""


SERIES_ACF = autocorrelation("SELECT series_id AS id, idx, y FROM filled", 24)

STATEMENTS: dict[str, str] = {
    "charge_flatten": FLATTEN,
    "pii_projection": MINIMISED,
    "charge_history": f"WITH {CHARGES} SELECT * FROM charges WHERE created >= TIMESTAMP '1998-01-01'",
    "minor_to_major": f"SELECT o_orderkey AS id, {FLAT_CURRENCY} AS currency, {_MINOR} AS minor, "
    f"{_major(_MINOR)} AS major FROM orders",
    "categorise": f"WITH {CHARGES} SELECT id, description, {CATEGORY} AS category FROM charges",
    "clean_charges": f"WITH {CLEAN} SELECT * FROM clean",
    "dropped_currency_audit": f"""WITH {CHARGES}
        SELECT lower(currency) AS currency, count(*) AS dropped_rows, sum(amount) AS dropped_amount
        FROM charges WHERE lower(currency) <> 'aud' GROUP BY 1""",
    "monthly_wide": f"WITH {CATEGORIES} {_WIDE}",
    "series_unpivot": f"WITH {CATEGORIES} SELECT * FROM filled",
    "features": f"""WITH {CATEGORIES}, wide AS ({_WIDE})
        SELECT *, CASE WHEN month < DATE '1996-04-01' THEN 1 ELSE 0 END AS disrupted,
               ln(1 + league) AS league_log, ln(1 + recurring) AS recurring_log,
               ln(1 + one_time) AS one_time_log, league + recurring + one_time AS total FROM wide""",
    "outlier_dummies": f"""WITH {GROUP_FLAGS}
        SELECT series_id, month, y, CASE WHEN flagged THEN 1 ELSE 0 END AS indicator FROM flags""",
    "step_dummy": f"""WITH {GROUP_FLAGS}
        SELECT f.series_id, f.month, f.y, b.break_month,
               CASE WHEN b.break_month IS NULL THEN NULL WHEN f.month >= b.break_month THEN 1.0
                    ELSE 0.0 END AS post_break
        FROM filled f LEFT JOIN breaks b ON b.series_id = f.series_id""",
    "forecast_floor": f"""WITH {GROUP},
        floors AS (
            SELECT series_id, coalesce(median(y) FILTER (y > 0), 0) * 0.25 AS floor
            FROM filled, span WHERE idx >= n - 18 GROUP BY 1),
        ends AS (
            SELECT series_id, arg_min(y, idx) AS first_y, arg_max(y, idx) AS last_y
            FROM filled GROUP BY 1)
        SELECT e.series_id, step, CAST(last_month + to_months(CAST(step AS INTEGER)) AS DATE) AS month,
               floor, greatest(last_y + (last_y - first_y) / (n - 1) * step, floor) AS yhat
        FROM ends e JOIN floors f ON f.series_id = e.series_id, span, range(1, 25) r(step)""",
    "dq_report": f"WITH {RAW} "
    + " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, '{column}' AS "column", count(*) AS "rows",
            count(*) FILTER ({flag}) AS failures, min({column}) FILTER ({flag}) AS sample FROM judged"""
        for rule, column, flag in RULES
    ),
    "dq_quarantine": f"WITH {RAW} SELECT id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {flag} THEN '{rule}' END" for rule, _, flag in RULES)
    + ") AS reasons FROM judged WHERE r1 OR r2 OR r3 OR r4 OR r5 OR r6",
    "request_validate": f"""WITH {REQUESTS}
        SELECT *, horizon BETWEEN 1 AND 24 AND level IN (80, 95) AS valid,
               concat_ws(',', CASE WHEN horizon NOT BETWEEN 1 AND 24 THEN 'horizon_in_range' END,
                         CASE WHEN level NOT IN (80, 95) THEN 'level_offered' END) AS reasons
        FROM requests""",
    "forecast_contract": f"""WITH {served()}
        SELECT request_id, max(horizon) AS horizon, count(*) AS months,
               bool_and(isfinite(yhat) AND isfinite(lo) AND isfinite(hi)) AS finite,
               bool_and(yhat >= 0 AND lo >= 0 AND hi >= 0) AS non_negative,
               bool_and(lo <= hi) AS ordered, count(*) = max(horizon) AS complete,
               count(*) = max(horizon) AND bool_and(yhat >= 0 AND lo >= 0 AND lo <= hi) AS accepted
        FROM served GROUP BY 1""",
    "monthly_long": f"WITH {SUMS['category']} SELECT * FROM sums",
    "monthly_long_groups": f"WITH {SUMS['group']} SELECT * FROM sums",
    "category_summary": f"""WITH {CLEAN}, t AS (
            SELECT category, count(amount) AS transactions, sum(amount) AS total,
                   min(amount) AS smallest, max(amount) AS largest FROM clean GROUP BY 1)
        SELECT category, transactions, CAST(total AS DOUBLE) AS total,
               round(CAST(total AS DOUBLE) / transactions, 2) AS average, smallest, largest,
               CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100 AS share_pct FROM t""",
    "series_profile": f"""WITH {GROUP}
        SELECT series_id, sum(y) AS total, count(*) FILTER (y > 0) AS nonzero_months,
               count(*) AS months, min(y) AS lowest, max(y) AS highest, min(month) AS first_month,
               max(month) AS data_through FROM filled GROUP BY 1""",
    "sparsity_route": f"""WITH {SUMS['payer']}, {SPAN},
        d AS (SELECT series_id, count(*) FILTER (month <= DATE '2001-07-01' AND y > 0) AS nonzero_months
              FROM sums GROUP BY 1)
        SELECT series_id, nonzero_months, nonzero_months / n AS nonzero_frac,
               CASE WHEN nonzero_months / n >= 0.6 THEN 'level' ELSE 'croston' END AS route
        FROM d, span""",
    "quarterly_scenarios": f"WITH {stream_forecast(24)} {_QUARTERS}",
    "full_quarters": f"WITH {stream_forecast(24)} {_QUARTERS} HAVING count(*) = 3",
    "annual_totals": f"WITH {stream_forecast(12)} SELECT count(*) AS months, {_SCENARIO_SUMS} FROM total",
    "stream_mix": f"""WITH {stream_forecast(12)}
        SELECT series_id, sum(yhat) AS forecast_sum,
               sum(yhat) / (SELECT sum(yhat) FROM forecast) * 100 AS share_pct
        FROM forecast GROUP BY 1""",
    "ytd_tracker": f"""WITH {timeline(12, False)}, t AS (
            SELECT series_id, year(any_value(last_actual)) AS year,
                   count(*) FILTER (kind = 'actual' AND year(month) = year(last_actual)) AS ytd_months,
                   round(sum(y) FILTER (kind = 'actual' AND year(month) = year(last_actual)), 2) AS ytd_actual,
                   round(sum(y) FILTER (kind = 'actual' AND year(month) = year(last_actual) - 1
                                        AND month(month) <= month(last_actual)), 2) AS prior_ytd,
                   round(sum(y) FILTER (kind = 'forecast' AND year(month) = year(last_actual)), 2) AS remaining
            FROM aged GROUP BY 1)
        SELECT *, {pct('ytd_actual', 'prior_ytd')} AS yoy_pct, ytd_actual + remaining AS full_year
        FROM t""",
    "vs_prior_year": f"""WITH {timeline(12, False)}, t AS (
            SELECT series_id,
                   round(sum(y) FILTER (kind = 'actual' AND year(month) = year(last_actual) - 1), 2) AS prior_year,
                   round(sum(y) FILTER (kind = 'forecast'), 2) AS base,
                   round(sum(bear), 2) AS bear, round(sum(bull), 2) AS bull
            FROM aged GROUP BY 1)
        SELECT *, bull - bear AS spread, abs({pct('base', 'prior_year')}) AS pct_vs_prior FROM t""",
    "stream_kpi": f"""WITH {timeline(12, True)}, t AS (
            SELECT series_id, sum(y) FILTER (kind = 'forecast') AS forecast_sum,
                   avg(y) FILTER (kind = 'forecast') AS forecast_mean,
                   avg(y) FILTER (kind = 'actual' AND age <= 12) AS last12_mean
            FROM aged GROUP BY 1)
        SELECT *, {pct('forecast_mean', 'last12_mean')} AS pct_vs_last12 FROM t""",
    "stream_baselines": f"WITH {GROUP}, {BASELINE_CALM} SELECT * FROM calm",
    "beats_summary": f"""WITH {GROUP_BACKTEST}
        SELECT count(*) FILTER (beats_baseline) AS beating, count(*) AS models FROM evaluation""",
    "calendar_fill": f"WITH {GROUP} SELECT * FROM filled",
    "outlier_context": f"""WITH {GROUP_FLAGS}, {BASELINE_CALM}
        SELECT f.series_id, f.month, f.y, c.median_positive AS stream_median,
               CASE WHEN c.median_positive > 0
                    THEN (f.y - c.median_positive) / c.median_positive * 100 END AS pct_above
        FROM flags f LEFT JOIN calm c ON c.series_id = f.series_id WHERE f.flagged""",
    "score_requests": f"WITH {served()} SELECT * FROM served",
    "regression_gate": f"""WITH {GROUP_BACKTEST}, prior AS (
            SELECT series_id, round(CASE length(series_id) % 3 WHEN 0 THEN mase * 0.6::DOUBLE
                                    WHEN 1 THEN mase END, 4) AS prior_mase FROM evaluation),
        t AS (SELECT e.*, p.prior_mase, e.mase / nullif(p.prior_mase, 0) AS ratio
              FROM evaluation e LEFT JOIN prior p ON p.series_id = e.series_id)
        SELECT series_id, prior_mase, mase, baseline_mase,
               CASE WHEN prior_mase > 0 THEN ratio END AS ratio,
               CASE WHEN mase IS NULL OR prior_mase IS NULL OR prior_mase <= 0 THEN 'skipped'
                    WHEN ratio <= 1.3 THEN 'ok' WHEN mase > baseline_mase THEN 'hard' ELSE 'soft'
               END AS verdict FROM t""",
    "cv_windows": f"""WITH {GROUP}, {TRAIN_CV}
        SELECT f.series_id, g.o AS train_end, g.o + 12 AS test_end,
               count(*) FILTER (f.idx < g.o) AS train_months,
               count(*) FILTER (f.idx >= g.o) AS test_months,
               sum(y) FILTER (f.idx < g.o) AS train_total, sum(y) FILTER (f.idx >= g.o) AS test_total
        FROM filled f JOIN origins g ON f.idx < g.o + 12 GROUP BY 1, 2, 3""",
    "history_bridge": f"""WITH {timeline(12, True)}
        SELECT series_id, month, kind, y FROM aged WHERE kind = 'forecast' OR month = last_actual""",
    "rolling_median": f"WITH {GROUP_FLAGS} SELECT * FROM medians",
    "hampel_flags": f"WITH {GROUP_FLAGS} SELECT * FROM flags",
    "outlier_topk": f"""WITH {GROUP_FLAGS}, ranked AS (
            SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(y) DESC, month DESC) AS place,
                   count(*) FILTER (flagged) OVER (PARTITION BY series_id) AS total FROM flags)
        SELECT series_id, month, y, flagged, flagged AND (total <= 3 OR place <= 3) AS outlier FROM ranked""",
    "mase_scale": f"""WITH {GROUP}
        SELECT a.series_id, nullif(avg(abs(a.y - b.y)), 0) AS scale
        FROM filled a JOIN filled b ON b.series_id = a.series_id AND b.idx = a.idx - 12 GROUP BY 1""",
    "cumulative_scenarios": f"""WITH {stream_forecast(24)}
        SELECT month, bear, base, bull, sum(bear) OVER w AS bear_cum, sum(base) OVER w AS base_cum,
               sum(bull) OVER w AS bull_cum FROM total WINDOW w AS (ORDER BY month)""",
    "mom_growth": f"""WITH {GROUP}, t AS (
            SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY month) AS before FROM filled)
        SELECT series_id, coalesce(avg(CASE WHEN idx > n - 6 THEN y / nullif(before, 0) - 1 END) * 100, 0)
               AS mom_growth_pct FROM t, span WHERE idx >= n - 6 GROUP BY 1""",
    "stream_health": f"""WITH {timeline(12, True)}, t AS (
            SELECT series_id, avg(y) FILTER (kind = 'actual' AND age <= 6) AS recent6_mean,
                   avg(y) FILTER (kind = 'actual' AND age BETWEEN 7 AND 12) AS prior6_mean,
                   round(sum(y) FILTER (kind = 'actual' AND age <= 12), 2) AS last12,
                   round(sum(y) FILTER (kind = 'forecast' AND age <= 12), 2) AS next12
            FROM aged GROUP BY 1),
        u AS (SELECT *, {pct('recent6_mean', 'prior6_mean')} AS momentum_pct,
                     {pct('next12', 'last12')} AS outlook_pct FROM t)
        SELECT *, CASE WHEN outlook_pct > 5 THEN 'Growing' WHEN outlook_pct < -5 THEN 'Declining'
                       ELSE 'Stable' END AS status FROM u""",
    "latest_month": f"""WITH {CATEGORIES}, t AS (
            SELECT max(f.month) AS month, sum(f.y) AS total, sum(p.y) AS year_ago,
                   sum(f.y) FILTER (f.series_id <> 'league') AS subscriptions,
                   sum(f.y) FILTER (f.series_id = 'league') AS league
            FROM filled f JOIN span ON f.idx = n - 1
            JOIN filled p ON p.series_id = f.series_id AND p.idx = f.idx - 12)
        SELECT month, round(total, 2) AS total, round(year_ago, 2) AS year_ago, subscriptions, league,
               {pct('round(total, 2)', 'round(year_ago, 2)')} AS yoy_pct,
               round(subscriptions, 2) / round(total, 2) * 100 AS subscriptions_pct,
               round(league, 2) / round(total, 2) * 100 AS league_pct FROM t""",
    "peak_month": f"""WITH {stream_forecast(12)}, t AS (
            SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY yhat DESC, month) AS place,
                   avg(yhat) OVER (PARTITION BY series_id) AS average FROM forecast)
        SELECT series_id, month AS peak_month, yhat AS peak, average FROM t WHERE place = 1""",
    "spread_bands": f"""WITH {stream_forecast(12)}, t AS (
            SELECT CAST(month AS VARCHAR) AS period, bear, base, bull, round(bull - bear, 2) AS spread
            FROM total
            UNION ALL
            SELECT 'TOTAL', sum(bear), sum(base), sum(bull), round(sum(bull) - sum(bear), 2) FROM total),
        u AS (SELECT *, spread / (SELECT max(spread) FROM t WHERE period <> 'TOTAL') AS rel FROM t)
        SELECT period, bear, base, bull, spread, bear - base AS downside, bull - base AS upside,
               CASE WHEN rel < 0.35 THEN 'low' WHEN rel < 0.70 THEN 'medium' ELSE 'high' END AS band
        FROM u""",
    "history_tail": f"WITH {GROUP} SELECT filled.* FROM filled, span WHERE idx >= n - 36",
    "trend_caution": f"""WITH {stream_forecast(24)}, t AS (
            SELECT arg_min(base, step) AS first_base, arg_max(base, step) AS last_base FROM total)
        SELECT *, last_base < first_base * 0.97::DOUBLE AS declining FROM t""",
    "first_break": f"WITH {GROUP_FLAGS} SELECT * FROM breaks",
    "baseline_mean": baseline(
        "yhat", "(SELECT series_id, avg(y) AS yhat FROM filled GROUP BY 1), steps, span"
    ),
    "baseline_snaive": baseline("yhat", "naive, span"),
    "baseline_drift": baseline(
        "last_y + (last_y - first_y) / (n - 1) * step",
        "(SELECT series_id, arg_min(y, idx) AS first_y, arg_max(y, idx) AS last_y "
        "FROM filled GROUP BY 1), steps, span",
    ),
    "level_forecast": f"""WITH {GROUP_FLAGS}, {TRAIN_ALL}, {paths(12)}, {DATED}
        SELECT * FROM dated WHERE model = 'level'""",
    "level_cv": f"""WITH {GROUP_BACKTEST}
        SELECT series_id, train_end, yhat AS level, lo80, hi80 FROM results
        WHERE model = 'level' AND step = 1""",
    "ensemble_combine": f"""WITH {GROUP}, {NO_OUTLIERS}, {TRAIN_ALL}, {paths(12)}
        SELECT series_id, step, greatest(sum(yhat) / 3, 0) AS yhat,
               greatest(median(lo80), 0) AS lo80_median, greatest(median(hi95), 0) AS hi95_median,
               sum(lo80) / 3 AS lo80_mean, sum(hi95) / 3 AS hi95_mean FROM paths GROUP BY 1, 2""",
    "model_spec": f"""WITH {GROUP_BACKTEST}, facts AS (
            SELECT series_id, count(*) AS n_train,
                   round(count(*) FILTER (y > 0) / count(*) * 100, 0) AS nonzero_pct
            FROM filled GROUP BY 1)
        SELECT c.series_id, c.model, n_train, nonzero_pct
        FROM chosen c JOIN facts f ON f.series_id = c.series_id""",
    "forecast_12m": f"WITH {chosen_forecast('category', 12)} SELECT * FROM forecast",
    "forecast_24m": f"WITH {chosen_forecast('group', 24)} SELECT * FROM forecast",
    "forecast_total": f"WITH {chosen_forecast('group', 24)}, {TOTAL} SELECT * FROM total",
    "forecast_table": f"""WITH {stream_forecast(12)}
        SELECT f.month, sum(f.yhat) FILTER (series_id = 'league') AS league,
               sum(f.yhat) FILTER (series_id = 'recurring') AS recurring,
               sum(f.yhat) FILTER (series_id = 'one_time') AS one_time, any_value(t.total) AS total_base,
               any_value(t.lo80) AS total_lo80, any_value(t.hi80) AS total_hi80,
               any_value(t.lo95) AS total_lo95, any_value(t.hi95) AS total_hi95,
               any_value(t.bear) AS bear, any_value(t.base) AS base, any_value(t.bull) AS bull
        FROM forecast f JOIN total t ON t.month = f.month GROUP BY 1""",
    "cv_snaive": f"WITH {GROUP_BACKTEST} SELECT * FROM results WHERE model = 'seasonal_naive'",
    "cv_croston": f"WITH {GROUP_BACKTEST} SELECT * FROM results WHERE model = 'croston'",
    "cv_level": f"WITH {GROUP_BACKTEST} SELECT * FROM results WHERE model = 'level'",
    "metric_mase": f"WITH {GROUP_BACKTEST} SELECT * FROM scores",
    "metric_rmse": f"WITH {GROUP_BACKTEST} SELECT * FROM scores",
    "metric_winkler": f"WITH {GROUP_BACKTEST} SELECT * FROM scores WHERE model = 'level'",
    "acf": f"WITH {GROUP}, {SERIES_ACF} SELECT id AS series_id, lag, r AS acf FROM acf",
    "pacf": f"""WITH RECURSIVE {GROUP}, {SERIES_ACF},
        rho AS (SELECT id, list(r ORDER BY lag) FILTER (lag > 0) AS r FROM acf GROUP BY 1),
        levinson AS (
            SELECT id, 1 AS lag, r, [r[1]] AS phi, 1 - r[1] * r[1] AS v, r[1] AS a FROM rho
            UNION ALL
            SELECT id, lag + 1, r,
                   list_concat(list_transform(range(1, lag + 1), lambda j: phi[j] - b * phi[lag + 1 - j]), [b]),
                   v * (1 - b * b), b
            FROM (SELECT *, (r[lag + 1] - list_sum(list_transform(range(1, lag + 1),
                                                   lambda j: phi[j] * r[lag + 1 - j]))) / v AS b
                  FROM levinson WHERE lag < 24))
        SELECT id AS series_id, lag, a AS pacf FROM levinson""",
    "ljung_box_q": f"""WITH {GROUP_BACKTEST}, {autocorrelation(
        "SELECT series_id AS id, y - yhat AS y, row_number() OVER "
        "(PARTITION BY series_id ORDER BY train_end, step) AS idx FROM results WHERE model = 'level'", 12)}
        SELECT id AS series_id, 'level' AS model, lag,
               n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY id ORDER BY lag) AS q
        FROM acf WHERE lag BETWEEN 1 AND least(12, greatest(1, n // 5)) AND n >= 10""",
    "select_model": f"WITH {GROUP_BACKTEST} SELECT * FROM chosen",
    "evaluation": f"WITH {GROUP_BACKTEST} SELECT * FROM evaluation",
    "accuracy_grade": f"""WITH {GROUP_BACKTEST}, {BASELINE_CALM}
        SELECT e.series_id, e.model,
               CASE WHEN beats_baseline THEN 'beats benchmark'
                    WHEN mase < baseline_mase * 1.5 THEN 'near benchmark'
                    ELSE 'trajectory only' END AS grade,
               beats_baseline AND mase < 1.3 AS strong,
               CASE WHEN beats_baseline THEN baseline_mase - mase ELSE mase - baseline_mase END
                   / nullif(baseline_mase, 0) * 100 AS gap_pct,
               rmse / coalesce(mean_positive, 1) * 100 AS error_pct
        FROM evaluation e LEFT JOIN calm c ON c.series_id = e.series_id""",
    "resolve_version": """WITH versions AS (
            SELECT p_brand AS model, CAST(p_partkey AS INTEGER) AS version, p_size, p_name FROM part),
        found AS (
            SELECT 'latest' AS request, * FROM versions WHERE p_size % 3 = 0
            UNION ALL SELECT 'champion', * FROM versions WHERE p_size = 50
            UNION ALL SELECT '17', * FROM versions WHERE version = 17)
        SELECT request, model, max(version) AS version, arg_max(p_name, version) AS run_id
        FROM found GROUP BY 1, 2""",
    "psi": f"WITH {psi_of(EVENT_SAMPLES)} SELECT * FROM psi",
    "psi_binned": f"""WITH {BINNED}, {psi_of("SELECT * FROM binned")}
        SELECT "column", psi, "values" AS bins, reference_rows, current_rows FROM psi""",
    "drift_report": f"""WITH {psi_of(EVENT_SAMPLES)}
        SELECT "column", psi, psi >= 0.02 AS drifted, 0.02 AS threshold,
               count(*) FILTER (psi >= 0.02) OVER () AS drifted_columns,
               count(*) FILTER (psi >= 0.02) OVER () / count(*) OVER () AS drifted_share FROM psi""",
    "prediction_expand": f"WITH {served()} SELECT request_id, step, yhat AS prediction FROM served",
    "served_drift": f"""WITH {served()}, {psi_of('''
        SELECT 'horizon' AS col, CAST(horizon AS VARCHAR) AS value,
               CASE WHEN asked_at < TIMESTAMP '1998-07-01' THEN 'reference' ELSE 'current' END AS period
        FROM valid
        UNION ALL
        SELECT 'prediction', CAST(CAST(yhat AS DECIMAL(18,2)) AS VARCHAR),
               CASE WHEN asked_at < TIMESTAMP '1998-07-01' THEN 'reference' ELSE 'current' END
        FROM served''')} SELECT * FROM psi""",
    "stream_ingest": "SELECT event_id, ts, event_type, value FROM events",
    "stream_windowed": """WITH w AS (
            SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS category,
                   count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS revenue FROM events GROUP BY 1, 2)
        SELECT * FROM w""",
    "stream_quarantine": """
        SELECT CASE WHEN value BETWEEN 1 AND 120 AND event_type <> 'error' THEN 'good'
                    ELSE 'quarantine' END AS sink, event_type, count(*) AS n,
               sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1, 2""",
}

STATEMENTS["serve_requests"] = STATEMENTS["score_requests"]

# Tail of the chi-square by the series of the incomplete gamma function.
STATEMENTS["ljung_box_p"] = f"""
    WITH tested AS ({STATEMENTS["ljung_box_q"]}),
    tails AS (
        SELECT t.series_id, t.model, t.lag,
               1 - sum(exp((t.lag / 2.0 + k) * ln(t.q / 2) - t.q / 2 - lgamma(t.lag / 2.0 + k + 1))) AS p
        FROM tested t, range(0, 2000) r(k) WHERE t.q > 0 GROUP BY 1, 2, 3)
    SELECT series_id, model, min(CASE WHEN p < 0 THEN 0 ELSE p END) AS ljung_box_p FROM (
        SELECT * FROM tails UNION ALL
        SELECT series_id, model, lag, CASE WHEN q IS NULL THEN NULL ELSE 1 END FROM tested
        WHERE q IS NULL OR q <= 0)
    GROUP BY 1, 2"""

_SMOOTHING = """{name} AS (
        SELECT {start}
        UNION ALL
        SELECT s.id, s.alpha, s.t + 1, s.level + s.alpha * (x.x - s.level),
               s.sse + (x.x - s.level) * (x.x - s.level)
        FROM {name} s JOIN adjusted x ON x.id = s.id AND x.idx = s.t + 1),
    {name}_best AS (
        SELECT * FROM (
            SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY s.sse, s.alpha) AS place
            FROM {name} s, span WHERE s.t = n - 1) WHERE place = 1)"""

_COARSE = _SMOOTHING.format(
    name="coarse",
    start="""id, round(0.02::DOUBLE + 0.04::DOUBLE * i, 2) AS alpha, CAST(0 AS BIGINT) AS t,
               x AS level, 0.0::DOUBLE AS sse FROM adjusted, range(25) r(i) WHERE idx = 0""",
)
_FINE = _SMOOTHING.format(
    name="fine",
    start="""a.id, least(greatest(b.alpha + 0.005::DOUBLE * i, 0.01), 0.99)::DOUBLE AS alpha,
               CAST(0 AS BIGINT) AS t, a.x AS level, 0.0::DOUBLE AS sse
        FROM adjusted a JOIN coarse_best b ON b.id = a.id, range(-4, 5) r(i) WHERE a.idx = 0""",
)

STATEMENTS["theta"] = f"""WITH RECURSIVE {GROUP},
    {autocorrelation("SELECT series_id AS id, idx, y FROM filled", 12)},
    kinds AS (
        SELECT f.series_id AS id, bool_and(f.y > 0) AS ratio,
               any_value(t.n >= 25 AND coalesce(t.seasonal, FALSE)) AS seasonal
        FROM filled f JOIN (
            SELECT id, any_value(n) AS n,
                   abs(sum(r) FILTER (lag = 12)) > 1.645::DOUBLE * sqrt(
                       (1 + 2 * sum(r * r) FILTER (lag BETWEEN 1 AND 11)) / any_value(n)) AS seasonal
            FROM acf GROUP BY 1) t ON t.id = f.series_id
        GROUP BY 1),
    averaged AS (
        SELECT series_id AS id, idx, y,
               (sum(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                + 0.5 * (lag(y, 6) OVER w + lead(y, 6) OVER w)) / 12 AS trend
        FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
    slots AS (
        SELECT a.id, a.idx % 12 AS slot,
               avg(CASE WHEN k.ratio THEN a.y / CASE WHEN a.trend = 0 THEN 1 ELSE a.trend END
                        ELSE a.y - a.trend END) AS raw
        FROM averaged a JOIN kinds k ON k.id = a.id WHERE a.trend IS NOT NULL GROUP BY 1, 2),
    centred_slots AS (
        SELECT s.id, s.slot, k.ratio, k.seasonal,
               CASE WHEN k.ratio THEN s.raw / avg(s.raw) OVER (PARTITION BY s.id)
                    ELSE s.raw - avg(s.raw) OVER (PARTITION BY s.id) END AS v
        FROM slots s JOIN kinds k ON k.id = s.id),
    indices AS (
        SELECT id, slot, ratio, seasonal,
               CASE WHEN seasonal THEN CASE WHEN ratio AND v <= 0 THEN 1 ELSE v END
                    WHEN ratio THEN 1 ELSE 0 END AS v
        FROM centred_slots),
    adjusted AS (
        SELECT f.series_id AS id, f.idx, CASE WHEN i.ratio THEN f.y / i.v ELSE f.y - i.v END AS x
        FROM filled f JOIN indices i ON i.id = f.series_id AND i.slot = f.idx % 12),
    {_COARSE},
    {_FINE},
    slopes AS (SELECT id, coalesce(regr_slope(x, idx), 0) AS slope FROM adjusted GROUP BY 1),
    fits AS (SELECT b.*, s.slope, n FROM fine_best b JOIN slopes s ON s.id = b.id, span)
    SELECT f.id AS series_id, CASE WHEN i.seasonal THEN 'Theta(seasonal)' ELSE 'Theta' END AS spec,
           n * ln(greatest(f.sse / n, 1e-12)) + 6 + 24.0 / (n - 4) AS aicc, step,
           (f.level + 0.5 * f.slope * (step - 1 + (1 - pow(1 - f.alpha, n)) / f.alpha))
               * CASE WHEN i.ratio THEN i.v ELSE 1 END + CASE WHEN i.ratio THEN 0 ELSE i.v END AS yhat
    FROM fits f, range(1, 13) r(step), indices i
    WHERE i.id = f.id AND i.slot = (n + step - 1) % 12"""

STATEMENTS["model_facts"] = f"""WITH {GROUP_FLAGS},
    variants AS (SELECT DISTINCT series_id, spec FROM ({STATEMENTS["theta"]})),
    facts AS (
        SELECT series_id, count(*) AS n_train, round(count(*) FILTER (y > 0) / count(*) * 100, 0) AS nonzero_pct
        FROM filled GROUP BY 1)
    SELECT f.series_id, n_train, nonzero_pct, b.break_month, v.spec AS theta_method
    FROM facts f LEFT JOIN breaks b ON b.series_id = f.series_id LEFT JOIN variants v ON v.series_id = f.series_id"""

# Exact segmentation by dynamic programming over the grid of admissible ends. The kernel is summed
# per pair of grid cells first, so that a segment's cost is a sum over whole cells.
STATEMENTS["breaks"] = f"""WITH RECURSIVE {GROUP},
    pairs AS (
        SELECT a.series_id AS id, a.idx AS i, b.idx AS j, (a.y - b.y) * (a.y - b.y) AS d
        FROM filled a JOIN filled b ON b.series_id = a.series_id),
    widths AS (SELECT id, median(d) AS w FROM pairs WHERE i < j GROUP BY 1),
    cells AS (
        SELECT p.id, CAST(p.i // 5 AS INTEGER) AS a, CAST(p.j // 5 AS INTEGER) AS b,
               sum(CASE WHEN i = j THEN 1.0 ELSE exp(-least(greatest(
                   d / CASE WHEN w = 0 THEN 1 ELSE w END, 0.01), 100)) END) AS g
        FROM pairs p JOIN widths u ON u.id = p.id GROUP BY 1, 2, 3),
    segments AS (
        SELECT s.i AS seg_a, e.i AS seg_b, s.i * 5 AS from_idx, least((e.i + 1) * 5, n) AS to_idx
        FROM span, range(0, 16) s(i), range(0, 16) e(i) WHERE e.i >= s.i),
    costs AS (
        SELECT c.id, s.seg_a, s.seg_b, (to_idx - from_idx) - sum(g) / (to_idx - from_idx) + 1.0 AS cost
        FROM cells c JOIN segments s ON c.a BETWEEN s.seg_a AND s.seg_b AND c.b BETWEEN s.seg_a AND s.seg_b
        GROUP BY c.id, s.seg_a, s.seg_b, to_idx, from_idx),
    by_last AS (SELECT id, seg_b, list(cost ORDER BY seg_a) AS cost FROM costs GROUP BY 1, 2),
    table_of AS (SELECT id, list(cost ORDER BY seg_b) AS costs FROM by_last GROUP BY 1),
    steps AS (
        SELECT id, costs, 0 AS k, [0.0::DOUBLE] AS best, CAST([] AS BIGINT[]) AS origin FROM table_of
        UNION ALL
        SELECT id, costs, k + 1, list_append(best, list_min(tried)),
               list_append(origin, CAST(list_position(tried, list_min(tried)) AS BIGINT))
        FROM (SELECT *, list_transform(range(1, k + 2), lambda j: best[j] + costs[k + 1][j]) AS tried
              FROM steps WHERE k < len(costs))),
    solved AS (SELECT id, origin, len(costs) AS cells FROM steps WHERE k = len(costs)),
    walk AS (
        SELECT id, origin, cells AS pos FROM solved
        UNION ALL
        SELECT id, origin, origin[pos] - 1 FROM walk WHERE pos > 0 AND origin[pos] > 1)
    SELECT w.id AS series_id, w.pos * 5 AS segment_end,
           CAST(DATE '1995-01-01' + to_months(CAST(w.pos * 5 - 1 AS INTEGER)) AS DATE) AS month
    FROM walk w JOIN solved s ON s.id = w.id WHERE w.pos < s.cells"""



def _horner(coefficients, x: str) -> str:
    text = repr(float(coefficients[0]))
    for c in coefficients[1:]:
        text = f"({text} * {x} + {float(c)!r}::DOUBLE)"
    return text


def _ratio(form, x: str) -> str:
    return f"{_horner(form[0], x)} / {_horner(form[1], x)}"


# Shapiro-Wilk of more than eleven residuals a series, which is what every backtest here has. The tail of the normal
# is the series of the incomplete gamma function at one half.
STATEMENTS["shapiro"] = f"""WITH {GROUP_BACKTEST},
    ordered AS (
        SELECT series_id AS id, y - yhat AS x,
               row_number() OVER (PARTITION BY series_id ORDER BY y - yhat) AS i, count(*) OVER (PARTITION BY series_id) AS n
        FROM results WHERE model = 'level'),
    placed AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) - 0.5::DOUBLE AS q FROM ordered),
    scored AS (
        SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(normality.MIDDLE, "(0.180625::DOUBLE - q * q)")}
                       WHEN t <= 5 THEN sign(q) * {_ratio(normality.SHOULDER, "(t - 1.6::DOUBLE)")}
                       ELSE sign(q) * {_ratio(normality.FAR, "(t - 5.0::DOUBLE)")} END AS s
        FROM (SELECT *, sqrt(-ln(least(q + 0.5, 0.5 - q))) AS t FROM placed)),
    sizes AS (
        SELECT id, n, sum(s * s) AS square, 1 / sqrt(n) AS u, max(s) AS s1, max(CASE WHEN i = n - 1 THEN s END) AS s2, avg(x) AS centre
        FROM scored GROUP BY id, n),
    ends AS (
        SELECT *, {_horner(normality.OUTERMOST, "u")} + s1 / sqrt(square) AS a1, {_horner(normality.SECOND, "u")} + s2 / sqrt(square) AS a2
        FROM sizes),
    weighted AS (
        SELECT c.id, c.n, c.x, e.centre,
               CASE WHEN i = n THEN a1 WHEN i = n - 1 THEN a2 WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2
                    ELSE s / sqrt((square - 2 * s1 * s1 - 2 * s2 * s2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a
        FROM scored c JOIN (SELECT * EXCLUDE (n) FROM ends) e ON e.id = c.id),
    tested AS (
        SELECT id, CASE WHEN max(x) > min(x) THEN least(1.0, pow(sum(a * x), 2) / sum((x - centre) * (x - centre))) END AS w,
               ln(max(n)) AS l FROM weighted GROUP BY id),
    turned AS (
        SELECT id, (ln(1 - w) - {_horner(normality.LARGE_MEAN, "l")}) / exp({_horner(normality.LARGE_SIGMA, "l")}) AS z FROM tested),
    tails AS (
        SELECT id, z, (1 - sum(exp((k + 0.5::DOUBLE) * ln(z * z / 2) - z * z / 2 - lgamma(k + 1.5::DOUBLE)))) / 2 AS half
        FROM turned, range(0, 2000) r(k) GROUP BY id, z)
    SELECT id AS series_id, 'level' AS model,
           CASE WHEN z IS NULL THEN NULL WHEN z >= 0 THEN greatest(half, 0) ELSE 1 - greatest(half, 0) END AS shapiro_p
    FROM tails"""

_RATES = f"""WITH {SUMS['payer']}, {SPAN},
    calendar AS (SELECT 1), filled AS (SELECT 1),
    training AS (
        SELECT series_id, n AS o, date_diff('month', DATE '1995-01-01', month) AS idx,
               CASE WHEN month <= DATE '2001-07-01' AND y > 0 THEN CAST(y AS DOUBLE) END AS y FROM sums, span),
    outliers AS (SELECT series_id, idx FROM training WHERE FALSE), {paths(1)}"""

STATEMENTS["croston"] = f"{_RATES} SELECT series_id, coalesce(m, 0) AS demand_months, rate FROM rates"
STATEMENTS["croston_interval"] = f"""{_RATES}
    SELECT p.series_id, p.yhat AS rate, c.spread, p.lo80, p.hi80, p.lo95, p.hi95
    FROM paths p JOIN croston c ON c.series_id = p.series_id WHERE p.model = 'croston'"""


def in_layout(name: str) -> str:
    """The statement with its columns in the published form of the query."""
    columns = []
    for entry in LAYOUTS[name]:
        raw, _, digits = entry.partition("~")
        plain = raw.rstrip("@#")
        column = f'"{plain}"'
        if digits:
            column = f"round(CAST({column} AS DOUBLE), {digits})"
        elif raw.endswith("@"):
            column = f"CAST({column} AS VARCHAR)"
        elif raw.endswith("#"):
            column = f"CAST({column} AS BIGINT)"
        columns.append(f'{column} AS "{plain}"')
    return f"SELECT {', '.join(columns)} FROM ({STATEMENTS[name]}) AS result"


def oracle_sql() -> dict[str, str]:
    return {name: in_layout(name) for name in STATEMENTS}
