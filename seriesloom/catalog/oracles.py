"""Reference SQL per named query, for a SQL engine that reads the same tables.

Each text is a chain of common table expressions and a final SELECT. The chains grow from
observations over the monthly panel to scored forecasts.
"""

from __future__ import annotations

from seriesloom.functions.sums import exact_sum_sql

SALES = """
sales AS (
  SELECT o_orderkey AS rid, n_name AS state, CAST(o_orderdate AS DATE) AS date, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

UNTIDY = SALES + """,
untidy AS (
  SELECT rid, state,
    CASE WHEN rid % 101 = 0 THEN 'not a date'
         WHEN rid % 3 = 0 THEN strftime(date, '%-m/%-d/%Y')
         WHEN rid % 3 = 1 THEN strftime(date, '%d-%m-%Y')
         ELSE strftime(date, '%Y-%m-%d') END AS date,
    CASE WHEN rid % 97 = 0 THEN 'n/a' ELSE ' ' || format('{:,.2f}', total) || ' ' END AS total
  FROM sales
),
typed AS (
  SELECT rid, state, date AS raw_date, total AS raw_total,
    CAST(coalesce(try_strptime(trim(date), '%d-%m-%Y'), try_strptime(trim(date), '%m/%d/%Y'),
                  try_strptime(trim(date), '%Y-%m-%d')) AS DATE) AS date,
    try_cast(regexp_replace(total, '[,\\s]', '', 'g') AS DOUBLE) AS total
  FROM untidy
),
firsts AS (
  SELECT state, date, total FROM (
    SELECT *, row_number() OVER (PARTITION BY state, date ORDER BY rid) AS rn FROM typed) WHERE rn = 1
)"""

EXACT = exact_sum_sql("total")
MONTHLY = SALES + f""",
monthly AS (
  SELECT state, last_day(date) AS date, coalesce({EXACT}, 0) AS total
  FROM sales GROUP BY 1, 2
)"""

CUSTOMER_MONTHS = f"""
months AS (
  SELECT CAST(o_custkey AS VARCHAR) AS state, last_day(CAST(o_orderdate AS DATE)) AS date,
    {exact_sum_sql("o_totalprice")} AS total
  FROM orders GROUP BY 1, 2
)"""

GRID = MONTHLY + """,
calendar AS (
  SELECT last_day(CAST(m AS DATE)) AS date
  FROM (SELECT unnest(generate_series(CAST(date_trunc('month', min(date)) AS TIMESTAMP),
                                      CAST(date_trunc('month', max(date)) AS TIMESTAMP),
                                      INTERVAL 1 MONTH)) AS m FROM monthly)
),
grid AS (
  SELECT s.state, c.date, m.total
  FROM (SELECT DISTINCT state FROM monthly) s CROSS JOIN calendar c
  LEFT JOIN monthly m ON m.state = s.state AND m.date = c.date
),
known AS (
  SELECT *,
    last_value(CASE WHEN total IS NOT NULL THEN pos END IGNORE NULLS) OVER past AS pp,
    last_value(total IGNORE NULLS) OVER past AS pv,
    first_value(CASE WHEN total IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS np,
    first_value(total IGNORE NULLS) OVER ahead AS nv
  FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY date) AS pos FROM grid)
  WINDOW past AS (PARTITION BY state ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY state ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
lines AS (
  SELECT state, date, nv,
    CASE WHEN total IS NOT NULL THEN total WHEN np IS NULL THEN pv
         ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END AS total
  FROM known
)"""

PANEL = GRID + """,
panel AS (
  SELECT state, date, total FROM (
    SELECT state, date, coalesce(total, nv) AS total, count(*) OVER (PARTITION BY state) AS n FROM lines)
  WHERE n >= 12
),
placed AS (
  SELECT state, date, total, row_number() OVER (PARTITION BY state ORDER BY date) - 1 AS idx,
    count(*) OVER (PARTITION BY state) AS n
  FROM panel
),
split AS (
  SELECT state, date, total, idx, n, CASE WHEN idx >= n - 6 THEN 'val' ELSE 'train' END AS split FROM placed
)"""


def _rolling(k: int) -> str:
    return (
        f"CASE WHEN count(total) OVER f{k} = {k} THEN avg(total) OVER f{k} END AS rolling_mean_{k}, "
        f"CASE WHEN count(total) OVER f{k} = {k} THEN stddev_samp(total) OVER f{k} END AS rolling_std_{k}"
    )


LAGS = ", ".join(f"lag(total, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 6, 12))
FRAMES = ", ".join(
    f"f{k} AS (PARTITION BY state ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 6, 12)
)
CALENDAR = (
    "CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, "
    "CAST(year(date) AS INTEGER) AS year, CAST(idx AS INTEGER) AS trend, "
    "sin(2 * pi() * month(date) / 12) AS sin_month, cos(2 * pi() * month(date) / 12) AS cos_month"
)
HOLIDAY_MONTH = "CAST(month(date) IN (1, 2, 5, 7, 9, 10, 11, 12) OR (month(date) = 6 AND year(date) >= 2021) AS INTEGER)"

FEATURES = PANEL + f""",
features AS (
  SELECT state, date, total AS sales, {LAGS}, {_rolling(3)}, {_rolling(6)}, {_rolling(12)}, {CALENDAR},
    {HOLIDAY_MONTH} AS holiday_month, total / nullif(lag(total, 12) OVER w, 0) - 1 AS yoy_growth
  FROM placed
  WINDOW w AS (PARTITION BY state ORDER BY date), {FRAMES}
)"""

LAG_NAMES = [f"lag_{k}" for k in (1, 2, 3, 6, 12)]
MEAN_NAMES = [f"rolling_mean_{k}" for k in (3, 6, 12)]
STD_NAMES = [f"rolling_std_{k}" for k in (3, 6, 12)]
ROLLING_NAMES = [name for pair in zip(MEAN_NAMES, STD_NAMES) for name in pair]
CALENDAR_NAMES = ["month", "quarter", "year", "trend"]


def _r(names: list[str], digits: int = 6) -> str:
    places = {name: 4 if "_std_" in name else digits for name in names}
    return ", ".join(f"round({name}, {places[name]}) AS {name}" for name in names)


ALL_FEATURES = (
    _r(["sales", *LAG_NAMES, *ROLLING_NAMES]) + ", " + ", ".join(CALENDAR_NAMES) + ", "
    + _r(["sin_month", "cos_month"]) + ", holiday_month, " + _r(["yoy_growth"])
)
COMPLETE = " AND ".join(f"{name} IS NOT NULL" for name in [*LAG_NAMES, *ROLLING_NAMES, "yoy_growth"])

SCALED = PANEL + """,
scaled AS (
  SELECT state, date, total, idx, split, lo, rng, (total - lo) / rng AS z FROM (
    SELECT *, min(CASE WHEN split = 'train' THEN total END) OVER (PARTITION BY state) AS lo,
      max(CASE WHEN split = 'train' THEN total END) OVER (PARTITION BY state)
      - min(CASE WHEN split = 'train' THEN total END) OVER (PARTITION BY state) + 1e-8 AS rng
    FROM split)
)"""

DICKEY_FULLER = PANEL + """,
changes AS (
  SELECT state, total - lag(total) OVER w AS delta, lag(total) OVER w AS level
  FROM split WHERE split = 'train' WINDOW w AS (PARTITION BY state ORDER BY date)
),
moments AS (
  SELECT state, regr_count(delta, level) AS n, regr_sxx(delta, level) AS sxx, regr_syy(delta, level) AS syy,
    regr_sxy(delta, level) AS sxy
  FROM changes GROUP BY state
),
tested AS (
  SELECT state, CAST(n AS BIGINT) AS n,
    (sxy / sxx) / sqrt(((syy - (sxy / sxx) * sxy) / (n - 2)) / sxx) AS t_stat
  FROM moments
),
stationarity AS (
  SELECT *, coalesce(t_stat < -2.8621 - 2.738 / n - 8.36 / (n * n), false) AS stationary FROM tested
)"""

PREDICTIONS = PANEL + """,
frame AS (
  SELECT p.state, p.date, p.total, p.idx, f.phase, f.steps, p.n - f.held AS n_fit, p.idx < p.n - f.held AS fit
  FROM placed p CROSS JOIN (VALUES ('val', 6, 6), ('future', 0, 2)) f(phase, held, steps)
),
fits AS (
  SELECT state, phase, steps, n_fit, max(CASE WHEN fit THEN date END) AS last_date,
    regr_slope(CASE WHEN fit THEN total END, idx) AS slope, regr_intercept(CASE WHEN fit THEN total END, idx) AS intercept
  FROM frame GROUP BY state, phase, steps, n_fit
),
steps AS (
  SELECT *, last_day(CAST(date_trunc('month', last_date) + to_months(CAST(step AS INTEGER)) AS DATE)) AS date
  FROM (SELECT *, unnest(generate_series(1, steps)) AS step FROM fits)
),
made AS (
  SELECT s.state, 'seasonal_naive' AS model, s.phase, s.step, s.date, p.total AS yhat
  FROM steps s JOIN placed p ON p.state = s.state AND p.idx = s.n_fit - 12 + (s.step - 1) % 12
  UNION ALL
  SELECT state, 'linear_trend', phase, step, date, intercept + slope * (n_fit - 1 + step) FROM steps
),
predictions AS (
  SELECT m.state, m.model, m.phase, CAST(m.step AS INTEGER) AS step, m.date, greatest(m.yhat, 0) AS yhat, p.total AS y
  FROM made m LEFT JOIN panel p ON p.state = m.state AND p.date = m.date
),
metrics AS (
  SELECT state, model, round(avg(abs(y - yhat)), 4) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse,
    round(avg(abs(y - yhat) / nullif(abs(y), 0) * 100), 4) AS mape,
    round(avg(abs(y - yhat) / nullif((abs(y) + abs(yhat)) / 2, 0) * 100), 4) AS smape
  FROM predictions WHERE phase = 'val' GROUP BY state, model
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY mape NULLS LAST, round(rmse, 2) NULLS LAST,
    CASE model WHEN 'seasonal_naive' THEN 1 ELSE 2 END) AS rank FROM metrics
),
best AS (SELECT state, model AS best_model, mape, round(rmse, 2) AS rmse FROM ranked WHERE rank = 1),
winner AS (
  SELECT b.state, b.best_model, p.step, p.date, round(p.yhat, 4) AS value
  FROM best b JOIN predictions p ON p.state = b.state AND p.model = b.best_model AND p.phase = 'future'
)"""

REQUESTS = PREDICTIONS + """,
requests AS (
  SELECT lower(n_name) AS request FROM nation UNION SELECT n_name FROM nation UNION SELECT r_name FROM region
),
answers AS (
  SELECT request, state, best_model FROM (
    SELECT r.request, b.state, b.best_model,
      row_number() OVER (PARTITION BY r.request ORDER BY r.request <> b.state, b.state) AS rn
    FROM requests r LEFT JOIN best b ON lower(b.state) = lower(r.request)) WHERE rn = 1
)"""

HOLIDAYS = """
years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
near AS (SELECT year FROM years UNION SELECT year + 1 FROM years),
fixed AS (
  SELECT make_date(year, m, d) AS date, name
  FROM near, (VALUES (1, 'New Year''s Day', 1, 1), (2021, 'Juneteenth National Independence Day', 6, 19),
                     (1, 'Independence Day', 7, 4), (1, 'Veterans Day', 11, 11), (1, 'Christmas Day', 12, 25))
       f(since, name, m, d)
  WHERE year >= since
),
days AS (
  SELECT CAST(unnest(generate_series(CAST(make_date(year, 1, 1) AS TIMESTAMP), CAST(make_date(year, 12, 31) AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS date FROM years
),
weekday AS (
  SELECT date, CASE
    WHEN month(date) = 1 AND isodow(date) = 1 AND day(date) BETWEEN 15 AND 21 AND year(date) >= 1986
      THEN 'Martin Luther King Jr. Day'
    WHEN month(date) = 2 AND isodow(date) = 1 AND day(date) BETWEEN 15 AND 21 THEN 'Washington''s Birthday'
    WHEN month(date) = 5 AND isodow(date) = 1 AND day(date) >= 25 THEN 'Memorial Day'
    WHEN month(date) = 9 AND isodow(date) = 1 AND day(date) <= 7 THEN 'Labor Day'
    WHEN month(date) = 10 AND isodow(date) = 1 AND day(date) BETWEEN 8 AND 14 THEN 'Columbus Day'
    WHEN month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28 THEN 'Thanksgiving' END AS name
  FROM days
),
holidays AS (
  SELECT date, name FROM fixed
  UNION ALL SELECT CASE isodow(date) WHEN 6 THEN date - 1 WHEN 7 THEN date + 1 END, name || ' (observed)' FROM fixed
  UNION ALL SELECT date, name FROM weekday WHERE name IS NOT NULL
),
calendar_days AS (SELECT date, name FROM holidays WHERE year(date) IN (SELECT year FROM years))"""


def _with(chain: str, select: str) -> str:
    joiner = "" if select.strip().startswith(",") else "\n"
    return f"WITH {chain.strip()}{joiner}{select.strip()}"


def _month_cells() -> str:
    return ", ".join(f"round(coalesce(max(total) FILTER (month = {m}), 0), 4) AS m{m:02d}" for m in range(1, 13))


def _next_cells() -> str:
    cells = [f"max(CASE WHEN idx = n - {k} THEN total END) AS lag_{k}" for k in (1, 2, 3, 6, 12)]
    for k in (3, 6, 12):
        cells.append(f"avg(CASE WHEN idx >= n - {k} THEN total END) AS rolling_mean_{k}")
        cells.append(f"stddev_samp(CASE WHEN idx >= n - {k} THEN total END) AS rolling_std_{k}")
    return ", ".join(cells)


def _fourier_cells() -> str:
    return ", ".join(
        f"round(sin(2 * pi() * month(date) / 12 * {k}), 6) AS sin_{k}, round(cos(2 * pi() * month(date) / 12 * {k}), 6) AS cos_{k}"
        for k in range(1, 5)
    )


def _scaled_cells() -> str:
    """Features of the pooled trees in their order, relative to the range of the series."""
    cells = [f"({name} - lo) / rng" for name in LAG_NAMES]
    for k in (3, 6, 12):
        cells += [f"(rolling_mean_{k} - lo) / rng", f"coalesce(rolling_std_{k}, 0) / rng"]
    return ", ".join(f"CAST({c} AS DOUBLE)" for c in [*cells, "month", "quarter", "year", "trend", "sin_month", "cos_month", "growth"])


def _design_cells(points: int = 25, orders: int = 6) -> str:
    hinges = [f"greatest(time - {0.8 * (i + 1) / points:.17e}, 0)" for i in range(points)]
    waves = [f"{f}(2 * pi() * month(date) / 12 * {k})" for k in range(1, orders + 1) for f in ("sin", "cos")]
    return ", ".join(f"CAST({c} AS DOUBLE)" for c in ["1", "time", *hinges, *waves, HOLIDAY_MONTH])


TOP = f"SELECT state, {EXACT} AS total FROM panel GROUP BY state ORDER BY total DESC, state LIMIT 10"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["scan_raw"] = _with(UNTIDY, """
      SELECT CAST(rid AS VARCHAR) AS order_key, state, date, CASE WHEN total <> 'n/a' THEN total END AS total FROM untidy""")
    q["normalize_columns"] = _with(UNTIDY, "SELECT rid AS order_key, state, date, total FROM untidy")
    q["parse_dates"] = _with(UNTIDY, "SELECT rid, raw_date, date FROM typed")
    q["clean_totals"] = _with(UNTIDY, "SELECT rid, raw_total, total FROM typed")
    q["dedupe_first"] = _with(UNTIDY, "SELECT state, date, total FROM firsts")
    q["clean_sales"] = _with(UNTIDY, "SELECT state, date, total FROM firsts WHERE date IS NOT NULL")
    q["quality_report"] = _with(UNTIDY, """
      SELECT CAST(count(*) AS BIGINT) AS n_rows_raw, CAST(count(*) FILTER (date IS NULL) AS BIGINT) AS n_bad_dates,
        CAST(count(*) FILTER (date IS NOT NULL AND total IS NULL) AS BIGINT) AS n_bad_totals,
        CAST(count(date) - count(DISTINCT CASE WHEN date IS NOT NULL THEN (state, date) END) AS BIGINT) AS n_duplicates,
        CAST(count(DISTINCT CASE WHEN date IS NOT NULL THEN (state, date) END) AS BIGINT) AS n_rows_clean,
        CAST(count(DISTINCT CASE WHEN date IS NOT NULL THEN state END) AS BIGINT) AS n_states,
        min(date) AS min_date, max(date) AS max_date
      FROM typed""")
    q["quality_observed"] = q["quality_report"]
    q["select_states"] = _with(MONTHLY, """
      SELECT state, date, total FROM monthly WHERE state IN (
        SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""")
    q["resume_pending"] = _with(MONTHLY, """
      SELECT state, max(date) AS fit_end FROM monthly WHERE state NOT IN (
        SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA') GROUP BY state""")

    q["monthly_sum"] = _with(MONTHLY, "SELECT state, date, total FROM monthly")
    q["dense_grid"] = _with(GRID, "SELECT state, date, total FROM grid")
    q["interpolate_linear"] = _with(GRID, "SELECT state, date, round(total, 6) AS total FROM lines")
    q["forward_fill"] = _with(GRID, "SELECT state, date, pv AS total FROM known")
    q["back_fill"] = _with(GRID, "SELECT state, date, nv AS total FROM known")
    q["min_periods"] = _with(CUSTOMER_MONTHS, """
      SELECT state, date, total FROM months WHERE state IN (
        SELECT state FROM months GROUP BY state HAVING count(total) >= 12)""")
    q["dropped_states"] = _with(CUSTOMER_MONTHS, "SELECT state FROM months GROUP BY state HAVING count(total) < 12")
    q["monthly_panel"] = _with(PANEL, "SELECT state, date, round(total, 6) AS total FROM panel")
    q["train_val_split"] = _with(PANEL, "SELECT state, date, round(total, 6) AS total, split FROM split")
    q["full_series"] = _with(PANEL, """
      SELECT state, date, round(total, 6) AS total FROM split WHERE split = 'train'
      UNION ALL SELECT state, date, round(total, 6) FROM split WHERE split = 'val'""")
    q["split_report"] = _with(PANEL, """
      SELECT state, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
        max(date) FILTER (split = 'train') AS last_train, min(date) FILTER (split = 'val') AS first_val
      FROM split GROUP BY state""")
    q["split_overlap"] = _with(PANEL, """
      SELECT count(*) AS n_overlap FROM (
        SELECT state, date FROM split WHERE split = 'train' INTERSECT SELECT state, date FROM split WHERE split = 'val')""")
    q["min_train_filter"] = _with(CUSTOMER_MONTHS, """
      SELECT state, date, total, split FROM (
        SELECT *, count(*) FILTER (split = 'train') OVER (PARTITION BY state) AS n_train FROM (
          SELECT *, CASE WHEN row_number() OVER (PARTITION BY state ORDER BY date DESC) <= 6 THEN 'val' ELSE 'train' END AS split
          FROM months)) WHERE n_train >= 10""")
    q["state_series"] = _with(MONTHLY, """
      SELECT 'NATION_7' AS state, c.date, m.total FROM (
        SELECT last_day(CAST(unnest(generate_series(CAST(date_trunc('month', min(date)) AS TIMESTAMP),
          CAST(date_trunc('month', max(date)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS date
        FROM monthly WHERE state = 'NATION_7') c
      LEFT JOIN monthly m ON m.date = c.date AND m.state = 'NATION_7'""")
    q["infer_frequency"] = _with(MONTHLY, """
      SELECT state, CASE WHEN count(*) >= 3 AND bool_and(steady) AND bool_and(date = last_day(date)) THEN 'ME'
                         WHEN count(*) >= 3 AND bool_and(steady) AND bool_and(day(date) = 1) THEN 'MS' ELSE 'ME' END AS freq
      FROM (SELECT *, coalesce(datediff('month', lag(date) OVER (PARTITION BY state ORDER BY date), date) = 1, true) AS steady
            FROM monthly) GROUP BY state""")
    q["future_calendar"] = _with(PANEL, """
      SELECT state, CAST(step AS INTEGER) AS step,
        last_day(CAST(date_trunc('month', last) + to_months(CAST(step AS INTEGER)) AS DATE)) AS date
      FROM (SELECT state, max(date) AS last, unnest(generate_series(1, 2)) AS step FROM panel GROUP BY state)""")
    q["panel_summary"] = _with(PANEL, """
      SELECT count(*) AS n_rows, count(DISTINCT state) AS n_states, count(DISTINCT date) AS n_months,
        min(date) AS min_date, max(date) AS max_date FROM panel""")

    q["build_features"] = _with(FEATURES, f"SELECT state, date, {ALL_FEATURES} FROM features")
    q["supervised"] = _with(FEATURES, f"SELECT state, date, {ALL_FEATURES} FROM features WHERE {COMPLETE}")
    filled = ", ".join(f"round(coalesce({name}, 0), 4) AS {name}" for name in STD_NAMES)
    q["model_features"] = _with(FEATURES, f"""
      SELECT state, date, {_r(["sales", *LAG_NAMES, *MEAN_NAMES])}, {filled}, {", ".join(CALENDAR_NAMES)},
        {_r(["sin_month", "cos_month"])}, round(coalesce(yoy_growth, 0), 6) AS yoy_growth
      FROM features WHERE lag_12 IS NOT NULL AND rolling_mean_12 IS NOT NULL""")
    q["lag_features"] = _with(FEATURES, f"SELECT state, date, {_r(LAG_NAMES)} FROM features")
    q["rolling_mean"] = _with(FEATURES, f"SELECT state, date, {_r(MEAN_NAMES)} FROM features")
    q["rolling_std"] = _with(FEATURES, f"SELECT state, date, {_r(STD_NAMES)} FROM features")
    q["calendar_features"] = _with(FEATURES, f"""
      SELECT state, date, {", ".join(CALENDAR_NAMES)}, {_r(["sin_month", "cos_month"])} FROM features""")
    q["yoy_growth"] = _with(FEATURES, "SELECT state, date, round(yoy_growth, 6) AS yoy_growth FROM features")
    q["next_step_features"] = _with(PANEL, f"""
      SELECT state, date, {_r([*LAG_NAMES, *ROLLING_NAMES])}, {CALENDAR.replace("sin(", "round(sin(").replace("/ 12) AS sin_month", "/ 12), 6) AS sin_month").replace("cos(", "round(cos(").replace("/ 12) AS cos_month", "/ 12), 6) AS cos_month")},
        round(coalesce(lag_1 / nullif(lag_12, 0) - 1, 0), 6) AS yoy_growth
      FROM (SELECT state, max(n) AS idx,
              last_day(CAST(date_trunc('month', max(date)) + INTERVAL 1 MONTH AS DATE)) AS date, {_next_cells()}
            FROM placed GROUP BY state)""")
    q["holiday_calendar"] = _with(HOLIDAYS, "SELECT date, name FROM calendar_days")
    q["holiday_day_counts"] = _with(HOLIDAYS + "," + PANEL, """
      SELECT p.date, replace(c.name, ' (observed)', '') AS holiday, CAST(count(*) AS INTEGER) AS days
      FROM (SELECT DISTINCT date FROM panel) p JOIN calendar_days c ON last_day(c.date) = p.date GROUP BY 1, 2""")
    q["holiday_month"] = _with(HOLIDAYS + "," + MONTHLY, """
      SELECT m.state, m.date, CAST(m.date IN (SELECT last_day(date) FROM calendar_days) AS INTEGER) AS holiday_month
      FROM monthly m""")
    q["fourier_terms"] = _with(MONTHLY, f"SELECT state, date, {_fourier_cells()} FROM monthly")
    q["scale_minmax"] = _with(SCALED, f"SELECT state, date, split, {_r(['z', 'lo', 'rng'], 6)} FROM scaled")
    q["inverse_scale"] = _with(SCALED, "SELECT state, date, round(z * rng + lo, 4) AS total FROM scaled")
    q["make_sequences"] = _with(SCALED, """
      SELECT a.state, a.date, round(a.z, 6) AS y, CAST(p.pos AS INTEGER) AS pos, round(b.z, 6) AS x
      FROM scaled a CROSS JOIN range(12) p(pos) JOIN scaled b ON b.state = a.state AND b.idx = a.idx - 12 + p.pos
      WHERE a.idx >= 12""")
    q["tail_split"] = _with(PANEL, """
      SELECT state, date, CASE WHEN idx >= n - greatest(1, floor((n - 12) * 0.2)) THEN 'val' ELSE 'train' END AS part
      FROM placed WHERE idx >= 12""")

    q["top_states"] = _with(PANEL, f"SELECT state, round(total, 4) AS total FROM ({TOP})")
    q["aggregate_trend"] = _with(PANEL, f"SELECT date, round({EXACT}, 4) AS total FROM panel GROUP BY date")
    q["seasonality_pivot"] = _with(PANEL, f"""
      SELECT year, {_month_cells()} FROM (
        SELECT CAST(year(date) AS INTEGER) AS year, month(date) AS month, {EXACT} AS total FROM panel GROUP BY 1, 2)
      GROUP BY year""")
    q["seasonal_decompose"] = _with(PANEL, """
      , averaged AS (
        SELECT state, date, total, idx, n, min(total) OVER (PARTITION BY state) AS least,
          CASE WHEN idx >= 6 AND idx < n - 6 THEN
            (sum(total) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
             + 0.5 * (lag(total, 6) OVER (PARTITION BY state ORDER BY date) + lead(total, 6) OVER (PARTITION BY state ORDER BY date))) / 12 END AS trend
        FROM placed),
      phases AS (
        SELECT state, idx % 12 AS phase, avg(total / trend) AS mean FROM averaged WHERE n >= 24 AND least > 0 GROUP BY 1, 2),
      levels AS (SELECT state, avg(mean) AS level FROM phases GROUP BY state)
      SELECT a.state, a.date, round(a.total, 6) AS total, CASE WHEN l.level IS NOT NULL THEN round(a.trend, 6) END AS trend,
        round(p.mean / l.level, 6) AS seasonal, round(a.total / (p.mean / l.level) / a.trend, 6) AS residual,
        CASE WHEN n < 24 THEN 'fewer than 24 months' WHEN least <= 0 THEN 'a value of 0 or less' END AS reason
      FROM averaged a LEFT JOIN phases p ON p.state = a.state AND p.phase = a.idx % 12 LEFT JOIN levels l ON l.state = a.state""")
    q["df_test"] = _with(DICKEY_FULLER, "SELECT state, n, round(t_stat, 6) AS t_stat, stationary FROM stationarity")
    q["adf_one_lag"] = _with(DICKEY_FULLER, """
      , lagged AS (SELECT *, lag(delta) OVER (PARTITION BY state ORDER BY date) AS before FROM (
          SELECT state, date, total - lag(total) OVER w AS delta, lag(total) OVER w AS level
          FROM split WHERE split = 'train' WINDOW w AS (PARTITION BY state ORDER BY date))),
      squares AS (SELECT state, count(*) AS n, regr_sxx(delta, level) AS ll, regr_sxx(delta, before) AS bb, regr_sxy(before, level) AS lb,
                    regr_sxy(delta, level) AS dl, regr_sxy(delta, before) AS db, regr_syy(delta, level) AS dd
                  FROM lagged WHERE before IS NOT NULL GROUP BY state),
      slopes AS (SELECT *, (dl * bb - db * lb) / (ll * bb - lb * lb) AS g, (db * ll - dl * lb) / (ll * bb - lb * lb) AS h FROM squares),
      ratio AS (SELECT state, n, g / sqrt((dd - g * dl - h * db) / (n - 3) * bb / (ll * bb - lb * lb)) AS t FROM slopes)
      SELECT state, CAST(n AS BIGINT) AS n, round(t, 4) AS t_stat,
        t <= -18.83 OR 2.1659 + 1.4412 * t + 0.038269 * t * t < -1.6448536269514722 AS stationary FROM ratio""")
    q["order_candidates"] = _with(DICKEY_FULLER, """
      SELECT s.state, CAST(p.v AS INTEGER) AS p, CASE WHEN stationary THEN 0 ELSE 1 END AS d, CAST(q.v AS INTEGER) AS q,
        CAST(sp.v AS INTEGER) AS sp, CAST(sd.v AS INTEGER) AS sd, CAST(sq.v AS INTEGER) AS sq,
        CAST(p.v * 24 + q.v * 8 + sp.v * 4 + sd.v * 2 + sq.v AS INTEGER) AS rank
      FROM stationarity s, range(3) p(v), range(3) q(v), range(2) sp(v), range(2) sd(v), range(2) sq(v)""")
    q["format_report"] = _with(PANEL, f"""
      SELECT state, printf('$%.2fB', total / 1e9) AS billions, '$' || format('{{:,.0f}}', total) AS dollars FROM ({TOP})""")

    one = "SELECT state, model, phase, step, date, round(yhat, 4) AS yhat, round(y, 4) AS y FROM predictions WHERE model = "
    q["forecast_seasonal_naive"] = _with(PREDICTIONS, one + "'seasonal_naive'")
    q["forecast_linear_trend"] = _with(PREDICTIONS, one + "'linear_trend'")
    q["score_models"] = _with(PREDICTIONS, "SELECT * FROM metrics")
    q["best_model"] = _with(PREDICTIONS, "SELECT state, best_model, mape, rmse FROM best")
    q["model_wins"] = _with(PREDICTIONS, "SELECT best_model, count(*) AS wins FROM best GROUP BY best_model")
    q["leaderboard"] = _with(PREDICTIONS, """
      SELECT model, CAST(wins AS BIGINT) AS wins, round(wins / total * 100, 1) AS win_pct, round(avg_mape, 2) AS avg_val_mape,
        CAST(total AS BIGINT) AS total_states
      FROM (SELECT model, count(*) FILTER (rank = 1) AS wins, avg(mape) AS avg_mape FROM ranked GROUP BY model),
           (SELECT count(*) AS total FROM best)
      WHERE wins > 0""")
    q["best_forecast"] = _with(PREDICTIONS, "SELECT state, best_model, step, date, value FROM winner")
    q["forecast_points"] = q["best_forecast"]
    q["compare_models"] = _with(PREDICTIONS, """
      SELECT p.state, b.best_model, p.model, m.mae, m.rmse, m.mape, m.smape, p.step, p.date, round(p.yhat, 4) AS value
      FROM predictions p JOIN best b ON b.state = p.state JOIN metrics m ON m.state = p.state AND m.model = p.model
      WHERE p.phase = 'future'""")
    q["forecast_record"] = _with(PREDICTIONS, """
      SELECT w.state, e.fit_end, w.best_model, w.part, w.date, w.value
      FROM (SELECT state, best_model, 'forecast' AS part, date, value FROM winner
            UNION ALL SELECT b.state, b.best_model, 'validation', p.date, round(p.y, 4)
            FROM best b JOIN predictions p ON p.state = b.state AND p.model = b.best_model AND p.phase = 'val') w
      JOIN (SELECT state, max(date) AS fit_end FROM panel GROUP BY state) e ON e.state = w.state""")
    q["final_summary"] = _with(PREDICTIONS, """
      SELECT state, best_model, max(value) FILTER (step = 1) AS step_1, max(value) FILTER (step = 2) AS step_2
      FROM winner GROUP BY state, best_model""")
    q["chart_frame"] = _with(PREDICTIONS, """
      SELECT state, split AS kind, CAST(NULL AS VARCHAR) AS model, date, round(total, 4) AS value FROM split
      UNION ALL SELECT state, 'val_forecast', model, date, round(yhat, 4) FROM predictions WHERE phase = 'val'
      UNION ALL SELECT state, 'forecast', best_model, date, value FROM winner""")
    q["list_states"] = _with(PREDICTIONS, "SELECT state FROM best ORDER BY state")
    q["lookup_state"] = _with(REQUESTS, "SELECT request, state, best_model FROM answers")
    q["batch_lookup"] = _with(REQUESTS, """
      SELECT a.request, a.best_model, w.step, w.date, w.value,
        CASE WHEN a.state IS NULL THEN '''' || a.request || ''' not found. GET /states for list.' END AS error
      FROM answers a LEFT JOIN winner w ON w.state = a.state""")
    q["forecast_response"] = _with(REQUESTS, """
      SELECT a.request AS state, a.best_model, CAST(2 AS INTEGER) AS forecast_steps, 'USD (monthly sales)' AS unit,
        w.step, w.date, w.value
      FROM answers a JOIN winner w ON w.state = a.state""")
    q["health"] = _with(PREDICTIONS, "SELECT 'healthy' AS status, count(*) AS states_loaded FROM best")
    q["store_round_trip"] = q["best_forecast"]
    q["skipped_series"] = _with(CUSTOMER_MONTHS, """
      , phased AS (
        SELECT s.state, f.phase, s.n - f.held AS n_fit
        FROM (SELECT state, count(*) AS n FROM months GROUP BY state) s CROSS JOIN (VALUES ('val', 6), ('future', 0)) f(phase, held))
      SELECT state, phase, m.model, n_fit || ' points, ' || m.needs || m.least AS reason
      FROM phased, (VALUES ('seasonal_naive', 'last year''s value needs at least ', 12),
                           ('linear_trend', 'a line needs at least ', 2)) m(model, needs, least)
      WHERE n_fit < m.least""")
    q["failed_states"] = _with(CUSTOMER_MONTHS, "SELECT state FROM months GROUP BY state HAVING count(*) - 6 < 2")
    q["monotone_dates"] = _with(PANEL, """
      SELECT state, count(*) AS n, bool_and(rises) AS monotone FROM (
        SELECT state, coalesce(date > lag(date) OVER (PARTITION BY state ORDER BY date), true) AS rises FROM panel) GROUP BY state""")
    q["gbt_training_rows"] = _with(FEATURES, f"""
      , wide AS (
        SELECT *, min(sales) OVER s AS lo, max(sales) OVER s - min(sales) OVER s + 1e-8 AS rng,
          coalesce(lag_1 / nullif(lag(sales, 13) OVER (PARTITION BY state ORDER BY date), 0) - 1, 0) AS growth
        FROM features WINDOW s AS (PARTITION BY state)),
      listed AS (
        SELECT state, date, (sales - lo) / rng AS label, [{_scaled_cells()}] AS cells FROM wide
        WHERE lag_12 IS NOT NULL AND rolling_mean_12 IS NOT NULL)
      SELECT state, date, round(label, 4) AS label, CAST(i.pos AS INTEGER) AS pos, round(cells[i.pos + 1], 4) AS value
      FROM listed, range(18) i(pos)""")
    q["huber_windows"] = _with(PANEL, """
      , ranged AS (
        SELECT state, date, idx, (total - min(total) OVER s) / (max(total) OVER s - min(total) OVER s + 1e-8) AS z
        FROM placed WINDOW s AS (PARTITION BY state))
      SELECT a.state, a.date, round(a.z, 6) AS label, CAST(p.pos AS INTEGER) AS pos, round(b.z, 6) AS x
      FROM ranged a CROSS JOIN range(12) p(pos) JOIN ranged b ON b.state = a.state AND b.idx = a.idx - 12 + p.pos
      WHERE a.idx >= 12""")
    q["trend_design"] = _with(PANEL, f"""
      , timed AS (SELECT state, date, idx / greatest(n - 1, 1) AS time FROM placed),
      listed AS (SELECT state, date, [{_design_cells()}] AS cells FROM timed)
      SELECT state, date, CAST(i.pos AS INTEGER) AS pos, round(cells[i.pos + 1], 6) AS x FROM listed, range(40) i(pos)""")
    q["model_output_checks"] = _with(PREDICTIONS, """
      SELECT s.state, m.model, s.phase, CAST(s.step AS INTEGER) AS step, s.date, true AS good, round(p.total, 4) AS y
      FROM steps s CROSS JOIN (VALUES ('seasonal_ar'), ('trend_seasonal'), ('gbt_lag'), ('window_huber'), ('seasonal_naive'),
                                      ('linear_trend')) m(model)
      LEFT JOIN panel p ON p.state = s.state AND p.date = s.date""")
    phases = """
      , numbered AS (SELECT state, date, total, row_number() OVER w AS idx, count(*) OVER (PARTITION BY state) AS n
                   FROM panel WINDOW w AS (PARTITION BY state ORDER BY date)),
      fitted AS (SELECT state, phase, steps, max(idx) AS n, max(date) AS last_date, arg_max(total, idx) AS newest, arg_min(total, idx) AS oldest,
                   avg(total) FILTER (idx > n - held - 12) AS yhat
                 FROM numbered CROSS JOIN (VALUES ('val', 6, 6), ('future', 0, 2)) f(phase, held, steps) WHERE idx <= n - held GROUP BY state, phase, steps)"""
    q["forecast_plugin"] = _with(PANEL, f"""{phases}
      SELECT state, 'recent_mean' AS model, phase, step, CAST(last_day(date_trunc('month', last_date) + to_months(step)) AS DATE) AS date, round(yhat, 4) AS yhat
      FROM (SELECT *, CAST(unnest(generate_series(1, steps)) AS INTEGER) AS step FROM fitted)""")
    q["plugin_failures"] = _with(PANEL, f"""{phases}
      SELECT state, 'rising_only' AS model, phase, 'ValueError: fell over ' || n || ' months' AS reason FROM fitted WHERE newest < oldest""")
    q["stepwise_commit"] = q["best_forecast"]
    q["stored_winners"] = q["best_forecast"]
    q["distinct_sketches"] = """
      SELECT n_name AS state, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS n_distinct
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
    q["stored_panel"] = q["monthly_panel"]
    q["history_view"] = _with(PREDICTIONS, """
      SELECT state, 'history' AS kind, date, round(total, 4) AS value FROM placed WHERE idx >= n - 36
      UNION ALL SELECT state, 'forecast', date, value FROM winner""")
    return q
