"""Decomposition, forecast, scoring and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY
from shelfspark.operators import anomaly as N
from shelfspark.operators import cleaning as C
from shelfspark.operators import forecast as O
from shelfspark.operators import inventory as I
from shelfspark.operators import pricing as E
from shelfspark.operators.windows import latest_row
from shelfspark.plans.inventory import _days, _traj, _traj_sql, kpis
from shelfspark.plans.registry import CTES, query
from shelfspark.session import written

_w = "PARTITION BY product_name ORDER BY week_start"
_d = "PARTITION BY product_name ORDER BY date"


def _decomp(src, p, mult):
    """Classical decomposition of (product_name, date, y) at a fixed period p."""
    h = p // 2
    fr = f"({_d} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    ends = f"- 0.5 * (FIRST_VALUE(y) OVER {fr} + LAST_VALUE(y) OVER {fr})" if p % 2 == 0 else ""
    op, inv = ("/", "*") if mult else ("-", "+")
    return f"""WITH s AS (SELECT *, ROW_NUMBER() OVER ({_d}) - 1 AS i, COUNT(*) OVER (PARTITION BY product_name) AS n, MIN(y) OVER (PARTITION BY product_name) AS low FROM ({src})),
        t AS (SELECT *, CASE WHEN COUNT(*) OVER {fr} = {2 * h + 1} THEN (SUM(y) OVER {fr} {ends}) / {p} END AS trend FROM s WHERE n >= {'52' if mult else 2 * p} {'AND low > 0' if mult else ''}),
        m AS (SELECT product_name, i % {p} AS slot, AVG(y {op} trend) AS sm FROM t GROUP BY 1, 2),
        l AS (SELECT product_name, AVG(sm) AS lev FROM m GROUP BY 1)
        SELECT t.product_name, date, y AS sales_qty, trend, sm {op} lev AS seasonal, y {op} ({'(sm / lev) * trend' if mult else '(sm - lev) + trend'}) AS resid
        FROM t JOIN m ON m.product_name = t.product_name AND m.slot = t.i % {p} JOIN l ON l.product_name = t.product_name"""


DEC = "product_name, date:d, sales_qty, trend:6, seasonal:6, resid:6"
_week_y = "SELECT s.product_name, s.week_start + 6 AS date, COALESCE(p.sales_qty, 0) AS y FROM spine s LEFT JOIN panel p USING (product_name, week_start)"
query("decompose_classical", DEC, lambda t: O.decompose_classical(t.panel), _decomp(_week_y, 52, True))

_day_y = f"""SELECT product_name, date, COALESCE(LAST_VALUE(sales_qty IGNORE NULLS) OVER ({_d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS y
                  FROM (SELECT s.product_name, s.date, sales_qty FROM day_spine s LEFT JOIN daily USING (product_name, date))"""


def filled_days(t):
    return C.ffill_bfill(C.spine_daily(t.daily.select(KEY, "date", "sales_qty")), KEY, ["sales_qty"], "date")


query("decompose_additive", DEC, lambda t: O.decompose_additive(filled_days(t), 7), _decomp(_day_y, 7, False))


def _local(step, src, part, at, value, half, out):
    """Local line of `value` over the rows of the same `part` by a join of near positions."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in part)
    return f"""{step}p AS (SELECT a.product_name, a.i, b.{at} - a.{at} AS d, {value} AS v, POW(1 - POW(ABS(b.{at} - a.{at}) / ({half} + 1e0), 3), 3) * b.weight AS w
            FROM {src} a JOIN {src} b ON {same} AND b.{at} BETWEEN a.{at} - {half} AND a.{at} + {half}),
        {step}m AS (SELECT product_name, i, SUM(w) AS s0, SUM(w * d) AS s1, SUM(w * d * d) AS s2, SUM(w * v) AS t0, SUM(w * d * v) AS t1 FROM {step}p GROUP BY 1, 2),
        {step} AS (SELECT s.*, CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s2 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS {out} FROM {src} s JOIN {step}m USING (product_name, i))"""


def _robust(src, p, inner, robust):
    """Local regression twin: passes over positions joined with their neighbours."""
    half, k = int(0.955 * p) + 1, p // 2
    fr = f"(PARTITION BY product_name ORDER BY i ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    mean = f"(SUM(cyclic) OVER {fr} {f'- 0.5e0 * (FIRST_VALUE(cyclic) OVER {fr} + LAST_VALUE(cyclic) OVER {fr})' if p % 2 == 0 else ''}) / {p}"
    steps = [f"""z0 AS (SELECT product_name, date, y, i, n, i % {p} AS slot, i // {p} AS cycle, 0e0 AS trend, 0e0 AS seasonal, 1e0 AS weight
        FROM (SELECT product_name, date, CAST(y AS DOUBLE) AS y, ROW_NUMBER() OVER ({_d}) - 1 AS i, COUNT(*) OVER (PARTITION BY product_name) AS n FROM ({src})) WHERE n >= {2 * p})"""]
    last = "z0"
    for outer in range(robust + 1):
        for step in range(inner):
            at = f"q{outer}{step}"
            steps += [
                _local(f"{at}c", last, ["product_name", "slot"], "cycle", "b.y - b.trend", 3, "cyclic"),
                f"{at}l AS (SELECT *, CASE WHEN COUNT(*) OVER {fr} = {2 * k + 1} THEN {mean} END AS level FROM {at}c)",
                f"{at}e AS (SELECT product_name, ARG_MIN(level, i) AS first, ARG_MAX(level, i) AS last FROM {at}l WHERE level IS NOT NULL GROUP BY 1)",
                f"""{at}s AS (SELECT product_name, date, y, i, n, slot, cycle, weight, cyclic - COALESCE(level, CASE WHEN 2 * i < n THEN first ELSE last END) AS seasonal
                    FROM {at}l JOIN {at}e USING (product_name))""",
                _local(f"{at}t", f"{at}s", ["product_name"], "i", "b.y - b.seasonal", half, "trend"),
            ]
            last = f"{at}t"
        if outer < robust:
            steps.append(f"""w{outer} AS (SELECT product_name, date, y, i, n, slot, cycle, trend, seasonal, CASE WHEN c <= 1e-9 THEN 1e0 WHEN r >= c THEN 1e-4 / POW(r / c, 2) ELSE GREATEST(1e-4, POW(1 - POW(r / c, 2), 2)) END AS weight
                FROM (SELECT *, 6 * MEDIAN(r) OVER (PARTITION BY product_name) AS c FROM (SELECT *, ABS(y - seasonal - trend) AS r FROM {last})))""")
            last = f"w{outer}"
    return f"WITH {', '.join(steps)} SELECT product_name, date, y AS sales_qty, trend, seasonal, y - seasonal - trend AS resid, weight FROM {last}"


ROBUST = f"{DEC}, weight:6"
query("decompose_robust", ROBUST, lambda t: O.decompose_robust(filled_days(t), 7), _robust(_day_y, 7, 2, 1))
query("decompose_robust_weekly", ROBUST, lambda t: O.decompose_robust(C.resample_weekly(t.panel.select(KEY, F.col("week_start").alias("date"), "sales_qty")), 52),
      _robust(_week_y, 52, 2, 1))

query("seasonality_mode", "product_name, mean:6, std:6, cv:6, mode", lambda t: O.seasonality_mode(t.panel),
      """SELECT product_name, AVG(sales_qty) AS mean, STDDEV_SAMP(sales_qty) AS std, STDDEV_SAMP(sales_qty) / AVG(sales_qty) AS cv,
                CASE WHEN STDDEV_SAMP(sales_qty) / AVG(sales_qty) > 0.3 THEN 'multiplicative' ELSE 'additive' END AS mode FROM panel GROUP BY 1""")

query("forecast_moving_average", "product_name, date:d, kind, yhat:6, yhat_lower:6, yhat_upper:6", lambda t: O.forecast_moving_average(t.daily),
      f"""WITH s AS (SELECT *, STDDEV_SAMP(sales_qty) OVER (PARTITION BY product_name) AS sd, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY date DESC) AS age FROM daily),
               f AS (SELECT product_name, date, 'fitted' AS kind, AVG(sales_qty) OVER ({_d} ROWS 6 PRECEDING) AS yhat, sd FROM s),
               l AS (SELECT product_name, MAX(date) AS last, AVG(sales_qty) FILTER (age <= 7) AS yhat, MAX(sd) AS sd FROM s GROUP BY 1),
               a AS (SELECT * FROM f UNION ALL SELECT product_name, last + CAST(i AS INT), 'forecast', yhat, sd FROM l, range(1, 15) r(i))
          SELECT product_name, date, kind, yhat, yhat - 1.96 * sd AS yhat_lower, yhat + 1.96 * sd AS yhat_upper FROM a""")

query("forecast_damped_trend", "product_name, date:d, yhat:6, yhat_lower:6, yhat_upper:6", lambda t: O.forecast_damped_trend(t.panel, 70),
      """WITH m AS (SELECT product_name, AVG(sales_qty) AS mean, MAX(week_start) AS last FROM panel GROUP BY 1),
              d AS (SELECT m.*, half_trend, last + CAST(i AS INT) AS day FROM m JOIN halves USING (product_name), range(1, 71) r(i)),
              g AS (SELECT product_name, MIN(day) AS date, GREATEST(0, ANY_VALUE(mean) * (1 + ANY_VALUE(half_trend) * 0.1)) AS yhat FROM d GROUP BY product_name, WEEKOFYEAR(day), YEAR(day))
         SELECT *, yhat * 0.8 AS yhat_lower, yhat * 1.2 AS yhat_upper FROM g""")

query("forecast_ma_bounds", "product_name, step:i, date:d, yhat:6, yhat_lower:6, yhat_upper:6, yhat_lower_95:6, yhat_upper_95:6", lambda t: O.forecast_ma_bounds(t.panel),
      """WITH m AS (SELECT product_name, MAX(week_start) AS last, AVG(sales_qty) FILTER (age <= 4) AS m4, CASE WHEN COUNT(*) >= 8 THEN AVG(sales_qty) FILTER (age <= 8) ELSE AVG(sales_qty) FILTER (age <= 4) END AS m8 FROM recent GROUP BY 1)
         SELECT product_name, i AS step, last + CAST(7 * i AS INT) AS date, m4 AS yhat, m8 * 0.7 AS yhat_lower, m4 * 1.3 AS yhat_upper, m8 * 0.5 AS yhat_lower_95, m4 * 1.5 AS yhat_upper_95 FROM m, range(1, 13) r(i)""")

query("forecast_ar", "product_name, step:i, date:d, yhat:6, mae:6, rmse:6", lambda t: O.forecast_ar(t.panel),
      f"""WITH RECURSIVE d AS (SELECT product_name, week_start, sales_qty AS y, LAG(sales_qty) OVER ({_w}) AS prev, sales_qty - LAG(sales_qty) OVER ({_w}) AS d, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY week_start DESC) AS age FROM panel),
               e AS (SELECT *, LAG(d) OVER ({_w}) AS ld FROM d),
               f AS (SELECT product_name, REGR_SLOPE(d, ld) AS b, REGR_INTERCEPT(d, ld) AS a, MAX(week_start) AS last, ARG_MAX(y, week_start) AS y, ARG_MAX(d, week_start) AS ld FROM e GROUP BY 1),
               x AS (SELECT e.product_name, AVG(ABS(e.y - (prev + a + b * e.ld))) AS mae, SQRT(AVG(POW(e.y - (prev + a + b * e.ld), 2))) AS rmse FROM e JOIN f USING (product_name) WHERE age <= 4 GROUP BY 1),
               r AS (SELECT product_name, 1 AS step, last, a, b, a + b * ld AS cd, y + a + b * ld AS yhat FROM f
                     UNION ALL SELECT product_name, step + 1, last, a, b, a + b * cd, yhat + a + b * cd FROM r WHERE step < 4)
          SELECT product_name, step, last + 7 * step AS date, yhat, mae, rmse FROM r JOIN x USING (product_name)""")


def _solved(name, src, x, y, ridge):
    """Views that end in `name`: coefficients c per product by elimination over arrays (the first feature has no penalty)."""
    k = len(x)
    return f"""{name}x AS (SELECT product_name, [{', '.join(x)}] AS x, {y} AS y FROM {src}),
      {name}g AS (SELECT product_name, i, j, SUM(x[i] * CASE WHEN j <= {k} THEN x[j] ELSE y END) AS v FROM {name}x, range(1, {k + 1}) a(i), range(1, {k + 2}) b(j) GROUP BY ALL),
      {name}r AS (SELECT product_name, i, list(v + CASE WHEN i <> j OR i = 1 THEN 0 ELSE {ridge} END ORDER BY j) AS r FROM {name}g GROUP BY ALL),
      {name}e AS (SELECT product_name, CAST(1 AS BIGINT) AS k, list(r ORDER BY i) AS m FROM {name}r GROUP BY 1
        UNION ALL SELECT product_name, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k THEN v / m[k][k] ELSE v - r[k] * (m[k][j] / m[k][k]) END)) FROM {name}e WHERE k <= {k}),
      {name} AS (SELECT product_name, list_transform(m, lambda r: r[{k + 1}]) AS c FROM {name}e WHERE k = {k + 1})"""


_past = ["1e0", "d1", "d2", "d3", "d4"]
query("forecast_arma", "product_name, step:i, date:d, model, yhat:5, mae:5, rmse:5, aic:5, phi:5, theta:5", lambda t: O.forecast_arma(t.panel),
      f"""WITH RECURSIVE d AS (SELECT product_name, week_start, sales_qty AS y, LAG(sales_qty) OVER ({_w}) AS prev, sales_qty - LAG(sales_qty) OVER ({_w}) AS d, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY week_start DESC) AS age FROM panel),
      l AS (SELECT *, {', '.join(f'LAG(d, {k}) OVER ({_w}) AS d{k}' for k in range(1, 5))} FROM d),
      {_solved('one', 'l WHERE d4 IS NOT NULL', _past, 'd', '1e-6')},
      e AS (SELECT l.*, CASE WHEN d4 IS NOT NULL THEN d - (c[1] + c[2] * d1 + c[3] * d2 + c[4] * d3 + c[5] * d4) END AS e FROM l LEFT JOIN one USING (product_name)),
      s AS (SELECT *, LAG(e) OVER ({_w}) AS e1 FROM e),
      {_solved('two', 's WHERE e1 IS NOT NULL', ['1e0', 'd1', 'e1'], 'd', '1e-6')},
      v AS (SELECT product_name, REGR_SLOPE(y, prev) AS slope, REGR_INTERCEPT(y, prev) AS base, COUNT(e1) AS changes, MAX(week_start) AS last, ARG_MAX(y, week_start) AS y, ARG_MAX(d, week_start) AS d, ARG_MAX(e, week_start) AS e FROM s GROUP BY 1),
      f AS (SELECT v.*, c, changes >= 20 AND ABS(c[2]) < 1 AND ABS(c[3]) < 1 AS moving FROM v JOIN two USING (product_name)),
      r AS (SELECT s.product_name, s.age, f.moving, s.y - CASE WHEN f.moving THEN s.prev + c[1] + c[2] * s.d1 + c[3] * s.e1 ELSE f.base + f.slope * s.prev END AS r FROM s JOIN f USING (product_name)),
      x AS (SELECT product_name, AVG(ABS(r)) FILTER (age <= 4) AS mae, SQRT(AVG(r * r) FILTER (age <= 4)) AS rmse, COUNT(r) * LN(SUM(r * r) / COUNT(r)) + CASE WHEN ANY_VALUE(moving) THEN 6 ELSE 4 END AS aic FROM r GROUP BY 1),
      h AS (SELECT product_name, 1 AS step, c[1] + c[2] * d + c[3] * e AS ch, CASE WHEN moving THEN y + c[1] + c[2] * d + c[3] * e ELSE base + slope * y END AS yhat FROM f
            UNION ALL SELECT product_name, step + 1, c[1] + c[2] * ch, CASE WHEN moving THEN yhat + c[1] + c[2] * ch ELSE base + slope * yhat END FROM h JOIN f USING (product_name) WHERE step < 4)
      SELECT product_name, step, last + 7 * step AS date, CASE WHEN moving THEN 'ARIMA(1,1,1)' ELSE 'ARIMA(1,0,0)' END AS model, yhat, mae, rmse, aic,
        CASE WHEN moving THEN c[2] ELSE slope END AS phi, CASE WHEN moving THEN c[3] END AS theta FROM h JOIN f USING (product_name) JOIN x USING (product_name)""")


def _trend_views(name, factor):
    CTES[f"{name}_fit"] = """
SELECT product_name, REGR_SLOPE(sales_qty, t) AS slope, REGR_INTERCEPT(sales_qty, t) AS base, AVG(sales_qty) AS mean, MIN(week_start) AS start, MAX(week_start) AS last
FROM (SELECT *, (week_start - MIN(week_start) OVER (PARTITION BY product_name)) / 7 AS t FROM panel) GROUP BY 1"""
    month = "LEFT JOIN month_means m ON m.product_name = {a}.product_name AND m.month = MONTH({d})" if factor else ""
    mult = " * COALESCE(m.mean_qty / mean, 1)" if factor else ""
    CTES[name] = f"""
WITH r AS (SELECT p.product_name, STDDEV_POP(p.sales_qty - GREATEST(0, (base + slope * ((p.week_start - start) / 7)){mult})) AS sd FROM panel p JOIN {name}_fit f USING (product_name)
           {month.format(a='p', d='p.week_start')} GROUP BY 1),
     d AS (SELECT f.*, i AS step, last + CAST(7 * i AS INT) AS date FROM {name}_fit f, range(1, 61) x(i)),
     y AS (SELECT d.product_name, step, date, GREATEST(0, (base + slope * ((date - start) / 7)){mult}) AS yhat, sd FROM d JOIN r USING (product_name) {month.format(a='d', d='d.date')})
SELECT product_name, step, date, yhat, GREATEST(0, yhat - 1.28 * sd) AS yhat_lower, yhat + 1.28 * sd AS yhat_upper, GREATEST(0, yhat - 1.96 * sd) AS yhat_lower_95, yhat + 1.96 * sd AS yhat_upper_95 FROM y"""


_trend_views("fct", False)
_trend_views("fc", True)
FC = "product_name, step:i, date:d, yhat:6, yhat_lower:6, yhat_upper:6, yhat_lower_95:6, yhat_upper_95:6"


def fc(t):
    return O.forecast_trend_season(t.panel, 60, "monthly")


def stored(t):
    """The forecast as a written table, for reports that read it several times."""
    return written(fc(t), "forecast")


query("forecast_trend", FC, lambda t: O.forecast_trend_season(t.panel, 60, "trend"), "SELECT * FROM fct")
query("forecast_trend_monthly", FC, fc, "SELECT * FROM fc")


def year_end(date):
    """The holidays of the panel: weeks that begin in November or December."""
    return F.month(date).isin(11, 12).cast("int")


query("forecast_trend_season", FC, lambda t: O.forecast_trend_season(t.panel, 52, "harmonic", year_end))

# four terms, solved by elimination over arrays
_x4 = "[1.0e0, {d} / 365.25e0, sin({d} * (2 * pi() / 365.25e0)), cos({d} * (2 * pi() / 365.25e0))]"
query("forecast_regression", FC, lambda t: O.forecast_regression(t.panel, 52, terms={"yearly": (365.25, 1, 0)}, bends=0, effects=False, logs=False),
      f"""WITH RECURSIVE d AS (SELECT product_name, sales_qty AS y, MIN(week_start) OVER w AS start, MAX(week_start) OVER w AS last, COUNT(*) OVER w AS n, week_start FROM panel WINDOW w AS (PARTITION BY product_name)),
      x AS (SELECT *, {_x4.format(d="date_diff('day', start, week_start)")} AS x FROM d WHERE n >= 10),
      g AS (SELECT product_name, i, j, SUM(x[i] * CASE WHEN j <= 4 THEN x[j] ELSE y END) AS v FROM x, range(1, 5) a(i), range(1, 6) b(j) GROUP BY ALL),
      r AS (SELECT product_name, i, list(v + CASE WHEN i <> j THEN 0 WHEN i <= 2 THEN 1e-6 ELSE 0.1e0 END ORDER BY j) AS r FROM g GROUP BY ALL),
      e AS (SELECT product_name, CAST(1 AS BIGINT) AS k, list(r ORDER BY i) AS m FROM r GROUP BY 1
        UNION ALL SELECT product_name, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k THEN v / m[k][k] ELSE v - r[k] * (m[k][j] / m[k][k]) END)) FROM e WHERE k <= 4),
      c AS (SELECT product_name, list_transform(m, lambda r: r[5]) AS c FROM e WHERE k = 5),
      s AS (SELECT product_name, any_value(c) AS c, any_value(start) AS start, any_value(last) AS last, stddev_pop(y - (c[1] * x[1] + c[2] * x[2] + c[3] * x[3] + c[4] * x[4])) AS sd FROM x JOIN c USING (product_name) GROUP BY 1),
      f AS (SELECT *, last + CAST(7 * step AS INTEGER) AS date FROM s, range(1, 53) q(step)),
      p AS (SELECT *, {_x4.format(d="date_diff('day', start, date)")} AS x FROM f),
      v AS (SELECT *, c[1] * x[1] + c[2] * x[2] + c[3] * x[3] + c[4] * x[4] AS v FROM p)
      SELECT product_name, step, date, GREATEST(0, v) AS yhat, GREATEST(0, v - 1.28e0 * sd) AS yhat_lower, GREATEST(0, v + 1.28e0 * sd) AS yhat_upper,
        GREATEST(0, v - 1.96e0 * sd) AS yhat_lower_95, GREATEST(0, v + 1.96e0 * sd) AS yhat_upper_95 FROM v""")

# ---- blending and scoring

CTES["preds"] = f"""
WITH r AS (SELECT product_name, week_start, sales_qty AS actual, LAG(sales_qty) OVER ({_w}) AS naive, AVG(sales_qty) OVER ({_w} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mean4,
                  GREATEST(0, base + slope * ((week_start - start) / 7)) AS trend FROM panel JOIN fct_fit USING (product_name))
SELECT product_name, week_start, actual, 'naive' AS model, naive AS predicted FROM r UNION ALL SELECT product_name, week_start, actual, 'mean4', mean4 FROM r UNION ALL SELECT product_name, week_start, actual, 'trend', trend FROM r"""
METRICS = """COUNT(*) AS n, AVG(POW(actual - predicted, 2)) AS mse, AVG(ABS(actual - predicted)) AS mae, AVG(ABS(actual - predicted) / ABS(actual)) FILTER (actual <> 0) * 100 AS mape,
    AVG(CASE WHEN ABS(actual) + ABS(predicted) = 0 THEN 0 ELSE ABS(actual - predicted) / ((ABS(actual) + ABS(predicted)) / 2) END) * 100 AS smape,
    AVG(2 * ABS(actual - predicted) / (ABS(actual) + ABS(predicted) + 1e-8)) * 100 AS smape_eps, SQRT(AVG(POW(actual - predicted, 2))) AS rmse, 1 - AVG(POW(actual - predicted, 2)) / NULLIF(VAR_POP(actual), 0) AS r2"""
CTES["scores"] = f"SELECT product_name, model, {METRICS} FROM preds WHERE predicted IS NOT NULL GROUP BY 1, 2"


def scores(t):
    return O.metrics(O.baseline_predictions(t.panel))


def trend_scores(t):
    return scores(t).filter("model = 'trend'")


query("metrics", "product_name, model, n:i, mse:4, mae:6, mape:6, smape:6, smape_eps:6, rmse:6, r2:6", scores, "SELECT * FROM scores")

query("model_leaderboard", "product_name, model, rmse:6, rank:i, improvement_pct:6, rmse_score:6, mae_score:6, mse_score:6, mape_score:6", lambda t: O.model_leaderboard(scores(t)),
      """WITH r AS (SELECT *, ROW_NUMBER() OVER w AS rank, LEAD(rmse) OVER w AS nx FROM scores WINDOW w AS (PARTITION BY product_name ORDER BY rmse, model))
         SELECT *, CASE WHEN rank = 1 THEN COALESCE((nx - rmse) / (nx + 1e-6) * 100, 0) END AS improvement_pct, """
      + ", ".join(f"100 - {c} / MAX({c}) OVER (PARTITION BY product_name) * 100 AS {c}_score" for c in ("rmse", "mae", "mse", "mape")) + " FROM r")

query("model_insight", "product_name, best_model, best_smape:6, accuracy, anomalies:i", lambda t: O.model_insight(scores(t), N.anomaly_hybrid(t.panel)),
      """WITH b AS (SELECT product_name, model AS best_model, smape AS best_smape FROM scores QUALIFY ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY smape, model) = 1)
         SELECT *, CASE WHEN best_smape < 15 THEN 'EXCELLENT' WHEN best_smape < 25 THEN 'GOOD' ELSE 'WEAK' END AS accuracy,
                (SELECT COUNT(*) FROM anoms a WHERE a.product_name = b.product_name) AS anomalies FROM b""")

# the three baselines take the places of the three blended models; one product group misses one of them
CTES["rmses"] = """SELECT product_name, CASE model WHEN 'trend' THEN 'prophet' WHEN 'mean4' THEN 'xgb' ELSE 'lgbm' END AS model,
    CASE WHEN model = 'naive' AND r2 < -0.9 THEN NULL ELSE rmse END AS rmse FROM scores"""
CTES["weights"] = """
WITH i AS (SELECT *, CASE WHEN rmse > 0 THEN 1 / (rmse + 1e-6) ELSE 0 END AS inv, CASE model WHEN 'prophet' THEN 0.4 ELSE 0.3 END AS base FROM rmses),
     w AS (SELECT *, 0.6 * inv / SUM(inv) OVER (PARTITION BY product_name) + 0.4 * base AS raw FROM i)
SELECT product_name, model, rmse, raw / SUM(raw) OVER (PARTITION BY product_name) AS weight FROM w"""


def _renamed(df):
    m = F.col("model")
    return df.withColumn("model", F.when(m == "trend", "prophet").when(m == "mean4", "xgb").otherwise("lgbm"))


def rmses(t):
    s = scores(t)
    weak = (F.col("model") == "naive") & (F.col("r2") < -0.9)
    return _renamed(s.withColumn("rmse", F.when(~weak, F.col("rmse")))).select(KEY, "model", "rmse")


def weights(t):
    return O.ensemble_weights(rmses(t))


query("ensemble_weights", "product_name, model, rmse:6, weight:6", weights, "SELECT * FROM weights")
CTES["blended"] = """
SELECT product_name, week_start, GREATEST(0, COALESCE(SUM(weight * predicted) / NULLIF(SUM(weight) FILTER (predicted IS NOT NULL), 0), AVG(predicted), 0)) AS yhat, COUNT(predicted) AS models
FROM (SELECT *, CASE p.model WHEN 'trend' THEN 'prophet' WHEN 'mean4' THEN 'xgb' ELSE 'lgbm' END AS m FROM preds p) x JOIN weights w ON w.product_name = x.product_name AND w.model = x.m GROUP BY ALL"""
CTES["blended"] = CTES["blended"].replace("SELECT product_name, week_start", "SELECT x.product_name, week_start").replace("SELECT *, CASE p.model", "SELECT p.product_name, week_start, predicted, CASE p.model")


def blended(t):
    preds = _renamed(O.baseline_predictions(t.panel)).withColumnRenamed("predicted", "yhat")
    return O.ensemble_blend(preds, weights(t))


query("ensemble_blend", "product_name, week_start:d, yhat:6, models:i", blended, "SELECT * FROM blended")

query("residual_table", "product_name, week_start:d, actual, predicted:6, residual:6", lambda t: O.residual_table(t.panel, blended(t).withColumnRenamed("yhat", "fitted")),
      "SELECT product_name, week_start, sales_qty AS actual, yhat AS predicted, sales_qty - yhat AS residual FROM panel JOIN blended USING (product_name, week_start)")
query("residual_table_fallback", "product_name, week_start:d, actual, predicted:6, residual:6", lambda t: O.residual_table(t.panel),
      f"SELECT product_name, week_start, sales_qty AS actual, AVG(sales_qty) OVER ({_w} ROWS 3 PRECEDING) AS predicted, sales_qty - AVG(sales_qty) OVER ({_w} ROWS 3 PRECEDING) AS residual FROM panel")


def _intervals(t):
    """Forecast rows; the bounds of steps beyond a year are treated as missing."""
    near = F.col("step") <= 52
    p = fc(t).select(KEY, "date", "yhat", F.when(near, F.col("yhat_lower")).alias("model_lower"), F.when(near, F.col("yhat_upper")).alias("model_upper"))
    return O.forecast_intervals(p, O.residual_table(t.panel))


query("forecast_intervals", "product_name, date:d, yhat:6, yhat_lower:6, yhat_upper:6, yhat_lower_95:6, yhat_upper_95:6", _intervals,
      """WITH r AS (SELECT product_name, STDDEV_POP(sales_qty - fitted) AS sd FROM fitted4 GROUP BY 1), p AS (SELECT fc.*, sd FROM fc JOIN r USING (product_name))
         SELECT product_name, date, yhat, CASE WHEN step <= 52 THEN LEAST(yhat_lower, yhat * 0.85) ELSE GREATEST(0, yhat - 1.28 * sd) END AS yhat_lower,
                CASE WHEN step <= 52 THEN GREATEST(yhat_upper, yhat * 1.15) ELSE yhat + 1.28 * sd END AS yhat_upper,
                CASE WHEN step <= 52 THEN LEAST(yhat_lower, yhat * 0.75) ELSE GREATEST(0, yhat - 1.96 * sd) END AS yhat_lower_95,
                CASE WHEN step <= 52 THEN GREATEST(yhat_upper, yhat * 1.25) ELSE yhat + 1.96 * sd END AS yhat_upper_95 FROM p""")

_cv = ", ".join(f"{a}_{m}:{4 if m == 'r2' else 6}" for m in ("rmse", "mae", "mape", "r2") for a in ("avg", "std"))
query("cross_validation", f"product_name, model, folds:i, {_cv}", lambda t: O.cross_validation(t.panel),
      f"""WITH n AS (SELECT product_name, week_start, sales_qty, COUNT(*) OVER (PARTITION BY product_name) AS n, ROW_NUMBER() OVER ({_w}) AS rn FROM panel),
               k AS (SELECT *, CASE WHEN n < 80 THEN GREATEST(2, n // 22) ELSE 5 END AS k FROM n),
               f AS (SELECT *, n - (k - fold + 1) * (n // (k + 1)) AS cut, n // (k + 1) AS size FROM k, range(1, 20) x(fold) WHERE fold <= k),
               tr AS (SELECT product_name, fold, AVG(sales_qty) AS mean, ARG_MAX(sales_qty, rn) AS last, REGR_SLOPE(sales_qty, rn) AS slope, REGR_INTERCEPT(sales_qty, rn) AS base FROM f WHERE rn <= cut GROUP BY 1, 2),
               te AS (SELECT f.product_name, f.fold, sales_qty AS actual, mean, last, GREATEST(0, base + slope * rn) AS trend FROM f JOIN tr USING (product_name, fold) WHERE rn > cut AND rn <= cut + size),
               lo AS (SELECT product_name, fold, actual, 'mean' AS model, mean AS predicted FROM te UNION ALL SELECT product_name, fold, actual, 'last', last FROM te UNION ALL SELECT product_name, fold, actual, 'trend', trend FROM te
                      UNION ALL SELECT product_name, fold, actual, 'blend', 0.4 * trend + 0.3 * mean + 0.3 * last FROM te),
               m AS (SELECT product_name, model, fold, {METRICS} FROM lo GROUP BY 1, 2, 3)
          SELECT product_name, model, COUNT(*) AS folds, """ + ", ".join(f"AVG({m}) AS avg_{m}, STDDEV_POP({m}) AS std_{m}" for m in ("rmse", "mae", "mape", "r2")) + " FROM m GROUP BY 1, 2")

# ---- figures on a forecast

_mn = "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])"
CTES["fpeaks"] = """
WITH m AS (SELECT product_name, MONTH(date) AS m, AVG(yhat) AS v FROM fc GROUP BY 1, 2),
     r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY v DESC, m) AS hi, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY v, m) AS lo FROM m)
SELECT product_name, MAX(m) FILTER (hi = 1) AS peak_month, MAX(m) FILTER (lo = 1) AS low_month, MAX(v) AS peak_value, AVG(v) AS month_mean FROM r GROUP BY 1"""
CTES["fkpis"] = f"""
WITH f AS (SELECT product_name, AVG(yhat) FILTER (step <= 4) AS next_mean, SUM(yhat) FILTER (step <= 4) AS next_month, SUM(yhat) FILTER (step <= 13) AS next_quarter, COUNT(*) AS horizon FROM fc GROUP BY 1)
SELECT f.*, recent AS mean_last_4, stock, (next_mean - recent) / (recent + 1e-6) * 100 AS growth_pct,
       CASE WHEN stock > 0 THEN LEAST(100, GREATEST(0, (1 - stock / (next_month / 4 + 1e-6) / 4) * 100)) END AS stockout_risk, {_mn}[peak_month] AS peak, {_mn}[low_month] AS low,
       mape, LEAST(100, GREATEST(0, 100 - mape)) AS confidence
FROM f JOIN stock_now USING (product_name) JOIN fpeaks USING (product_name) JOIN (SELECT product_name, mape FROM scores WHERE model = 'trend') USING (product_name)"""
query("forecast_kpis", "product_name, growth_pct:6, next_month:6, next_quarter:6, peak, low, stockout_risk:6, confidence:6",
      lambda t: O.forecast_kpis(t.panel, stored(t), latest_row(t.panel), trend_scores(t)), "SELECT * FROM fkpis")


CTES["fc_daily"] = """
WITH q AS (SELECT product_name, ISODOW(date) - 1 AS wd, SUM(sales_qty) AS qty FROM daily GROUP BY 1, 2), h AS (SELECT product_name, wd, qty / SUM(qty) OVER (PARTITION BY product_name) AS share FROM q)
SELECT product_name, (step - 1) * 7 + wd + 1 AS step, date + CAST(wd AS INT) AS date, yhat * share AS yhat FROM fc JOIN h USING (product_name) WHERE (step - 1) * 7 + wd + 1 <= 30"""


def fc_daily(t):
    return written(O.forecast_daily(fc(t), t.daily, 30), "daily-forecast")


query("forecast_daily", "product_name, step:i, date:d, yhat:6", fc_daily, "SELECT * FROM fc_daily")
query("forecast_kpis_daily", "product_name, next_week_sales:6, stockout_risk:6, best_day:d, best_day_sales:6, worst_day:d, worst_day_sales:6",
      lambda t: O.forecast_kpis_daily(t.daily, fc_daily(t)),
      """WITH s AS (SELECT product_name, AVG(stock_on_hand) AS st FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY date DESC) AS age FROM daily) WHERE age <= 4 GROUP BY 1),
              g AS (SELECT product_name, SUM(GREATEST(0, yhat)) FILTER (step <= 7) AS next_week_sales, AVG(yhat) FILTER (step <= 7) AS af, MAX(yhat) AS best_day_sales, MIN(yhat) AS worst_day_sales FROM fc_daily GROUP BY 1),
              b AS (SELECT product_name, MIN(date) FILTER (hi = 1) AS best_day, MIN(date) FILTER (lo = 1) AS worst_day FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY yhat DESC, date) AS hi,
                           ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY yhat, date) AS lo FROM fc_daily) GROUP BY 1)
         SELECT *, CASE WHEN st > 0 THEN LEAST(1, GREATEST(0, (af - st) / GREATEST(st, 1))) END AS stockout_risk FROM g JOIN s USING (product_name) JOIN b USING (product_name)""")

query("forecast_high_flags", "product_name, date:d, value:6, type, severity", lambda t: N.forecast_high_flags(fc(t)),
      """WITH f AS (SELECT *, AVG(yhat) OVER p + 2 * STDDEV_SAMP(yhat) OVER p AS lim, COUNT(*) OVER p AS n FROM fc WINDOW p AS (PARTITION BY product_name))
         SELECT product_name, date, yhat AS value, 'high_forecast' AS type, 'moderate' AS severity FROM f WHERE n >= 4 AND yhat > lim""")

CTES["fc5"] = "SELECT product_name, step - 1 AS week, yhat FROM fc WHERE step <= 5"
query("stock_trajectory_forecast", _traj, lambda t: _days(I.stock_trajectory(kpis(t), fc(t).select(KEY, (F.col("step") - 1).alias("week"), "yhat"))),
      _traj_sql("COALESCE((SELECT yhat FROM fc5 f WHERE f.product_name = kpis.product_name AND f.week = {i} // 7) / 7 * (1 + growth / 100), weekly_demand / 7)"))

query("topk_weeks", "product_name, date:d, rank:i, yhat:6, ci_range:6, growth_pct:6, confidence_pct:6", lambda t: O.topk_weeks(fc(t), t.panel),
      """WITH r AS (SELECT fc.*, recent, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY yhat DESC, date) AS rank, yhat_upper - yhat_lower AS ci_range FROM fc JOIN stock_now USING (product_name))
         SELECT *, (yhat - recent) / (recent + 1e-6) * 100 AS growth_pct, LEAST(100, GREATEST(0, 100 - ci_range / (yhat + 1e-6) * 100)) AS confidence_pct FROM r WHERE rank <= 5""")

query("forecast_narrative", "product_name, trend, trend_pct:6, season, quarter_growth:6, risk, price, accuracy, recommendations",
      lambda t: O.forecast_narrative(t.panel, stored(t), trend_scores(t), E.elasticity_gated(t.panel), latest_row(t.panel)),
      """WITH q AS (SELECT product_name, SUM(sales_qty) FILTER (age <= 13) AS lq, COUNT(*) AS hist FROM recent GROUP BY 1),
              k AS (SELECT fkpis.*, lq, hist, elasticity FROM fkpis JOIN q USING (product_name) JOIN elas USING (product_name))
         SELECT product_name, CASE WHEN next_mean > mean_last_4 * 1.1 THEN 'rise' WHEN next_mean < mean_last_4 * 0.9 THEN 'decline' ELSE 'stable' END AS trend, (next_mean - mean_last_4) / mean_last_4 * 100 AS trend_pct,
                CASE WHEN horizon >= 52 THEN peak || ' / ' || low WHEN horizon >= 13 THEN peak ELSE 'emerging' END AS season, CASE WHEN hist >= 13 THEN (next_quarter - lq) / (lq + 1e-6) * 100 END AS quarter_growth,
                CASE WHEN stockout_risk > 70 THEN 'high' WHEN stockout_risk > 40 THEN 'moderate' ELSE 'low' END AS risk, CASE WHEN elasticity < -1 THEN 'elastic' WHEN elasticity > -0.5 THEN 'inelastic' ELSE 'moderate' END AS price,
                CASE WHEN mape < 10 THEN 'excellent' WHEN mape < 20 THEN 'good' ELSE 'moderate' END AS accuracy,
                concat_ws('; ', CASE WHEN stockout_risk > 40 THEN 'Reorder inventory' END, CASE WHEN horizon >= 52 THEN 'Plan promotions for ' || peak END, CASE WHEN elasticity < -1 THEN 'Consider price reduction' END, 'Update the model monthly') AS recommendations FROM k""")

query("insight_cards", "product_name, growth_month, growth_pct:6, top_date:d, top_value:6, savings:6, confidence:6", lambda t: O.insight_cards(stored(t), trend_scores(t)),
      f"""WITH t AS (SELECT product_name, date AS top_date, yhat AS top_value FROM fc QUALIFY ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY yhat DESC, date) = 1)
          SELECT fkpis.product_name, peak AS growth_month, (peak_value - month_mean) / (month_mean + 1e-6) * 100 AS growth_pct, top_date, top_value, CASE WHEN mape < 15 THEN next_quarter * 0.05 END AS savings, 100 - mape AS confidence
          FROM fkpis JOIN fpeaks USING (product_name) JOIN t USING (product_name)""")

query("exec_summary", "anomalies:i, low_stock:i, pricing_rows:i, total_gain:3, top_actions:i",
      lambda t: O.exec_summary(N.anomaly_hybrid(t.panel), I.alerts_weeks(t.panel), E.pricing_opportunities(t.panel, E.elasticity_gated(t.panel))),
      """SELECT (SELECT COUNT(*) FROM anoms) AS anomalies, (SELECT COUNT(*) FROM al_weeks WHERE urgency = 'CRITICAL') AS low_stock, COUNT(*) AS pricing_rows, SUM(revenue_gain) AS total_gain, LEAST(5, COUNT(*)) AS top_actions FROM opps""")

# ---- scenarios

SCEN = [("discount", -10.0, True, False, 0.5, "Sunny", 1.0), ("holiday", 0.0, False, True, 0.0, "Cloudy", 1.2), ("storm", 5.0, False, False, 1.0, "Stormy", 0.6)]
CTES["sims"] = f"""
WITH v(scenario, price_delta, promotion, holiday, intensity, weather, stock_factor) AS (VALUES {', '.join(f"('{n}', {p}::DOUBLE, {pr}, {ho}, {i}::DOUBLE, '{w}', {s}::DOUBLE)" for n, p, pr, ho, i, w, s in SCEN)}),
     f AS (SELECT *, POW(1 + price_delta / 100, -1.2) * CASE WHEN promotion AND intensity > 0 THEN 1.2 ELSE 1 END * CASE WHEN holiday THEN 1.25 ELSE 1 END * CASE WHEN promotion AND intensity > 0 THEN 1 + intensity * 0.2 ELSE 1 END
                  * CASE weather WHEN 'Sunny' THEN 1.15 WHEN 'Rainy' THEN 0.9 WHEN 'Stormy' THEN 0.75 ELSE 1 END * LEAST(1, stock_factor) AS factor FROM v)
SELECT fc.*, scenario, price_delta, yhat * factor AS yhat_simulated, yhat_lower * factor AS yhat_lower_simulated, yhat_upper * factor AS yhat_upper_simulated FROM fc, f"""


def sims(t):
    return O.scenario_multipliers(fc(t), SCEN)


query("scenario_multipliers", "product_name, scenario, step:i, date:d, yhat_simulated:6, yhat_lower_simulated:6, yhat_upper_simulated:6", sims, "SELECT * FROM sims")
query("scenario_impact", "product_name, scenario, demand_change_pct:6, base_revenue:4, simulated_revenue:4, revenue_change:4, impact", lambda t: O.scenario_impact(sims(t)),
      """WITH s AS (SELECT product_name, scenario, price_delta, SUM(yhat) AS b, SUM(yhat_simulated) AS x FROM sims WHERE step <= 4 GROUP BY 1, 2, 3),
              r AS (SELECT *, (x - b) / (b + 1e-6) * 100 AS demand_change_pct, b * 100 AS base_revenue, x * 100 * (1 + price_delta / 100) AS simulated_revenue FROM s)
         SELECT *, simulated_revenue - base_revenue AS revenue_change, CASE WHEN demand_change_pct > 5 THEN 'Positive' WHEN demand_change_pct < -5 THEN 'Negative' ELSE 'Neutral' END AS impact FROM r""")

query("scenario_growth", "product_name, scenario, step:i, date:d, yhat:6, yhat_lower:6, yhat_upper:6, yhat_lower_95:6, yhat_upper_95:6", lambda t: O.scenario_growth(fc(t)),
      """WITH v(scenario, growth, seasonality) AS (VALUES ('optimistic', 0.15::DOUBLE, 1.2::DOUBLE), ('pessimistic', -0.10, 0.8), ('steady_growth', 0.05, 1.0)),
              f AS (SELECT fc.*, scenario, POW(1 + growth, (step - 1) / 52.0::DOUBLE) * CASE WHEN MONTH(date) IN (11, 12, 1) THEN seasonality ELSE 1 END AS k FROM fc, v)
         SELECT product_name, scenario, step, date, """ + ", ".join(f"{c} * k AS {c}" for c in ("yhat", "yhat_lower", "yhat_upper", "yhat_lower_95", "yhat_upper_95")) + " FROM f")
