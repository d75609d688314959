"""Lag, rolling, price, stock, calendar and category features."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME
from shelfspark.operators import filters as P
from shelfspark.functions.linear import correlations
from shelfspark.operators import windows as W
from shelfspark.plans.registry import CTES, query
from shelfspark.plans.relational import SEASON_SQL, holey

_w = "PARTITION BY product_name ORDER BY week_start"
ID = "product_name, week_start:d"


def lag(c, k=1):
    return f"LAG({c}, {k}) OVER ({_w})"


def full(f, c, k):
    fr = f"({_w} ROWS {k - 1} PRECEDING)"
    return f"CASE WHEN COUNT({c}) OVER {fr} = {k} THEN {f}({c}) OVER {fr} END"


def part(f, c, k):
    return f"{f}({c}) OVER ({_w} ROWS {k - 1} PRECEDING)"


def filled(raw: dict[str, str], extra: list[str] = (), source: str = "panel") -> str:
    """Columns `raw` computed over a source, their nulls filled with the column median."""
    inner = ", ".join(f"{e} AS {n}" for n, e in raw.items())
    outer = ", ".join(f"COALESCE({n}, (SELECT MEDIAN({n}) FROM raw)) AS {n}" for n in raw)
    more = "".join(f", {e}" for e in extra)
    return f"WITH raw AS (SELECT product_name, week_start{more}, {inner} FROM {source}) SELECT product_name, week_start{more}, {outer} FROM raw"


LAGS = {f"sales_qty_lag_{k}": lag("sales_qty", k) for k in (1, 2, 4, 8)}
query("lag_features", f"{ID}, " + ", ".join(LAGS), lambda t: W.lag_features(t.panel), filled(LAGS))

_l4 = {f"lag_{k}": f"COALESCE({lag('sales_qty', k)}, {part('AVG', 'sales_qty', 4)})" for k in (1, 2, 3, 7)}
query("lag_features_weekly", f"{ID}, " + ", ".join(f"{n}:6" for n in _l4), lambda t: W.lag_features_weekly(t.panel),
      "SELECT product_name, week_start, " + ", ".join(f"{e} AS {n}" for n, e in _l4.items()) + " FROM panel")

STRICT = {f"sales_qty_{n}_{k}": full(f, "sales_qty", k) for k in (3, 6, 12)
          for n, f in (("ma", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"))}
query("rolling_strict", f"{ID}, " + ", ".join(f"{n}:6" for n in STRICT), lambda t: W.rolling_strict(t.panel), filled(STRICT))


def partials(widths, extremes=False):
    out = {}
    for k in widths:
        out[f"rolling_mean_{k}"] = part("AVG", "sales_qty", k)
        out[f"rolling_std_{k}"] = f"COALESCE({part('STDDEV_SAMP', 'sales_qty', k)}, 0)"
        if extremes:
            out[f"rolling_min_{k}"] = part("MIN", "sales_qty", k)
            out[f"rolling_max_{k}"] = part("MAX", "sales_qty", k)
    return out


_rp = partials((4, 8, 12, 26))
query("rolling_partial", f"{ID}, " + ", ".join(f"{n}:6" for n in _rp), lambda t: W.rolling_partial(t.panel),
      "SELECT product_name, week_start, " + ", ".join(f"{e} AS {n}" for n, e in _rp.items()) + " FROM panel")

query("rolling_centered", f"{ID}, centered:6", lambda t: W.rolling_centered(t.panel, 8),
      f"""WITH c AS (SELECT product_name, week_start, CASE WHEN COUNT(*) OVER f = 8 THEN AVG(sales_qty) OVER f END AS m FROM panel
                    WINDOW f AS ({_w} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING))
         SELECT product_name, week_start, COALESCE(LAST_VALUE(m IGNORE NULLS) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                FIRST_VALUE(m IGNORE NULLS) OVER ({_w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS centered FROM c""")

query("rolling_pair_smooth", "product_name, date:d, yhat:6",
      lambda t: W.rolling_pair_smooth(t.panel.select(KEY, F.col(TIME).alias("date"), F.col("sales_qty").alias("yhat"))),
      f"SELECT product_name, week_start AS date, AVG(sales_qty) OVER ({_w} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS yhat FROM panel")

query("pct_change", f"{ID}, price_pct_change:9", lambda t: W.pct_change(t.panel, "price"),
      f"SELECT product_name, week_start, price / {lag('price')} - 1 AS price_pct_change FROM panel")

query("diff", f"{ID}, stock_on_hand_diff", lambda t: W.diff(t.panel, "stock_on_hand"),
      f"SELECT product_name, week_start, stock_on_hand - {lag('stock_on_hand')} AS stock_on_hand_diff FROM panel")

PRICE = {
    "price_change": f"price / {lag('price')} - 1",
    "price_lag_1": lag("price"),
    "price_volatility_3": full("STDDEV_SAMP", "price", 3),
    "price_volatility_6": full("STDDEV_SAMP", "price", 6),
    "price_relative_to_avg": "price / AVG(price) OVER (PARTITION BY product_name)",
    "price_relative_to_category": "price / AVG(price) OVER (PARTITION BY category)",
}
_ps = ", ".join(f"{n}:9" if n == "price_lag_1" else f"{n}:6" for n in PRICE)
query("price_features", f"{ID}, {_ps}", lambda t: W.price_features(t.panel), filled(PRICE))

STOCK = {
    "stock_sales_ratio": "stock_on_hand / (sales_qty + 1)",
    "sales_stock_ratio": "sales_qty / (stock_on_hand + 1)",
    "avg_stock_4w": full("AVG", "stock_on_hand", 4),
    "stock_change": f"stock_on_hand - {lag('stock_on_hand')}",
}
LEVEL = {
    "low_stock": "CASE WHEN stock_on_hand < 0.5 * (SELECT MEDIAN(stock_on_hand) FROM panel) THEN 1 ELSE 0 END",
    "high_stock": "CASE WHEN stock_on_hand > 2 * (SELECT MEDIAN(stock_on_hand) FROM panel) THEN 1 ELSE 0 END",
}
_ss = ", ".join(f"{n}:6" for n in STOCK)
query("inventory_features", f"{ID}, {_ss}, low_stock:i, high_stock:i", lambda t: W.inventory_features(t.panel),
      filled({**STOCK, **LEVEL}))

VOL = {
    "ratio_3_6": f"{part('AVG', 'sales_qty', 3)} / ({part('AVG', 'sales_qty', 6)} + 1e-6)",
    "ratio_6_12": f"{part('AVG', 'sales_qty', 6)} / ({part('AVG', 'sales_qty', 12)} + 1e-6)",
    "volatility": f"COALESCE({part('STDDEV_SAMP', 'sales_qty', 3)}, 0) / ({part('AVG', 'sales_qty', 3)} + 1e-6)",
}
query("volatility_ratios", f"{ID}, " + ", ".join(f"{n}:6" for n in VOL), lambda t: W.volatility_ratios(t.panel),
      "SELECT product_name, week_start, " + ", ".join(f"{e} AS {n}" for n, e in VOL.items()) + " FROM panel")

query("label_encode", f"{ID}, category_encoded:i, product_name_encoded:i, weather_encoded:i",
      lambda t: P.label_encode(holey(t), ["category", "product_name", "weather"]),
      """SELECT product_name, week_start, DENSE_RANK() OVER (ORDER BY category) - 1 AS category_encoded,
                DENSE_RANK() OVER (ORDER BY product_name) - 1 AS product_name_encoded,
                DENSE_RANK() OVER (ORDER BY COALESCE(weather, 'nan')) - 1 AS weather_encoded FROM holey""")

query("frequency_encode", f"{ID}, category_frequency:i, product_name_frequency:i",
      lambda t: P.frequency_encode(t.panel, ["category", "product_name"]),
      """SELECT product_name, week_start, COUNT(*) OVER (PARTITION BY category) AS category_frequency,
                COUNT(*) OVER (PARTITION BY product_name) AS product_name_frequency FROM panel""")

query("weeks_from_start", f"{ID}, weeks_from_start:i", lambda t: W.weeks_from_start(t.panel),
      "SELECT product_name, week_start, (week_start - (SELECT MIN(week_start) FROM panel)) // 7 AS weeks_from_start FROM panel")

CTES["latest"] = f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY week_start DESC) AS rn FROM panel) WHERE rn = 1"
query("latest_row", f"{ID}, category, sales_qty, price, stock_on_hand, promotion:i", lambda t: W.latest_row(t.panel), "SELECT * FROM latest")

CTES["recent"] = "SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY week_start DESC) AS age FROM panel"
query("last_n_mean", "product_name, mean_last_4:6", lambda t: W.last_n_mean(t.panel, 4),
      "SELECT product_name, AVG(sales_qty) AS mean_last_4 FROM recent WHERE age <= 4 GROUP BY 1")

CTES["halves"] = f"""SELECT product_name, AVG(sales_qty) FILTER (rn <= n // 2) AS first_half, AVG(sales_qty) FILTER (rn > n // 2) AS second_half, COUNT(*) AS n,
    CASE WHEN COUNT(*) >= 4 THEN (AVG(sales_qty) FILTER (rn > n // 2) - AVG(sales_qty) FILTER (rn <= n // 2)) / (AVG(sales_qty) FILTER (rn <= n // 2) + 1e-6) ELSE 0 END AS half_trend
FROM (SELECT *, ROW_NUMBER() OVER ({_w}) AS rn, COUNT(*) OVER (PARTITION BY product_name) AS n FROM panel) GROUP BY 1"""
query("half_trend", "product_name, first_half:6, second_half:6, n:i, half_trend:6", lambda t: W.half_trend(t.panel), "SELECT * FROM halves")

query("zscore_product", f"{ID}, z_score:6", lambda t: W.zscore_product(t.panel, "sales_qty"),
      """SELECT product_name, week_start, (sales_qty - AVG(sales_qty) OVER p) / (STDDEV_SAMP(sales_qty) OVER p + 1e-6) AS z_score
         FROM panel WINDOW p AS (PARTITION BY product_name)""")

CAL = {
    "year": "YEAR(week_start)", "month": "MONTH(week_start)", "quarter": "QUARTER(week_start)",
    "week_of_year": "WEEKOFYEAR(week_start)", "day_of_year": "DAYOFYEAR(week_start)",
    "month_sin": "SIN(2 * PI() * MONTH(week_start) / 12)", "month_cos": "COS(2 * PI() * MONTH(week_start) / 12)",
    "quarter_sin": "SIN(2 * PI() * QUARTER(week_start) / 4)", "quarter_cos": "COS(2 * PI() * QUARTER(week_start) / 4)",
    "is_year_end": "CAST(MONTH(week_start) IN (11, 12) AS INT)", "is_year_start": "CAST(MONTH(week_start) IN (1, 2) AS INT)",
    "is_mid_year": "CAST(MONTH(week_start) IN (6, 7) AS INT)",
    "weeks_from_start": "(week_start - (SELECT MIN(week_start) FROM panel)) // 7",
}
_cal = ", ".join(f"{n}:6" if n[-4:] in ("_sin", "_cos") else f"{n}:i" for n in CAL)
query("time_features", f"{ID}, {_cal}", lambda t: W.time_features(t.panel),
      "SELECT product_name, week_start, " + ", ".join(f"{e} AS {n}" for n, e in CAL.items()) + " FROM panel")

WEEKLY = {**_l4, **_rp, "month": CAL["month"], "quarter": CAL["quarter"], "year": CAL["year"], "weekofyear": CAL["week_of_year"],
          "month_sin": CAL["month_sin"], "month_cos": CAL["month_cos"],
          "week_sin": "SIN(2 * PI() * WEEKOFYEAR(week_start) / 52)", "week_cos": "COS(2 * PI() * WEEKOFYEAR(week_start) / 52)"}
_int = {"month", "quarter", "year", "weekofyear", "week", "day", "dayofweek", "is_weekend", "dayofyear", "is_q1", "is_q2", "is_q3", "is_q4"}
query("weekly_features", f"{ID}, " + ", ".join(f"{n}:i" if n in _int else f"{n}:6" for n in WEEKLY), lambda t: W.weekly_features(t.panel),
      "SELECT product_name, week_start, " + ", ".join(f"{e} AS {n}" for n, e in WEEKLY.items()) + " FROM panel")

_ps_, _pp_ = f"(sales_qty / {lag('sales_qty')} - 1)", f"(price / {lag('price')} - 1)"
RICH = {
    "year": CAL["year"], "month": CAL["month"], "week": CAL["week_of_year"], "day": "DAY(week_start)",
    "dayofweek": "ISODOW(week_start) - 1", "is_weekend": "CAST(ISODOW(week_start) >= 6 AS INT)", "quarter": CAL["quarter"],
    "dayofyear": CAL["day_of_year"], **partials((3, 6, 12, 26), True),
    **{f"lag_{k}": f"COALESCE({lag('sales_qty', k)}, FIRST_VALUE(sales_qty) OVER ({_w}))" for k in (1, 2, 4, 8)},
    **{f"is_q{q}": f"CAST(QUARTER(week_start) = {q} AS INT)" for q in (1, 2, 3, 4)},
    "sales_per_price": "sales_qty / (price + 1e-6)", "pct_change_sales": f"COALESCE({_ps_}, 0) * 100",
    "pct_change_price": f"COALESCE({_pp_}, 0) * 100",
    "price_elasticity": f"COALESCE({_ps_}, 0) * 100 / NULLIF(COALESCE({_pp_}, 0) * 100 + 1e-6, 0)", **VOL,
    "month_sin": CAL["month_sin"], "month_cos": CAL["month_cos"], "week_sin": WEEKLY["week_sin"], "week_cos": WEEKLY["week_cos"],
}
query("rich_features", f"{ID}, " + ", ".join(f"{n}:i" if n in _int else f"{n}:6" for n in RICH), lambda t: W.rich_features(t.panel),
      "SELECT product_name, week_start, " + ", ".join(f"{e} AS {n}" for n, e in RICH.items()) + " FROM panel")

_cat = {
    **{f"{c}_encoded": f"DENSE_RANK() OVER (ORDER BY {c}) - 1" for c in ("category", "product_name", "season", "weather")},
    **{f"{c}_frequency": f"COUNT(*) OVER (PARTITION BY {c})" for c in ("category", "product_name")},
}
_inter = {
    "price_promotion_interaction": "price * promotion",
    "holiday_season_interaction": "holiday_flag * (DENSE_RANK() OVER (ORDER BY season) - 1)",
    "stock_availability_interaction": "stock_on_hand * availability",
    "price_stock_interaction": "price * stock_on_hand",
}
CTES["seasoned"] = f"SELECT *, {SEASON_SQL} AS season FROM panel"
_med = {**LAGS, **STRICT, **PRICE, **STOCK}
_plain = {**CAL, **LEVEL, **_cat, **_inter}
_spec = [ID]
for _c in (*CAL, *LAGS, *STRICT, *PRICE, *STOCK, *LEVEL, *_cat, *_inter):
    kind = ":i" if _c in LEVEL or _c in _cat or _c in CAL and _c[-4:] not in ("_sin", "_cos") or _c == "holiday_season_interaction" else \
        "" if _c in _inter else ":9" if _c == "price_lag_1" else ":6"
    _spec.append(_c + kind)
query("feature_table", ", ".join(_spec), lambda t: W.feature_table(t.panel),
      "WITH raw AS (SELECT product_name, week_start, " + ", ".join(f"{e} AS {n}" for n, e in {**_med, **_plain}.items()) + " FROM seasoned) "
      "SELECT product_name, week_start, " + ", ".join(f"COALESCE({n}, (SELECT MEDIAN({n}) FROM raw)) AS {n}" for n in _med) + ", " + ", ".join(_plain) + " FROM raw")

_names = list(RICH)
query("corr_features", "a, b, n:i, corr:6", lambda t: correlations(W.rich_features(t.panel), _names),
      "WITH f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RICH.items()) + " FROM panel), "
      "one AS (SELECT [" + ", ".join(
          f"{{'a': '{a}', 'b': '{b}', 'n': COUNT(CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE)), 'corr': CORR({a}, {b})}}"
          for a in _names for b in _names) + "] AS l FROM f) SELECT x.a, x.b, x.n, CASE WHEN NOT isnan(x.corr) THEN x.corr END AS corr FROM (SELECT unnest(l) AS x FROM one)")

query("split_chronological", f"{ID}, split", lambda t: W.split_chronological(t.panel, 0.8),
      f"""SELECT product_name, week_start, CASE WHEN ROW_NUMBER() OVER ({_w}) <= FLOOR(0.8 * COUNT(*) OVER (PARTITION BY product_name))
                 THEN 'train' ELSE 'test' END AS split FROM panel""")

query("tail_per_group", f"{ID}, sales_qty", lambda t: W.tail_per_group(t.panel, 2),
      """SELECT product_name, week_start, sales_qty FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY week_start DESC) AS r
         FROM panel) WHERE r <= 2""")
