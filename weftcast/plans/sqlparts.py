"""SQL text for the DuckDB oracle, built from the same fixed parameters as the Spark side.

These strings are the *independent* formulation of each query: plain SQL
(window functions, FILTER, CTEs) that DuckDB runs over the driver's views.
They are never executed by Spark.
"""

from __future__ import annotations

from ..operators.features import DEFAULT_LAGS, DEFAULT_WINDOWS, min_periods
from ..sources.panels import DAILY_TEST_FROM, WEEKLY_TEST_FROM

W_ENTITY = "PARTITION BY entity ORDER BY period"
W_SPLIT = "PARTITION BY entity, split ORDER BY period"


def r6(expr: str) -> str:
    """Same engine-stable rounding as ``functions.r6`` (9 significant digits)."""
    x = f"CAST({expr} AS DOUBLE)"
    p = f"pow(10.0, greatest(floor(log10(abs({x}))), -1))"
    return (f"(CASE WHEN {x} = 0 OR isnan({x}) OR NOT abs({x}) BETWEEN 1e-300 AND 1e300 THEN {x} + 0.0 "
            f"ELSE round({x} * (1.0 + 1e-13) / {p}, 8) * {p} + 0.0 END)")


def ffill_bfill(col: str, part: str = W_SPLIT) -> str:
    return (f"coalesce(last_value({col} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({col} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")


def lag(col: str, k: int, part: str = W_ENTITY) -> str:
    return f"lag({col}, {k}) OVER ({part})"


def roll(col: str, win: int, stat: str, part: str = W_ENTITY, minp: int | None = None) -> str:
    frame = f"OVER ({part} ROWS BETWEEN {win} PRECEDING AND 1 PRECEDING)"
    fn = "avg" if stat == "mean" else "stddev_samp"
    m = min_periods(win) if minp is None else minp
    return f"CASE WHEN count({col}) {frame} >= {m} THEN {fn}({col}) {frame} END"


WEEKLY_AGG = """
  SELECT c_mktsegment AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS period,
         avg(o_totalprice) AS f_price,
         avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS f_urgent,
         avg(c_acctbal) FILTER (WHERE o_orderstatus = 'F') AS f_acct,
         avg(o_totalprice) AS f_price_dup,
         count(*) AS target
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2"""

WEEKLY_PANEL = f"""
  SELECT entity, period, CAST(isoyear(period) AS INTEGER) AS year, CAST(weekofyear(period) AS INTEGER) AS weekofyear,
         f_price, f_urgent, f_acct, f_price_dup,
         CASE WHEN period < DATE '{WEEKLY_TEST_FROM}' THEN target END AS target,
         CASE WHEN period < DATE '{WEEKLY_TEST_FROM}' THEN 'train' ELSE 'test' END AS split
  FROM weekly_agg"""

DAILY_PANEL = f"""
  SELECT entity, period, CAST(isoyear(period) AS INTEGER) AS year, CAST(weekofyear(period) AS INTEGER) AS weekofyear,
         f_avg, f_max, f_std, f_users,
         CASE WHEN period < DATE '{DAILY_TEST_FROM}' THEN target END AS target,
         CASE WHEN period < DATE '{DAILY_TEST_FROM}' THEN 'train' ELSE 'test' END AS split
  FROM (SELECT event_type AS entity, CAST(date_trunc('day', ts) AS DATE) AS period,
               avg(value) AS f_avg, max(value) AS f_max, stddev_samp(value) AS f_std,
               CAST(count(DISTINCT user_id) AS DOUBLE) AS f_users, count(*) AS target
        FROM events GROUP BY 1, 2) d"""

BASE3 = ["f_price", "f_urgent", "f_acct"]


def cleaned(cols=BASE3, src="weekly_panel") -> str:
    sel = ", ".join(f"{ffill_bfill(c)} AS {c}" for c in cols)
    return f"SELECT entity, period, year, weekofyear, {sel}, target, split FROM {src}"


def with_ctes(*ctes: tuple[str, str], body: str) -> str:
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {parts}\n{body}"


PANEL_CTES = (("weekly_agg", WEEKLY_AGG), ("weekly_panel", WEEKLY_PANEL))


def flagship_ctes() -> tuple:
    """CTEs up to the hold-out frame ``tr`` (train rows with pos/n/role)."""
    feat = (f"SELECT *, {lag('f_urgent', 4)} AS f_urgent_lag_4, {roll('f_urgent', 12, 'mean')} AS f_urgent_rollmean_12, "
            f"{roll('f_urgent', 12, 'std')} AS f_urgent_rollstd_12 FROM clean1")
    kept = ("SELECT * FROM feat1 WHERE split = 'test' OR (f_urgent IS NOT NULL AND f_urgent_lag_4 IS NOT NULL "
            "AND f_urgent_rollmean_12 IS NOT NULL AND f_urgent_rollstd_12 IS NOT NULL)")
    tr = ("SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY period) <= "
          "floor(count(*) OVER (PARTITION BY entity) * CAST(0.75 AS DOUBLE)) THEN 'fit' ELSE 'holdout' END AS role "
          "FROM kept1 WHERE split = 'train'")
    return PANEL_CTES + (("clean1", cleaned(["f_urgent"])), ("feat1", feat), ("kept1", kept), ("tr", tr))


def naive_preds_ctes() -> tuple:
    wide = ("SELECT entity, period, role, CAST(target AS DOUBLE) AS actual, "
            f"lag(CAST(target AS DOUBLE), 1) OVER ({W_ENTITY}) AS naive_lag1, "
            f"{roll('CAST(target AS DOUBLE)', 4, 'mean', minp=2)} AS naive_roll4, "
            f"lag(CAST(target AS DOUBLE), 52) OVER ({W_ENTITY}) AS naive_seasonal FROM tr")
    preds = ("SELECT entity, model_key, period, actual, predicted FROM ("
             "SELECT entity, 'naive_lag1' AS model_key, period, actual, naive_lag1 AS predicted FROM wide WHERE role = 'holdout' "
             "UNION ALL SELECT entity, 'naive_roll4', period, actual, naive_roll4 FROM wide WHERE role = 'holdout' "
             "UNION ALL SELECT entity, 'naive_seasonal', period, actual, naive_seasonal FROM wide WHERE role = 'holdout') u "
             "WHERE predicted IS NOT NULL")
    return flagship_ctes() + (("wide", wide), ("preds", preds))


def metric_sql(a: str = "actual", p: str = "predicted", rounded: bool = True) -> str:
    e = f"({a} - {p})"
    ss_tot = f"(var_pop({a}) * count({a}))"
    ss_res = f"sum({e} * {e})"
    r2 = (f"CASE WHEN {ss_tot} > 0 THEN 1 - {ss_res} / {ss_tot} WHEN {ss_res} = 0 THEN 1.0 ELSE 0.0 END")
    mae, rmse = f"avg(abs({e}))", f"sqrt(avg({e} * {e}))"
    if rounded:
        mae, rmse, r2 = r6(mae), r6(rmse), r6(r2)
    return f"count({a}) AS n, {mae} AS mae, {rmse} AS rmse, {r2} AS r2"


SEASON_SQL = ("sin(2 * pi() * CAST(weekofyear AS DOUBLE) / 52.0) AS woy_sin, "
              "cos(2 * pi() * CAST(weekofyear AS DOUBLE) / 52.0) AS woy_cos, "
              "sin(2 * pi() * CAST(month(period) AS DOUBLE) / 12.0) AS month_sin, "
              "cos(2 * pi() * CAST(month(period) AS DOUBLE) / 12.0) AS month_cos")
SEASON_COLS = ["woy_sin", "woy_cos", "month_sin", "month_cos"]


def window_feature_names(cols=BASE3, lags=DEFAULT_LAGS, windows=DEFAULT_WINDOWS) -> list[str]:
    out = []
    for c in cols:
        out += [f"{c}_lag_{k}" for k in lags]
        for w in windows:
            out += [f"{c}_rollmean_{w}", f"{c}_rollstd_{w}"]
    return out


def window_feature_sql(cols=BASE3, lags=DEFAULT_LAGS, windows=DEFAULT_WINDOWS) -> str:
    out = []
    for c in cols:
        out += [f"{lag(c, k)} AS {c}_lag_{k}" for k in lags]
        for w in windows:
            out += [f"{roll(c, w, 'mean')} AS {c}_rollmean_{w}", f"{roll(c, w, 'std')} AS {c}_rollstd_{w}"]
    return ", ".join(out)


def feature_names(cols=BASE3) -> list[str]:
    return list(cols) + SEASON_COLS + window_feature_names(cols)


def engineered_ctes(cols=BASE3, ar: bool = False, src_ctes=PANEL_CTES, src="weekly_panel") -> tuple:
    """CTE chain equal to ``operators.features.engineer`` on the cleaned panel; last CTE = ``eng``."""
    names = feature_names(cols)
    feat = f"SELECT *, {SEASON_SQL} FROM clean"
    feat2 = f"SELECT *, {window_feature_sql(cols)} FROM seas"
    cond = " AND ".join(f"{n} IS NOT NULL" for n in names)
    kept = f"SELECT * FROM feat WHERE split = 'test' OR ({cond})"
    fills = ", ".join(f"CASE WHEN split = 'test' THEN {ffill_bfill(n)} ELSE {n} END AS {n}" for n in names)
    filled = f"SELECT entity, period, year, weekofyear, {fills}, target, split FROM kept"
    ctes = src_ctes + (("clean", cleaned(cols, src)), ("seas", feat), ("feat", feat2), ("kept", kept), ("eng0", filled))
    if not ar:
        return ctes + (("eng", "SELECT * FROM eng0"),)
    y = "CAST(target AS DOUBLE)"
    case_sel = ", ".join([f"lag({y}, {k}) OVER ({W_ENTITY}) AS cases_lag_{k}" for k in DEFAULT_LAGS] +
                         [f"{roll(y, 4, 'mean', minp=2)} AS cases_rollmean_4"])
    case_names = CASE_NAMES
    ccond = " AND ".join(f"{n} IS NOT NULL" for n in case_names)
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in case_names)
    ar_sql = (f"SELECT * FROM (SELECT *, {case_sel} FROM eng0 WHERE split = 'train') t WHERE {ccond} "
              f"UNION ALL SELECT *, {nulls} FROM eng0 WHERE split = 'test'")
    return ctes + (("eng", ar_sql),)


CASE_NAMES = [f"cases_lag_{k}" for k in DEFAULT_LAGS] + ["cases_rollmean_4"]


def split_ctes(ar: bool = False) -> tuple:
    """engineered -> train rows with the 75 % role (CTE ``spl``)."""
    spl = ("SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY period) <= "
           "floor(count(*) OVER (PARTITION BY entity) * CAST(0.75 AS DOUBLE)) THEN 'fit' ELSE 'holdout' END AS role "
           "FROM eng WHERE split = 'train'")
    return engineered_ctes(ar=ar) + (("spl", spl),)


def harmonic_sql(m: str) -> str:
    """H(m) exactly as ``functions.harmonic`` computes it."""
    md = f"CAST({m} AS DOUBLE)"
    return (f"(CASE WHEN {m} <= 0 THEN 0.0 WHEN {m} <= 64 THEN "
            f"list_reduce(list_transform(range(1, CAST({m} AS BIGINT) + 1), lambda i: CAST(1.0 AS DOUBLE) / i), lambda a, b: a + b) "
            f"ELSE ln({md}) + 0.5772156649015329 + 1.0 / (2.0 * {md}) - 1.0 / (12.0 * {md} * {md}) "
            f"+ 1.0 / (120.0 * pow({md}, 4)) END)")


def jitter_sql(rid: str, fidx: str) -> str:
    a = f"((CAST({rid} AS BIGINT) * 1103515245 + (CAST({fidx} AS BIGINT) + 7) * 12345 + 12345) % 2147483648)"
    b = f"(({a} * 1103515245 + 12345) % 2147483648)"
    return f"(CAST({b} AS DOUBLE) / 1073741824.0 - 1.0)"


def mi_ctes(names: list[str], rows_cte: str = "spl", where: str = "role = 'fit'") -> tuple:
    """Brute-force KSG (all pairs; fine for an oracle) ending in CTE ``mi``."""
    base = (f"SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY period) AS rid, "
            f"ln(1 + CAST(target AS DOUBLE)) AS y0, {', '.join(names)} FROM {rows_cte} WHERE {where}")
    long = " UNION ALL ".join(f"SELECT entity, rid, y0, '{c}' AS feature, {i} AS feature_idx, CAST({c} AS DOUBLE) AS x0 "
                              f"FROM mib" for i, c in enumerate(names))
    sc = ("SELECT entity, feature, feature_idx, rid, "
          "x0 / coalesce(CASE WHEN stddev_pop(x0) OVER g <> 0 THEN stddev_pop(x0) OVER g END, 1.0) AS xs, "
          "y0 / coalesce(CASE WHEN stddev_pop(y0) OVER g <> 0 THEN stddev_pop(y0) OVER g END, 1.0) AS ys, "
          "count(*) OVER g AS n FROM mil WINDOW g AS (PARTITION BY entity, feature)")
    pts = (f"SELECT entity, feature, feature_idx, rid, n, "
           f"xs + 1e-10 * greatest(1.0, avg(abs(xs)) OVER g) * {jitter_sql('rid', 'feature_idx')} AS x, "
           f"ys + 1e-10 * greatest(1.0, avg(abs(ys)) OVER g) * {jitter_sql('rid', '-1')} AS y "
           "FROM mis WINDOW g AS (PARTITION BY entity, feature)")
    eps = ("SELECT a.entity, a.feature, a.rid, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS eps FROM mip a JOIN mip b "
           "ON a.entity = b.entity AND a.feature = b.feature AND a.rid <> b.rid WHERE a.n > 3 "
           "QUALIFY row_number() OVER (PARTITION BY a.entity, a.feature, a.rid "
           "ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) = 3")
    cnt = ("SELECT a.entity, a.feature, a.rid, "
           "count(*) FILTER (WHERE b.x < a.x + e.eps * CAST('0.999999999' AS DOUBLE)) - "
           "count(*) FILTER (WHERE b.x <= a.x - e.eps * CAST('0.999999999' AS DOUBLE)) - 1 AS nx, "
           "count(*) FILTER (WHERE b.y < a.y + e.eps * CAST('0.999999999' AS DOUBLE)) - "
           "count(*) FILTER (WHERE b.y <= a.y - e.eps * CAST('0.999999999' AS DOUBLE)) - 1 AS ny "
           "FROM mip a JOIN mie e ON a.entity = e.entity AND a.feature = e.feature AND a.rid = e.rid "
           "JOIN mip b ON a.entity = b.entity AND a.feature = b.feature GROUP BY a.entity, a.feature, a.rid")
    agg = (f"SELECT entity, feature, avg({harmonic_sql('nx')}) AS hx, avg({harmonic_sql('ny')}) AS hy "
           "FROM mic GROUP BY entity, feature")
    meta = "SELECT entity, feature, any_value(feature_idx) AS feature_idx, any_value(n) AS n FROM mip GROUP BY ALL"
    mi = (f"SELECT m.entity, m.feature, m.feature_idx, m.n, CASE WHEN m.n > 3 THEN greatest("
          f"{harmonic_sql('m.n - 1')} + {harmonic_sql('2')} - hx - hy, 0.0) END AS mi "
          "FROM mim m LEFT JOIN mia a ON m.entity = a.entity AND m.feature = a.feature")
    return (("mib", base), ("mil", long), ("mis", sc), ("mip", pts), ("mie", eps), ("mic", cnt), ("mia", agg),
            ("mim", meta), ("mi", mi))
