"""Independent SQL statements of the registered queries (DuckDB dialect).

They run on the raw driver tables (views ``lineitem``, ``orders`` ...) and
recompute everything from scratch, including the cleaning statistics, so they
share no code path with the Spark plans. Conventions that make results equal
bit for bit in both engines: money is summed as DECIMAL(18,4) and cast to
DOUBLE afterwards; a division by zero gives NULL (``NULLIF``); integer outputs
are BIGINT.
"""

from __future__ import annotations

from ..sources.tables import FACT_SQL

CAPPED = ("sales", "profit", "quantity", "discount")
MONEY_COLS = ("sales", "profit")
KEY_TEXT = ("ship_mode", "segment", "region", "state", "category", "sub_category")


def money(x: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({x} AS DECIMAL(18,4))), 0) AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def margin(p: str = "profit", s: str = "sales") -> str:
    return f"({ratio(p, s)} * 100.0)"


def _prepared_ctes(extra_parts: bool = False) -> str:
    """fact -> dated -> imputed -> quartiles -> prepared."""
    if extra_parts:
        parts = """,
    year(order_date) AS order_year, month(order_date) AS order_month,
    quarter(order_date) AS order_quarter, isodow(order_date) - 1 AS order_dayofweek,
    day(order_date) AS order_dayofmonth, weekofyear(order_date) AS order_weekofyear,
    CAST(date_diff('day', order_date, ship_date) AS BIGINT) AS ship_lag"""
    else:
        parts = """,
    year(order_date) AS order_year, month(order_date) AS order_month,
    quarter(order_date) AS order_quarter, isodow(order_date) - 1 AS order_dayofweek,
    year(ship_date) AS ship_year, month(ship_date) AS ship_month,
    quarter(ship_date) AS ship_quarter, isodow(ship_date) - 1 AS ship_dayofweek"""
    def lists(src: str) -> str:
        return ", ".join(f"count({c}) AS n_{c}, list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS l_{c}"
                         for c in MONEY_COLS) + f" FROM {src}"

    def quant(c: str, p: float) -> str:
        if c not in MONEY_COLS:
            return f"quantile_cont(CAST({c} AS DOUBLE), {p})"
        # exact decimal interpolation between the two order statistics
        h = f"((n_{c} - 1) * {p})"
        lo = f"l_{c}[CAST(floor({h}) AS BIGINT) + 1]"
        hi = f"l_{c}[CAST(ceil({h}) AS BIGINT) + 1]"
        return f"({lo} + ({hi} - {lo}) * CAST({h} - floor({h}) AS DECIMAL(10,4)))"

    med = ",\n    ".join(f"{quant(c, 0.5)} AS med_{c}" for c in CAPPED)
    modes = ",\n    ".join(
        f"(SELECT {c} FROM dated WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_{c}" for c in KEY_TEXT)
    fill = ",\n    ".join(
        [f"COALESCE({c}, CAST(med_{c} AS {'DECIMAL(18,4)' if c in ('sales', 'profit') else 'DOUBLE'})) AS {c}"
         for c in CAPPED] + [f"COALESCE({c}, mode_{c}) AS {c}" for c in KEY_TEXT])
    quart = ",\n    ".join(
        f"{quant(c, 0.25)} AS q1_{c}, {quant(c, 0.75)} AS q3_{c}" for c in CAPPED)
    bounds = ",\n    ".join(
        f"q1_{c} - 1.5 * (q3_{c} - q1_{c}) AS lo_{c}, q3_{c} + 1.5 * (q3_{c} - q1_{c}) AS hi_{c}"
        for c in CAPPED)

    def cap(c: str) -> str:
        t = "DECIMAL(18,4)" if c in ("sales", "profit") else "DOUBLE"
        lo, hi = f"CAST(lo_{c} AS {t})", f"CAST(hi_{c} AS {t})"
        return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}"

    capped = ",\n    ".join(cap(c) for c in CAPPED)
    return f"""WITH fact AS ({FACT_SQL}),
dated AS (SELECT *{parts} FROM fact),
dlists AS (SELECT {lists('dated')}),
fills AS (SELECT
    {med},
    {modes}
  FROM dated, dlists GROUP BY ALL),
imputed AS (SELECT * EXCLUDE ({', '.join([f'med_{c}' for c in CAPPED] + [f'mode_{c}' for c in KEY_TEXT])}) REPLACE (
    {fill}) FROM dated, fills),
ilists AS (SELECT {lists('imputed')}),
quartiles AS (SELECT
    {quart} FROM imputed, ilists GROUP BY ALL),
bounds AS (SELECT
    {bounds} FROM quartiles),
prepared AS (SELECT * EXCLUDE ({', '.join(f'lo_{c}, hi_{c}' for c in CAPPED)}) REPLACE (
    {capped}) FROM imputed, bounds)
"""


# Deterministic gaps injected into the (complete) driver data to exercise the
# imputation; the same rule is applied by ``plans.frames.with_gaps``.
GAPS = {
    "quantity": "product_id % 17 = 0",
    "discount": "customer_id % 11 = 0",
    "sales": "order_id % 23 = 0",
    "segment": "order_id % 13 = 0",
    "ship_mode": "customer_id % 19 = 0",
}


def _gapped() -> str:
    rep = ",\n    ".join(f"CASE WHEN {cond} THEN NULL ELSE {c} END AS {c}"
                          for c, cond in GAPS.items())
    return f"""WITH fact AS ({FACT_SQL}),
gapped AS (SELECT * REPLACE (
    {rep}) FROM fact)
"""


GAPPED = _gapped()
PREPARED = _prepared_ctes(False)
PREPARED_X = _prepared_ctes(True)
RAW = f"WITH fact AS ({FACT_SQL})\n"


def on_prepared(body: str, extra_parts: bool = False) -> str:
    return (PREPARED_X if extra_parts else PREPARED) + body


def on_raw(body: str) -> str:
    return RAW + body


# ---------------------------------------------------------------------------
# Monthly series and features (forecaster's prepared frame)
# ---------------------------------------------------------------------------

def monthly_cte(keys: tuple[str, ...] = ()) -> str:
    k = "".join(f"{c}, " for c in keys)
    nn = "".join(f" AND {c} IS NOT NULL" for c in keys)
    return f"""
, ms AS (SELECT {k}year(order_date) AS year, month(order_date) AS month,
    make_date(year(order_date), month(order_date), 1) AS date,
    COALESCE(SUM(CAST(sales AS DECIMAL(18,4))), 0) AS sales_dec,
    CAST(COALESCE(SUM(CAST(sales AS DECIMAL(18,4))), 0) AS DOUBLE) AS sales,
    CAST(COALESCE(SUM(CAST(profit AS DECIMAL(18,4))), 0) AS DOUBLE) AS profit,
    CAST(COALESCE(SUM(CAST(quantity AS DECIMAL(18,4))), 0) AS DOUBLE) AS quantity,
    CAST(SUM(CAST(discount AS DECIMAL(18,4))) AS DOUBLE)
      / NULLIF(CAST(COUNT(discount) AS DOUBLE), 0) AS avg_discount,
    COUNT(order_id) AS order_count
  FROM prepared WHERE order_date IS NOT NULL{nn}
  GROUP BY {k}year(order_date), month(order_date))
"""


def features_cte(keys: tuple[str, ...], lags, measures, windows, with_std: bool) -> str:
    """ms -> feat (all columns, nulls where the series is too short) ->
    feat_clean (incomplete rows dropped)."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    cols = []
    for k in lags:
        for c in measures:
            cols.append(f"CASE WHEN n > {k} THEN lag({c}, {k}) OVER (w) END AS {c}_lag_{k}")
    for win in windows:
        fr = f"(w ROWS BETWEEN {win} PRECEDING AND 1 PRECEDING)"
        full = f"n > {win} AND count(sales) OVER {fr} = {win}"
        cols.append(f"CASE WHEN {full} THEN CAST(SUM(sales_dec) OVER {fr} AS DOUBLE) / {win}.0 END"
                    f" AS sales_rolling_mean_{win}")
        if with_std:
            cols.append(f"CASE WHEN {full} THEN stddev_samp(sales) OVER {fr} END"
                        f" AS sales_rolling_std_{win}")
    cols.append("sin(2 * pi() * month / 12) AS month_sin")
    cols.append("cos(2 * pi() * month / 12) AS month_cos")
    need = []
    for k in lags:
        for c in measures:
            need.append(f"({c}_lag_{k} IS NOT NULL OR n <= {k})")
    for win in windows:
        need.append(f"(sales_rolling_mean_{win} IS NOT NULL OR n <= {win})")
        if with_std:
            need.append(f"(sales_rolling_std_{win} IS NOT NULL OR n <= {win})")
    base_cols = ["year", "month", "date", "sales", "profit", "quantity", "avg_discount",
                 "order_count"]
    need += [f"{c} IS NOT NULL" for c in list(keys) + base_cols]
    join_n = (f"JOIN (SELECT {', '.join(keys)}, count(*) AS n FROM ms GROUP BY ALL) USING ({', '.join(keys)})"
              if keys else ", (SELECT count(*) AS n FROM ms)")
    return f"""
, feat AS (SELECT ms.*, n,
    {(','+chr(10)+'    ').join(cols)}
  FROM ms {join_n}
  WINDOW w AS ({part}ORDER BY date))
, feat_clean AS (SELECT * FROM feat WHERE {' AND '.join(need)})
"""


GLOBAL_FEAT = monthly_cte() + features_cte((), (1, 2, 3, 6, 12), ("sales", "profit", "quantity"),
                                           (3, 6, 12), True)
CATEGORY_FEAT = monthly_cte(("category",)) + features_cte(
    ("category",), (1, 2, 3), ("sales", "profit"), (3, 6), False)


def global_feature_list() -> list[str]:
    out = ["avg_discount"]
    out += [f"{c}_lag_{k}" for k in (1, 2, 3, 6, 12) for c in ("sales", "profit", "quantity")]
    out += [f"sales_rolling_{s}_{w}" for w in (3, 6, 12) for s in ("mean", "std")]
    return out + ["month_sin", "month_cos"]


def category_feature_list() -> list[str]:
    out = ["avg_discount"]
    out += [f"{c}_lag_{k}" for k in (1, 2, 3) for c in ("sales", "profit")]
    out += [f"sales_rolling_mean_{w}" for w in (3, 6)]
    return out + ["month_sin", "month_cos"]


def rounded(col: str) -> str:
    """Compare precision for values whose last bits depend on the engine's
    algorithm (sample std: 2 places, sin/cos: 10 places)."""
    if "_std_" in col:
        return f"round({col}, 2) AS {col}"
    if col in ("month_sin", "month_cos"):
        return f"round({col}, 10) + 0.0 AS {col}"   # + 0.0: no -0.0
    return col


# ---------------------------------------------------------------------------
# Least squares from product sums: the same elimination, as recursive SQL
# ---------------------------------------------------------------------------

def _swept(m: str, k: str) -> str:
    return (f"list_transform({m}, lambda r, i: list_transform(r, lambda x, j: "
            f"CASE WHEN i = {k} AND j = {k} THEN 1.0::DOUBLE / {m}[{k}][{k}] "
            f"WHEN i = {k} THEN x / {m}[{k}][{k}] WHEN j = {k} THEN -x / {m}[{k}][{k}] "
            f"ELSE x - r[{k}] * {m}[{k}][j] / {m}[{k}][{k}] END))")


def _total(items: str, start: str = "0.0::DOUBLE") -> str:
    return f"list_reduce(list_prepend({start}, {items}), lambda a, c: a + c)"


def linear_cte(keys: tuple[str, ...], feats: list[str], min_train: int = 0, min_test: int = 0) -> str:
    """numbered (rn, cnt) -> linear (keys, fold, train_size, test_size,
    intercept, coefs) and inputs (keys, rn, date, sales, xs)."""
    p = len(feats)
    y = p + 1
    k = "".join(f"{c}, " for c in keys)
    using = f"USING ({', '.join(keys)})" if keys else "ON true"
    over = f"(PARTITION BY {', '.join(keys)})" if keys else "()"
    cols = [*feats, "sales"]
    same = "".join(f" AND a.{c} = b.{c}" for c in keys)
    ak = "".join(f"a.{c}, " for c in keys)

    def share(a: str, b: str) -> str:
        cell = f"b[{a} + 1][{b} + 1]"
        return f"CASE WHEN abs({cell}) > 1e-6 THEN {cell} ELSE 0.0::DOUBLE END"

    def own(a: str) -> str:
        less = _total(f"list_transform(rest, lambda w: ({share(a, 'w')}) * g[w + 1][{y} + 1])")
        return f"(b[{a} + 1][{y} + 1] - {less})"

    return f"""
, inputs AS (SELECT {k}rn, cnt, date, sales,
    [{', '.join(f'CAST({c} AS DOUBLE)' for c in cols)}] AS xs,
    [{', '.join(f'max(abs(CAST({c} AS DOUBLE))) OVER {over}' for c in cols)}] AS units FROM numbered)
, scaled AS (SELECT {k}rn, cnt, units, list_prepend(CAST(1e10 AS HUGEINT),
    list_transform(range(1, {p + 2}), lambda q: CASE WHEN xs[q] IS NOT NULL AND units[q] > 0
      THEN CAST(floor(xs[q] / units[q] * 1e10 + 0.5) AS HUGEINT) ELSE 0::HUGEINT END)) AS z FROM inputs)
, long AS (SELECT {k}rn, i, z[i + 1] AS v FROM scaled, range(0, {p + 2}) r(i))
, ends AS (SELECT * FROM (SELECT DISTINCT {k}cnt, fold, cnt - (5 - fold) * (cnt // 6) AS train_size,
    cnt // 6 AS test_size FROM numbered, range(0, 5) f(fold))
  WHERE test_size >= 1 AND train_size >= {min_train} AND test_size >= {min_test})
, wanted AS (SELECT * FROM ends UNION ALL SELECT DISTINCT {k}cnt, -1, cnt, 0 FROM ends)
, sums AS (SELECT {ak}fold, a.i, b.i AS j, (CAST(SUM(a.v * b.v) // 1000000000000 AS DOUBLE) * 1e12::DOUBLE
    + CAST(SUM(a.v * b.v) % 1000000000000 AS DOUBLE)) / (1e10::DOUBLE * 1e10::DOUBLE) AS s
  FROM wanted JOIN long a {using} JOIN long b ON a.rn = b.rn{same}
  WHERE a.rn < train_size GROUP BY {ak}fold, a.i, b.i)
, lines AS (SELECT {k}fold, i, list(s ORDER BY j) AS line FROM sums GROUP BY {k}fold, i)
, mats AS (SELECT {k}fold, list(line ORDER BY i) AS m0 FROM lines GROUP BY {k}fold)
, centred AS (SELECT {k}fold, m0, {_swept('m0', '1')} AS m, units
  FROM mats JOIN (SELECT DISTINCT {k}units FROM scaled) {using})
, ready AS (SELECT {k}fold, m, units,
    list_transform(range(1, {p + 3}), lambda q: CASE WHEN m[q][q] > 1e-12 * m0[q][q] THEN m[q][q] END) AS vars,
    list_transform(list_sort(list_transform(range(1, {p + 1}), lambda q:
      {{'u': -coalesce(units[q], 0.0), 'k': q}})), lambda o: o.k) AS ord FROM centred)
, swept({k}fold, n, m, used, units, vars, ord) AS (
  SELECT {k}fold, 1, m, []::BIGINT[], units, vars, ord FROM ready
  UNION ALL SELECT {k}fold, n + 1, CASE WHEN take THEN {_swept('m', 'k')} ELSE m END,
    CASE WHEN take THEN list_append(used, k - 1) ELSE used END, units, vars, ord
  FROM (SELECT *, ord[n] + 1 AS k, coalesce(m[ord[n] + 1][ord[n] + 1] > 1e-10 * vars[ord[n] + 1], false) AS take
        FROM swept WHERE n <= {p}))
, basis AS (SELECT {k}fold, m AS b, used, units, list_filter(range(1, {p + 1}), lambda q:
    vars[q + 1] IS NOT NULL AND NOT list_contains(used, q)) AS rest FROM swept WHERE n = {p + 1})
, grams AS (SELECT *, list_transform(range(0, {p + 2}), lambda i: list_transform(range(0, {p + 2}), lambda j:
    CASE WHEN list_contains(rest, i) AND (list_contains(rest, j) OR j = {y}) THEN
      {_total(f"list_transform(used, lambda q: 1.0::DOUBLE / (units[q] * units[q]) * ({share('q', 'i')}) * (CASE WHEN j = {y} THEN b[q + 1][{y} + 1] ELSE {share('q', 'j')} END))")}
      + CASE WHEN i = j THEN 1.0::DOUBLE / (units[i] * units[i]) ELSE 0.0 END ELSE 0.0 END)) AS g FROM basis)
, shortest({k}fold, n, b, used, units, rest, g) AS (
  SELECT {k}fold, 1, b, used, units, rest, g FROM grams
  UNION ALL SELECT {k}fold, n + 1, b, used, units, rest, {_swept('g', 'k')}
  FROM (SELECT *, rest[n] + 1 AS k FROM shortest WHERE n <= len(rest)))
, linear AS (SELECT {k}wanted.fold, train_size, test_size, {own('0')} * units[{y}] AS intercept,
    list_transform(range(1, {p + 1}), lambda q: CASE WHEN units[q] IS NOT NULL THEN
      CASE WHEN units[q] > 0 THEN (CASE WHEN list_contains(used, q) THEN {own('q')}
        WHEN list_contains(rest, q) THEN g[q + 1][{y} + 1] ELSE 0.0 END) * units[{y}] / units[q]
      ELSE 0.0 END END) AS coefs
  FROM shortest JOIN wanted USING ({k}fold) WHERE n = len(rest) + 1)
"""


def linear_prediction(p: int) -> str:
    terms = (f"list_transform(range(1, {p + 1}), lambda q: "
             "CASE WHEN coefs[q] IS NULL THEN 0.0 ELSE coefs[q] * xs[q] END)")
    return _total(terms, "intercept")


def linear_scores_cte(keys: tuple[str, ...], p: int) -> str:
    """-> scores (keys, fold, train_size, test_size, rmse) and told (horizon)."""
    k = "".join(f"{c}, " for c in keys)
    on = f"USING ({', '.join(keys)})" if keys else "ON true"
    feats = category_feature_list() if keys else global_feature_list()
    ahead = ", ".join(f"CAST({c} AS DOUBLE)" for c in feats if not c.startswith("month_"))
    return f"""
, tried AS (SELECT {k}fold, train_size, test_size, sales, {linear_prediction(p)} AS prediction
  FROM linear JOIN inputs {on}
  WHERE fold >= 0 AND rn >= train_size AND rn < train_size + test_size)
, linear_scores AS (SELECT {k}CAST(fold AS INTEGER) AS fold, CAST(train_size AS INTEGER) AS train_size,
    CAST(test_size AS INTEGER) AS test_size, sqrt(avg((sales - prediction) * (sales - prediction))) AS rmse
  FROM tried GROUP BY {k}fold, train_size, test_size)
, linear_told AS (SELECT {k}step, date, strftime(date, '%B %Y') AS label, {linear_prediction(p)} AS forecasted_sales
  FROM linear JOIN (SELECT {k}step, date, [{ahead}, sin(2 * pi() * month(date) / 12),
    cos(2 * pi() * month(date) / 12)] AS xs FROM steps) {on} WHERE fold = -1)
"""


def digits(col: str) -> str:
    """Six significant digits: what rounding in sums and products cannot reach."""
    return f"CAST(printf('%.5e', {col}) AS DOUBLE)"
