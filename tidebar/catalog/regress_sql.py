"""SQL pieces for least squares: sums of products as lists, solved by sweeping one column after another.

Independent of the Spark side, which solves the same normal equations in another way.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidebar.catalog.base import sql_norm_cdf
from tidebar.operators import fracdiff


def gram(cols: str, m: str) -> str:
    """All products of a list of columns with each other, as one list of m x m numbers."""
    return (f"list_transform(range(0, {m}*{m}), lambda q: list_dot_product({cols}[CAST(q//{m} AS INTEGER)+1], {cols}[CAST(q%{m} AS INTEGER)+1]))")


def sweep(g: str, m: str, p: str) -> str:
    """The list after column `p` (from 0) moved to the regressors: below a swept column stand the coefficients in the last
    column, the inverse in the swept block and the residual sum at the end."""
    at = lambda i, j: f"{g}[CAST(({i})*{m}+({j})+1 AS INTEGER)]"
    i, j = f"(q//{m})", f"(q%{m})"
    return (f"list_transform(range(0, {m}*{m}), lambda q: CASE WHEN {i}={p} AND {j}={p} THEN 1/{at(p, p)} WHEN {i}={p} THEN {at(p, j)}/{at(p, p)} "
            f"WHEN {j}={p} THEN -{at(i, p)}/{at(p, p)} ELSE {at(i, j)}-{at(i, p)}*{at(p, j)}/{at(p, p)} END)")


def _columns(lags: str) -> str:
    """Columns [1, level before, lagged differences, difference] of the rows after `lags`, from lists y and d (d[1] null)."""
    return (f"list_concat([list_transform(range(0, n-{lags}-1), lambda z: CAST(1 AS DOUBLE)), y[{lags}+1:n-1]], "
            f"list_transform(range(1, {lags}+1), lambda k: d[{lags}+2-k:n-k]), [d[{lags}+2:n]])")


def _p_value() -> str:
    small = "+".join(f"({c!r}::DOUBLE)*pow(tau,{i})" for i, c in enumerate(fracdiff.SMALL_P))
    large = "+".join(f"({c!r}::DOUBLE)*pow(tau,{i})" for i, c in enumerate(fracdiff.LARGE_P))
    z = f"(CASE WHEN tau<={fracdiff.TAU_STAR} THEN {small} ELSE {large} END)"
    return f"CASE WHEN tau>{fracdiff.TAU_MAX} THEN 1 WHEN tau<{fracdiff.TAU_MIN} THEN 0 ELSE {sql_norm_cdf(z)} END"


def adf(src: str, keys: Sequence[str], name: str) -> str:
    """CTEs ending in `name`: keys, n_obs, best_lag, tau, p_value of series `src` (keys, n, y as a list)."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM b.{c}" for c in keys)
    return f""",
{name}0 AS MATERIALIZED (SELECT {k}, n, y, list_concat([NULL::DOUBLE], list_transform(range(2, n+1), lambda i: y[CAST(i AS INTEGER)]-y[CAST(i-1 AS INTEGER)])) AS d,
      least(n//2-2, CAST(ceil(12*pow(n/100.0::DOUBLE, 0.25::DOUBLE)) AS BIGINT)) AS lags FROM {src}),
{name}1 AS MATERIALIZED (SELECT {k}, n, lags, lags+3 AS m, {gram('c', '(lags+3)')} AS g FROM (SELECT *, {_columns('lags')} AS c FROM {name}0)),
{name}2 AS (SELECT {k}, n, lags, m, 0 AS p, g FROM {name}1 UNION ALL
      SELECT {k}, n, lags, m, p+1, {sweep('g', 'm', 'p')} FROM {name}2 WHERE p<m-1),
{name}3 AS MATERIALIZED (SELECT {k}, n, lags, p-2 AS lag, (n-lags-1)*ln(g[CAST(m*m AS INTEGER)]/(n-lags-1))+2*(p-2+2) AS aic FROM {name}2 WHERE p>=2),
{name}4 AS MATERIALIZED (SELECT {k}, min(lag) AS best FROM (SELECT *, min(aic) OVER (PARTITION BY {k}) AS low FROM {name}3) WHERE aic=low GROUP BY ALL),
{name}5 AS MATERIALIZED (SELECT {k}, n, best, best+3 AS m, {gram('c', '(best+3)')} AS g FROM (SELECT s.*, best, {_columns('best')} AS c FROM {name}0 s JOIN {name}4 b ON {on})),
{name}6 AS (SELECT {k}, n, best, m, 0 AS p, g FROM {name}5 UNION ALL SELECT {k}, n, best, m, p+1, {sweep('g', 'm', 'p')} FROM {name}6 WHERE p<m-1),
{name}7 AS (SELECT {k}, n, best, g[CAST(2*m AS INTEGER)]/sqrt(g[CAST(m*m AS INTEGER)]/(n-best-1-(2+best))*g[CAST(m+2 AS INTEGER)]) AS tau FROM {name}6 WHERE p=m-1),
{name} AS MATERIALIZED (SELECT {k}, n AS n_obs, best AS best_lag, tau, {_p_value()} AS p_value FROM {name}7)"""


#: Differencing weights of the 40 orders, newest first, down to the first under the threshold.
WEIGHTS = f""",
fd AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS d_no),
fw AS (SELECT d_no, 0 AS k, CAST(1 AS DOUBLE) AS v FROM fd UNION ALL
       SELECT d_no, k+1, -v*(d_no/CAST(39 AS DOUBLE)-(k+1)+1)/(k+1) FROM fw WHERE abs(-v*(d_no/CAST(39 AS DOUBLE)-(k+1)+1)/(k+1)) >= {fracdiff.THRESHOLD!r}),
wl AS MATERIALIZED (SELECT d_no, count(*) AS w, list(v ORDER BY k DESC) AS old FROM fw GROUP BY 1)"""


def differenced(src: str, keys: Sequence[str], name: str) -> str:
    """`src` (keys, n, y) at every order: keys, d_no, n (what is left), y, and x, the undifferenced values of the same rows."""
    k = ", ".join(keys)
    return f""",
{name} AS MATERIALIZED (SELECT {k}, d_no, n-w+1 AS n, list_transform(range(1, n-w+2), lambda i: list_dot_product(y[CAST(i AS INTEGER):CAST(i+w-1 AS INTEGER)], old)) AS y,
      y[CAST(w AS INTEGER):n] AS x FROM {src}, wl WHERE n-w+1>=8)"""


def min_order(src: str, keys: Sequence[str], name: str) -> str:
    """CTEs ending in `name`: keys, d_no, d, corr of the smallest order whose series passes the test; (39, 1, 0) where none does."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c}=t.{c}" for c in keys)
    return differenced(src, keys, f"{name}d") + adf(f"{name}d", [*keys, "d_no"], f"{name}t") + f""",
{name}p AS (SELECT s.*, t.n_obs, t.p_value FROM {name}d s JOIN {name}t t ON {on} AND s.d_no=t.d_no WHERE p_value<={fracdiff.P_LIMIT!r} AND n_obs>={fracdiff.MIN_OBS}),
{name}q AS (SELECT * FROM {name}p QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY d_no)=1),
{name} AS MATERIALIZED (SELECT {', '.join('a.'+c for c in keys)}, coalesce(d_no, 39) AS d_no, coalesce(d_no/CAST(39 AS DOUBLE), 1) AS d,
      coalesce((list_dot_product(x, q.y)-list_sum(x)*list_sum(q.y)/n_obs)/sqrt((list_dot_product(x, x)-list_sum(x)*list_sum(x)/n_obs)*(list_dot_product(q.y, q.y)-list_sum(q.y)*list_sum(q.y)/n_obs)), 0) AS corr
      FROM (SELECT DISTINCT {k} FROM {src}) a LEFT JOIN {name}q q USING ({k}))"""
