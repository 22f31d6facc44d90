"""Indicators, volatility, differencing and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog import regress_sql
from tidebar.catalog.base import ctes, query, r
from tidebar.functions.expr import r6
from tidebar.operators import arma, fracdiff, indicators, screen, series, volatility
from tidebar.plans import backtest
from tidebar.sources import market

S = "PARTITION BY symbol ORDER BY bar_idx"

EMA_SQL = ctes("bars", recursive=True) + """,
e AS (SELECT symbol, bar_idx, close, high, low, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS macd, CAST(0 AS DOUBLE) AS sig,
             CAST(0 AS DOUBLE) AS ag, CAST(0 AS DOUBLE) AS al, high-low AS tr, high-low AS atr FROM bars WHERE bar_idx=0
      UNION ALL
      SELECT symbol, bar_idx, close, high, low, e12, e26, e12-e26, sig*(1-CAST(2 AS DOUBLE)/10)+(e12-e26)*(CAST(2 AS DOUBLE)/10),
             ag*(1-CAST(1 AS DOUBLE)/14)+g*(CAST(1 AS DOUBLE)/14), al*(1-CAST(1 AS DOUBLE)/14)+l*(CAST(1 AS DOUBLE)/14), tr,
             atr*(1-CAST(1 AS DOUBLE)/14)+tr*(CAST(1 AS DOUBLE)/14)
      FROM (SELECT b.symbol, b.bar_idx, b.close, b.high, b.low, e.sig, e.ag, e.al, e.atr,
                   e.e12*(1-CAST(2 AS DOUBLE)/13)+b.close*(CAST(2 AS DOUBLE)/13) AS e12,
                   e.e26*(1-CAST(2 AS DOUBLE)/27)+b.close*(CAST(2 AS DOUBLE)/27) AS e26,
                   CASE WHEN b.close>e.close THEN b.close-e.close ELSE CAST(0 AS DOUBLE) END AS g,
                   CASE WHEN b.close<e.close THEN e.close-b.close ELSE CAST(0 AS DOUBLE) END AS l,
                   greatest(b.high-b.low, abs(b.high-e.close), abs(b.low-e.close)) AS tr
            FROM e JOIN bars b ON b.symbol=e.symbol AND b.bar_idx=e.bar_idx+1) x)
"""
RSI_SQL = "100-100/(1+ag/CASE WHEN al=0 THEN CAST(1e-10 AS DOUBLE) ELSE al END)"


@query("w1_ema", EMA_SQL + f"SELECT symbol, bar_idx, {r('e12')} AS ema12, {r('e26')} AS ema26 FROM e")
def _(spark, sf):
    b = market.bars_d1(spark, sf)
    d = indicators.ema(indicators.ema(b, indicators.span_alpha(12), out="ema12"), indicators.span_alpha(26), out="ema26")
    return d.select("symbol", "bar_idx", r6("ema12").alias("ema12"), r6("ema26").alias("ema26"))


@query("w2_macd", EMA_SQL + f"""SELECT symbol, bar_idx, {r('macd')} AS "MACD", {r('sig')} AS "MACD_Signal",
{r('macd-sig')} AS "MACD_Hist" FROM e""")
def _(spark, sf):
    d = indicators.macd(market.bars_d1(spark, sf))
    return d.select("symbol", "bar_idx", *[r6(c).alias(c) for c in ("MACD", "MACD_Signal", "MACD_Hist")])


@query("w3_rsi", EMA_SQL + f"""SELECT symbol, bar_idx, {r(RSI_SQL)} AS "RSI" FROM e""")
def _(spark, sf):
    return indicators.rsi(market.bars_d1(spark, sf)).select("symbol", "bar_idx", r6("RSI").alias("RSI"))


@query("w4_atr", EMA_SQL + f"""SELECT symbol, bar_idx, {r('tr')} AS "TR", {r('atr')} AS "ATR" FROM e""")
def _(spark, sf):
    return indicators.atr(market.bars_d1(spark, sf)).select("symbol", "bar_idx", r6("TR").alias("TR"), r6("ATR").alias("ATR"))


@query("w5_add_indicators", EMA_SQL + f"""SELECT symbol, bar_idx, {r('macd-sig')} AS "MACD_Hist", {r(RSI_SQL)} AS "RSI",
{r('atr')} AS "ATR" FROM e""")
def _(spark, sf):
    d = indicators.add_indicators(market.bars_d1(spark, sf))
    return d.select("symbol", "bar_idx", *[r6(c).alias(c) for c in ("MACD_Hist", "RSI", "ATR")])


@query("w6_historical_volatility", ctes("vol") + f"SELECT symbol, bar_idx, {r('vol')} AS hist_vol FROM vol")
def _(spark, sf):
    return volatility.hist_vol(market.bars_d1(spark, sf)).select("symbol", "bar_idx", r6("hist_vol").alias("hist_vol"))


@query("w7_conditional_volatility")
def _(spark, sf):
    d = volatility.conditional_vol(market.bars_d1(spark, sf), keep_parts=True)
    return d.select("symbol", "bar_idx", "egarch", "garch", "hist", "EGARCH_Vol")


def _grid_sql() -> str:
    """Grid likelihoods of the newest 500 returns by recursion over the returns, one row per series and grid point."""
    points = ", ".join(f"({i}, 'egarch', {a!r}::DOUBLE, {g!r}::DOUBLE, {b!r}::DOUBLE, {dof!r}::DOUBLE)"
                       for i, (a, g, b, dof) in enumerate(volatility.EGARCH_GRID))
    points += ", " + ", ".join(f"({i}, 'garch', {a!r}::DOUBLE, 0::DOUBLE, {b!r}::DOUBLE, 8::DOUBLE)"
                               for i, (a, b) in enumerate(volatility.GARCH_GRID))
    return ctes("rets", recursive=True) + f""",
gp AS (SELECT * FROM (VALUES {points}) v(no, kind, a, g, b, dof)),
gx AS (SELECT symbol, bar_idx-n_bars+500 AS t, log_ret-avg(log_ret) OVER (PARTITION BY symbol) AS x FROM rets WHERE n_bars>=500 AND bar_idx>=n_bars-500),
gv AS (SELECT symbol, avg(x*x) AS var FROM gx GROUP BY 1),
gr AS (SELECT symbol, no, kind, a, g, b, dof, CAST(0 AS BIGINT) AS t, CASE WHEN kind='egarch' THEN ln(var) ELSE var END AS h, CAST(0 AS DOUBLE) AS ll, var FROM gv, gp
       UNION ALL
       SELECT gr.symbol, no, kind, a, g, b, dof, gr.t+1,
              CASE WHEN kind='egarch' THEN (1-b)*ln(var)+a*(abs(x*exp(-0.5::DOUBLE*h))-{volatility.MEAN_ABS_Z!r})+g*x*exp(-0.5::DOUBLE*h)+b*h ELSE (1-a-b)*var+a*x*x+b*h END,
              ll+CASE WHEN kind='egarch' THEN 0.5::DOUBLE*h+0.5::DOUBLE*(dof+1)*ln(1+x*x*exp(-h)/(dof-2)) ELSE ln(h)+x*x/h END, var
       FROM gr JOIN gx ON gx.symbol=gr.symbol AND gx.t=gr.t),
ge AS (SELECT symbol, kind, no, CASE WHEN kind='egarch' THEN ll-500*(lgamma((dof+1)/2)-lgamma(dof/2)-0.5::DOUBLE*ln(pi()*(dof-2))) ELSE ll END AS loss,
              sqrt(CASE WHEN kind='egarch' THEN exp(h) ELSE h END) AS vol FROM gr WHERE t=500),
gb AS (SELECT * FROM ge QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY loss)=1)
SELECT symbol, {", ".join(f"max({r(c, 5)}) FILTER (WHERE kind='{k}') AS {k}_grid_{c}, true AS {k}_better_{c}" for k in ("egarch", "garch") for c in ("loss", "vol"))}
FROM gb GROUP BY 1""".replace(", true AS egarch_better_vol", "").replace(", true AS garch_better_vol", "").replace("_better_loss", "_never_worse")


@query("w7c_volatility_fits", _grid_sql())
def _(spark, sf):
    """Likelihood and forecast of the grid's best point for the newest window of each series, checked by recursion in SQL;
    the search around it must never be worse."""
    d = volatility.newest_fits(market.bars_d1(spark, sf))
    return d.select("symbol", *[r6(f"{k}_grid_{c}", 5).alias(f"{k}_grid_{c}") for k in ("egarch", "garch") for c in ("loss", "vol")],
                    *[(F.col(f"{k}_loss") <= F.col(f"{k}_grid_loss")).alias(f"{k}_never_worse") for k in ("egarch", "garch")])


@query("w7b_volatility_chain", ctes("vol") + f""",
p AS (SELECT symbol, bar_idx, vol, CASE WHEN bar_idx%3=0 THEN NULL WHEN bar_idx%3=1 THEN vol*20 ELSE vol*1.1 END AS a,
             CASE WHEN bar_idx%2=0 THEN vol/1e9 ELSE vol*0.9 END AS b FROM vol WHERE vol IS NOT NULL)
SELECT symbol, bar_idx, {r('coalesce(CASE WHEN a<=5 AND a>=1e-6 THEN a END, CASE WHEN b<=5 AND b>=1e-6 THEN b END, vol)')} AS v FROM p""")
def _(spark, sf):
    d = volatility.hist_vol(market.bars_d1(spark, sf)).filter("hist_vol is not null")
    v, i = F.col("hist_vol"), F.col("bar_idx")
    first = F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, v * 20).otherwise(v * 1.1)
    second = F.when(i % 2 == 0, v / 1e9).otherwise(v * 0.9)
    return d.select("symbol", "bar_idx", r6(volatility.choose(first, second, v)).alias("v"))


@query("w8_fractional_difference", ctes("bars", recursive=True) + f""",
w AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS v UNION ALL
      SELECT k+1, -v*(CAST(0.4 AS DOUBLE)-(k+1)+1)/(k+1) FROM w WHERE abs(-v*(CAST(0.4 AS DOUBLE)-(k+1)+1)/(k+1)) >= 1e-4),
n AS (SELECT max(k) AS width FROM w)
SELECT b.symbol, b.bar_idx, CASE WHEN b.bar_idx >= max(n.width) THEN {r('sum(w.v*p.close)')} END AS "close_FFD"
FROM bars b JOIN w ON true JOIN n ON true LEFT JOIN bars p ON p.symbol=b.symbol AND p.bar_idx=b.bar_idx-w.k GROUP BY 1,2""")
def _(spark, sf):
    d = fracdiff.frac_diff(market.bars_d1(spark, sf), 0.4)
    return d.select("symbol", "bar_idx", r6("close_FFD").alias("close_FFD"))


@query("w10_sma", ctes("bars") + f"""
SELECT symbol, bar_idx, CASE WHEN bar_idx>=199 THEN {r(f'avg(close) OVER ({S} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)')} END AS sma FROM bars""")
def _(spark, sf):
    return series.sma(market.bars_d1(spark, sf), 200).select("symbol", "bar_idx", r6("sma").alias("sma"))


_SMA = lambda n: f"CASE WHEN bar_idx>={n - 1} THEN {r(f'avg(close) OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')} END"


@query("w10b_sma_by_timeframe", ctes("bars") + " SELECT symbol, bar_idx, " + ", ".join(
    f"{_SMA(n)} AS sma_{tf.lower()}" for tf, n in backtest.SMA_BARS.items()) + " FROM bars")
def _(spark, sf):
    """The averages of all timeframes, over the same bars."""
    d = market.bars_d1(spark, sf)
    for tf, n in backtest.SMA_BARS.items():
        d = series.sma(d, n, out=f"sma_{tf.lower()}")
    return d.select("symbol", "bar_idx", *[r6(f"sma_{tf.lower()}").alias(f"sma_{tf.lower()}") for tf in backtest.SMA_BARS])


TREND_SQL = ctes("bars") + f""",
s AS (SELECT *, CASE WHEN bar_idx>=199 THEN avg(close) OVER ({S} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma,
             lead(close) OVER ({S})/close-1 AS nx FROM bars WHERE n_bars>=201),
t AS (SELECT symbol, time, bar_idx, CASE WHEN close>sma THEN nx ELSE 0 END AS ret FROM s WHERE nx IS NOT NULL)"""


def metrics_sql(src: str, key: str, pos: str = "bar_idx", time: str = "time", ret: str = "ret") -> str:
    """Series metrics of `functions` twins: total, CAGR, Sharpe, VaR, CVaR, MDD, STARR."""
    return f""",
q0 AS (SELECT *, exp(sum(ln(1+{ret})) OVER (PARTITION BY {key} ORDER BY {pos})) AS eq FROM {src}),
q1 AS (SELECT *, eq/max(eq) OVER (PARTITION BY {key} ORDER BY {pos})-1 AS dd FROM q0),
q2 AS (SELECT {key}, quantile_cont({ret}, CAST(0.05 AS DOUBLE)) AS var_95 FROM {src} GROUP BY 1),
q3 AS (SELECT q1.{key}, count(*) AS n, avg({ret}) AS m, stddev_pop({ret}) AS s, last(eq ORDER BY {pos})-1 AS total_ret, min(dd) AS mdd,
              date_diff('day', min({time}), max({time})) AS days, any_value(var_95) AS var_95,
              avg({ret}) FILTER (WHERE {ret}<=var_95+CAST(1e-12 AS DOUBLE)) AS cvar_95 FROM q1 JOIN q2 USING ({key}) GROUP BY 1),
q4 AS (SELECT *, CASE WHEN s>0 THEN m/s*sqrt(CAST(252 AS DOUBLE)) ELSE 0 END AS sharpe,
              CASE WHEN days<=0 THEN 0 WHEN total_ret<=-1 THEN -1 ELSE pow(1+total_ret, 1/(days/CAST(365.25 AS DOUBLE)))-1 END AS cagr FROM q3),
met AS (SELECT *, CASE WHEN abs(mdd)>0 THEN cagr/abs(mdd) ELSE 0 END AS starr FROM q4)"""


METRIC_COLS = ("total_ret", "cagr", "sharpe", "var_95", "cvar_95", "mdd", "starr")
METRIC_SQL = ", ".join(f"{r(c)} AS {c}" for c in METRIC_COLS)


def metric_cols():
    return [r6(c).alias(c) for c in METRIC_COLS]


@query("w11_trend_benchmark", TREND_SQL + metrics_sql("t", "symbol") + f" SELECT symbol, n, {METRIC_SQL} FROM met")
def _(spark, sf):
    from tidebar.operators.metrics import series_metrics
    d = series_metrics(backtest.trend_returns(market.bars_d1(spark, sf)), ["symbol"])
    return d.select("symbol", "n", *metric_cols())


@query("w12_cumulative_equity", ctes("rets") + f"""
SELECT symbol, bar_idx, {r(f'exp(sum(ln(1+ret)) OVER ({S}))')} AS equity FROM rets""")
def _(spark, sf):
    d = series.equity(series.simple_return(market.bars_d1(spark, sf)))
    return d.select("symbol", "bar_idx", r6("cum_ret").alias("equity"))


@query("w13_drawdown", ctes("rets") + f""",
e AS (SELECT symbol, bar_idx, exp(sum(ln(1+ret)) OVER ({S})) AS eq FROM rets),
k AS (SELECT *, max(eq) OVER ({S}) AS peak FROM e)
SELECT symbol, bar_idx, {r('peak')} AS peak, {r('eq/peak-1')} AS drawdown,
       {r('min(eq/peak-1) OVER (PARTITION BY symbol)')} AS mdd FROM k""")
def _(spark, sf):
    d = series.simple_return(market.bars_d1(spark, sf))
    mdd = series.path_summary(d).select("symbol", "mdd")
    return series.equity(d).join(mdd, "symbol").select(
        "symbol", "bar_idx", r6("peak").alias("peak"), r6("drawdown").alias("drawdown"), r6("mdd").alias("mdd"))


@query("w24_buy_and_hold", ctes("bars") + f""",
t AS (SELECT * FROM (SELECT symbol, time, bar_idx, close/lag(close) OVER ({S})-1 AS ret FROM bars) WHERE ret IS NOT NULL)"""
       + metrics_sql("t", "symbol") + f" SELECT symbol, n, {METRIC_SQL} FROM met")
def _(spark, sf):
    from tidebar.operators.metrics import series_metrics
    d = series_metrics(backtest.buy_and_hold(market.bars_d1(spark, sf)), ["symbol"])
    return d.select("symbol", "n", *metric_cols())


# --- screening ------------------------------------------------------------------------------------

HURST_SQL = ctes("bars") + """,
rb AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx)-1 AS i, least(n_bars, 1500) AS n
       FROM bars WHERE bar_idx >= greatest(n_bars-1500, 0)),
x AS (SELECT rb.*, k, CAST(floor(i/k) AS BIGINT) AS chunk FROM rb, (SELECT unnest(range(10, 100, 5)) AS k)
      WHERE n>=200 AND floor(i/k) < floor(n/k) AND floor(n/k)>=2),
y AS (SELECT *, close-avg(close) OVER (PARTITION BY symbol, k, chunk) AS d FROM x),
z AS (SELECT *, sum(d) OVER (PARTITION BY symbol, k, chunk ORDER BY i) AS z FROM y),
rs AS (SELECT symbol, k, chunk, max(z)-min(z) AS r, stddev_pop(close) AS s FROM z GROUP BY 1,2,3),
mk AS (SELECT symbol, k, avg(r/s) AS rs FROM rs WHERE s>0 GROUP BY 1,2),
sl AS (SELECT symbol, greatest(0, least(1, regr_slope(ln(rs), ln(k)))) AS h, count(*) AS c FROM mk GROUP BY 1),
hurst AS MATERIALIZED (SELECT symbol, CAST(CASE WHEN c>=2 THEN h ELSE 0.5 END AS DOUBLE) AS hurst
                       FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN sl USING (symbol))"""


@query("a4_hurst_exponent", HURST_SQL + f" SELECT symbol, {r('hurst')} AS hurst FROM hurst")
def _(spark, sf):
    return screen.hurst(screen.recent_bars(market.bars_d1(spark, sf))).select("symbol", r6("hurst").alias("hurst"))


@query("r3_top_by_hurst", HURST_SQL + f""" SELECT row_number() OVER (ORDER BY hurst DESC, symbol) AS rank, symbol, {r('hurst')} AS hurst FROM hurst""")
def _(spark, sf):
    from pyspark.sql import Window
    h = screen.hurst(screen.recent_bars(market.bars_d1(spark, sf)))
    w = Window.orderBy(F.desc("hurst"), "symbol")      # one row per symbol
    return h.select(F.row_number().over(w).cast("long").alias("rank"), "symbol", r6("hurst").alias("hurst"))


CORR_SQL = HURST_SQL + """,
rr AS (SELECT symbol, time, i, coalesce(close/lag(close) OVER (PARTITION BY symbol ORDER BY i)-1, 0) AS ret FROM rb),
ra AS (SELECT * FROM rr),
cm AS MATERIALIZED (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n_obs, corr(a.ret, b.ret) AS corr
       FROM ra a JOIN ra b ON a.time=b.time AND a.symbol<b.symbol GROUP BY 1,2)"""


def _arrays(spark, sf):
    recent = screen.recent_bars(market.bars_d1(spark, sf))
    return screen.aligned_returns(series.simple_return(recent))


@query("j9_pairwise_returns", CORR_SQL + f" SELECT a, b, n_obs, {r('corr')} AS corr FROM cm")
def _(spark, sf):
    return screen.correlation(_arrays(spark, sf)).select("a", "b", F.col("n_obs").cast("long").alias("n_obs"), r6("corr").alias("corr"))


@query("a5_abs_correlation", CORR_SQL + f""" SELECT a, b, {r('abs(corr)')} AS corr FROM cm
UNION ALL SELECT b, a, {r('abs(corr)')} FROM cm UNION ALL SELECT DISTINCT symbol, symbol, CAST(1 AS DOUBLE) FROM ra""")
def _(spark, sf):
    arrays = _arrays(spark, sf)
    c = screen.correlation(arrays).select("a", "b", r6(F.abs("corr")).alias("corr"))
    eye = arrays.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), F.lit(1.0).alias("corr"))
    return c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(eye)


GREEDY_SQL = """,
rk AS (SELECT symbol, hurst, row_number() OVER (ORDER BY {order}) AS rank FROM hurst {where}),
bad AS (SELECT a, b FROM cm WHERE abs(corr)>{limit} UNION ALL SELECT b, a FROM cm WHERE abs(corr)>{limit}),
g AS (SELECT CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS kept UNION ALL
      SELECT g.rank+1, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.a=rk.symbol AND list_contains(g.kept, bad.b)) THEN g.kept
                            ELSE list_append(g.kept, rk.symbol) END FROM g JOIN rk ON rk.rank=g.rank+1),
fin AS (SELECT unnest(kept) AS symbol, unnest(range(len(kept))) AS pos FROM (SELECT kept FROM g ORDER BY rank DESC LIMIT 1))
"""


@query("a6_greedy_decorrelation", CORR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + GREEDY_SQL.format(
    order="hurst DESC, symbol", where="", limit="0.02") + " SELECT CAST(pos AS BIGINT) AS pos, symbol FROM fin")
def _(spark, sf):
    from pyspark.sql import Window
    recent = screen.recent_bars(market.bars_d1(spark, sf))
    h = screen.hurst(recent)
    ranked = h.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hurst"), "symbol")))
    corr = screen.correlation(screen.aligned_returns(series.simple_return(recent)))
    d = screen.greedy_decorrelate(ranked, corr, 0.02)
    return d.select(F.col("pos").cast("long").alias("pos"), "symbol")


@query("a7_universe_screen", CORR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + GREEDY_SQL.format(
    order="symbol", where="WHERE hurst>=0.55", limit="0.80") + f""" SELECT CAST(pos AS BIGINT) AS pos, symbol, {r('hurst')} AS hurst
FROM fin JOIN hurst USING (symbol)""")
def _(spark, sf):
    d = screen.screen_universe(market.bars_d1(spark, sf))
    return d.select(F.col("pos").cast("long").alias("pos"), "symbol", r6("hurst").alias("hurst"))


# --- statistical kernels --------------------------------------------------------------------------

MELT_SQL = """,
ml_ AS (SELECT symbol, bar_idx, n_bars AS n, unnest([{cols}]) AS c FROM bars),
sl AS MATERIALIZED (SELECT symbol, c.k AS "column", n, list(c.v ORDER BY bar_idx) AS y FROM ml_ GROUP BY 1, 2, 3)"""


def melt_sql(cols: dict[str, str]) -> str:
    return MELT_SQL.format(cols=", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in cols.items()))


@query("a32_unit_root_screen", ctes("bars", recursive=True) + melt_sql({"close": "close", "open": "open", "close_diff": "close-open"})
       + regress_sql.adf("sl", ["symbol", '"column"'], "ur") + f"""
SELECT symbol, "column", n_obs, best_lag, {r('tau', 4)} AS tau, {r('p_value', 4)} AS p_value FROM ur""")
def _(spark, sf):
    b = market.bars_d1(spark, sf).withColumn("close_diff", F.col("close") - F.col("open"))
    d = fracdiff.adf(fracdiff.melt(b, ["close", "open", "close_diff"]))
    return d.select("symbol", "column", "n_obs", F.col("best_lag").cast("long").alias("best_lag"), r6("tau", 4).alias("tau"),
                    r6("p_value", 4).alias("p_value"))


FOUR = {c: c for c in ("close", "open", "high", "low")}
TRAIN_SQL = """,
st AS MATERIALIZED (SELECT symbol, "column", CAST(floor(n*0.8::DOUBLE) AS BIGINT) AS n, y[1:CAST(floor(n*0.8::DOUBLE) AS INTEGER)] AS y FROM sl)"""
ORDER_SQL = ctes("bars", recursive=True) + melt_sql(FOUR) + TRAIN_SQL + regress_sql.WEIGHTS + regress_sql.min_order(
    "st", ["symbol", '"column"'], "mo")


@query("a33_min_stationary_d", ORDER_SQL + f""" SELECT symbol, "column", CAST(d_no AS BIGINT) AS d_no, {r('d')} AS d, {r('corr')} AS corr FROM mo""")
def _(spark, sf):
    d = fracdiff.min_stationary_d(fracdiff.melt(market.bars_d1(spark, sf), list(FOUR)))
    return d.select("symbol", "column", F.col("d_no").cast("long").alias("d_no"), r6("d").alias("d"), r6("corr").alias("corr"))


@query("w9_apply_ffd", ORDER_SQL + regress_sql.adf("sl", ["symbol", '"column"'], "lv") + """,
ch AS (SELECT mo.symbol, mo."column", CASE WHEN lv.p_value<0.05::DOUBLE THEN 0 ELSE mo.d_no END AS d_no FROM mo JOIN lv USING (symbol, "column")),
ax AS (SELECT sl.symbol, sl."column", sl.n, sl.y, w, old FROM sl JOIN ch USING (symbol, "column") JOIN wl USING (d_no)),
fx AS (SELECT symbol, "column", unnest(range(CAST(w AS BIGINT)-1, n)) AS bar_idx,
       unnest(list_transform(range(1, n-w+2), lambda i: list_dot_product(y[CAST(i AS INTEGER):CAST(i+w-1 AS INTEGER)], old))) AS v FROM ax),
fp AS (SELECT symbol, bar_idx, """ + ", ".join(f"max(v) FILTER (WHERE \"column\"='{c}') AS {c}_x" for c in FOUR) + """ FROM fx GROUP BY 1, 2 HAVING count(*)=4)
SELECT symbol, bar_idx, """ + ", ".join(f"{r(c)} AS {c}" for c in FOUR) + ", " + ", ".join(f"{r(c + '_x')} AS \"{c}_FFD\"" for c in FOUR) + """
FROM fp JOIN bars USING (symbol, bar_idx)""")
def _(spark, sf):
    """Every price column at its own smallest stationary order."""
    b = market.bars_d1(spark, sf).select("symbol", "time", "bar_idx", "n_bars", *FOUR)
    d = fracdiff.apply_ffd(b, list(FOUR))
    return d.select("symbol", "bar_idx", *[r6(c).alias(c) for c in FOUR], *[r6(f"{c}_FFD").alias(f"{c}_FFD") for c in FOUR])


# Two least-squares passes: a regression on six lags gives innovations; the orders (1, 1) and (2, 1) regress on lags and the
# last innovation.  Columns are swept in the order constant, lag 1, innovation, lag 2, so both orders are on the way.
_LAGS = ", ".join(f"lag(log_ret, {i}) OVER (PARTITION BY symbol ORDER BY bar_idx) AS y{i}" for i in range(1, 7))
_COLS = lambda names: "[" + ", ".join(f"list(CAST({c} AS DOUBLE) ORDER BY bar_idx)" for c in names) + "]"
ARMA_SQL = ctes("rets", recursive=True) + f""",
h0 AS MATERIALIZED (SELECT symbol, bar_idx, log_ret AS y0, {_LAGS} FROM rets),
h1 AS (SELECT symbol, {_COLS(['1', *[f'y{i}' for i in range(1, 7)], 'y0'])} AS c FROM h0 WHERE y6 IS NOT NULL GROUP BY 1),
h2 AS (SELECT symbol, 0 AS p, {regress_sql.gram('c', '8')} AS g FROM h1 UNION ALL SELECT symbol, p+1, {regress_sql.sweep('g', '8', 'p')} FROM h2 WHERE p<7),
h3 AS MATERIALIZED (SELECT h0.*, y0-({'+'.join(f'coalesce(y{i}, NULL)*g[{8 * (i + 1)}]' for i in range(1, 7))}+g[8]) AS e0 FROM h0 JOIN h2 USING (symbol) WHERE p=7),
h4 AS MATERIALIZED (SELECT *, lag(e0) OVER (PARTITION BY symbol ORDER BY bar_idx) AS e1 FROM h3),
h5 AS (SELECT symbol, count(*) AS n, {_COLS(['1', 'y1', 'e1', 'y2', 'y0'])} AS c FROM h4 WHERE e1 IS NOT NULL AND y2 IS NOT NULL GROUP BY 1),
h6 AS (SELECT symbol, n, 0 AS p, {regress_sql.gram('c', '5')} AS g FROM h5 UNION ALL SELECT symbol, n, p+1, {regress_sql.sweep('g', '5', 'p')} FROM h6 WHERE p<4),
ar AS MATERIALIZED (SELECT symbol, CAST(p-2 AS INTEGER) AS p, 1 AS q, n, g[5] AS const, g[10] AS phi1, CASE WHEN p=4 THEN g[20] END AS phi2, g[15] AS theta1,
       n*(ln(2*pi()*g[25]/n)+1)+2*(p-2+1+2) AS aic FROM h6 WHERE p>=3)"""
ARMA_OUT = ", ".join(f"{r(c, 5)} AS {c}" for c in ("const", "phi1", "phi2", "theta1", "aic"))


def _arma_columns(d, *more):
    at = lambda c, i: F.get(c, F.lit(i))
    return d.select("symbol", "p", "q", *more, r6("const", 5).alias("const"), r6(at("phi", 0), 5).alias("phi1"), r6(at("phi", 1), 5).alias("phi2"),
                    r6(at("theta", 0), 5).alias("theta1"), r6("aic", 5).alias("aic"))


@query("a34_arma_order", ARMA_SQL + f" SELECT symbol, p, q, n, {ARMA_OUT} FROM ar")
def _(spark, sf):
    return _arma_columns(arma.fit_orders(series.log_return(market.bars_d1(spark, sf)), "log_ret"), "n")


@query("a34b_arma_best_order", ARMA_SQL + f" SELECT symbol, p, q, {ARMA_OUT} FROM ar QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY aic)=1")
def _(spark, sf):
    return _arma_columns(arma.best_order(arma.fit_orders(series.log_return(market.bars_d1(spark, sf)), "log_ret")))


@query("m11_direction_target", ctes("bars") + f"""
SELECT symbol, bar_idx, CASE WHEN round(close,8)>lag(round(close,8)) OVER ({S}) THEN 1 ELSE 0 END AS up FROM bars""")
def _(spark, sf):
    b = market.bars_d1(spark, sf).withColumn("close", F.round("close", 8))
    return arma.direction(b, "close").select("symbol", "bar_idx", "up")


@query("m12_arma_residuals", ctes("rets", recursive=True) + f""",
u AS MATERIALIZED (SELECT symbol, bar_idx, CASE WHEN bar_idx>=2 THEN log_ret-CAST(0.01 AS DOUBLE)-CAST(0.3 AS DOUBLE)*lag(log_ret,1) OVER ({S})
             -CAST(-0.1 AS DOUBLE)*lag(log_ret,2) OVER ({S}) ELSE 0 END AS u FROM rets),
e AS (SELECT symbol, bar_idx, u AS resid FROM u WHERE bar_idx=0 UNION ALL
      SELECT u.symbol, u.bar_idx, u.u-CAST(0.25 AS DOUBLE)*e.resid FROM e JOIN u ON u.symbol=e.symbol AND u.bar_idx=e.bar_idx+1)
SELECT symbol, bar_idx, {r('resid')} AS resid FROM e""")
def _(spark, sf):
    d = arma.one_step_residuals(series.log_return(market.bars_d1(spark, sf)), "log_ret", 0.01, (0.3, -0.1), 0.25)
    return d.select("symbol", "bar_idx", r6("resid").alias("resid"))
