"""Allocation over strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import ctes, query, r
from tidebar.catalog.series import metrics_sql
from tidebar.functions.expr import dbl, r6
from tidebar.operators import allocate, metrics, series
from tidebar.session import cut
from tidebar.sources import market


def strategies(spark, sf):
    """One strategy per symbol: daily returns on the common calendar, flat where it has no bar."""
    d = series.equity(series.simple_return(market.bars_d1(spark, sf)))
    curves = d.select(F.col("symbol").alias("strategy"), F.col("time").alias("date"), F.col("cum_ret").alias("equity"))
    a = allocate.align(curves).withColumn("_pos", series.day_number("date"))
    r_ = series.simple_return(a, "equity", keys=["strategy"], pos="_pos")
    return cut(allocate.numbered_returns(r_.select("date", "strategy", "equity", "ret")))


ALIGN_SQL = ctes("rets") + """,
cu AS (SELECT symbol AS strategy, time AS date, exp(sum(ln(1+ret)) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS eq FROM rets),
gd AS (SELECT d.date, s.strategy FROM (SELECT DISTINCT date FROM cu) d, (SELECT DISTINCT strategy FROM cu) s),
al AS MATERIALIZED (SELECT g.date, g.strategy, coalesce(last_value(eq IGNORE NULLS) OVER (PARTITION BY g.strategy ORDER BY g.date ROWS UNBOUNDED PRECEDING), 1) AS equity
       FROM gd g LEFT JOIN cu USING (date, strategy)),
dn AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n_days FROM (SELECT DISTINCT date FROM al)),
sr AS MATERIALIZED (SELECT al.*, coalesce(equity/lag(equity) OVER (PARTITION BY strategy ORDER BY date)-1, 0) AS ret, i, n_days FROM al JOIN dn USING (date)),
wi AS MATERIALIZED (SELECT s.*, w AS window_id FROM sr s, LATERAL (SELECT unnest(range(5, CAST(floor((n_days-1)/20) AS BIGINT)+1)) AS w)
       WHERE i >= w*20-100 AND i < w*20),
wa AS MATERIALIZED (SELECT window_id, strategy, avg(ret) AS m, stddev_samp(ret) AS s FROM wi GROUP BY 1,2 HAVING stddev_samp(ret)>0),
co AS MATERIALIZED (SELECT a.window_id, a.strategy AS a, b.strategy AS b, covar_samp(a.ret, b.ret) AS cov,
              CASE WHEN a.strategy=b.strategy THEN 1 ELSE corr(a.ret, b.ret) END AS corr
       FROM wi a JOIN wi b ON a.window_id=b.window_id AND a.i=b.i AND a.strategy<=b.strategy GROUP BY 1,2,3),
iv AS (SELECT window_id, a AS strategy, (1/cov)/sum(1/cov) OVER (PARTITION BY window_id) AS ivp FROM co WHERE a=b),
pf AS (SELECT *, f/sum(f) OVER (PARTITION BY window_id) AS perf, count(*) OVER (PARTITION BY window_id) AS nv
       FROM (SELECT *, greatest(0.05::DOUBLE, CASE WHEN s>0 THEN m/s*sqrt(252::DOUBLE) ELSE 0.1::DOUBLE END) AS f FROM wa)),
cl AS (SELECT window_id, strategy, ivp, perf, greatest(0.15::DOUBLE/nv, least(least(0.55::DOUBLE, 2.5::DOUBLE/nv), (1-0.85::DOUBLE)*ivp+0.85::DOUBLE*perf)) AS c
       FROM pf JOIN iv USING (window_id, strategy) WHERE nv>1),
wt AS MATERIALIZED (SELECT *, c/sum(c) OVER (PARTITION BY window_id) AS weight FROM cl),
pd_ AS (SELECT window_id, i, sum(weight*ret) AS h, avg(ret) AS e FROM wi JOIN wt USING (window_id, strategy) GROUP BY 1,2),
to_ AS MATERIALIZED (SELECT window_id, CASE WHEN stddev_samp(h)>0 THEN avg(h)/stddev_samp(h) ELSE 0 END AS sw, CASE WHEN stddev_samp(e)>0 THEN avg(e)/stddev_samp(e) ELSE 0 END AS se
       FROM pd_ GROUP BY 1)"""


def _risk(lo: str, hi: str) -> str:
    """Variance of the inverse-variance portfolio of the leaves lo..hi in order."""
    at = f"range({lo}, {hi} + 1)"
    return (f"(list_sum(list_transform({at}, lambda x: list_sum(list_transform({at}, lambda y: "
            f"cov[ord[x]][ord[y]] / (cov[ord[x]][ord[x]] * cov[ord[y]][ord[y]]))))) "
            f"/ power(list_sum(list_transform({at}, lambda z: 1 / cov[ord[z]][ord[z]])), 2))")


_MID = "(p.lo + (p.hi - p.lo + 1) // 2 - 1)"
_LEFT, _RIGHT = _risk("p.lo", _MID), _risk(f"({_MID} + 1)", "p.hi")
# hierarchical risk parity by recursion: merge the closest two clusters (single linkage; ties by number), then halve
# the order of leaves and share the weight by the risks of the halves
_HRP = f"""hx AS (SELECT window_id, strategy, row_number() OVER (PARTITION BY window_id ORDER BY strategy) AS k FROM wa),
hp AS (SELECT co.window_id, x.k AS i, y.k AS j, cov, corr FROM co JOIN hx x ON x.window_id=co.window_id AND x.strategy=a
       JOIN hx y ON y.window_id=co.window_id AND y.strategy=b),
hq AS (SELECT * FROM hp UNION ALL SELECT window_id, j, i, cov, corr FROM hp WHERE i<>j),
hm AS MATERIALIZED (SELECT window_id, count(*) AS n, list(dr ORDER BY i) AS dist, list(cr ORDER BY i) AS cov FROM (
       SELECT window_id, i, list(sqrt(greatest((1-corr)/2, 0)) ORDER BY j) AS dr, list(cov ORDER BY j) AS cr FROM hq GROUP BY 1,2) GROUP BY 1),
hl AS (SELECT window_id, n, dist, cov, list_transform(range(1, n+1), lambda k: {{'id': k, 'l': [k]}}) AS cl, n AS last FROM hm
       UNION ALL
       SELECT window_id, n, dist, cov, list_append(list_filter(cl, lambda c: c.id<>b.i AND c.id<>b.j), {{'id': last+1, 'l': list_concat(
              list_filter(cl, lambda c: c.id=b.i)[1].l, list_filter(cl, lambda c: c.id=b.j)[1].l)}}), last+1
       FROM (SELECT *, list_min(flatten(list_transform(cl, lambda p: list_transform(list_filter(cl, lambda q: q.id>p.id), lambda q: {{
              'gap': list_min(flatten(list_transform(p.l, lambda x: list_transform(q.l, lambda y: dist[x][y])))), 'i': p.id, 'j': q.id}})))) AS b
             FROM hl WHERE len(cl)>1)),
hb AS (SELECT window_id, cov, cl[1].l AS ord, [{{'lo': CAST(1 AS BIGINT), 'hi': CAST(n AS BIGINT), 'w': CAST(1 AS DOUBLE)}}] AS ps FROM hl WHERE len(cl)=1
       UNION ALL
       SELECT window_id, cov, ord, flatten(list_transform(ps, lambda p: CASE WHEN p.hi<=p.lo THEN [p] ELSE [
              {{'lo': p.lo, 'hi': CAST({_MID} AS BIGINT), 'w': p.w * (1 - {_LEFT} / ({_LEFT} + {_RIGHT}))}},
              {{'lo': CAST({_MID} + 1 AS BIGINT), 'hi': p.hi, 'w': p.w * ({_LEFT} / ({_LEFT} + {_RIGHT}))}}] END))
       FROM hb WHERE list_max(list_transform(ps, lambda p: p.hi - p.lo)) > 0),
hr AS MATERIALIZED (SELECT u.window_id, strategy, u.w AS hrp FROM (SELECT window_id, ord[p.lo] AS k, p.w AS w FROM (
       SELECT window_id, ord, unnest(ps) AS p FROM hb WHERE list_max(list_transform(ps, lambda p: p.hi - p.lo)) = 0)) u
       JOIN hx ON hx.window_id=u.window_id AND hx.k=u.k),
iv AS (SELECT window_id, strategy, hrp AS ivp FROM hr),
"""
_IVP = next(line for line in ALIGN_SQL.splitlines() if line.startswith("iv AS"))
HRP_SQL = ALIGN_SQL.replace(_IVP + "\n", _HRP).replace("WITH ", "WITH RECURSIVE ", 1)


@query("j5_align_equity", ALIGN_SQL + f" SELECT date, strategy, {r('equity')} AS equity FROM al")
def _(spark, sf):
    return strategies(spark, sf).select("date", "strategy", r6("equity").alias("equity"))


def _arrays(spark, sf):
    win = allocate.windows(strategies(spark, sf))
    return win, cut(allocate.window_arrays(win))


@query("a23_covariance_windows", ALIGN_SQL + f" SELECT window_id, a, b, {r('cov', 12)} AS cov, {r('corr')} AS corr FROM co")
def _(spark, sf):
    c = allocate.covariance(_arrays(spark, sf)[1])
    return c.select("window_id", "a", "b", r6("cov", 12).alias("cov"), r6("corr").alias("corr"))


@query("a24_inverse_variance", ALIGN_SQL + f" SELECT window_id, strategy, {r('ivp')} AS weight FROM iv")
def _(spark, sf):
    w = allocate.inverse_variance(_arrays(spark, sf)[1])
    return w.select("window_id", "strategy", r6("weight").alias("weight"))


@query("a25_correlation_distance", ALIGN_SQL + f" SELECT window_id, a, b, {r('sqrt(greatest((1-corr)/2, 0))')} AS dist FROM co")
def _(spark, sf):
    return allocate.covariance(_arrays(spark, sf)[1]).select("window_id", "a", "b", r6("dist").alias("dist"))


@query("a26_hrp_weights", HRP_SQL + f" SELECT window_id, strategy, {r('hrp')} AS hrp FROM hr")
def _(spark, sf):
    return allocate.hrp(_arrays(spark, sf)[1]).select("window_id", "strategy", r6("hrp").alias("hrp"))


@query("a27_shrunk_weights", HRP_SQL + f" SELECT window_id, strategy, {r('perf')} AS perf, {r('weight')} AS weight FROM wt")
def _(spark, sf):
    w, _ = allocate.rebalance(strategies(spark, sf))
    return w.select("window_id", "strategy", r6("perf").alias("perf"), r6("weight").alias("weight"))


@query("a28_allocation_tournament", HRP_SQL + f" SELECT window_id, {r('sw')} AS sharpe_weighted, {r('se')} AS sharpe_equal, sw>=se AS use_weighted FROM to_")
def _(spark, sf):
    _, t = allocate.rebalance(strategies(spark, sf))
    return t.select("window_id", r6("sharpe_weighted").alias("sharpe_weighted"), r6("sharpe_equal").alias("sharpe_equal"), "use_weighted")


HELD_SQL = HRP_SQL + """,
hd AS (SELECT s.*, coalesce(w.weight, CASE WHEN t.window_id IS NOT NULL THEN 0 END, 1/CAST(nn AS DOUBLE)) AS wm,
              CASE WHEN t.sw>=t.se THEN coalesce(w.weight, 0) ELSE 1/CAST(nn AS DOUBLE) END AS wc, nn
       FROM (SELECT *, CAST(floor(i/20) AS BIGINT) AS window_id FROM sr WHERE i>=100) s CROSS JOIN (SELECT count(DISTINCT strategy) AS nn FROM sr)
       LEFT JOIN to_ t USING (window_id) LEFT JOIN wt w USING (window_id, strategy)),
sm AS (SELECT symbol AS strategy, time AS date, CASE WHEN bar_idx>=199 THEN close>avg(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) ELSE true END AS up FROM bars),
sf AS (SELECT h.*, coalesce(lag(up2) OVER (PARTITION BY strategy ORDER BY date), true) AS on_ FROM
       (SELECT h.*, coalesce(last_value(s.up IGNORE NULLS) OVER (PARTITION BY h.strategy ORDER BY h.date ROWS UNBOUNDED PRECEDING), true) AS up2
        FROM hd h LEFT JOIN sm s USING (strategy, date)) h),
pr AS MATERIALIZED (SELECT date, i, 'HRP' AS portfolio, sum(wm*ret) AS ret FROM hd GROUP BY 1,2 UNION ALL SELECT date, i, 'TORNEO', sum(wc*ret) FROM hd GROUP BY 1,2
 UNION ALL SELECT date, i, 'EQUAL', sum(ret/nn) FROM hd GROUP BY 1,2 UNION ALL SELECT date, i, 'EQUAL_SMA', sum(CASE WHEN on_ THEN ret ELSE 0 END/nn) FROM sf GROUP BY 1,2)"""


def held(spark, sf, base="hrp"):
    """Strategies with the weights in force and a price-trend signal of the day before."""
    s = strategies(spark, sf).drop("equity")
    w, t = allocate.rebalance(s, base=base)
    h = allocate.hold_weights(s, w, t)
    b = series.sma(market.bars_d1(spark, sf), 200)
    up = b.select(F.col("symbol").alias("strategy"), F.col("time").alias("date"),
                  F.coalesce(F.col("close") > F.col("sma"), F.lit(True)).alias("up"))
    h = h.join(up, ["strategy", "date"], "left")
    h = series.fill(h, ["up"], keys=["strategy"], pos="i", backfill=False)
    h = h.withColumn("up", F.coalesce("up", F.lit(True)))
    h = series.in_blocks(h, lambda d, q: d.withColumn("trend_on", F.coalesce(F.lag("up").over(q()), F.lit(True))),
                         keys=["strategy"], back=1, pos="i")
    return h


@query("w21_rolling_allocation", HELD_SQL + f""" SELECT date, portfolio, {r('exp(sum(ln(1+ret)) OVER (PARTITION BY portfolio ORDER BY i))')} AS equity FROM pr""")
def _(spark, sf):
    p = allocate.portfolio_returns(held(spark, sf), "trend_on")
    d = series.equity(p, keys=["portfolio"], pos="i")
    return d.select("date", "portfolio", r6("cum_ret").alias("equity"))


@query("w21b_rolling_allocation_hrp", HELD_SQL + f""" SELECT date, portfolio, {r('exp(sum(ln(1+ret)) OVER (PARTITION BY portfolio ORDER BY i))')} AS cum_ret
FROM pr WHERE portfolio IN ('HRP', 'TORNEO')""")
def _(spark, sf):
    p = allocate.portfolio_returns(held(spark, sf)).filter(F.col("portfolio").isin("HRP", "TORNEO"))
    d = series.equity(p, keys=["portfolio"], pos="i")
    return d.select("date", "portfolio", r6("cum_ret").alias("cum_ret"))


X3_COLS = ("total_ret", "cagr", "sharpe", "starr", "mdd")
# Fixed value: the symbol that stands for the index in the comparison.
INDEX = "RF"


@query("x3_portfolio_comparison", HELD_SQL + f""",
ix AS (SELECT *, lag(close) OVER (ORDER BY bar_idx) AS pc, CASE WHEN bar_idx>=199 THEN avg(close) OVER (ORDER BY bar_idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma
       FROM bars WHERE symbol='{INDEX}'),
sp AS (SELECT DISTINCT date, i FROM pr),
ia AS (SELECT sp.date, sp.i, ix.close, ix.sma FROM sp ASOF LEFT JOIN ix ON sp.date>=ix.time),
ir AS (SELECT date, i, coalesce(close/lag(close) OVER (ORDER BY i)-1, 0) AS ret, lag(close>sma) OVER (ORDER BY i) AS on_ FROM ia),
pa AS (SELECT date, i, portfolio, ret FROM pr UNION ALL SELECT date, i, 'INDEX', ret FROM ir
       UNION ALL SELECT date, i, 'INDEX_SMA', CASE WHEN on_ THEN ret ELSE 0 END FROM ir)""" + metrics_sql("pa", "portfolio", "i", "date") + """
SELECT portfolio, """ + ", ".join(f"{r(c)} AS {c}" for c in X3_COLS) + " FROM met")
def _(spark, sf):
    from tidebar.sources.ingest import asof_backward
    p = cut(allocate.portfolio_returns(held(spark, sf), "trend_on"))
    index = series.sma(market.bars_d1(spark, sf).filter(F.col("symbol") == INDEX), 200).select("time", "close", "sma")
    days = p.select(F.col("date").alias("time"), "i").distinct()
    a = asof_backward(days, index, ["close", "sma"], backfill=False).withColumn("_all", F.lit(0))
    a = series.simple_return(a, keys=["_all"], pos="i")
    a = series.in_blocks(a.withColumn("_up", F.col("close") > F.col("sma")), lambda d, q: d.withColumn(
        "_on", F.lag("_up").over(q())), keys=["_all"], back=1, pos="i")
    hold = a.select(F.col("time").alias("date"), "i", F.lit("INDEX").alias("portfolio"), "ret")
    trend = a.select(F.col("time").alias("date"), "i", F.lit("INDEX_SMA").alias("portfolio"),
                     F.when(F.col("_on"), F.col("ret")).otherwise(dbl(0.0)).alias("ret"))
    m = metrics.series_metrics(p.unionByName(hold).unionByName(trend), ["portfolio"], time="date", pos="i")
    return m.select("portfolio", *[r6(c).alias(c) for c in X3_COLS])


@query("j11_active_weights", HRP_SQL + f""",
lw AS (SELECT strategy AS symbol, weight FROM wt WHERE window_id=(SELECT max(window_id) FROM wt)),
nw AS (SELECT max(time) AS newest FROM bars),
ac AS (SELECT symbol FROM bars GROUP BY 1 HAVING max(time) >= (SELECT newest FROM nw) - INTERVAL 180 DAY),
j AS (SELECT ac.symbol, coalesce(weight, 0) AS weight FROM ac LEFT JOIN lw USING (symbol))
SELECT symbol, {r('weight')} AS weight, {r('CASE WHEN sum(weight) OVER ()>0 THEN weight/sum(weight) OVER () ELSE 1/CAST(count(*) OVER () AS DOUBLE) END')} AS norm_weight FROM j""")
def _(spark, sf):
    w, _ = allocate.rebalance(strategies(spark, sf))
    newest = w.groupBy("strategy").agg(F.max_by("weight", "window_id").alias("weight"), F.max("window_id").alias("w"))
    top = w.agg(F.max("window_id").alias("w"))
    latest = newest.join(top, "w").select(F.col("strategy").alias("symbol"), "weight")
    seen = cut(market.bars_d1(spark, sf).groupBy("symbol").agg(F.max("time").alias("t")))       # one row per symbol
    newest = seen.agg(F.max("t").alias("newest")).first()["newest"]
    active = seen.filter(F.col("t") >= F.date_sub(F.lit(newest), 180)).select("symbol")          # traded in the last 180 days
    d = allocate.active_weights(active, latest)
    return d.select("symbol", r6("weight").alias("weight"), r6("norm_weight").alias("norm_weight"))
