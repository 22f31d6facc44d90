"""Signals, barriers, trades, tournament and audit."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidebar.catalog.base import ctes, query, r, sql_norm_cdf
from tidebar.catalog.series import METRIC_SQL, TREND_SQL, metric_cols, metrics_sql
from tidebar.functions import signals as rules
from tidebar.functions.expr import dbl, norm_cdf, norm_ppf, r6
from tidebar.operators import barriers, bootstrap, cv, metrics, series, trades, volatility
from tidebar.operators.champion import champions
from tidebar.plans import backtest
from tidebar.session import cut
from tidebar.sources import market

S = "PARTITION BY symbol ORDER BY bar_idx"
K = "symbol, model, bank, threshold"
N_TRIALS = 24


def bars_vol(spark, sf):
    """Bars with rolling volatility and parameters, written once: every step below starts from them."""
    b = volatility.hist_vol(market.bars_d1(spark, sf), out="EGARCH_Vol")
    return cut(market.with_params(b))


def probs_of(spark, sf, bars):
    return market.with_params(market.probs(spark, sf, bars)).filter("split = 'oos'").drop("k_up", "k_down", "cost")


def oos_probs(spark, sf):
    return probs_of(spark, sf, cut(market.bars_d1(spark, sf)))


def oos_bars(bars):
    return bars.filter(market.is_oos())


def trades_of(spark, sf, bars):
    """Trades of all strategies, written once."""
    return cut(backtest.run_trades(bars, probs_of(spark, sf, bars)))


def all_trades(spark, sf):
    return trades_of(spark, sf, bars_vol(spark, sf))


def scored_bars(spark, sf):
    """Bars joined with their scores."""
    b = bars_vol(spark, sf)
    return b.join(probs_of(spark, sf, b).select("symbol", "model", "bank", "bar_idx", "prob"), ["symbol", "bar_idx"])


PB = ctes("vol", "probs") + """,
pb AS (SELECT v.*, p.model, p.bank, p.prob FROM vol v JOIN probs p USING (symbol, bar_idx) WHERE p.split='oos' AND v.vol IS NOT NULL),
sg AS (SELECT *, CASE WHEN prob>0.6 THEN 1 WHEN bilateral AND prob<1-CAST(0.6 AS DOUBLE) THEN -1 ELSE 0 END AS side FROM pb)"""
TP = "CASE WHEN side>=0 THEN close*(1+k_up*(vol/100)) ELSE close*(1-k_up*(vol/100)) END"
SL = "CASE WHEN side>=0 THEN close*(1-k_down*(vol/100)) ELSE close*(1+k_down*(vol/100)) END"
DELTA = "greatest(0, CASE WHEN prob>0.5 THEN prob-CAST(0.6 AS DOUBLE) ELSE (1-CAST(0.6 AS DOUBLE))-prob END)"
KELLY = f"CASE WHEN {DELTA}<=0.05 THEN 0.5::DOUBLE WHEN {DELTA}<=0.15 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"


def signal_rows(spark, sf):
    d = scored_bars(spark, sf).filter("EGARCH_Vol is not null")
    d = d.withColumn("side", rules.side(F.col("prob"), dbl(0.6), F.col("bilateral")))
    p, v = F.col("close"), F.col("EGARCH_Vol")
    return d.withColumns({"tp": rules.take_profit(p, v, F.col("k_up"), F.col("side")),
                          "sl": rules.stop_loss(p, v, F.col("k_down"), F.col("side")),
                          "kelly": rules.kelly(F.col("prob"), dbl(0.6))})


@query("p9_signal", PB + " SELECT symbol, model, bank, bar_idx, side FROM sg")
def _(spark, sf):
    return signal_rows(spark, sf).select("symbol", "model", "bank", "bar_idx", "side")


@query("p10_barrier_levels", PB + f" SELECT symbol, model, bank, bar_idx, side, {r(TP)} AS tp, {r(SL)} AS sl FROM sg")
def _(spark, sf):
    return signal_rows(spark, sf).select("symbol", "model", "bank", "bar_idx", "side", r6("tp").alias("tp"), r6("sl").alias("sl"))


@query("p11_kelly_tier", PB + f" SELECT symbol, model, bank, bar_idx, {KELLY} AS kelly FROM sg")
def _(spark, sf):
    return signal_rows(spark, sf).select("symbol", "model", "bank", "bar_idx", "kelly")


@query("p12_position_size", PB + f""",
z AS (SELECT *, {SL} AS sl, {KELLY} AS kelly FROM sg),
l AS (SELECT *, abs(close-sl)/0.00001::DOUBLE*1.0::DOUBLE AS per_lot FROM z),
t AS (SELECT *, CASE WHEN close=sl OR per_lot<=0 THEN 0 ELSE round(floor(10000::DOUBLE*(0.025::DOUBLE*kelly)/per_lot/0.0001::DOUBLE)*0.0001::DOUBLE, 4) END AS lots FROM l)
SELECT symbol, model, bank, bar_idx, {r('lots', 4)} AS lots FROM t WHERE lots >= 0.0001""")
def _(spark, sf):
    d = signal_rows(spark, sf).withColumn("lots", rules.position_size(
        dbl(10000), F.col("close"), F.col("sl"), dbl(0.00001), dbl(1.0), 0.0001, dbl(0.025) * F.col("kelly")))
    return d.filter("lots >= 0.0001").select("symbol", "model", "bank", "bar_idx", r6("lots", 4).alias("lots"))


@query("p13_capped_notional", PB + f""",
z AS (SELECT *, {SL} AS sl, {TP} AS tp, {KELLY} AS kelly FROM sg),
n AS (SELECT *, CASE WHEN close<>sl THEN 2000::DOUBLE*(0.025::DOUBLE*kelly)/(abs(close-sl)/close) ELSE 0 END AS raw FROM z)
SELECT symbol, model, bank, bar_idx, {r('least(raw, 6000)', 4)} AS notional, raw>6000 AS capped,
       {r('abs(close-sl)*10000', 4)} AS sl_pips, {r('abs(tp-close)*10000', 4)} AS tp_pips FROM n""")
def _(spark, sf):
    d = signal_rows(spark, sf)
    notional, capped = rules.capped_notional(2000 * (dbl(0.025) * F.col("kelly")), F.col("close"), F.col("sl"), 6000.0)
    return d.select("symbol", "model", "bank", "bar_idx", r6(notional, 4).alias("notional"), capped.alias("capped"),
                    r6(F.abs(F.col("close") - F.col("sl")) * 10000, 4).alias("sl_pips"),
                    r6(F.abs(F.col("tp") - F.col("close")) * 10000, 4).alias("tp_pips"))


@query("j6_probs_join_bars", PB + f" SELECT symbol, model, bank, bar_idx, {r('close')} AS close, prob FROM pb")
def _(spark, sf):
    d = scored_bars(spark, sf).filter("EGARCH_Vol is not null")
    return d.select("symbol", "model", "bank", "bar_idx", r6("close").alias("close"), "prob")


@query("j7_forward_range_join", ctes("bars") + f"""
SELECT a.symbol, a.bar_idx, count(b.bar_idx) AS n_ahead, {r('max(b.high)')} AS max_high, {r('min(b.low)')} AS min_low
FROM bars a LEFT JOIN bars b ON b.symbol=a.symbol AND b.bar_idx BETWEEN a.bar_idx+1 AND a.bar_idx+10 GROUP BY 1, 2""")
def _(spark, sf):
    d = series.in_blocks(market.bars_d1(spark, sf), lambda b, w: b.withColumns({
        "n_ahead": F.count("high").over(w(1, 10)), "max_high": F.max("high").over(w(1, 10)),
        "min_low": F.min("low").over(w(1, 10))}), ahead=10)
    return d.select("symbol", "bar_idx", "n_ahead", r6("max_high").alias("max_high"), r6("min_low").alias("min_low"))


@query("j8_strategy_grid", ctes("probs") + """
SELECT symbol, model, bank, t AS threshold, count(*) AS n_rows, count(*) FILTER (WHERE prob>t) AS n_long
FROM probs, (SELECT CAST(unnest([0.50,0.55,0.60,0.65,0.70,0.75]) AS DOUBLE) AS t) WHERE split='oos' GROUP BY 1,2,3,4""")
def _(spark, sf):
    grid = F.array(*[dbl(t) for t in trades.THRESHOLDS])
    d = oos_probs(spark, sf).withColumn("threshold", F.explode(grid))
    return d.groupBy("symbol", "model", "bank", "threshold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prob") > F.col("threshold")).alias("n_long"))


LABEL_SQL = ctes("vol") + """,
e AS (SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY bar_idx) AS entry FROM vol WHERE vol IS NOT NULL),
l AS (SELECT *, entry*(1+k_up*(vol/100)) AS tp, entry*(1-k_down*(vol/100)) AS sl FROM e WHERE bar_idx < n_bars-11),
t AS (SELECT l.symbol, l.bar_idx, min(b.bar_idx-l.bar_idx) FILTER (WHERE b.high>=l.tp) AS jt,
             min(b.bar_idx-l.bar_idx) FILTER (WHERE b.low<=l.sl) AS js
      FROM l JOIN bars b ON b.symbol=l.symbol AND b.bar_idx BETWEEN l.bar_idx+1 AND l.bar_idx+10 GROUP BY 1,2),
lab AS MATERIALIZED (SELECT l.*, CASE WHEN jt<js OR (jt IS NOT NULL AND js IS NULL) THEN 1 ELSE 0 END AS "Label",
        CASE WHEN jt<js OR (jt IS NOT NULL AND js IS NULL) THEN 'TP' WHEN js IS NOT NULL THEN 'SL' ELSE 'TIME' END AS exit_kind
        FROM l JOIN t USING (symbol, bar_idx))"""


def labelled(spark, sf):
    return barriers.label(bars_vol(spark, sf)).filter("EGARCH_Vol is not null")


@query("w14_triple_barrier_label", LABEL_SQL + ' SELECT symbol, bar_idx, "Label", exit_kind FROM lab')
def _(spark, sf):
    return labelled(spark, sf).select("symbol", "bar_idx", "Label", "exit_kind")


@query("a20_label_distribution", LABEL_SQL + f""" SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE exit_kind='TP') AS tp_hits,
count(*) FILTER (WHERE exit_kind='SL') AS sl_hits, count(*) FILTER (WHERE exit_kind='TIME') AS time_exits,
{r("count(*) FILTER (WHERE exit_kind='TP')/CAST(count(*) AS DOUBLE)")} AS hit_ratio FROM lab GROUP BY 1""")
def _(spark, sf):
    d = barriers.label_distribution(labelled(spark, sf))
    return d.withColumn("hit_ratio", r6("hit_ratio"))


@query("w15_barrier_outcomes", ctes("outc") + f"""
SELECT symbol, bar_idx, side, exit_kind, duration, exit_idx, {r('tp')} AS tp, {r('sl')} AS sl, {r('raw_ret')} AS raw_ret, {r('ret')} AS ret FROM outc""")
def _(spark, sf):
    return barriers.outcomes(bars_vol(spark, sf)).select("symbol", "bar_idx", "side", "exit_kind", "duration", "exit_idx",
                                      *[r6(c).alias(c) for c in ("tp", "sl", "raw_ret", "ret")])


TRADES = ctes("trades")


@query("w16_non_overlapping_trades", TRADES + f"""
SELECT {K}, entry_idx, exit_idx, side, exit_kind, duration, prob, {r('ret')} AS ret, {r('cum_ret')} AS cum_ret, is_dead FROM trades""")
def _(spark, sf):
    return all_trades(spark, sf).select(*trades.STRATEGY, "entry_idx", "exit_idx", "side", "exit_kind", "duration", "prob",
                                        r6("ret").alias("ret"), r6("cum_ret").alias("cum_ret"), "is_dead")


COOL_SQL = ctes("cands", recursive=True) + f""",
nx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY bar_idx) AS rn FROM cands),
st AS (SELECT {K}, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS free, CAST([] AS DOUBLE[]) AS win, CAST([] AS BOOLEAN[]) AS bad,
              CAST(NULL AS BIGINT) AS entry_idx, CAST(NULL AS BIGINT) AS exit_idx, CAST(NULL AS DOUBLE) AS ret FROM (SELECT DISTINCT {K} FROM cands)
       UNION ALL
       SELECT symbol, model, bank, threshold, rn,
              CASE WHEN NOT take THEN free WHEN stop THEN exit_idx+60 ELSE exit_idx END,
              CASE WHEN NOT take THEN win WHEN stop THEN CAST([] AS DOUBLE[]) ELSE nw END,
              CASE WHEN NOT take THEN bad WHEN stop THEN CAST([] AS BOOLEAN[]) ELSE nb END,
              CASE WHEN take THEN bar_idx END, CASE WHEN take THEN exit_idx END, CASE WHEN take THEN ret END
       FROM (SELECT *, take AND list_contains(nb, true) AND list_sum(nw) < -0.03 AS stop FROM (
             SELECT s.symbol, s.model, s.bank, s.threshold, n.rn, s.free, s.win, s.bad, n.bar_idx, n.exit_idx, n.ret, n.bar_idx>=s.free AS take,
                    list_append(s.win, n.ret)[greatest(1, len(s.win)-8):] AS nw,
                    list_append(s.bad, n.exit_kind='SL' AND n.duration<=2)[greatest(1, len(s.bad)-8):] AS nb
             FROM st s JOIN nx n ON n.symbol=s.symbol AND n.model=s.model AND n.bank=s.bank AND n.threshold=s.threshold AND n.rn=s.rn+1) x) y)
SELECT {K}, entry_idx, exit_idx, {r('ret')} AS ret FROM st WHERE entry_idx IS NOT NULL"""


@query("w16b_trades_with_cooldown", COOL_SQL)
def _(spark, sf):
    b = bars_vol(spark, sf)
    c = trades.candidates(trades.signals(probs_of(spark, sf, b)), barriers.outcomes(b))
    c = c.withColumn("anomalous", (F.col("exit_kind") == "SL") & (F.col("duration") <= 2))
    c = c.select(*trades.STRATEGY, "bar_idx", "exit_idx", "ret", "anomalous")
    return trades.with_cooldown(c).select(*trades.STRATEGY, "entry_idx", "exit_idx", r6("ret").alias("ret"))


@query("w19_metric_window", TRADES + f""",
w AS (SELECT {K}, trade_no, sum(ret) OVER v AS s, sum(duration) OVER v AS d, count(*) FILTER (WHERE ret>0) OVER v AS k, count(*) OVER v AS c
      FROM trades WINDOW v AS (PARTITION BY {K} ORDER BY trade_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT {K}, trade_no, {r('s')} AS sum_ret, CAST(d AS DOUBLE) AS sum_duration, CAST(k AS DOUBLE) AS wins, CAST(10-c AS INTEGER) AS n_pad, CAST(10 AS INTEGER) AS size FROM w""")
def _(spark, sf):
    t = backtest.numbered_trades(all_trades(spark, sf))
    d = trades.metric_window(t)
    add = lambda i: F.aggregate("window", dbl(0.0), lambda s, x: s + x[i])
    return d.select(*trades.STRATEGY, "trade_no", r6(add(0)).alias("sum_ret"), add(1).alias("sum_duration"), add(2).alias("wins"),
                    F.size(F.filter("window", lambda x: x[1] == 0)).alias("n_pad"), F.size("window").alias("size"))


# --- metrics ------------------------------------------------------------------------------------------

def _max_sharpe() -> str:
    return repr(metrics.expected_max_sharpe(N_TRIALS))


MET_SQL = TRADES + f""",
v0 AS (SELECT {K}, quantile_cont(ret, CAST(0.05 AS DOUBLE)) AS var_95 FROM trades GROUP BY ALL),
g0 AS (SELECT {K}, cum_ret/max(cum_ret) OVER (PARTITION BY {K} ORDER BY exit_idx)-1 AS dd, exit_idx FROM trades),
g1 AS (SELECT {K}, min(dd) AS mdd FROM g0 GROUP BY ALL),
mo AS (SELECT {K}, count(*) AS n, avg(ret) AS mean_ret, stddev_pop(ret) AS std_ret, any_value(var_95) AS var_95,
              avg(ret) FILTER (WHERE ret<=var_95+CAST(1e-12 AS DOUBLE)) AS cvar_95, avg(CASE WHEN ret>0 THEN 1 ELSE 0 END) AS win_rate,
              avg(duration) AS avg_duration, last(cum_ret ORDER BY exit_idx)-1 AS total_ret, max(exit_idx) AS last_exit, bool_or(is_dead) AS is_dead
       FROM trades JOIN v0 USING ({K}) GROUP BY ALL),
cm AS (SELECT {K}, avg(pow(t.ret-m.mean_ret,3)) AS m3, avg(pow(t.ret-m.mean_ret,4)) AS m4 FROM trades t JOIN mo m USING ({K}) GROUP BY ALL),
m1 AS (SELECT mo.*, CASE WHEN n<2 THEN 0 ELSE g1.mdd END AS mdd, CASE WHEN std_ret>0 THEN mean_ret/std_ret ELSE 0 END AS sr_raw,
              CASE WHEN n<2 OR std_ret=0 THEN 0 ELSE m3/pow(std_ret,3) END AS skew, CASE WHEN n<2 OR std_ret=0 THEN 0 ELSE m4/pow(std_ret,4)-3 END AS kurt
       FROM mo JOIN cm USING ({K}) JOIN g1 USING ({K})),
m2 AS (SELECT *, sr_raw*sqrt(CAST(252 AS DOUBLE)) AS sharpe, CASE WHEN abs(cvar_95)>0 THEN mean_ret/abs(cvar_95) ELSE 0 END AS starr,
              sr_raw/sqrt(greatest(CAST(1e-9 AS DOUBLE), (1+CAST(0.5 AS DOUBLE)*sr_raw*sr_raw-skew*sr_raw+kurt/4*(sr_raw*sr_raw))/(n-1))) AS zp FROM m1),
m3 AS (SELECT *, (1-skew*sharpe+(kurt-1)/4*(sharpe*sharpe))/(n-1) AS vd FROM m2),
m4 AS (SELECT *, CASE WHEN vd>0 THEN (sharpe-CAST({_max_sharpe()} AS DOUBLE))/sqrt(vd) ELSE 0 END AS zd FROM m3),
tm AS MATERIALIZED (SELECT *, CASE WHEN n<2 THEN 0 ELSE {sql_norm_cdf('zp')} END AS psr,
              CASE WHEN n<5 OR sharpe=0 OR vd<=0 THEN 0 ELSE {sql_norm_cdf('zd')} END AS dsr FROM m4)"""


def _tm(spark, sf):
    return metrics.trade_metrics(all_trades(spark, sf), trades.STRATEGY, N_TRIALS)


def _metric_query(name, cols, digits=6):
    @query(name, MET_SQL + f" SELECT {K}, " + ", ".join(f"{r(c, digits)} AS {c}" for c in cols) + " FROM tm")
    def _(spark, sf):
        return _tm(spark, sf).select(*trades.STRATEGY, *[r6(c, digits).alias(c) for c in cols])


_metric_query("a8_sharpe", ("sr_raw", "sharpe"))
_metric_query("a9_var_cvar", ("var_95", "cvar_95"))
_metric_query("a10_starr", ("starr",))
_metric_query("a11_skew_kurtosis", ("skew", "kurt"))
_metric_query("a12_probabilistic_sharpe", ("psr",))
_metric_query("a13_deflated_sharpe", ("dsr",))

EVAL_SQL = MET_SQL + f""",
mk AS (SELECT symbol, first(close ORDER BY bar_idx) AS c0, last(close ORDER BY bar_idx) AS c1, date_diff('day', min(time), max(time)) AS days
       FROM bars WHERE bar_idx*5>=n_bars*4 GROUP BY 1),
e0 AS (SELECT tm.*, mk.c0, mk.c1, mk.days, b.close AS cx FROM tm JOIN mk USING (symbol) JOIN bars b ON b.symbol=tm.symbol AND b.bar_idx=tm.last_exit),
e1 AS (SELECT *, c1/c0-1 AS market_ret, total_ret-(CASE WHEN is_dead THEN cx ELSE c1 END/c0-1) AS alpha FROM e0),
ev AS MATERIALIZED (SELECT *, CASE WHEN days<=0 THEN 0 WHEN total_ret<=-1 THEN -1 ELSE pow(1+total_ret, 1/(days/CAST(365.25 AS DOUBLE)))-1 END AS cagr,
              CASE WHEN days<=0 THEN 0 ELSE pow(1+market_ret, 1/(days/CAST(365.25 AS DOUBLE)))-1 END AS market_cagr FROM e1)"""


def evaluated(spark, sf):
    b = bars_vol(spark, sf)
    return backtest.evaluate(trades_of(spark, sf, b), oos_bars(b), N_TRIALS)


@query("a15_cagr", EVAL_SQL + f" SELECT {K}, {r('total_ret')} AS total_ret, {r('cagr')} AS cagr, {r('market_cagr')} AS market_cagr FROM ev")
def _(spark, sf):
    return evaluated(spark, sf).select(*trades.STRATEGY, *[r6(c).alias(c) for c in ("total_ret", "cagr", "market_cagr")])


@query("a16_alpha_win_rate", EVAL_SQL + f""" SELECT {K}, n, {r('market_ret')} AS market_ret, {r('alpha')} AS alpha,
{r('win_rate')} AS win_rate, {r('avg_duration')} AS avg_duration FROM ev""")
def _(spark, sf):
    return evaluated(spark, sf).select(*trades.STRATEGY, "n", *[r6(c).alias(c) for c in ("market_ret", "alpha", "win_rate", "avg_duration")])


TOURNAMENT = ("n", "is_dead", "total_ret", "alpha", "cagr", "sharpe", "var_95", "cvar_95", "starr", "psr", "dsr", "mdd", "win_rate", "avg_duration")


@query("w17_threshold_tournament", EVAL_SQL + f" SELECT {K}, " + ", ".join(
    c if c in ("n", "is_dead") else f"{r(c)} AS {c}" for c in TOURNAMENT) + " FROM ev")
def _(spark, sf):
    return evaluated(spark, sf).select(*trades.STRATEGY, *[F.col(c) if c in ("n", "is_dead") else r6(c).alias(c) for c in TOURNAMENT])


def champion_sql(src: str, part: str, order: str, out: str, alive: str = "") -> str:
    return f""",
{out}0 AS (SELECT *, CASE WHEN NOT is_dead AND n>=25 AND mdd>-0.20 THEN 2 WHEN NOT is_dead THEN 1 ELSE 0 END AS g_ FROM {src}),
{out}1 AS (SELECT *, max(g_) OVER (PARTITION BY {part}) AS best_ FROM {out}0),
{out}2 AS (SELECT *, 0.5::DOUBLE*CASE WHEN max(alpha) OVER w>min(alpha) OVER w THEN (alpha-min(alpha) OVER w)/(max(alpha) OVER w-min(alpha) OVER w) ELSE 1 END
  + 0.3::DOUBLE*CASE WHEN max(cagr) OVER w>min(cagr) OVER w THEN (cagr-min(cagr) OVER w)/(max(cagr) OVER w-min(cagr) OVER w) ELSE 1 END
  + 0.2::DOUBLE*CASE WHEN max(sharpe) OVER w>min(sharpe) OVER w THEN (sharpe-min(sharpe) OVER w)/(max(sharpe) OVER w-min(sharpe) OVER w) ELSE 1 END AS score
  FROM {out}1 WHERE g_=best_ {alive} WINDOW w AS (PARTITION BY {part})),
{out} AS MATERIALIZED (SELECT * EXCLUDE (g_, best_) FROM {out}2 QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY round(score, 9) DESC, {order})=1)"""


CHAMP_SQL = EVAL_SQL + champion_sql("ev", "symbol, model", "bank, threshold", "pm")
FINAL_SQL = CHAMP_SQL + champion_sql("(SELECT * EXCLUDE (score) FROM pm)", "symbol", "model", "fc", "AND g_>0")


@query("r2_champion_per_model", CHAMP_SQL + f" SELECT {K}, n, {r('alpha')} AS alpha, {r('score')} AS score FROM pm")
def _(spark, sf):
    d, _ = backtest.pick_champions(cut(evaluated(spark, sf)))
    return d.select(*trades.STRATEGY, "n", r6("alpha").alias("alpha"), r6("score").alias("score"))


@query("r2b_champion_per_symbol", FINAL_SQL + f" SELECT {K}, n, {r('alpha')} AS alpha, {r('score')} AS score FROM fc")
def _(spark, sf):
    _, d = backtest.pick_champions(cut(evaluated(spark, sf)))
    return d.select(*trades.STRATEGY, "n", r6("alpha").alias("alpha"), r6("score").alias("score"))


@query("j13_exit_time", TRADES + f" SELECT {K}, t.entry_idx, b.time AS exit_time FROM trades t JOIN bars b USING (symbol) WHERE b.bar_idx=t.exit_idx")
def _(spark, sf):
    at = market.bars_d1(spark, sf).select("symbol", F.col("bar_idx").alias("exit_idx"), F.col("time").alias("exit_time"))
    return all_trades(spark, sf).join(at, ["symbol", "exit_idx"]).select(*trades.STRATEGY, "entry_idx", "exit_time")


X_COLS = ("alpha", "cagr", "win_rate", "avg_duration", "sharpe", "starr", "mdd", "cvar_95")
X1_SQL = CHAMP_SQL + f""",
ob AS (SELECT * FROM bars WHERE bar_idx*5>=n_bars*4),
oi AS (SELECT symbol, time, bar_idx, close, count(*) OVER (PARTITION BY symbol) AS nb, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx)-1 AS k FROM ob),
t AS (SELECT * FROM (SELECT symbol, time, bar_idx, close/lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx)-1 AS ret FROM oi) WHERE ret IS NOT NULL)""" + \
    metrics_sql("t", "symbol") + f""",
bh AS (SELECT symbol, 'BUY_HOLD' AS name, cagr, sharpe, mdd, cvar_95 FROM met),
s AS (SELECT *, CASE WHEN k>=199 THEN avg(close) OVER ({S} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma, lead(close) OVER ({S})/close-1 AS nx FROM oi WHERE nb>=201),
t2 AS (SELECT symbol, time, bar_idx, CASE WHEN close>sma THEN nx ELSE 0 END AS ret FROM s WHERE nx IS NOT NULL)""" + \
    metrics_sql("t2", "symbol").replace("q0", "z0").replace("q1", "z1").replace("q2", "z2").replace("q3", "z3").replace("q4", "z4").replace("met AS", "met2 AS") + f""",
allr AS (SELECT symbol, model AS name, bank, threshold, is_dead, alpha, cagr, n, win_rate, avg_duration, sharpe, starr, mdd, cvar_95 FROM pm
 UNION ALL SELECT DISTINCT symbol, 'RISK_FREE', NULL, NULL, NULL, NULL, CAST(0.05 AS DOUBLE), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM bars
 UNION ALL SELECT symbol, name, NULL, NULL, NULL, NULL, cagr, NULL, NULL, NULL, sharpe, NULL, mdd, cvar_95 FROM bh
 UNION ALL SELECT symbol, 'SMA_200', NULL, NULL, NULL, NULL, cagr, NULL, NULL, NULL, sharpe, NULL, mdd, cvar_95 FROM met2)
SELECT symbol, name, bank, threshold, is_dead, n, """ + ", ".join(f"{r(c)} AS {c}" for c in X_COLS) + " FROM allr"


@query("x1_tournament_report", X1_SQL)
def _(spark, sf):
    b = bars_vol(spark, sf)
    ev = cut(backtest.evaluate(trades_of(spark, sf, b), oos_bars(b), N_TRIALS))
    d = backtest.tournament_report(ev, cut(series.with_bar_idx(oos_bars(b))))
    return d.select("symbol", "name", "bank", "threshold", "is_dead", "n", *[r6(c).alias(c) for c in X_COLS])


@query("x2_equity_points", TRADES + f""",
p AS (SELECT {K}, b.time AS date, t.cum_ret AS equity FROM trades t JOIN bars b USING (symbol) WHERE b.bar_idx=t.exit_idx)
SELECT {K}, date, {r('equity')} AS equity FROM p UNION ALL SELECT {K}, CAST(min(date)-1 AS DATE), CAST(1 AS DOUBLE) FROM p GROUP BY ALL""")
def _(spark, sf):
    d = backtest.equity_points(all_trades(spark, sf), market.bars_d1(spark, sf))
    return d.withColumn("equity", r6("equity"))


# --- bootstrap, leverage, audit -------------------------------------------------------------------------

P = bootstrap.PRIME
SIMS = 1000


def draw_sql(sim, pos, n):
    h1 = f"(({sim}*1000003+{pos}*10007+12345)%{P})"
    h2 = f"(({h1}*{h1})%{P})"
    h3 = f"(({h2}*48271+11)%{P})"
    return f"((({h3}*{h3})%{P})%{n})"


ONE = "model='XGBOOST' AND bank='Tecnicos' AND threshold=CAST(0.6 AS DOUBLE)"


def boot_sql(src: str, spec: str, extra: str = "") -> str:
    """Drawdown quantile of simulated paths; `spec` has the keys, `extra` and n."""
    e = f", {extra}" if extra else ""
    return f""",
dr AS (SELECT s.symbol, s.model, s.bank, s.threshold{', s.' + extra if extra else ''}, s.n, sim, pos, {draw_sql('CAST(sim AS BIGINT)', 'CAST(pos AS BIGINT)', 's.n')} AS k
       FROM {spec} s, (SELECT unnest(range({SIMS})) AS sim), LATERAL (SELECT unnest(range(s.n)) AS pos)),
pa AS (SELECT d.*, t.ret FROM dr d JOIN {src} t ON t.symbol=d.symbol AND t.model=d.model AND t.bank=d.bank AND t.threshold=d.threshold AND t.trade_no=d.k),
pe AS (SELECT {K}{e}, sim, pos, exp(sum(ln(1+ret)) OVER (PARTITION BY {K}{e}, sim ORDER BY pos)) AS v FROM pa),
pd AS (SELECT {K}{e}, sim, v/max(v) OVER (PARTITION BY {K}{e}, sim ORDER BY pos)-1 AS dd FROM pe),
pm_ AS (SELECT {K}{e}, sim, min(dd) AS mdd FROM pd GROUP BY ALL),
mc AS MATERIALIZED (SELECT {K}{e}, quantile_cont(mdd, CAST(0.05 AS DOUBLE)) AS mc_mdd_95 FROM pm_ GROUP BY ALL)"""


SPEC = f", spec AS (SELECT {K}, count(*) AS n FROM trades GROUP BY ALL)"


@query("a14_bootstrap_mdd", TRADES + SPEC + boot_sql("trades", "spec") + f" SELECT {K}, {r('mc_mdd_95')} AS mc_mdd_95 FROM mc")
def _(spark, sf):
    t = cut(backtest.numbered_trades(all_trades(spark, sf)))
    specs = t.groupBy(*trades.STRATEGY).agg(F.count(F.lit(1)).alias("n"))
    d = bootstrap.bootstrap_mdd(t, specs, trades.STRATEGY, n_sims=SIMS)
    return d.select(*trades.STRATEGY, r6("mc_mdd_95").alias("mc_mdd_95"))


RISK = "greatest(0.01, least({cap}::DOUBLE, 0.20::DOUBLE/greatest(0.05, abs({m}))*0.045::DOUBLE))"


@query("p14_risk_budget", TRADES + SPEC + boot_sql("trades", "spec") + f"""
SELECT {K}, {r(RISK.format(cap='0.0675', m='mc_mdd_95'))} AS optimal_risk_pct, {r('least(-0.20::DOUBLE, 1.2::DOUBLE*mc_mdd_95)')} AS kill_switch_mdd FROM mc""")
def _(spark, sf):
    t = cut(backtest.numbered_trades(all_trades(spark, sf)))
    specs = t.groupBy(*trades.STRATEGY).agg(F.count(F.lit(1)).alias("n"))
    d = bootstrap.bootstrap_mdd(t, specs, trades.STRATEGY, n_sims=SIMS)
    m = F.col("mc_mdd_95")
    return d.select(*trades.STRATEGY, r6(rules.risk_budget(m)).alias("optimal_risk_pct"), r6(rules.kill_switch(m)).alias("kill_switch_mdd"))


LEV_SQL = TRADES + f""",
te AS (SELECT *, CAST(floor(trade_no/30) AS BIGINT) AS epoch FROM trades),
spec AS (SELECT DISTINCT {K}, epoch, epoch*30 AS n FROM te WHERE epoch>0)""" + boot_sql("te", "spec", "epoch") + f""",
lv AS (SELECT te.*, {RISK.format(cap='0.0675', m='coalesce(mc_mdd_95, -0.20::DOUBLE)')} AS risk_pct,
              greatest(0, CASE WHEN prob>0.5 THEN prob-te.threshold ELSE (1-te.threshold)-prob END) AS delta
       FROM te LEFT JOIN mc USING ({K}, epoch)),
lw AS (SELECT *, ret*(risk_pct*CASE WHEN delta<=0.05 THEN 0.5::DOUBLE WHEN delta<=0.15 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END/0.015::DOUBLE) AS lr FROM lv)
SELECT {K}, trade_no, {r('risk_pct')} AS risk_pct, {r(f'exp(sum(ln(1+lr)) OVER (PARTITION BY {K} ORDER BY trade_no))')} AS capital FROM lw"""


@query("w20_walk_forward_leverage", LEV_SQL)
def _(spark, sf):
    d = backtest.leveraged(all_trades(spark, sf), n_sims=SIMS)
    return d.select(*trades.STRATEGY, "trade_no", r6("risk_pct").alias("risk_pct"), r6("capital").alias("capital"))


CPCV_BASE = ctes("rets", "probs") + """,
ob AS (SELECT p.symbol, p.model, p.bank, p.prob, r.ret, row_number() OVER (PARTITION BY p.symbol, p.model, p.bank ORDER BY bar_idx)-1 AS i,
              count(*) OVER (PARTITION BY p.symbol, p.model, p.bank) AS n
       FROM probs p JOIN rets r USING (symbol, bar_idx) WHERE split='oos'),
gr AS (SELECT *, least(CAST(floor(i/floor(n/6)) AS BIGINT), 5) AS g FROM ob),
combo AS (SELECT a, b, row_number() OVER (ORDER BY a, b)-1 AS path FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a<b)"""


def _cv_rows(spark, sf):
    """Scored out-of-sample bars, renumbered per (symbol, model, bank)."""
    b = cut(market.bars_d1(spark, sf))
    p = probs_of(spark, sf, b).select("symbol", "model", "bank", "bar_idx", "prob")
    d = series.simple_return(b).select("symbol", "time", "bar_idx", "ret").join(p, ["symbol", "bar_idx"])
    return cut(series.with_bar_idx(d, ["symbol", "model", "bank"]))


@query("j10_path_combinations", CPCV_BASE + " SELECT symbol, model, bank, path, count(*) AS n_test FROM gr JOIN combo ON g IN (a, b) GROUP BY ALL")
def _(spark, sf):
    d = cv.path_sharpes(_cv_rows(spark, sf), ["symbol", "model", "bank"])
    return d.select("symbol", "model", "bank", F.col("path").cast("long").alias("path"), F.col("n").alias("n_test"))


PATHS_SQL = CPCV_BASE + """,
pr AS (SELECT symbol, model, bank, path, CASE WHEN prob>0.5 THEN ret ELSE 0 END AS x FROM gr JOIN combo ON g IN (a, b)),
ps AS (SELECT symbol, model, bank, path, count(*) AS n, CASE WHEN count(*)<5 OR stddev_pop(x)<=1e-9 THEN 0 ELSE avg(x)/stddev_pop(x)*sqrt(252::DOUBLE) END AS sharpe FROM pr GROUP BY ALL)"""


@query("a17_cpcv_audit", PATHS_SQL + f""",
o AS (SELECT symbol, model, bank, avg(CASE WHEN sharpe<=0 THEN 1 ELSE 0 END) AS pbo, avg(sharpe) AS sharpe_mean, stddev_pop(sharpe) AS sharpe_std,
      min(sharpe) AS sharpe_min, max(sharpe) AS sharpe_max, count(*) AS n_paths FROM ps GROUP BY ALL)
SELECT symbol, model, bank, {r('pbo')} AS pbo, {r('sharpe_mean')} AS sharpe_mean, {r('sharpe_std')} AS sharpe_std, {r('sharpe_min')} AS sharpe_min,
       {r('sharpe_max')} AS sharpe_max, n_paths, CASE WHEN pbo<0.05 THEN 'robust' WHEN pbo<0.20 THEN 'acceptable' ELSE 'overfit' END AS verdict FROM o""")
def _(spark, sf):
    d = cv.audit(_cv_rows(spark, sf), ["symbol", "model", "bank"])
    return d.select("symbol", "model", "bank", *[r6(c).alias(c) for c in ("pbo", "sharpe_mean", "sharpe_std", "sharpe_min", "sharpe_max")],
                    "n_paths", "verdict")


@query("a18_cpcv_membership", ctes("bars") + """,
gb AS (SELECT symbol, bar_idx, n_bars, floor(n_bars/6) AS sz, least(CAST(floor(bar_idx/floor(n_bars/6)) AS BIGINT), 5) AS g FROM bars),
combo AS (SELECT a, b, row_number() OVER (ORDER BY a, b)-1 AS path FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a<b),
m AS (SELECT symbol, bar_idx, path, CASE WHEN g IN (a,b) THEN 'test'
  WHEN ((g-1) IN (a,b) AND bar_idx < g*sz+10) OR ((g+1) IN (a,b) AND bar_idx >= (CASE WHEN g=5 THEN n_bars ELSE (g+1)*sz END)-10) THEN NULL ELSE 'train' END AS role FROM gb, combo)
SELECT symbol, path, bar_idx, role FROM m WHERE role IS NOT NULL""")
def _(spark, sf):
    d = cv.cpcv_membership(market.bars_d1(spark, sf))
    return d.select("symbol", F.col("path").cast("long").alias("path"), "bar_idx", "role")


@query("a19_purged_folds", ctes("bars") + """,
f AS (SELECT symbol, bar_idx, fold, fold*floor(n_bars/3) AS lo, CASE WHEN fold=2 THEN n_bars ELSE (fold+1)*floor(n_bars/3) END AS hi
      FROM bars, (SELECT CAST(unnest(range(3)) AS INTEGER) AS fold))
SELECT symbol, fold, bar_idx, CASE WHEN bar_idx>=lo AND bar_idx<hi THEN 'val' ELSE 'train' END AS role FROM f
WHERE (bar_idx>=lo AND bar_idx<hi) OR bar_idx<lo-60 OR bar_idx>=hi+10""")
def _(spark, sf):
    return cv.purged_folds(market.bars_d1(spark, sf)).select("symbol", "fold", "bar_idx", "role")


@query("f7_normal_cdf", ctes("vol") + f", z AS (SELECT symbol, bar_idx, log_ret/vol AS z FROM vol WHERE vol>0) SELECT symbol, bar_idx, {r(sql_norm_cdf('z'))} AS p FROM z")
def _(spark, sf):
    d = series.log_return(volatility.hist_vol(market.bars_d1(spark, sf))).filter("hist_vol > 0")
    return d.select("symbol", "bar_idx", r6(norm_cdf(F.col("log_ret") / F.col("hist_vol"))).alias("p"))


def ppf_sql(p: str) -> str:
    from tidebar.functions import expr as e
    d = lambda v: f"CAST({v!r} AS DOUBLE)"

    def horner(c, x):
        acc = d(c[0])
        for v in c[1:]:
            acc = f"({acc}*{x}+{d(v)})"
        return acc
    q = f"sqrt(-2*ln(least({p}, 1-{p})))"
    u = f"({p}-CAST(0.5 AS DOUBLE))"
    rr = f"({u}*{u})"
    tail = f"{horner(e.PPF_C, q)}/({horner(e.PPF_D, q)}*{q}+1)"
    mid = f"{horner(e.PPF_A, rr)}*{u}/({horner(e.PPF_B, rr)}*{rr}+1)"
    return f"CASE WHEN {p}<0.02425 THEN {tail} WHEN {p}>1-0.02425 THEN -({tail}) ELSE {mid} END"


@query("f8_normal_quantile", ctes("journal") + f""", z AS (SELECT order_no, probability*0.998::DOUBLE+0.001::DOUBLE AS p FROM journal)
SELECT order_no, {r(ppf_sql('p'))} AS z FROM z""")
def _(spark, sf):
    p = F.col("probability") * 0.998 + 0.001
    return market.journal(spark, sf).select("order_no", p.alias("p")).select("order_no", r6(norm_ppf(F.col("p"))).alias("z"))
