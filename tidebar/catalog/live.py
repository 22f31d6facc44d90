"""Streams and live reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import ctes, ntz, query, r
from tidebar.catalog.portfolio import HRP_SQL, strategies
from tidebar.catalog.trading import bars_vol, probs_of
from tidebar.functions import signals as rules
from tidebar.functions.expr import dbl, r6
from tidebar.operators import barriers, trades
from tidebar.operators.metrics import group_quantile
from tidebar.plans import backtest
from tidebar.session import cut, scratch_path
from tidebar.sources import market
from tidebar.streaming import bars as sbars, monitors as smon, positions as spos


@query("t1_new_closed_bars", ctes("h4") + " SELECT symbol, time AS bar_time FROM h4")
def _(spark, sf):
    out = sbars.drain(sbars.new_bars(sbars.tick_stream(spark, sf)), scratch_path(spark, "new-bars"))
    return out.select("symbol", ntz("bar_time", "bar_time"))


@query("t2_streaming_bars", ctes("h4") + """
SELECT symbol, time, open, high, low, close, tick_volume FROM h4
WHERE time + INTERVAL 4 HOUR <= (SELECT max(time) - INTERVAL 1 HOUR FROM ticks)""")
def _(spark, sf):
    """Only bars that the watermark has passed are there; the open one per symbol is held back."""
    out = sbars.drain(sbars.stream_bars(sbars.tick_stream(spark, sf)), scratch_path(spark, "bars"))
    return out.select("symbol", ntz("time", "time"), "open", "high", "low", "close", "tick_volume")


@query("t3_position_lifecycle", ctes("free") + f"""
SELECT concat(symbol, '/', model, '/', bank) AS symbol, threshold, bar_idx AS entry_idx, exit_idx, side, exit_kind, duration, prob, {r('ret')} AS ret
FROM free""")
def _(spark, sf):
    """Signals at every threshold of every (symbol, model, bank), replayed in three parts by a job started anew for each."""
    bv = bars_vol(spark, sf)
    p = probs_of(spark, sf, bv).select("symbol", "model", "bank", "bar_idx", "prob", "bilateral")
    d = spos.position_bars(bv, p)
    span = d.groupBy("symbol").agg(F.min("bar_idx").alias("_a"), (F.max("bar_idx") + 1).alias("_z"))
    d = cut(d.join(span, "symbol").withColumn("part", F.floor(3 * (F.col("bar_idx") - F.col("_a")) / (F.col("_z") - F.col("_a")))))
    path = scratch_path(spark, "positions")
    schema = d.drop("_a", "_z", "part").schema
    for part in range(3):
        rows = d.filter(F.col("part") == part).drop("_a", "_z", "part")
        rows.write.mode("append").parquet(f"{path}/in")
        smon.run_job(spark.readStream.schema(schema).parquet(f"{path}/in"), spos.PositionBook(spark, f"{path}/book").job,
                     f"{path}/checkpoint")
    return spos.PositionBook(spark, f"{path}/book").closed().withColumn("ret", r6("ret"))


T4_SQL = ctes("cands", recursive=True) + """,
m0 AS MATERIALIZED (SELECT concat(c.symbol, '/', model, '/', bank) AS symbol, c.bar_idx, exit_idx, ret FROM cands c JOIN bars b USING (symbol, bar_idx)
       WHERE threshold=CAST(0.5 AS DOUBLE) AND c.bar_idx>=b.n_bars-300),
m1 AS MATERIALIZED (SELECT c.*, (SELECT min(d.bar_idx) FROM m0 d WHERE d.symbol=c.symbol AND d.bar_idx>=c.exit_idx) AS next_idx FROM m0 c),
m2 AS (SELECT m1.* FROM m1 JOIN (SELECT symbol, min(bar_idx) AS bar_idx FROM m0 GROUP BY 1) USING (symbol, bar_idx)
       UNION ALL SELECT n.* FROM m2 w JOIN m1 n ON n.symbol=w.symbol AND n.bar_idx=w.next_idx),
m3 AS (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY symbol ORDER BY exit_idx)) AS v FROM m2),
m4 AS (SELECT *, v/greatest(1.0, max(v) OVER (PARTITION BY symbol ORDER BY exit_idx))-1 AS dd FROM m3),
m5 AS (SELECT m4.*, dead_at IS NOT NULL AS q, pow(100*ret, 2) AS mse, row_number() OVER (PARTITION BY symbol ORDER BY exit_idx)-1 AS no, count(*) OVER (PARTITION BY symbol) AS n
       FROM m4 JOIN (SELECT symbol, min(exit_idx) FILTER (WHERE dd<=-0.20) AS dead_at FROM m4 GROUP BY 1) USING (symbol) WHERE dead_at IS NULL OR exit_idx<=dead_at),
m6 AS (SELECT symbol, quantile_cont(mse, CAST(0.9 AS DOUBLE)) AS p90 FROM m5 WHERE no*2<n GROUP BY 1),
m7 AS (SELECT symbol, median(mse) AS md FROM m5 WHERE n>=30 AND no>=n-30 GROUP BY 1),
m8 AS (SELECT symbol, bool_or(q) AS q, bool_or(coalesce(md>p90, false)) AS d FROM m5 LEFT JOIN m6 USING (symbol) LEFT JOIN m7 USING (symbol) GROUP BY 1)
SELECT symbol, 'quarantine' AS event FROM m8 WHERE q UNION ALL SELECT symbol, 'drift' FROM m8 WHERE d AND NOT q
UNION ALL SELECT symbol, CASE WHEN q THEN 'state_quarantined' ELSE 'state_ok' END FROM m8"""


@query("t4_monitor_events", T4_SQL)
def _(spark, sf):
    """Newest 300 bars of every strategy replayed as one micro-batch; status changes become events."""
    bv = bars_vol(spark, sf)
    b = bv.filter("bar_idx >= n_bars - 300")
    p = probs_of(spark, sf, bv).join(b.select("symbol", "bar_idx"), ["symbol", "bar_idx"], "left_semi")
    path = scratch_path(spark, "monitor")
    p.write.parquet(f"{path}/probs")
    table = smon.VersionedTable(spark, f"{path}/state", smon.STATUS)
    oc = cut(barriers.outcomes(b))

    def replay(batch):
        c = trades.candidates(trades.signals(batch, (0.5,)), oc)
        c = c.withColumn("symbol", F.concat_ws("/", "symbol", "model", "bank"))
        t = cut(backtest.numbered_trades(trades.simulate(c, ["symbol"]), ["symbol"]))
        e = t.withColumn("mse", F.pow(100 * F.col("ret"), dbl(2.0)))
        p90 = group_quantile(e.filter("trade_no * 2 < n_trades"), ["symbol"], "mse", 0.90, "p90", 0.05)
        from tidebar.operators.monitors import concept_drift
        drift = concept_drift(e, p90, ["symbol"], last=30)
        return smon.monitor_status(t, drift)
    stream = spark.readStream.schema(p.schema).parquet(f"{path}/probs")
    smon.run_job(stream, smon.monitor_job(replay, table, f"{path}/events"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/events").select("symbol", "event").unionByName(
        table.current().select("symbol", F.when(F.col("quarantined"), "state_quarantined").otherwise("state_ok").alias("event")))


def _live(spark, sf):
    """Live returns per symbol: order value against its running scale, one per order."""
    o = market.table(spark, sf, "orders")
    return o.select(F.concat(F.lit("S"), (F.col("o_custkey") % 200).cast("string")).alias("symbol"),
                    F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") * 7919 % 1000 - 480) / dbl(20000)).alias("ret"))


SIMS = 1000
REC_SQL = """
WITH lv AS (SELECT concat('S', o_custkey%200) AS symbol, o_orderkey AS seq, (o_orderkey*7919%1000-480)/CAST(20000 AS DOUBLE) AS ret FROM orders),
ld AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq)-1 AS k, count(*) OVER (PARTITION BY symbol) AS c FROM lv),
us AS (SELECT symbol, k AS trade_no, ret, CAST(floor(c/30)*30 AS BIGINT) AS n FROM ld WHERE c>=30 AND k<floor(c/30)*30),
sp AS (SELECT DISTINCT symbol, n FROM us),"""


def _recal_sql():
    from tidebar.catalog.trading import draw_sql
    return REC_SQL + f"""
dr AS (SELECT symbol, n, sim, pos, {draw_sql('CAST(sim AS BIGINT)', 'CAST(pos AS BIGINT)', 'n')} AS trade_no FROM sp, (SELECT unnest(range({SIMS})) AS sim), LATERAL (SELECT unnest(range(n)) AS pos)),
pa AS (SELECT d.symbol, d.n, sim, pos, ret FROM dr d JOIN us USING (symbol, trade_no)),
pe AS (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY symbol, sim ORDER BY pos)) AS v FROM pa),
pd AS (SELECT symbol, n, sim, v/max(v) OVER (PARTITION BY symbol, sim ORDER BY pos)-1 AS dd FROM pe),
m AS (SELECT symbol, n, sim, min(dd) AS mdd FROM pd GROUP BY ALL),
q AS (SELECT symbol, n AS n_live, quantile_cont(mdd, CAST(0.05 AS DOUBLE)) AS x FROM m GROUP BY ALL)
SELECT symbol, n_live, {r('x')} AS mc_mdd_95, {r('greatest(0.01::DOUBLE, least(0.0675::DOUBLE, 0.20::DOUBLE/greatest(0.05::DOUBLE, abs(x))*0.045::DOUBLE))')} AS optimal_risk_pct,
       {r('least(-0.20::DOUBLE, 1.2::DOUBLE*x)')} AS kill_switch_mdd FROM q"""


@query("t5_recalibrate_risk", _recal_sql())
def _(spark, sf):
    path = scratch_path(spark, "recalibrate")
    live = _live(spark, sf)
    live.write.parquet(f"{path}/in")
    history = spark.createDataFrame([], smon.LIVE)
    table = smon.VersionedTable(spark, f"{path}/risk", smon.RISK)
    job = smon.recalibration_job(history, f"{path}/live", table, SIMS)
    smon.run_job(spark.readStream.schema(live.schema).parquet(f"{path}/in"), job, f"{path}/checkpoint")
    d = table.current()
    return d.select("symbol", "n_live", *[r6(c).alias(c) for c in ("mc_mdd_95", "optimal_risk_pct", "kill_switch_mdd")])


@query("t6_rebalance_due", """
SELECT concat('P', o_custkey%100) AS portfolio, CAST(max(o_orderdate) AS DATE) AS as_of FROM orders GROUP BY 1
HAVING date_diff('day', CAST(max(o_orderdate) AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) >= 30""")
def _(spark, sf):
    o = market.table(spark, sf, "orders").select(
        F.concat(F.lit("P"), (F.col("o_custkey") % 100).cast("string")).alias("portfolio"),
        F.col("o_orderdate").cast("date").alias("as_of"))
    now = o.agg(F.max("as_of")).first()[0]                                # one value: the stream's clock
    return smon.rebalance_due(o, F.lit(now))


@query("t6b_rebalance_weights", HRP_SQL + f""",
cw AS (SELECT max(window_id) AS w FROM to_)
SELECT 'ALL' AS portfolio, u.strategy, {r('CASE WHEN t.sw>=t.se THEN coalesce(wt.weight, 0) ELSE 1/CAST(u.nn AS DOUBLE) END')} AS weight,
       t.sw>=t.se AS use_weighted, d.date AS as_of
FROM cw JOIN to_ t ON t.window_id=cw.w JOIN dn d ON d.i=cw.w*20, (SELECT strategy, count(*) OVER () AS nn FROM (SELECT DISTINCT strategy FROM sr)) u
LEFT JOIN wt ON wt.strategy=u.strategy AND wt.window_id=(SELECT w FROM cw)""")
def _(spark, sf):
    """Three clock ticks, 60 days apart, as micro-batches; the newest weights are those of the last."""
    days = strategies(spark, sf).withColumn("portfolio", F.lit("ALL"))
    last = days.agg(F.max("i")).first()[0] // 20 * 20                           # one number: the last tick
    ticks = days.filter(F.col("i").isin(last - 120, last - 60, last)).select("portfolio", F.col("date").alias("now"), "i").distinct()
    path = scratch_path(spark, "rebalance")
    table = smon.VersionedTable(spark, f"{path}/weights", smon.WEIGHTS)
    for i in (last - 120, last - 60, last):
        ticks.filter(F.col("i") == i).drop("i").coalesce(1).write.mode("append").parquet(f"{path}/clock")
        smon.run_job(spark.readStream.schema(ticks.drop("i").schema).parquet(f"{path}/clock"),
                     smon.rebalance_job(days, table), f"{path}/checkpoint")
    return table.current().withColumn("weight", r6("weight"))


@query("t7_journal_append", ctes("journal") + f" SELECT order_no, status, {r('probability')} AS probability FROM journal")
def _(spark, sf):
    o = sbars.read_table_stream(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("order_no"), F.when(k % 4 == 0, "CASH").otherwise("EJECUTADO").alias("status"),
                    (k * 7919 % 1000 / dbl(1000)).alias("probability"))
    return sbars.drain(rows, scratch_path(spark, "journal")).withColumn("probability", r6("probability"))


W22_SQL = ctes("journal", recursive=True) + """,
ex AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY timestamp, order_no)-1 AS seq,
       CASE WHEN probability>=threshold THEN CASE WHEN probability>0.65 THEN 1.33::DOUBLE ELSE 1::DOUBLE END ELSE -1::DOUBLE END AS g FROM journal WHERE status='EJECUTADO'),
cp AS (SELECT CAST(-1 AS BIGINT) AS seq, 10000::DOUBLE AS capital UNION ALL
       SELECT e.seq, c.capital + e.g*CASE WHEN risk_usd IS NULL OR risk_usd<=0 THEN c.capital*0.015::DOUBLE ELSE risk_usd END FROM cp c JOIN ex e ON e.seq=c.seq+1)"""


@query("w22_journal_equity", W22_SQL + f" SELECT order_no, ex.seq, {r('capital', 2)} AS capital FROM cp JOIN ex USING (seq)")
def _(spark, sf):
    d = backtest.journal_equity(market.journal(spark, sf))
    return d.select("order_no", "seq", r6("capital", 2).alias("capital"))


@query("r4_last_executions", ctes("journal") + f"""
SELECT order_no, timestamp, symbol, {r('probability')} AS probability, {r('price', 4)} AS price FROM journal WHERE status='EJECUTADO' ORDER BY timestamp DESC, order_no DESC LIMIT 20""")
def _(spark, sf):
    d = backtest.last_executions(market.journal(spark, sf))
    return d.select("order_no", "timestamp", "symbol", r6("probability").alias("probability"), r6("price", 4).alias("price"))


@query("x4_live_report", W22_SQL + f""",
rr AS (SELECT seq, capital, capital/lag(capital) OVER (ORDER BY seq)-1 AS ret, capital/max(capital) OVER (ORDER BY seq)-1 AS dd FROM cp)
SELECT {r('last(capital ORDER BY seq)', 2)} AS capital, count(ret) AS n_trades, {r('avg(ret)/stddev_pop(ret)*sqrt(252::DOUBLE)')} AS sharpe, {r('min(dd)')} AS mdd,
       {r('avg(CASE WHEN ret>0 THEN 1 WHEN ret IS NOT NULL THEN 0 END)')} AS win_rate, {r('last(capital ORDER BY seq)/10000-1')} AS roi FROM rr""")
def _(spark, sf):
    d = backtest.live_kpis(backtest.journal_equity(market.journal(spark, sf)))
    return d.select(r6("capital", 2).alias("capital"), "n_trades", *[r6(c).alias(c) for c in ("sharpe", "mdd", "win_rate", "roi")])
