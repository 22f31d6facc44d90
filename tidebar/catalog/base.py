"""Registry of named queries and the SQL pieces their checks are built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where it can be said in SQL, its independent check."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


def ntz(col, name: str):
    """Output timestamps without a zone."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("timestamp_ntz").alias(name)


def r(x: str, digits: int = 6) -> str:
    """SQL twin of `functions.expr.r6`."""
    return f"round({x}, {digits}) + 0.0"


W = "OVER (PARTITION BY symbol ORDER BY bar_idx)"
DBL = "CAST({} AS DOUBLE)"

# --- common table expressions (DuckDB) ------------------------------------------------------------

PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """
d0 AS (SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS DATE) AS time,
              avg(l_discount) AS m, max(l_discount) AS hi, min(l_discount) AS lo, count(*) AS tick_volume
       FROM lineitem GROUP BY 1, 2),
c0 AS (SELECT *, 100*exp(sum(ln(1+0.4*(m-0.05))) OVER (PARTITION BY symbol ORDER BY time)) AS close FROM d0),
o0 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY time), close) AS open,
              row_number() OVER (PARTITION BY symbol ORDER BY time)-1 AS bar_idx,
              count(*) OVER (PARTITION BY symbol) AS n_bars FROM c0),
bars AS MATERIALIZED (SELECT symbol, time, bar_idx, n_bars, open,
              greatest(open,close)*(1+0.1*(hi-m)) AS high, least(open,close)*(1-0.1*(m-lo)) AS low,
              close, tick_volume, 0 AS real_volume, CAST(0 AS DOUBLE) AS spread FROM o0)"""),
    "rets": (("bars",), """
rets AS MATERIALIZED (SELECT *, coalesce(close/lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx)-1, 0) AS ret,
              coalesce(100*(ln(close)-lag(ln(close)) OVER (PARTITION BY symbol ORDER BY bar_idx)), 0) AS log_ret
         FROM bars)"""),
    "vol": (("rets",), """
vol AS MATERIALIZED (SELECT *, CASE WHEN count(log_ret) OVER v = 500 THEN stddev_samp(log_ret) OVER v END AS vol,
               CASE WHEN symbol='NF' THEN CAST(2.5 AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) END AS k_up,
               CAST(1.5 AS DOUBLE) AS k_down,
               CASE WHEN symbol='NF' THEN CAST(0.00006 AS DOUBLE) WHEN symbol='RF' THEN CAST(0.0001 AS DOUBLE)
                    ELSE CAST(0.00005 AS DOUBLE) END AS cost,
               symbol NOT IN ('NF','RF') AS bilateral
        FROM rets WINDOW v AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))"""),
    "outc": (("vol",), """
ent AS (SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY bar_idx) AS entry,
               lead(close, 10) OVER (PARTITION BY symbol ORDER BY bar_idx) AS last_close FROM vol),
sides AS (SELECT e.*, s.side FROM ent e, (VALUES (1), (-1)) s(side)
          WHERE bar_idx < n_bars - 11 AND vol IS NOT NULL AND vol <> 0),
lev AS (SELECT *, CASE WHEN side > 0 THEN entry*(1+k_up*(vol/100)) ELSE entry*(1-k_up*(vol/100)) END AS tp,
               CASE WHEN side > 0 THEN entry*(1-k_down*(vol/100)) ELSE entry*(1+k_down*(vol/100)) END AS sl
        FROM sides),
touch AS (SELECT l.symbol, l.bar_idx, l.side,
                 min(b.bar_idx-l.bar_idx) FILTER (WHERE CASE WHEN l.side>0 THEN b.high>=l.tp ELSE b.low<=l.tp END) AS jt,
                 min(b.bar_idx-l.bar_idx) FILTER (WHERE CASE WHEN l.side>0 THEN b.low<=l.sl ELSE b.high>=l.sl END) AS js
          FROM lev l JOIN bars b ON b.symbol=l.symbol AND b.bar_idx BETWEEN l.bar_idx+1 AND l.bar_idx+10
          GROUP BY 1,2,3),
kinds AS (SELECT l.*, CASE WHEN jt=js THEN 'SL (Dual)' WHEN jt IS NULL AND js IS NULL THEN 'TIME'
                          WHEN js IS NULL OR jt<js THEN 'TP' ELSE 'SL' END AS exit_kind,
                 coalesce(least(jt,js), 10) AS duration
          FROM lev l JOIN touch USING (symbol, bar_idx, side)),
raw AS (SELECT *, CASE exit_kind WHEN 'TP' THEN tp WHEN 'TIME' THEN last_close ELSE sl END AS lvl FROM kinds),
outc AS MATERIALIZED (SELECT symbol, time, bar_idx, n_bars, side, entry AS entry_price, tp, sl, exit_kind, duration,
               bar_idx+duration AS exit_idx,
               CASE WHEN side>0 THEN lvl/entry-1 ELSE entry/lvl-1 END AS raw_ret,
               (1+CASE WHEN side>0 THEN lvl/entry-1 ELSE entry/lvl-1 END)*((1-cost)*(1-cost))-1 AS ret
        FROM raw)"""),
    "probs": (("bars",), """
symno AS (SELECT symbol, rank() OVER (ORDER BY symbol)-1 AS symbol_no FROM (SELECT DISTINCT symbol FROM bars)),
grid AS (SELECT * FROM (VALUES ('RANDOM_FOREST',0,'Precio_Puro',0),('RANDOM_FOREST',0,'Tecnicos',1),
                               ('XGBOOST',1,'Precio_Puro',0),('XGBOOST',1,'Tecnicos',1)) g(model,model_no,bank,bank_no)),
probs AS MATERIALIZED (SELECT b.symbol, model, bank, bar_idx, n_bars,
                 CASE WHEN bar_idx*5 >= n_bars*4 THEN 'oos' ELSE 'train' END AS split,
                 ((bar_idx*7919+symbol_no*104729+model_no*1299709+bank_no*15485863)%1000)/CAST(1000 AS DOUBLE) AS prob
          FROM bars b JOIN symno USING (symbol), grid)"""),
    "cands": (("outc", "probs"), """
thr AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES (0.50),(0.55),(0.60),(0.65),(0.70),(0.75)) v(t)),
sig AS (SELECT p.symbol, model, bank, threshold, bar_idx, prob,
               CASE WHEN prob>threshold THEN 1 WHEN symbol NOT IN ('NF','RF') AND prob<1-threshold THEN -1 ELSE 0 END AS side
        FROM probs p, thr WHERE split='oos'),
cands AS MATERIALIZED (SELECT s.*, o.exit_idx, o.exit_kind, o.duration, o.ret
          FROM sig s JOIN outc o USING (symbol, bar_idx, side) WHERE side<>0)"""),
    "free": (("cands",), """
nxt AS MATERIALIZED (SELECT c.*, (SELECT min(d.bar_idx) FROM cands d WHERE d.symbol=c.symbol AND d.model=c.model
                       AND d.bank=c.bank AND d.threshold=c.threshold
                       AND d.bar_idx >= c.exit_idx) AS next_idx FROM cands c),
walk AS (SELECT n.* FROM nxt n JOIN (SELECT symbol, model, bank, threshold, min(bar_idx) AS bar_idx FROM cands
                                     GROUP BY 1,2,3,4) USING (symbol, model, bank, threshold, bar_idx)
         UNION ALL
         SELECT n.* FROM walk w JOIN nxt n ON n.symbol=w.symbol AND n.model=w.model AND n.bank=w.bank
                AND n.threshold=w.threshold AND n.bar_idx=w.next_idx),
free AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, model, bank, threshold ORDER BY exit_idx)-1 AS trade_no
         FROM walk)"""),
    "trades": (("free",), """
eq0 AS (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY symbol, model, bank, threshold ORDER BY exit_idx)) AS cum_ret FROM free),
eq1 AS (SELECT *, greatest(1.0, max(cum_ret) OVER (PARTITION BY symbol, model, bank, threshold ORDER BY exit_idx)) AS peak FROM eq0),
dead AS (SELECT symbol, model, bank, threshold, min(exit_idx) FILTER (WHERE cum_ret/peak-1 <= -0.20) AS dead_at
         FROM eq1 GROUP BY 1,2,3,4),
trades AS MATERIALIZED (SELECT symbol, model, bank, threshold, bar_idx AS entry_idx, exit_idx, side, exit_kind, ret, duration,
                  prob, cum_ret, trade_no, dead_at IS NOT NULL AS is_dead
           FROM eq1 JOIN dead USING (symbol, model, bank, threshold) WHERE dead_at IS NULL OR exit_idx<=dead_at)"""),
    "macro": ((), """
ml AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'VIX_close' WHEN '2-HIGH' THEN 'DXY_close' WHEN '3-MEDIUM' THEN 'Yield10Y'
              WHEN '4-NOT SPECIFIED' THEN 'Copper' ELSE 'EMBI' END AS series,
              CAST(o_orderdate AS DATE) AS date, avg(o_totalprice)/10000 AS value
       FROM orders GROUP BY 1,2),
macro AS MATERIALIZED (SELECT date, max(value) FILTER (WHERE series='VIX_close') AS "VIX_close",
                 max(value) FILTER (WHERE series='DXY_close') AS "DXY_close",
                 max(value) FILTER (WHERE series='Yield10Y') AS "Yield10Y",
                 max(value) FILTER (WHERE series='Copper') AS "Copper",
                 max(value) FILTER (WHERE series='EMBI') AS "EMBI" FROM ml GROUP BY 1)"""),
    "journal": ((), """
journal AS MATERIALIZED (SELECT o_orderdate AS timestamp, o_orderkey AS order_no, concat('S', o_orderkey%8) AS symbol,
                   (o_orderkey*7919%1000)/CAST(1000 AS DOUBLE) AS probability, CAST(0.5 AS DOUBLE) AS threshold,
                   CASE WHEN o_orderkey%4=0 THEN 'CASH' ELSE 'EJECUTADO' END AS status,
                   o_totalprice/1000 AS price,
                   CASE WHEN o_orderkey%10<>0 THEN o_totalprice/2000 END AS risk_usd FROM orders)"""),
    "ticks": ((), """
ticks AS MATERIALIZED (SELECT event_type AS symbol, ts AS time, value AS price, event_id AS tick_id FROM events)"""),
    "h4": (("ticks",), """
h4 AS MATERIALIZED (SELECT symbol, make_timestamp(CAST(floor(epoch_us(time)/14400000000.0) AS BIGINT)*14400000000) AS time,
               first(price ORDER BY time, tick_id) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY time, tick_id) AS close, count(*) AS tick_volume FROM ticks GROUP BY 1,2)"""),
    "strat": (("rets",), """
strat AS MATERIALIZED (SELECT symbol AS strategy, time AS date, ret FROM rets)"""),
}



def ctes(*names: str, recursive: bool = False) -> str:
    """`WITH` clause of the named pieces and what they need, in order."""
    done: list[str] = []

    def visit(n):
        deps, _ = PIECES[n]
        for d in deps:
            visit(d)
        if n not in done:
            done.append(n)
    for n in names:
        visit(n)
    rec = recursive or "free" in done
    return "WITH " + ("RECURSIVE " if rec else "") + ",".join(PIECES[n][1] for n in done)


def sql_norm_cdf(z: str) -> str:
    """Same published approximation as `functions.expr.norm_cdf`."""
    from tidebar.functions.expr import CDF_B, CDF_P, INV_SQRT_2PI
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    a = f"least(abs({z}), CAST(38 AS DOUBLE))"
    t = f"(1/(1+{d(CDF_P)}*{a}))"
    poly = d(0.0)
    for b in reversed(CDF_B):
        poly = f"{t}*({d(b)}+{poly})"
    tail = f"{d(INV_SQRT_2PI)}*exp(-({a})*({a})/2)*({poly})"
    return f"CASE WHEN {z} >= 0 THEN 1-({tail}) ELSE {tail} END"
