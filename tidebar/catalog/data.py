"""Sources, cleaning, joins and quality reports (S, P, J and A1-A3 of the survey)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidebar.catalog.base import ctes, ntz, query, r
from tidebar.functions.expr import r6
from tidebar.operators import features, quality, series
from tidebar.session import scratch_path
from tidebar.sources import ingest, market, sinks

OHLC = ("open", "high", "low", "close")


def ohlc6():
    return [r6(c).alias(c) for c in OHLC]


def sql_ohlc(p: str = "") -> str:
    return ", ".join(f"{r(p + c)} AS {c}" for c in OHLC)


@query("s1_csv_bar_scan", ctes("bars") + f"""
SELECT symbol, CAST(time AS TIMESTAMP) AS time, {sql_ohlc()}, tick_volume FROM bars""")
def _(spark, sf):
    path = scratch_path(spark, "bars-csv")
    (market.bars_d1(spark, sf).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
     .select("symbol", "time", *OHLC, "tick_volume", "real_volume", "spread")
     .write.partitionBy("symbol").option("header", True).csv(path))
    d = ingest.read_bar_csv(spark, path, r"symbol=([^/]+)/")
    return d.select("symbol", ntz("time", "time"), *ohlc6(), "tick_volume")


@query("s2_bar_normalise", """
WITH t AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS e, value, event_id,
                  row_number() OVER (PARTITION BY event_type, CAST(floor(epoch(ts)) AS BIGINT) ORDER BY event_id) AS k FROM events)
SELECT symbol, date_trunc('day', make_timestamp(e*1000000)) AS time, value AS open, value AS high,
       value AS low, value AS close, CAST(1 AS BIGINT) AS tick_volume, CAST(0 AS BIGINT) AS real_volume,
       CAST(0 AS DOUBLE) AS spread FROM t WHERE k=1""")
def _(spark, sf):
    t = market.ticks(spark, sf)
    raw = t.select("symbol", F.unix_seconds("time").alias("time"), F.col("tick_id").alias("row_no"),
                   *[F.col("price").alias(c) for c in OHLC], F.lit(1).cast("long").alias("tick_volume"),
                   F.lit(0).cast("long").alias("real_volume"), F.lit(0.0).alias("spread"))
    d = ingest.normalise_bars(raw, "D1")
    return d.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("s3_chunked_extraction", """
SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS DATE) AS time, count(*) AS n_rows
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    """All years of the table, from its first to its last."""
    lines = market.table(spark, sf, "lineitem")
    ends = lines.agg(F.year(F.min("l_shipdate")).alias("a"), F.year(F.max("l_shipdate")).alias("z")).first()   # two numbers
    rows = ingest.read_range(lines, ends["a"], ends["z"], time="l_shipdate")
    return (rows.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"),
                         F.col("l_shipdate").cast("date").alias("time"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("s4_bars_from_ticks", ctes("h4") + " SELECT symbol, time, open, high, low, close, tick_volume FROM h4")
def _(spark, sf):
    d = ingest.bars_from_ticks(market.ticks(spark, sf), "H4")
    return d.select("symbol", ntz("time", "time"), *OHLC, "tick_volume")


def _width_sql(tf: str, micros: int) -> str:
    return f"""SELECT symbol, '{tf}' AS timeframe, make_timestamp(CAST(floor(epoch_us(time)/{micros}.0) AS BIGINT)*{micros}) AS time,
first(price ORDER BY time, tick_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY time, tick_id) AS close, count(*) AS tick_volume
FROM ticks GROUP BY 1, 3"""


@query("s4b_bars_by_timeframe", ctes("ticks") + _width_sql("D1", 86_400_000_000) + " UNION ALL " + _width_sql("H1", 3_600_000_000))
def _(spark, sf):
    """Daily and hourly bars of the same ticks."""
    t = market.ticks(spark, sf)
    parts = [ingest.bars_from_ticks(t, tf).withColumn("timeframe", F.lit(tf)) for tf in ("D1", "H1")]
    return parts[0].unionByName(parts[1]).select("symbol", "timeframe", ntz("time", "time"), *OHLC, "tick_volume")


@query("s5_incremental_upsert", ctes("bars") + f"""
SELECT symbol, time, {r('CASE WHEN bar_idx >= n_bars-20 THEN close*1.01 ELSE close END')} AS close FROM bars""")
def _(spark, sf):
    b = market.bars_d1(spark, sf)
    old = b.filter("bar_idx < n_bars - 10").select("symbol", "time", "close")
    new = b.filter("bar_idx >= n_bars - 20").select("symbol", "time", (F.col("close") * 1.01).alias("close"))
    return ingest.upsert(old, new).select("symbol", "time", r6("close").alias("close"))


@query("s6_high_water_mark", ctes("bars") + """,
h AS (SELECT symbol, greatest(max(time) - 1, DATE '2000-01-01') AS start FROM bars WHERE bar_idx*5 < n_bars*4 GROUP BY 1)
SELECT symbol, CAST(start AS DATE) AS start, count(time) AS n_rows
FROM h LEFT JOIN bars USING (symbol) WHERE time IS NULL OR time >= start GROUP BY 1, 2""")
def _(spark, sf):
    b = market.bars_d1(spark, sf)
    marks = ingest.high_water_mark(b.filter("bar_idx * 5 < n_bars * 4"), floor="1990-01-01")
    marks = marks.withColumn("start", F.greatest("start", F.lit("2000-01-01").cast("date")))
    rows = ingest.incremental(b, marks).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    return marks.join(rows, "symbol")


@query("s7_incremental_skip", ctes("bars") + """
SELECT symbol, count(*) AS n_rows FROM bars WHERE symbol NOT LIKE 'A%' GROUP BY 1""")
def _(spark, sf):
    b = market.bars_d1(spark, sf)
    done = b.filter(F.col("symbol").startswith("A") | (F.col("bar_idx") < F.col("n_bars") - 1))
    return ingest.stale_only(b, done).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s8_last_n_bars", ctes("bars") + f"""
SELECT symbol, time, bar_idx, {r('close')} AS close FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 300""")
def _(spark, sf):
    return series.last_n(market.bars_d1(spark, sf), 300).select("symbol", "time", "bar_idx", r6("close").alias("close"))


@query("s9_nested_json_series", ctes("macro") + f"""
SELECT series, date, {r('value', 10)} AS "TPM" FROM ml""")
def _(spark, sf):
    """Yearly documents with one entry per day (at most 366), written and parsed as JSON text."""
    m = market.macro_long(spark, sf)
    docs = (m.groupBy("series", F.year("date").alias("y")).agg(F.to_json(F.struct(F.collect_list(F.struct(
        F.date_format("date", "yyyy-MM-dd'T'00:00:00.000'Z'").alias("fecha"),
        F.col("value").alias("valor"))).alias("serie"))).alias("doc")))
    parsed = docs.select("series", F.from_json("doc", "serie array<struct<fecha:string,valor:double>>").alias("d")).select(
        "series", "d.serie")
    return ingest.flatten_series(parsed, keep=["series"]).select("series", "date", r6("TPM", 10).alias("TPM"))


@query("s10_spread_clean", ctes("macro") + f""",
v AS (SELECT series, date, CASE WHEN day(date)%5=0 THEN NULL ELSE value END AS x FROM ml WHERE day(date)%7<>0)
SELECT series, date, {r('lag(x,3) OVER (PARTITION BY series ORDER BY date)', 10)} AS "EMBI" FROM v""")
def _(spark, sf):
    m = market.macro_long(spark, sf)
    day = F.dayofmonth("date")
    raw = m.select("series", F.when(day % 7 == 0, "n/a").otherwise(F.col("date").cast("string")).alias("fecha"),
                   F.when(day % 5 == 0, "-").otherwise(F.col("value").cast("string")).alias("spread"))
    return ingest.clean_spread(raw, "fecha", "spread", keys=["series"]).select("series", "date", r6("EMBI", 10).alias("EMBI"))


@query("s11_table_sink", ctes("bars") + f"""
SELECT symbol, count(*) AS n_rows, {r('sum(close)', 4)} AS sum_close FROM bars GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "processed")
    sinks.write_table(market.bars_d1(spark, sf), path)
    return spark.read.parquet(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.sum("close"), 4).alias("sum_close"))


@query("s12_append_journal", ctes("journal") + """
SELECT status, count(*) AS n_rows FROM journal GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "journal")
    j = market.journal(spark, sf)
    sinks.append_journal(j.filter("probability > threshold"), path)
    sinks.append_journal(j.filter("not (probability > threshold)"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s13_run_summary_upsert", """
SELECT concat('A', o_custkey%50) AS asset, concat('M', o_custkey%3) AS model, o_orderpriority AS bank, max(o_orderkey) AS run_no
FROM orders GROUP BY 1,2,3""")
def _(spark, sf):
    o = market.table(spark, sf, "orders").select(
        F.concat(F.lit("A"), (F.col("o_custkey") % 50).cast("string")).alias("asset"),
        F.concat(F.lit("M"), (F.col("o_custkey") % 3).cast("string")).alias("model"),
        F.col("o_orderpriority").alias("bank"), F.col("o_orderkey").alias("run_no"))
    return sinks.upsert_summary(o.filter("run_no % 2 = 0"), o.filter("run_no % 2 <> 0"))


@query("p1_zero_columns", ctes("bars") + """
SELECT symbol, u.c AS column, CASE u.c WHEN 'real_volume' THEN max(abs(real_volume))=0 WHEN 'spread' THEN max(abs(spread))=0
       WHEN 'close' THEN max(abs(close))=0 ELSE max(abs(tick_volume))=0 END AS all_zero
FROM bars, (VALUES ('close'),('tick_volume'),('real_volume'),('spread')) u(c) GROUP BY 1, 2""")
def _(spark, sf):
    return quality.zero_columns(market.bars_d1(spark, sf), ("close", "tick_volume", "real_volume", "spread"))


@query("p2_gap_segment", ctes("bars") + f""",
g AS (SELECT *, time - lag(time) OVER (PARTITION BY symbol ORDER BY time) AS gap FROM bars),
s AS (SELECT symbol, coalesce(max(time) FILTER (WHERE gap > 2), min(time)) AS t0 FROM g GROUP BY 1)
SELECT symbol, time, {r('close')} AS close FROM g JOIN s USING (symbol) WHERE time >= t0""")
def _(spark, sf):
    d = quality.newest_segment(market.bars_d1(spark, sf), max_gap_days=2)
    return d.select("symbol", "time", r6("close").alias("close"))


MACRO = tuple(market.PRIORITY_SERIES.values())
FILL_SQL = lambda c, by="", order="time": (
    f"coalesce(last_value({c} IGNORE NULLS) OVER ({by} ORDER BY {order} ROWS UNBOUNDED PRECEDING), "
    f"first_value({c} IGNORE NULLS) OVER ({by} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
SQL_MACRO = ", ".join(f'"{c}"' for c in MACRO)


@query("p3_clean_and_fill", ctes("bars") + f""",
x AS (SELECT symbol, time, CASE WHEN tick_volume % 5 = 0 THEN NULL ELSE close END AS x FROM bars)
SELECT symbol, time, {r(FILL_SQL('x', 'PARTITION BY symbol'))} AS x FROM x""")
def _(spark, sf):
    b = market.bars_d1(spark, sf)
    bad = (F.when(F.col("tick_volume") % 10 == 0, float("inf")).when(F.col("tick_volume") % 5 == 0, float("nan"))
           .otherwise(F.col("close")))
    d = series.clean_non_finite(b.withColumn("x", bad), ["x"])
    return series.fill(d, ["x"]).select("symbol", "time", r6("x").alias("x"))


@query("p4_macro_fill", ctes("macro") + " SELECT date, " + ", ".join(
    f'{r(FILL_SQL(chr(34) + c + chr(34), "", "date"), 10)} AS "{c}"' for c in MACRO) + " FROM macro")
def _(spark, sf):
    m = market.macro_daily(spark, sf).withColumns({"_all": F.lit(0), "_pos": series.day_number("date")})
    d = series.fill(m, MACRO, keys=["_all"], pos="_pos")
    return d.select("date", *[r6(c, 10).alias(c) for c in MACRO])


@query("p5_simple_return", ctes("rets") + f" SELECT symbol, time, {r('ret', 9)} AS ret FROM rets")
def _(spark, sf):
    return series.simple_return(market.bars_d1(spark, sf)).select("symbol", "time", r6("ret", 9).alias("ret"))


@query("p6_log_return", ctes("rets") + f" SELECT symbol, time, {r('log_ret', 9)} AS log_ret FROM rets")
def _(spark, sf):
    return series.log_return(market.bars_d1(spark, sf)).select("symbol", "time", r6("log_ret", 9).alias("log_ret"))


# A universe of names for the taxonomy queries.
NAMES = ("EURUSD", "SP500_H4", "XAUUSD", "WTI", "Oro", "ECH", "USDJPY_H1", "NAS100", "XBRUSD", "plata", "IPSA", "DE40")


def _universe(spark, sf):
    names = F.array(*[F.lit(n) for n in NAMES])
    return (market.table(spark, sf, "orders").groupBy((F.col("o_custkey") % len(NAMES)).alias("k"))
            .agg(F.count(F.lit(1)).alias("n_orders"))
            .select(F.get(names, F.col("k").cast("int")).alias("symbol"), "n_orders"))


SQL_UNIVERSE = (f"uni AS (SELECT list_extract({list(NAMES)!r}, CAST(o_custkey%{len(NAMES)}+1 AS BIGINT)) AS symbol, "
                "count(*) AS n_orders FROM orders GROUP BY 1)")
# The class words, banks and tickers of `features` and `screen`, repeated for an independent check.
_FX = ["EUR", "USD", "GBP", "JPY", "AUD", "NZD", "CAD", "CHF", "MXN", "NOK", "SEK", "SGD"]


def _has(words):
    return "(" + " OR ".join(f"contains(b, '{w}')" for w in words) + ")"


@query("p7_feature_banks", f"""
WITH {SQL_UNIVERSE}, b AS (SELECT symbol, upper(split_part(symbol, '_', 1)) AS b FROM uni),
k AS (SELECT symbol, CASE WHEN {_has(_FX)} AND NOT {_has(['SP500', 'US500', 'NAS100', 'US100'])} THEN 'fx'
      WHEN {_has(['SP500', 'US500', 'NAS100', 'US100', 'GER40', 'DE40', 'UK100', 'JPN225', 'IPSA'])} THEN 'index'
      WHEN {_has(['ORO', 'XAUUSD', 'PLATA', 'XAGUSD'])} THEN 'metal'
      WHEN {_has(['WTI', 'XTIUSD', 'XBRUSD', 'BRENT'])} THEN 'energy' ELSE 'other' END AS asset_class FROM b),
t AS (SELECT * FROM (VALUES
 ('Precio_Puro',0,'open_FFD'),('Precio_Puro',1,'high_FFD'),('Precio_Puro',2,'low_FFD'),
 ('Precio_Volumen',0,'open_FFD'),('Precio_Volumen',1,'high_FFD'),('Precio_Volumen',2,'low_FFD'),('Precio_Volumen',3,'tick_volume'),
 ('Tecnicos',0,'MACD_Hist'),('Tecnicos',1,'RSI'),('Tecnicos',2,'ATR'),('Tecnicos',3,'EGARCH_Vol'),
 ('Hibrido_Precio_Tec_Vol',0,'open_FFD'),('Hibrido_Precio_Tec_Vol',1,'high_FFD'),('Hibrido_Precio_Tec_Vol',2,'low_FFD'),
 ('Hibrido_Precio_Tec_Vol',3,'MACD_Hist'),('Hibrido_Precio_Tec_Vol',4,'RSI'),('Hibrido_Precio_Tec_Vol',5,'ATR'),
 ('Hibrido_Precio_Tec_Vol',6,'EGARCH_Vol'),('Hibrido_Precio_Tec_Vol',7,'tick_volume')) v(bank, position, col)),
s AS (SELECT * FROM (VALUES ('fx','Macros',0,'Yield10Y_FFD'),('index','Macros',0,'Yield10Y_FFD'),('other','Macros',0,'Yield10Y_FFD'),
 ('metal','Macros',0,'Yield10Y_FFD'),('metal','Macros',1,'DXY_close_FFD'),('energy','Macros',0,'DXY_close_FFD'),
 ('fx','Globales',0,'DXY_close_FFD'),('fx','Globales',1,'VIX_close'),('index','Globales',0,'VIX_close'),('index','Globales',1,'DXY_close_FFD'),
 ('other','Globales',0,'VIX_close'),('other','Globales',1,'DXY_close_FFD'),('metal','Globales',0,'VIX_close'),
 ('energy','Globales',0,'VIX_close')) v(asset_class, bank, position, col))
SELECT symbol, asset_class, bank, position, col AS column FROM k, t
UNION ALL SELECT symbol, asset_class, bank, position, col FROM k JOIN s USING (asset_class)""")
def _(spark, sf):
    return features.bank_columns(_universe(spark, sf).select("symbol"))


@query("p8_asset_parameters", ctes("vol") + """
SELECT symbol, k_up, k_down, cost, bilateral, count(*) AS n_rows FROM vol GROUP BY ALL""")
def _(spark, sf):
    return (market.with_params(market.bars_d1(spark, sf))
            .groupBy("symbol", "k_up", "k_down", "cost", "bilateral").agg(F.count(F.lit(1)).alias("n_rows")))


@query("p15_business_days", """
WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders),
s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS time FROM b)
SELECT time, n_orders FROM s LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS time, count(*) AS n_orders FROM orders GROUP BY 1)
USING (time) WHERE isodow(time) < 6""")
def _(spark, sf):
    o = market.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("time"))
    span = o.agg(F.min("time").alias("a"), F.max("time").alias("z"))
    spine = span.select(F.explode(F.sequence("a", "z")).alias("time")).filter(F.weekday("time") < 5)
    return spine.join(o.groupBy("time").agg(F.count(F.lit(1)).alias("n_orders")), "time", "left")


@query("p16_status_range_filter", ctes("journal") + f"""
SELECT order_no, timestamp, {r('probability')} AS probability FROM journal
WHERE status='EJECUTADO' AND timestamp BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'""")
def _(spark, sf):
    j = market.journal(spark, sf).filter(
        (F.col("status") == "EJECUTADO")
        & F.col("timestamp").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")))
    return j.select("order_no", "timestamp", r6("probability").alias("probability"))


@query("p17_column_normalise", """
SELECT event_id AS id, date_trunc('day', ts) AS time, value AS close, user_id AS real_volume, user_id AS tick_volume,
       CAST(0 AS DOUBLE) AS spread, value AS adj_close FROM events""")
def _(spark, sf):
    raw = market.table(spark, sf, "events").select(
        F.col("event_id").alias("Id"), F.col("ts").alias("Time"), F.col("value").alias("Close"),
        F.col("user_id").alias("Volume"), F.col("value").alias("Adj Close"))
    d = ingest.normalise_download(raw)
    return d.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("p18_drop_null_rows", ctes("macro") + f"""
SELECT date, {", ".join(f'{r(chr(34) + c + chr(34), 10)} AS "{c}"' for c in MACRO)} FROM macro
WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in MACRO)}""")
def _(spark, sf):
    return market.macro_daily(spark, sf).na.drop("any").select("date", *[r6(c, 10).alias(c) for c in MACRO])


def _joined_macro(table, key):
    fills = ", ".join(f'{r(FILL_SQL(chr(34) + c + chr(34), "PARTITION BY symbol"), 10)} AS "{c}"' for c in MACRO)
    return f""",
j AS (SELECT b.symbol, b.time, b.close, {SQL_MACRO} FROM {table} b LEFT JOIN macro m ON m.date = {key})
SELECT symbol, time, {r('close')} AS close, {fills} FROM j"""


@query("j1_bars_macro", ctes("bars", "macro") + _joined_macro("bars", "b.time"))
def _(spark, sf):
    d = ingest.join_macro(market.bars_d1(spark, sf), market.macro_daily(spark, sf), MACRO)
    return d.select("symbol", "time", r6("close").alias("close"), *[r6(c, 10).alias(c) for c in MACRO])




@query("j2_intraday_macro", ctes("h4", "macro") + """,
k AS (SELECT *, CAST(time AS DATE) AS d FROM h4),
f AS (SELECT k.symbol, k.time, k.close, m.n_orders, m.avg_price FROM k LEFT JOIN (SELECT CAST(o_orderdate AS DATE) + 8766 AS date,
      count(*) AS n_orders, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) m ON m.date = k.d)
SELECT symbol, time, close, """ + r(FILL_SQL("avg_price", "PARTITION BY symbol"), 9) + " AS macro FROM f")
def _(spark, sf):
    """The order dates lie years before the ticks, so the macro series is moved by 8766 days."""
    from tidebar.operators.series import with_bar_idx
    m = (market.table(spark, sf, "orders")
         .groupBy(F.date_add(F.col("o_orderdate").cast("date"), 8766).alias("date"))
         .agg(F.avg("o_totalprice").alias("macro")))
    b = with_bar_idx(ingest.bars_from_ticks(market.ticks(spark, sf), "H4"))
    d = ingest.join_macro(b, m, ["macro"])
    return d.select("symbol", ntz("time", "time"), "close", r6("macro", 9).alias("macro"))


@query("j3_asof_join", ctes("bars", "macro") + f""",
v AS (SELECT date AS time, "VIX_close" AS v FROM macro WHERE "VIX_close" IS NOT NULL)
SELECT b.symbol, b.time, {r('coalesce(v.v, (SELECT min_by(v, time) FROM v))', 10)} AS vix
FROM bars b ASOF LEFT JOIN v ON b.time >= v.time""")
def _(spark, sf):
    """Right side: days with a value.  Left side: every bar; order is by time inside each symbol."""
    left = market.bars_d1(spark, sf).select("symbol", "time")
    v = market.macro_daily(spark, sf).filter("VIX_close is not null").select(
        F.col("date").alias("time"), F.col("VIX_close").alias("vix"))
    d = ingest.asof_backward(left, v, ["vix"])
    return d.select("symbol", "time", r6("vix", 10).alias("vix"))


@query("j4_calendar_spine", ctes("macro") + """,
b AS (SELECT min(date) AS a, max(date) AS z FROM macro),
s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS time FROM b),
f AS (SELECT s.time, """ + SQL_MACRO + """ FROM s LEFT JOIN macro ON date = s.time WHERE isodow(s.time) < 6)
SELECT time, """ + ", ".join(f'{r(FILL_SQL(chr(34) + c + chr(34)), 10)} AS "{c}"' for c in MACRO) + " FROM f")
def _(spark, sf):
    m = market.macro_daily(spark, sf)
    span = m.agg(F.min("date").alias("a"), F.max("date").alias("z"))
    spine = span.select(F.explode(F.sequence("a", "z")).alias("time")).filter(F.weekday("time") < 5)
    d = ingest.spine_join(spine, m, MACRO)
    return d.select("time", *[r6(c, 10).alias(c) for c in MACRO])


@query("w23_publication_lag", ctes("bars") + f"""
SELECT symbol, time, {r('lag(close,3) OVER (PARTITION BY symbol ORDER BY bar_idx)')} AS close_lag3 FROM bars""")
def _(spark, sf):
    d = series.lagged(market.bars_d1(spark, sf), ["close"], 3, suffix="_lag3")
    return d.select("symbol", "time", r6("close_lag3").alias("close_lag3"))


@query("a1_null_profile", ctes("journal") + """
SELECT 'risk_usd' AS column, count(*) FILTER (WHERE risk_usd IS NULL) AS n_null,
       round(100.0*count(*) FILTER (WHERE risk_usd IS NULL)/count(*), 6)+0.0 AS pct_null FROM journal
UNION ALL SELECT 'probability', count(*) FILTER (WHERE probability IS NULL), 0.0 FROM journal""")
def _(spark, sf):
    d = quality.null_profile(market.journal(spark, sf), ["risk_usd", "probability"])
    return d.select("column", "n_null", r6("pct_null").alias("pct_null"))


@query("a2_date_range", ctes("bars") + """
SELECT symbol, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time FROM bars GROUP BY 1""")
def _(spark, sf):
    return quality.date_range(market.bars_d1(spark, sf))


@query("a3_continuity", ctes("bars") + """,
g AS (SELECT *, time - lag(time) OVER (PARTITION BY symbol ORDER BY time) AS gap FROM bars)
SELECT symbol, count(*) AS n_rows, coalesce(max(gap), 0) AS max_gap, min(time) AS first_time, max(time) AS last_time,
       coalesce(max(gap), 0) > 2 AS has_gap FROM g GROUP BY 1""")
def _(spark, sf):
    return quality.continuity(market.bars_d1(spark, sf), max_gap_days=2)


@query("f1_math_functions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(l_extendedprice), 6)+0.0 AS ln_p, round(exp(l_discount), 6)+0.0 AS exp_d,
       round(sqrt(l_quantity), 6)+0.0 AS sqrt_q, round(abs(l_tax-0.04), 6)+0.0 AS abs_t, round(pow(1+l_discount, 3), 6)+0.0 AS pow_d,
       greatest(10.0::DOUBLE, least(40.0::DOUBLE, l_quantity)) AS clip_q, CAST(floor(l_extendedprice/100) AS BIGINT) AS floor_p FROM lineitem""")
def _(spark, sf):
    from tidebar.functions.expr import clip
    t = market.table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.ln("l_extendedprice")).alias("ln_p"),
                    r6(F.exp("l_discount")).alias("exp_d"), r6(F.sqrt("l_quantity")).alias("sqrt_q"),
                    r6(F.abs(F.col("l_tax") - 0.04)).alias("abs_t"),
                    r6(F.pow(1 + F.col("l_discount"), F.lit(3))).alias("pow_d"),
                    clip(F.col("l_quantity"), 10.0, 40.0).alias("clip_q"),
                    F.floor(F.col("l_extendedprice") / 100).alias("floor_p"))


@query("f2_date_functions", """
SELECT event_id, CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS parsed, date_trunc('day', ts) AS day,
       make_timestamp(CAST(floor(epoch(ts)) AS BIGINT)*1000000) AS from_epoch,
       date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_diff FROM events""")
def _(spark, sf):
    e = market.table(spark, sf, "events")
    t = F.col("ts").cast("timestamp")
    return e.select("event_id", F.to_date(F.date_format("ts", "yyyy-MM-dd")).alias("parsed"),
                    ntz(F.date_trunc("day", t), "day"), ntz(F.timestamp_seconds(F.unix_seconds(t)), "from_epoch"),
                    F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day_diff"))


@query("f3_string_functions", f"""
WITH {SQL_UNIVERSE}
SELECT symbol, upper(split_part(symbol,'_',1)) AS base, CASE WHEN contains(symbol,'H4') THEN 'H4' WHEN contains(symbol,'H1') THEN 'H1'
       ELSE 'D1' END AS timeframe, regexp_replace(concat(symbol,'_daily.csv'), '_daily\\.csv$', '') AS stem, n_orders FROM uni""")
def _(spark, sf):
    s = F.col("symbol")
    return _universe(spark, sf).select(
        "symbol", F.upper(F.split(s, "_")[0]).alias("base"),
        F.when(s.contains("H4"), "H4").when(s.contains("H1"), "H1").otherwise("D1").alias("timeframe"),
        F.regexp_replace(F.concat(s, F.lit("_daily.csv")), r"_daily\.csv$", "").alias("stem"), "n_orders")


@query("f4_coerce_numeric", """
SELECT event_id, TRY_CAST(CASE WHEN event_id%3=0 THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x FROM events""")
def _(spark, sf):
    e = market.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", text.alias("t")).select("event_id", F.expr("try_cast(t as double)").alias("x"))


@query("f5_array_dot", ctes("bars") + f"""
SELECT symbol, time, {r('0.5*close + 0.3*open + 0.2*low')} AS dot FROM bars""")
def _(spark, sf):
    from tidebar.functions.expr import dbl, dot
    w = F.array(dbl(0.5), dbl(0.3), dbl(0.2))
    return market.bars_d1(spark, sf).select("symbol", "time", r6(dot(w, F.array("close", "open", "low"))).alias("dot"))


@query("f6_json_functions", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    e = market.table(spark, sf, "events")
    k = F.from_json("props", "k bigint")["k"]
    text = F.to_json(F.struct(k.alias("k")))
    return e.select("event_id", F.from_json(text, "k bigint")["k"].alias("k"))


@query("r1_sort_by_time", ctes("bars") + f"""
SELECT symbol, time, {r('close')} AS close FROM bars ORDER BY symbol, time""")
def _(spark, sf):
    return market.bars_d1(spark, sf).select("symbol", "time", r6("close").alias("close")).orderBy("symbol", "time")


@query("u1_union_all", """
SELECT 'order' AS kind, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'tick', CAST(ts AS DATE), count(*) FROM events GROUP BY 2""")
def _(spark, sf):
    one = lambda t, c, k: (market.table(spark, sf, t).groupBy(F.col(c).cast("date").alias("date"))
                           .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)))
    return one("orders", "o_orderdate", "order").unionByName(one("events", "ts", "tick"))


@query("r5_candidate_list", """
WITH s AS (SELECT CAST(o_custkey%40 AS BIGINT) AS k, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT unnest(['EURUSD','GBPUSD','USDJPY','AUDUSD','NZDUSD','USDCAD','USDCHF','EURGBP','EURJPY','GBPJPY','XAUUSD','XAGUSD',
 'SP500','US500','NAS100','US100','GER40','DE40','UK100','WTI','XTIUSD','XBRUSD']) AS symbol, generate_subscripts([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22],1) AS seq),
names AS (SELECT k, CASE WHEN k%2=0 AND k/2+1<=20 THEN (SELECT symbol FROM p WHERE seq=k/2+1) ELSE concat('SYM',k) END AS symbol FROM s),
pri AS (SELECT symbol, tf AS timeframe, 0 AS tier, seq FROM names JOIN p USING (symbol), (VALUES ('D1'),('H4')) t(tf)
        WHERE tf='D1' OR symbol IN ('EURUSD','SP500','US500','XAUUSD')),
oth AS (SELECT symbol, 'D1' AS timeframe, 1 AS tier, k AS seq FROM names WHERE symbol LIKE 'SYM%' AND k%3<>0),
u AS (SELECT *, row_number() OVER (ORDER BY tier, seq, timeframe) AS position FROM (SELECT * FROM pri UNION ALL SELECT * FROM oth))
SELECT position, CASE WHEN timeframe='D1' THEN symbol ELSE concat(symbol,'_',timeframe) END AS name, symbol, timeframe
FROM u WHERE tier=0 OR position<=25""")
def _(spark, sf):
    from tidebar.operators.screen import PRIORITY, prioritise
    k = F.col("k")
    s = (market.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    listed = F.array(*[F.lit(t) for t in PRIORITY[:20]])
    name = F.when((k % 2 == 0) & (k < 40), F.get(listed, (k / 2).cast("int"))).otherwise(
        F.concat(F.lit("SYM"), k.cast("string")))
    return prioritise(s.select(name.alias("symbol"), (k % 3 != 0).alias("visible"), k.alias("listing_no")), max_candidates=25)
