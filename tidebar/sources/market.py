"""Market tables derived from the generic test tables (the data holds no price bars).

Every frame here is declared lazily over the parquet scans, so its work grows with the tables; only
the needed columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidebar.functions.expr import dbl

OOS_PARTS = 5  # the newest fifth of each series is out of sample

# Model and bank numbers of the deterministic score table.
MODELS = ("RANDOM_FOREST", "XGBOOST")
BANKS = ("Precio_Puro", "Tecnicos")
PRIORITY_SERIES = {"1-URGENT": "VIX_close", "2-HIGH": "DXY_close", "3-MEDIUM": "Yield10Y", "4-NOT SPECIFIED": "Copper",
                   "5-LOW": "EMBI"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, symbol = return flag + line status.

    The line items are reduced to one row per (symbol, day) with map-side combine before anything
    is ordered, so a series is bounded by the calendar (some 2,500 days) at any scale factor.
    """
    day = (table(spark, sf_dir, "lineitem")
           .select(F.concat("l_returnflag", "l_linestatus").alias("symbol"),
                   F.col("l_shipdate").cast("date").alias("time"), "l_discount")
           .groupBy("symbol", "time")
           .agg(F.avg("l_discount").alias("m"), F.max("l_discount").alias("hi"),
                F.min("l_discount").alias("lo"), F.count(F.lit(1)).alias("tick_volume")))
    w = Window.partitionBy("symbol").orderBy("time")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = 100 * F.exp(F.sum(F.ln(1 + 0.4 * (F.col("m") - 0.05))).over(upto))
    c = day.withColumn("close", close)
    o = c.select(
        "*", F.coalesce(F.lag("close").over(w), F.col("close")).alias("open"),
        (F.row_number().over(w) - 1).cast("long").alias("bar_idx"),
        F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n_bars"))
    return o.select(
        "symbol", "time", "bar_idx", "n_bars", "open",
        (F.greatest("open", "close") * (1 + 0.1 * (F.col("hi") - F.col("m")))).alias("high"),
        (F.least("open", "close") * (1 - 0.1 * (F.col("m") - F.col("lo")))).alias("low"),
        "close", "tick_volume", F.lit(0).cast("long").alias("real_volume"),
        F.lit(0.0).alias("spread"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"),
                    F.col("value").alias("price"), F.col("event_id").alias("tick_id")))


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value): average order value per priority and day."""
    pairs = [x for kv in PRIORITY_SERIES.items() for x in map(F.lit, kv)]
    return (table(spark, sf_dir, "orders")
            .select(F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("o_orderpriority")), F.lit("EMBI")).alias("series"),
                    F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
            .groupBy("series", "date").agg((F.avg("o_totalprice") / 10000).alias("value")))


def macro_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per date with any series; absent values stay NULL."""
    return (macro_long(spark, sf_dir).groupBy("date")
            .pivot("series", list(PRIORITY_SERIES.values())).agg(F.first("value")))


def probs(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Deterministic scores per (symbol, model, bank, bar), from integer arithmetic only."""
    bars = bars_d1(spark, sf_dir) if bars is None else bars
    numbered = (bars.select("symbol").distinct()               # one row per symbol
                .withColumn("symbol_no", F.rank().over(Window.orderBy("symbol")) - 1))
    grid = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_no"),
                              F.lit(b).alias("bank"), F.lit(j).alias("bank_no"))
                     for i, m in enumerate(MODELS) for j, b in enumerate(BANKS)])
    x = (bars.select("symbol", "bar_idx", "n_bars").join(numbered, "symbol")
         .select("symbol", "symbol_no", "bar_idx", "n_bars", F.explode(grid).alias("g")))
    score = (F.col("bar_idx") * 7919 + F.col("symbol_no") * 104729
             + F.col("g.model_no") * 1299709 + F.col("g.bank_no") * 15485863) % 1000
    return x.select("symbol", "g.model", "g.bank", "bar_idx",
                    F.when(is_oos(), "oos").otherwise("train").alias("split"),
                    (score / dbl(1000)).alias("prob"))


def is_oos():
    return F.col("bar_idx") * OOS_PARTS >= F.col("n_bars") * (OOS_PARTS - 1)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live signal journal rows, one per order."""
    k = F.col("o_orderkey")
    p = k * 7919 % 1000 / dbl(1000)
    return (table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("timestamp"), k.alias("order_no"),
        F.concat(F.lit("S"), (k % 8).cast("string")).alias("symbol"),
        F.lit("D1").alias("timeframe"), F.lit("XGBOOST").alias("model_type"),
        p.alias("probability"), F.lit(0.5).alias("threshold"),
        F.when(p > 0.5, "COMPRA (Long)").otherwise("VENTA (Short)").alias("signal"),
        F.when(k % 4 == 0, "CASH").otherwise("EJECUTADO").alias("status"),
        (F.col("o_totalprice") / 1000).alias("price"),
        F.when(k % 10 != 0, F.col("o_totalprice") / 2000).alias("risk_usd")))


# Per-symbol parameters of the derived universe.
PARAMS = (
    # symbol, k_up, k_down, cost, bilateral
    ("NF", 2.5, 1.5, 0.00006, False),
    ("RF", 2.0, 1.5, 0.00010, False),
)
DEFAULT_PARAMS = (2.0, 1.5, 0.00005, True)


def with_params(df: DataFrame, params=PARAMS, default=DEFAULT_PARAMS) -> DataFrame:
    """Attach (k_up, k_down, cost, bilateral) by symbol; unknown symbols get the default row.

    The dimension is a plan constant of a few rows, so it is folded into the projection.
    """
    names = ("k_up", "k_down", "cost", "bilateral")
    out = {}
    for i, name in enumerate(names):
        expr = None
        for row in params:
            cond, val = F.col("symbol") == row[0], F.lit(row[i + 1])
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        out[name] = F.lit(default[i]) if expr is None else expr.otherwise(F.lit(default[i]))
    return df.withColumns(out)
