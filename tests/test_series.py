"""Block and scan primitives against plain pandas, over several blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import indicators, series, volatility


def collect(df, *cols, keys=("symbol", "bar_idx")):
    return df.select(*keys, *cols).toPandas().sort_values(list(keys)).reset_index(drop=True)


def per_symbol(pdf, fn):
    return np.concatenate([np.asarray(fn(g)) for _, g in pdf.sort_values(["symbol", "bar_idx"]).groupby("symbol")])


def test_bar_idx_is_dense_and_counts(spark, long_walk):
    d = spark.createDataFrame(long_walk.drop(columns=["bar_idx", "n_bars"]).sample(frac=1, random_state=1))
    got = series.with_bar_idx(d).select("symbol", "time", "bar_idx", "n_bars").toPandas().sort_values(["symbol", "bar_idx"])
    want = long_walk.sort_values(["symbol", "bar_idx"])
    assert (got["bar_idx"].to_numpy() == want["bar_idx"].to_numpy()).all()
    assert (got["time"].to_numpy() == want["time"].to_numpy()).all()
    assert (got["n_bars"].to_numpy() == want["n_bars"].to_numpy()).all()


@pytest.mark.parametrize("span", [3, 12, 26])
def test_ema_equals_recursion(spark, long_walk, span):
    got = collect(indicators.ema(spark.createDataFrame(long_walk), indicators.span_alpha(span)), "ema")
    want = per_symbol(long_walk, lambda g: g["close"].ewm(span=span, adjust=False).mean())
    assert np.allclose(got["ema"], want, rtol=1e-11)


def test_macd_rsi_atr(spark, long_walk):
    got = collect(indicators.add_indicators(spark.createDataFrame(long_walk)), "MACD", "MACD_Signal", "RSI", "ATR")

    def ref(g):
        c = g["close"]
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        dx = c.diff()
        up = dx.where(dx > 0, 0.0).ewm(alpha=1 / 14, adjust=False).mean()
        dn = (-dx.where(dx < 0, 0.0)).ewm(alpha=1 / 14, adjust=False).mean().replace(0, 1e-10)
        tr = pd.concat([g["high"] - g["low"], (g["high"] - c.shift()).abs(), (g["low"] - c.shift()).abs()], axis=1).max(axis=1)
        return np.column_stack([macd, macd.ewm(span=9, adjust=False).mean(), 100 - 100 / (1 + up / dn),
                                tr.ewm(alpha=1 / 14, adjust=False).mean()])
    want = per_symbol(long_walk, ref)
    assert np.allclose(got[["MACD", "MACD_Signal", "RSI", "ATR"]], want, rtol=1e-8, atol=1e-10)


def test_indicator_properties(spark, clean):
    d = indicators.add_indicators(spark.createDataFrame(clean)).toPandas()
    assert d["RSI"].between(0, 100).all() and (d["ATR"] > 0).all()
    assert not d[["MACD_Hist", "RSI", "ATR"]].isna().any().any() and len(d) == len(clean)
    with pytest.raises(ValueError):
        indicators.add_indicators(spark.createDataFrame(clean[["symbol", "bar_idx", "close"]]))


def test_rolling_and_returns(spark, long_walk):
    d = spark.createDataFrame(long_walk)
    got = collect(series.sma(d, 200), "sma")["sma"]
    assert np.allclose(got, per_symbol(long_walk, lambda g: g["close"].rolling(200).mean()), equal_nan=True)
    got = collect(volatility.hist_vol(d), "hist_vol")["hist_vol"].astype(float)

    def ref(g):
        lr = (100 * np.log(g["close"]).diff()).fillna(0)
        return lr.rolling(500).std().shift(1)
    assert np.allclose(got, per_symbol(long_walk, ref), equal_nan=True)


def test_equity_and_drawdown_across_blocks(spark, long_walk):
    d = series.simple_return(spark.createDataFrame(long_walk))
    got = collect(series.equity(d), "cum_ret", "drawdown")

    def ref(g):
        eq = (1 + g["close"].pct_change().fillna(0)).cumprod()
        return np.column_stack([eq, eq / eq.cummax() - 1])
    want = per_symbol(long_walk, ref)
    assert np.allclose(got[["cum_ret", "drawdown"]], want, atol=1e-10)
    mdd = series.path_summary(d).toPandas().set_index("symbol")["mdd"]
    for sym, g in long_walk.groupby("symbol"):
        assert mdd[sym] == pytest.approx(ref(g)[:, 1].min(), abs=1e-10)


def test_fill_carries_over_empty_blocks(spark):
    n = 12000
    x = np.full(n, np.nan)
    x[[5, 4500, 11999]] = [1.0, 2.0, 3.0]
    pdf = pd.DataFrame({"symbol": "A", "bar_idx": np.arange(n), "x": x})
    d = series.clean_non_finite(spark.createDataFrame(pdf), ["x"])
    got = collect(series.fill(d, ["x"], size=512), "x")["x"]
    assert (got == pdf["x"].ffill().bfill()).all()
    got = collect(series.fill(d, ["x"], size=512, backfill=False), "x")["x"]
    assert got.isna().sum() == 5


def test_affine_path(spark):
    rng = np.random.default_rng(3)
    m = np.where(rng.random(3000) < 0.3, 1 + rng.choice([-0.015, 0.015], 3000), 1.0)
    a = np.where(m == 1, rng.normal(0, 50, 3000), 0.0)
    v, want = 10000.0, []
    for mi, ai in zip(m, a):
        v = mi * v + ai
        want.append(v)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "pos": np.arange(3000), "m": m, "a": a}))
    got = series.affine_path(d, 10000.0, "m", "a", "v", keys=["k"], pos="pos").orderBy("pos").toPandas()["v"]
    assert np.allclose(got, want)


def test_no_window_holds_a_whole_series(spark, long_walk):
    """Ordered windows over bars are partitioned by block, not by symbol alone."""
    d = spark.createDataFrame(long_walk)
    plan = indicators.add_indicators(d)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition" in line:
            assert "_blk" in line.split("windowspecdefinition", 1)[1]


def test_volatility_chain_properties(spark):
    from conftest import walk
    noisy = walk(42, 620, 0.0, 0.02, 100.0)
    d = volatility.conditional_vol(spark.createDataFrame(noisy.drop(columns="EGARCH_Vol"))).toPandas()
    assert len(d) == 120 and (d["EGARCH_Vol"] > 0).all() and not d["EGARCH_Vol"].isna().any()
    v = spark.createDataFrame([(7.0, 0.9, 2.0), (None, 9.0, 6.5), (0.7, 1.0, 2.0), (float("nan"), 1e-9, 1.5)], "a double, b double, c double")
    got = [r[0] for r in v.select(volatility.choose(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [0.9, 6.5, 0.7, 1.5]


def test_volatility_tracks_regime():
    rng = np.random.default_rng(0)
    calm, wild = rng.normal(0, 0.3, 600), rng.normal(0, 1.5, 60)
    eg, ga = volatility.forecast_rows(np.concatenate([calm, wild]), 500, both=True)
    assert eg[-1] > 2 * eg[90] and ga[-1] > 2 * ga[90]
