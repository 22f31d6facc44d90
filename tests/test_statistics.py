"""Differencing, unit roots, ARMA, screening, allocation, features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import allocate, arma, features, fracdiff, models, screen, series


def test_weights():
    assert fracdiff.weights(0.0) == [1.0]
    assert fracdiff.weights(0.4)[0] == 1.0 and fracdiff.weights(1.0) == [1.0, -1.0]


def test_frac_diff_matches_convolution(spark, long_walk):
    got = fracdiff.frac_diff(spark.createDataFrame(long_walk), 0.4).select("symbol", "bar_idx", "close_FFD").toPandas()
    w = np.array(fracdiff.weights(0.4))
    for s, g in long_walk.groupby("symbol"):
        mine = got[got["symbol"] == s].sort_values("bar_idx")["close_FFD"].to_numpy(float)
        want = np.convolve(g["close"], w, "valid")
        assert np.isnan(mine[:len(w) - 1]).all() and np.allclose(mine[len(w) - 1:], want)


def plain_adf(x):
    """Textbook regression with the same lag rule, by a generic least-squares solver."""
    n, dx = len(x), np.diff(x)
    lags = fracdiff.max_lag(n)

    def fit(k, start):
        t = np.arange(start, len(dx))
        cols = [np.ones(len(t)), x[t]] + [dx[t - j] for j in range(1, k + 1)]
        a = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(a, dx[t], rcond=None)
        res = dx[t] - a @ beta
        ssr = res @ res
        se = np.sqrt(ssr / (len(t) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        return len(t) * np.log(ssr / len(t)) + 2 * a.shape[1], beta[1] / se
    best = min(range(lags + 1), key=lambda k: fit(k, lags)[0])
    return best, fit(best, best)[1]


def test_adf_matches_plain_regression(spark):
    rng = np.random.default_rng(11)
    walk = np.cumsum(rng.normal(0, 1, 5000)) + 100
    ar = np.zeros(700)
    for t in range(1, 700):
        ar[t] = 0.6 * ar[t - 1] + rng.normal()
    frames = [pd.DataFrame({"symbol": s, "column": "x", "bar_idx": np.arange(len(v)), "n_bars": len(v), "value": v})
              for s, v in (("walk", walk), ("ar", ar))]
    got = {r.symbol: r for r in fracdiff.adf(spark.createDataFrame(pd.concat(frames))).collect()}
    for s, v in (("walk", walk), ("ar", ar)):
        lag, tau = plain_adf(v)
        assert got[s].best_lag == lag and got[s].tau == pytest.approx(tau, rel=1e-6)
    assert got["ar"].p_value < 0.01 < 0.05 < got["walk"].p_value


def test_p_value_known_points():
    """Published 1, 5 and 10 % large-sample values of the constant-only case."""
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert fracdiff.p_value(tau) == pytest.approx(p, rel=0.03)


def test_min_d_keeps_memory(spark):
    rng = np.random.default_rng(42)
    x = np.cumsum(rng.normal(0, 1, 1500)) + 100
    pdf = pd.DataFrame({"symbol": "A", "bar_idx": np.arange(1500), "n_bars": 1500, "close": x, "RSI": 50.0})
    d = spark.createDataFrame(pdf)
    r = fracdiff.min_stationary_d(fracdiff.melt(d, ["close"])).first()
    assert 0 < r.d <= 1 and r.corr > 0.5
    out = fracdiff.apply_ffd(d, ["close", "RSI"]).toPandas()
    assert "close_FFD" in out and "RSI" in out and "RSI_FFD" not in out and "close" in out
    w = np.array(fracdiff.weights(fracdiff.D_GRID[r.d_no]))
    assert np.allclose(out.sort_values("bar_idx")["close_FFD"], np.convolve(x, w, "valid"))


def test_arma_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    e, x = rng.normal(0, 1, 8000), np.zeros(8000)
    for t in range(1, 8000):
        x[t] = 0.5 * x[t - 1] + e[t] + 0.3 * e[t - 1]
    d = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_idx": np.arange(8000), "n_bars": 8000, "x": x}))
    orders = arma.fit_orders(d, "x")
    row = orders.filter("p = 1").first()
    assert row.phi[0] == pytest.approx(0.5, abs=0.06) and row.theta[0] == pytest.approx(0.3, abs=0.06)
    res = arma.one_step_residuals(d, "x", 0.0, (0.5,), 0.3).orderBy("bar_idx").toPandas()["resid"].to_numpy()
    want, prev = [0.0], 0.0
    for t in range(1, 8000):
        prev = x[t] - 0.5 * x[t - 1] - 0.3 * prev
        want.append(prev)
    assert np.allclose(res, want)


def test_hurst_short_series_and_trend(spark):
    n = 1000
    trend = pd.DataFrame({"symbol": "T", "bar_idx": np.arange(n), "n_bars": n, "close": 100 + np.arange(n) * 0.5})
    short = pd.DataFrame({"symbol": "S", "bar_idx": np.arange(50), "n_bars": 50, "close": np.arange(50) + 1.0})
    got = {r.symbol: r.hurst for r in screen.hurst(spark.createDataFrame(pd.concat([trend, short]))).collect()}
    assert got["S"] == 0.5 and got["T"] > 0.9


def test_greedy_keeps_candidate_order(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "symbol string, rank int")
    corr = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.95), ("a", "c", 0.1), ("c", "d", 0.85)], "a string, b string, corr double")
    assert [r.symbol for r in screen.greedy_decorrelate(ranked, corr).orderBy("pos").collect()] == ["a", "c"]


def test_priority_list(spark):
    rows = [("WTI", True, 0), ("ZZZ", True, 1), ("EURUSD", False, 2), ("HID", False, 3)]
    got = [r.name for r in screen.prioritise(spark.createDataFrame(rows, "symbol string, visible boolean, listing_no long")).orderBy("position").collect()]
    assert got == ["EURUSD", "EURUSD_H4", "WTI", "ZZZ"]


def test_hrp_two_assets_closed_form():
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    w = allocate.hrp_weights(cov, np.array([[1, 0.17], [0.17, 1]]))
    assert np.allclose(w, [0.09 / 0.13, 0.04 / 0.13])


def test_hrp_invariants_and_leaf_order(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(1000, 4))
    x[:, 2] = x[:, 0] + rng.normal(size=1000) * 0.1
    corr = np.corrcoef(x.T)
    order = allocate.leaf_order(np.sqrt((1 - corr) / 2))
    assert abs(order.index(0) - order.index(2)) == 1
    w = allocate.hrp_weights(np.cov(x.T), corr)
    assert w.sum() == pytest.approx(1) and (w > 0).all() and w[0] + w[2] < w[1] + w[3]


def test_shrink_bounds(spark):
    rows = [(1, s, h, p, 3) for s, h, p in (("a", 0.9, 0.98), ("b", 0.05, 0.01), ("c", 0.05, 0.01))]
    d = spark.createDataFrame(rows, "window_id int, strategy string, hrp double, perf double, n_valid int")
    w = {r.strategy: r.weight for r in allocate.shrink(d, "hrp").collect()}
    assert sum(w.values()) == pytest.approx(1) and w["a"] == pytest.approx(0.55 / 0.65) and w["b"] == w["c"]


def test_weights_wait_for_first_window(spark):
    """Before any window, and where only one strategy moves, weights are 1/N."""
    days = pd.date_range("2020-01-01", periods=130).date
    pdf = pd.concat([pd.DataFrame({"date": days, "strategy": s, "ret": r}) for s, r in
                     (("a", np.random.default_rng(1).normal(0, .01, 130)), ("b", np.zeros(130)))])
    d = allocate.numbered_returns(spark.createDataFrame(pdf))
    w, t = allocate.rebalance(d)
    held = allocate.hold_weights(d, w, t).toPandas()
    assert w.count() == 0 and (held["w_main"] == 0.5).all() and len(held) == 60


def test_active_weights(spark):
    act = spark.createDataFrame([("a",), ("b",)], "symbol string")
    w = spark.createDataFrame([("a", 0.2), ("z", 0.8)], "symbol string, weight double")
    got = {r.symbol: r.norm_weight for r in allocate.active_weights(act, w).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    none = spark.createDataFrame([("z", 1.0)], "symbol string, weight double")
    assert {r.norm_weight for r in allocate.active_weights(act, none).collect()} == {0.5}


def test_lag_windows(spark, clean):
    d = features.lag_windows(spark.createDataFrame(clean), ["close", "open"], label=None, look_back=60)
    got = d.orderBy("bar_idx").select("bar_idx", "window").toPandas()
    assert len(got) == 540
    want = clean[["close", "open"]].to_numpy()[:60].ravel()
    assert np.allclose(got.iloc[0]["window"], want)


def test_asset_classes(spark):
    names = {"EURUSD": "fx", "SP500_H4": "index", "XAUUSD": "fx", "Oro": "metal", "WTI": "energy", "ECH": "other", "XTIUSD": "fx"}
    d = spark.createDataFrame([(n,) for n in names], "symbol string")
    got = {r.symbol: r.c for r in d.select("symbol", features.asset_class(F.col("symbol")).alias("c")).collect()}
    assert got == names


def test_search_and_importance(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, 6))
    pdf = pd.DataFrame({"symbol": "A", "bar_idx": range(400), "n_bars": 400, "Label": (x[:, 0] + x[:, 1] > 0).astype(int), "w": list(map(list, x))})
    d = features.as_vector(spark.createDataFrame(pdf), "w").cache()
    res = models.search(d, "RANDOM_FOREST", 6, {"numTrees": [5], "maxDepth": [2, 4]}, trials=2, idx="bar_idx", n="n_bars").toPandas()
    assert len(res) == 6 and res["score"].between(0, 1).all() and res["params"].str.contains("maxDepth").all()
    m = models.fit(d, "RANDOM_FOREST", 6, numTrees=5, maxDepth=4)
    imp = {r.column: r.importance for r in models.importance(m, ["u", "v"], spark).collect()}
    assert sum(imp.values()) == pytest.approx(1)
    z = m.transform(d.withColumn("features", d.features)).select("scaled").first()[0]
    assert max(abs(z.toArray())) <= 10


def test_unit_root_of_a_long_series_equals_a_plain_regression(spark):
    """150,000 rows: the lag order passes 64, so lags reach over the edge of a block."""
    from tidebar.operators import fracdiff
    y = np.cumsum(np.random.default_rng(3).normal(0, 1, 150_000)) + 100
    pdf = pd.DataFrame({"symbol": "A", "column": "c", "bar_idx": np.arange(len(y)), "n_bars": len(y), "value": y})
    got = fracdiff.adf(spark.createDataFrame(pdf)).first()
    lags = fracdiff.max_lag(len(y))
    assert lags > 66
    dy = np.diff(y)
    rows = np.arange(lags, len(dy))
    x = np.column_stack([np.ones(len(rows)), y[rows], *[dy[rows - k] for k in range(1, lags + 1)]])
    n, aic = len(rows), []
    for k in range(lags + 1):
        res = np.linalg.lstsq(x[:, :2 + k], dy[rows], rcond=None)[1][0]
        aic.append(n * np.log(res / n) + 2 * (k + 2))
    best = int(np.argmin(aic))
    rows = np.arange(best, len(dy))
    x = np.column_stack([np.ones(len(rows)), y[rows], *[dy[rows - k] for k in range(1, best + 1)]])
    beta, res, *_ = np.linalg.lstsq(x, dy[rows], rcond=None)
    tau = beta[1] / np.sqrt(res[0] / (len(rows) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert got["best_lag"] == best and abs(got["tau"] - tau) < 1e-6


def test_screen_takes_every_symbol_and_falls_back_in_symbol_order(spark):
    rng, rows = np.random.default_rng(8), []
    base = rng.normal(0, 0.01, 260)
    for k in range(70):                               # more than one tile
        ret = base if k in (3, 50) else rng.normal(0, 0.01, 260)
        for i, c in enumerate(100 * np.cumprod(1 + ret)):
            rows.append((f"S{k:02d}", i, i, 260, float(c)))
    bars = spark.createDataFrame(rows, "symbol string, time int, bar_idx long, n_bars long, close double")
    got = [r.symbol for r in screen.screen_universe(bars, min_hurst=2.0, max_corr=0.9).orderBy("pos").collect()]
    assert got == [f"S{k:02d}" for k in range(70) if k != 50]
    corr = {(r.a, r.b): r["corr"] for r in screen.correlation(screen.aligned_returns(
        bars.withColumnRenamed("close", "ret"))).collect()}
    assert len(corr) == 70 * 69 // 2 and all(a < b for a, b in corr)
    wide = pd.DataFrame(rows, columns=["s", "t", "i", "n", "c"]).pivot(index="t", columns="s", values="c").corr()
    assert all(abs(v - wide.loc[a, b]) < 1e-9 for (a, b), v in corr.items())


def test_priority_report_is_cut_only_where_asked(spark):
    rows = [(f"X{k:03d}", True, k) for k in range(60)]
    frame = spark.createDataFrame(rows, "symbol string, visible boolean, listing_no long")
    assert screen.prioritise(frame).count() == 60 and screen.prioritise(frame, max_candidates=25).count() == 25
