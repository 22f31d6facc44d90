"""Operators that compose in levels, rounds or buckets, against plain loops."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import allocate, models, monitors, residual_model, screen, series, surrogate, trades, volatility
from tidebar.sources import ingest


@pytest.mark.parametrize("fan", [2, 64])
def test_entry_offsets_of_a_deep_tree_equal_a_chain(spark, monkeypatch, fan):
    monkeypatch.setattr(trades, "FAN", fan)
    rng = np.random.default_rng(fan)
    rows, want = [], {}
    for key in ("a", "b"):
        off, before = 0, -1
        for blk in range(60):
            if rng.random() < 0.15:
                continue
            table = [int(x) for x in rng.integers(0, 5, 5)]
            off = off if blk == before + 1 else 0
            want[key, blk] = off
            off, before = table[off], blk
            rows.append((key, blk, table))
    maps = spark.createDataFrame(rows, "k string, _blk long, _map array<long>")
    got = {(r.k, r["_blk"]): r["_off"] for r in trades.entry_offsets(maps, ["k"], 5).collect()}
    assert got == want


def test_affine_maps_over_many_levels_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(series, "MAPS", 3)
    rng = np.random.default_rng(2)
    m, a = rng.normal(1, 0.05, 3000), rng.normal(0, 1, 3000)
    pdf = pd.DataFrame({"k": 1, "pos": range(3000), "m": m, "a": a})
    got = series.affine_path(spark.createDataFrame(pdf), 100.0, "m", "a", "v", keys=["k"], pos="pos", size=16)
    v, want = 100.0, []
    for x, y in zip(m, a):
        v = v * x + y
        want.append(v)
    assert np.allclose(got.orderBy("pos").toPandas()["v"], want)


def test_range_numbers_do_not_need_even_days(spark):
    rows = [("2020-01-01", k) for k in range(5000)] + [("2020-01-02", k) for k in range(7)]
    d = spark.createDataFrame(rows, "day string, no long").repartition(7)
    got = series.range_index(d, ["day", "no"], "seq", "n").orderBy("seq").collect()
    assert [(r.day, r.no) for r in got] == sorted(rows) and [r.seq for r in got] == list(range(5007))
    assert {r.n for r in got} == {5007}
    assert series.range_index(d.limit(0), ["day", "no"], "seq").count() == 0


def test_greedy_rounds_equal_the_walk_on_many_names(spark):
    rng = np.random.default_rng(3)
    names = [f"n{k:04d}" for k in rng.permutation(2000)]
    pairs = {tuple(sorted(rng.choice(2000, 2, replace=False))) for _ in range(4000)} | {(0, k) for k in range(1, 300)}
    rows = [(names[a], names[b], float(rng.choice([0.9, -0.95, 0.3]))) for a, b in pairs]
    ranked = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "symbol string, rank int")
    got = screen.greedy_decorrelate(ranked, spark.createDataFrame(rows, "a string, b string, corr double"), 0.8).orderBy("pos").collect()
    near = {n: set() for n in names}
    for a, b, c in rows:
        if abs(c) > 0.8:
            near[a].add(b)
            near[b].add(a)
    kept = []
    for n in names:
        if not near[n] & set(kept):
            kept.append(n)
    assert [r.symbol for r in got] == kept and [r.pos for r in got] == list(range(len(kept)))


def test_a_short_series_shortens_only_its_own_pairs(spark):
    rng = np.random.default_rng(4)
    wide = pd.DataFrame(rng.normal(0, 1, (300, 3)), columns=list("abc"))
    wide.loc[20:, "c"] = np.nan
    wide["d"] = np.nan
    wide.loc[295:, "d"] = 1.0
    long = wide.reset_index(names="time").melt("time", var_name="symbol", value_name="ret").dropna()
    got = {(r.a, r.b): (r.n_obs, r["corr"]) for r in screen.correlation(screen.aligned_returns(spark.createDataFrame(long))).collect()}
    want = wide.corr()
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}
    assert got["a", "b"][0] == 300 and got["a", "c"][0] == 20 and got["a", "d"] == (5, None)
    assert all(abs(got[p][1] - want.loc[p]) < 1e-9 for p in (("a", "b"), ("a", "c"), ("b", "c")))


@pytest.mark.parametrize("width", [ingest.DAY, 7 * ingest.DAY, ingest.DAY // 24])
@pytest.mark.parametrize("backfill", [True, False])
def test_asof_equals_a_plain_merge(spark, width, backfill):
    rng = np.random.default_rng(5)
    def times(n):
        return pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24 * 60, n), unit="min")
    left = pd.DataFrame({"k": rng.choice(["x", "y", "z"], 400), "time": times(400), "no": range(400), "v": "old"})
    right = pd.DataFrame({"k": rng.choice(["x", "y"], 60), "time": times(60), "v": rng.normal(size=60)}).drop_duplicates(["k", "time"])
    d = ingest.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["v"], by=["k"], backfill=backfill, width=width)
    got = d.toPandas().set_index("no")["v"].sort_index()
    keys = left.drop(columns="v").sort_values("time")
    want = pd.merge_asof(keys, right.sort_values("time"), on="time", by="k")
    if backfill:
        ahead = pd.merge_asof(keys, right.sort_values("time"), on="time", by="k", direction="forward")
        want["v"] = want["v"].fillna(ahead["v"])
    want = want.set_index("no")["v"].sort_index()
    assert len(got) == 400 and np.allclose(got.astype(float), want, equal_nan=True)


def test_asof_looks_back_column_by_column(spark):
    left = spark.createDataFrame([(10,), (200_000,)], "time long").selectExpr("timestamp_seconds(time) as time")
    right = spark.createDataFrame([(0, 1.0, None), (5, None, 2.0), (90_000, 3.0, None)], "time long, a double, b double").selectExpr(
        "timestamp_seconds(time) as time", "a", "b")
    got = ingest.asof_backward(left, right, ["a", "b"]).orderBy("time").collect()
    assert [(r.a, r.b) for r in got] == [(1.0, 2.0), (3.0, 2.0)]
    assert ingest.asof_backward(left, right.limit(0), ["a"]).filter("a is null").count() == 2


def test_csv_folder_without_rows(spark, tmp_path):
    (tmp_path / "AAA_daily.csv").write_text("")
    (tmp_path / "BBB_daily.csv").write_text("time,open,close\n")
    assert ingest.read_bar_csv(spark, str(tmp_path)).collect() == []


def test_proposals_use_the_history_and_never_repeat():
    grid = {"depth": [1, 2, 3, 4, 5, 6, 7, 8], "kind": ["a", "b"]}
    score = lambda p: -abs(p["depth"] - 6) + (p["kind"] == "b")
    history = []
    while (p := surrogate.propose(grid, history, 1)) is not None:
        assert p == surrogate.propose(grid, history, 1)
        history.append((p, score(p)))
    assert len(history) == 16 and len({tuple(sorted(p.items())) for p, _ in history}) == 16
    firsts = []
    for seed in range(30):
        h = []
        for _ in range(9):
            p = surrogate.propose(grid, h, seed)
            h.append((p, score(p)))
        firsts.append(np.mean([s for _, s in h[4:]]) - np.mean([s for _, s in h[:4]]))
    assert np.mean(firsts) > 0.7                        # proposals are better than the draws they start from
    assert surrogate.hopeless([0.1], [[0.5], [0.6], [0.4], [0.7]]) and not surrogate.hopeless([0.1], [[0.5]])


def test_search_is_sequential_over_purged_folds(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 10))
    pdf = pd.DataFrame({"symbol": "A", "bar_idx": range(200), "n_bars": 200, "Label": (x[:, 0] + x[:, 1] > 0).astype(int), "w": list(map(list, x))})
    from tidebar.operators import features
    d = features.as_vector(spark.createDataFrame(pdf), "w")
    grid = {"maxIter": [5, 20], "regParam": [0.0, 0.1, 1.0]}
    found = models.search(d, "LOGISTIC", 10, grid, trials=8, idx="bar_idx", n="n_bars", purge=5, embargo=2).toPandas()
    assert found["trial"].nunique() == 6 and len(found) == 18 and found["params"].nunique() == 6      # the grid's size
    assert found.groupby("fold")["n_train"].first().tolist() == [132, 127, 127] or found["n_train"].between(120, 134).all()
    best = models.best_params(spark.createDataFrame(found))
    assert set(best) == set(grid) and all(best[k] in v for k, v in grid.items())
    cut_short = models.search(d, "LOGISTIC", 10, {"maxIter": [1, 2, 3, 4, 5, 6], "regParam": [0.0, 5.0]}, trials=10, idx="bar_idx",
                              n="n_bars", purge=5, embargo=2, prune=True).toPandas()
    per_trial = cut_short.groupby("trial").agg(n=("fold", "size"), pruned=("pruned", "first"))
    assert ((per_trial["n"] < 3) == per_trial["pruned"]).all() and json.loads(cut_short["params"][0])


def test_recurrent_kinds_are_refused():
    for kind in ("LSTM", "BILSTM", "LSTM_RF", "ARIMA_LSTM"):
        with pytest.raises(ValueError):
            models.estimator(kind, 4)


def test_residuals_use_each_series_own_filter(spark):
    rng = np.random.default_rng(6)
    frames, want = [], {}
    for s, (const, phi, theta) in {"A": (0.1, [0.5, -0.2], 0.6), "B": (0.0, [0.3], -0.4)}.items():
        x, prev, res = rng.normal(size=700), 0.0, []
        for t in range(700):
            u = x[t] - const - sum(p * x[t - 1 - i] for i, p in enumerate(phi)) if t >= len(phi) else 0.0
            prev = u - theta * prev
            res.append(prev)
        want[s] = res
        frames.append(pd.DataFrame({"symbol": s, "bar_idx": range(700), "n_bars": 700, "x": x}))
    filters = spark.createDataFrame([("A", 2, 1, 0.1, [0.5, -0.2], [0.6]), ("B", 1, 1, 0.0, [0.3], [-0.4])],
                                    "symbol string, p int, q int, const double, phi array<double>, theta array<double>")
    got = residual_model.residuals(spark.createDataFrame(pd.concat(frames)), "x", filters).toPandas()
    for s, g in got.groupby("symbol"):
        assert np.allclose(g.sort_values("bar_idx")["resid"], want[s], atol=1e-9)


def test_residual_model_scores_each_test_row_once_from_the_past(spark):
    rng = np.random.default_rng(7)
    n = 420
    pdf = pd.concat([pd.DataFrame({"symbol": s, "bar_idx": range(n), "n_bars": n, "x": np.cumsum(rng.normal(size=n)) * 0.1,
                                   "vol": rng.normal(size=n)}) for s in ("A", "B")])
    frame = residual_model.matrix(spark.createDataFrame(pdf), "x", ["vol"], look_back=5)
    got = residual_model.walk_forward(frame, 10, 40, "LOGISTIC", maxIter=5).toPandas()
    test = n - int(np.ceil(n * 4 / 5))
    assert len(got) == 2 * test and not got.duplicated(["symbol", "bar_idx"]).any() and got["prob"].between(0, 1).all()
    later = pdf.copy()
    later.loc[later["bar_idx"] >= n - 10, "x"] += 50.0            # what comes later changes no earlier window
    again = residual_model.matrix(spark.createDataFrame(later), "x", ["vol"], look_back=5)
    a, b = (f.filter(F.col("bar_idx") < n - 10).orderBy("symbol", "bar_idx").select("features").collect() for f in (frame, again))
    assert a == b


def test_zooming_fits_never_lose_likelihood():
    rng = np.random.default_rng(8)
    x = rng.standard_t(5, (6, 300)) * np.exp(0.3 * rng.normal(size=(6, 1)))
    x -= x.mean(axis=1, keepdims=True)
    var = x.var(axis=1)
    for fit, limits in ((volatility.fit_egarch, volatility.EGARCH_LIMITS), (volatility.fit_garch, volatility.GARCH_LIMITS)):
        losses = [fit(x, var, rounds)[1] for rounds in range(4)]
        assert all((b <= a + 1e-9).all() for a, b in zip(losses, losses[1:])) and (losses[3] < losses[0] - 1e-6).any()
        points, loss, h = fit(x, var)
        assert (h > 0).all() and all((points[:, i] >= lo).all() and (points[:, i] <= hi).all() for i, (lo, hi) in enumerate(limits))
    point, loss, h = volatility.fit_garch(x[:1], var[:1])
    a, b = point[0]
    v, ll = var[0], 0.0
    for e in x[0]:
        ll += np.log(v) + e * e / v
        v = (1 - a - b) * var[0] + a * e * e + b * v
    assert abs(ll - loss[0]) < 1e-8 and abs(v - h[0]) < 1e-10


def test_one_reconstruction_model_per_key(spark):
    rng = np.random.default_rng(9)
    frames = []
    for k, c in (("up", 0.8), ("down", -0.8), ("flat", 0.0)):
        a = rng.normal(2, 3, 400)
        frames.append(pd.DataFrame({"k": k, "no": range(400), "a": a, "b": c * a + rng.normal(size=400), "z": 7.0}))
    pdf = pd.concat(frames).assign(is_train=lambda d: d["no"] < 300)
    got = monitors.reconstruction_error(spark.createDataFrame(pdf), ["a", "b", "z"], k=1, train="is_train", keys=["k"]).toPandas()
    for k, g in got.groupby("k"):
        t = g[g["is_train"]]
        z = ((g[["a", "b"]] - t[["a", "b"]].mean()) / t[["a", "b"]].std(ddof=0)).to_numpy()
        s = np.sign(np.corrcoef(t["a"], t["b"])[0, 1])
        assert np.allclose(g["mse"], (z[:, 0] - s * z[:, 1]) ** 2 / 2 / 3)
    one = monitors.reconstruction_error(spark.createDataFrame(pdf), ["a", "b"], k=2, train="is_train").toPandas()
    assert np.allclose(one["mse"], 0, atol=1e-12) and len(one) == 1200
    none = monitors.reconstruction_error(spark.createDataFrame(pdf), ["a", "b"], k=1, train="k <> 'up' and is_train", keys=["k"])
    assert none.filter("k = 'up' and mse is not null").count() == 0 and none.count() == 1200


def test_models_on_rows_scaled_once_equal_those_scaled_each(spark):
    from tidebar.operators import features
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4))
    pdf = pd.DataFrame({"symbol": "A", "bar_idx": range(300), "Label": (x[:, 0] > 0).astype(int), "w": list(map(list, x))})
    d = features.as_vector(spark.createDataFrame(pdf), "w")
    start = models.scaled(d)
    for kind, params in (("LOGISTIC", {"maxIter": 5}), ("LATENT_FOREST", {"components": 2, "numTrees": 3, "maxDepth": 2})):
        a, b = (models.score(models.fit(d, kind, 4, s, **params), d).orderBy("bar_idx").collect() for s in (None, start))
        assert a == b


def test_partitions_of_training_rows_go_by_cores_and_bytes(spark, long_walk, monkeypatch):
    """Every pass of a learner sends something per partition, so the session's shuffle partitions must not set them."""
    cores, was = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    d = spark.createDataFrame(long_walk)
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        from tidebar.operators import residual_model
        frame = residual_model.matrix(d, "close", ["tick_volume"])
        assert frame.rdd.getNumPartitions() == cores and frame.count() == len(long_walk) - 2 * 60
        monkeypatch.setattr(models, "FIT_BYTES", 1 << 20)
        assert models.dealt(d, len(long_walk), 120, "symbol", "bar_idx").rdd.getNumPartitions() == 13          # 12.8 MB of vectors
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_search_scales_a_fold_once(spark, monkeypatch):
    from tidebar.operators import features
    x = np.random.default_rng(8).normal(size=(200, 4))
    pdf = pd.DataFrame({"symbol": "A", "bar_idx": range(200), "n_bars": 200, "Label": (x[:, 0] > 0).astype(int), "w": list(map(list, x))})
    seen, scaled = [], models.scaled
    monkeypatch.setattr(models, "scaled", lambda train: seen.append(1) or scaled(train))
    found = models.search(features.as_vector(spark.createDataFrame(pdf), "w"), "LOGISTIC", 4, {"maxIter": [5, 20], "regParam": [0.0, 1.0]},
                          trials=3, idx="bar_idx", n="n_bars", purge=5, embargo=2)
    assert found.count() == 9 and len(seen) == 3


def test_matrices_from_one_filter_equal_those_filtered_each(spark, clean, monkeypatch):
    from tidebar.operators import residual_model
    d = spark.createDataFrame(clean)
    seen, fit_filters = [], residual_model.fit_filters
    monkeypatch.setattr(residual_model, "fit_filters", lambda *a, **kw: seen.append(1) or fit_filters(*a, **kw))
    start = residual_model.filtered(d, "close")
    for cols in ((), ("tick_volume", "high")):
        a, b = (residual_model.matrix(d, "close", cols, start=s).orderBy("bar_idx").collect() for s in (None, start))
        assert a == b and len(a) == len(clean) - 60 and len(a[0].features) == 60 * (1 + len(cols))
    assert len(seen) == 3
