"""Labels, trades, metrics and bootstrap against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import signals as rules
from tidebar.functions.expr import norm_cdf, norm_ppf
from tidebar.operators import barriers, bootstrap, cv, metrics, trades
from tidebar.operators.champion import champions


def labels(spark, pdf):
    return barriers.label(spark.createDataFrame(pdf)).toPandas()


def test_label_share_by_market(spark, bull, crash, flat):
    up, down, side = (labels(spark, x) for x in (bull, crash, flat))
    assert up["Label"].mean() > 0.5 > down["Label"].mean()
    assert side["Label"].mean() < 0.3
    for d in (up, down, side):
        assert len(d) == 200 - 11 and d["Label"].isin([0, 1]).all()


def test_same_bar_touch_is_a_stop(spark):
    n = 30
    pdf = pd.DataFrame({"symbol": "A", "time": pd.bdate_range("2020-01-01", periods=n).date, "bar_idx": range(n), "n_bars": n,
                        "open": 100.0, "high": 100.5, "low": 99.5, "close": 100.0, "EGARCH_Vol": 2.0})
    pdf.loc[2, ["high", "low"]] = [115.0, 85.0]
    d = labels(spark, pdf).sort_values("bar_idx")
    assert d.iloc[0]["Label"] == 0 and d.iloc[0]["exit_kind"] == "SL"
    pdf.loc[5, "EGARCH_Vol"] = 0.0
    d = labels(spark, pdf).set_index("bar_idx")
    assert d.loc[5, "Label"] == 0 and d.loc[5, "exit_kind"] is None


def test_label_is_long_take_profit(spark, long_walk):
    d = spark.createDataFrame(long_walk).withColumns({"k_up": F.lit(2.0), "k_down": F.lit(1.5), "cost": F.lit(0.0)})
    lab = barriers.label(d).select("symbol", "bar_idx", "Label")
    oc = barriers.outcomes(d, sides=(1,)).select("symbol", "bar_idx", (F.col("exit_kind") == "TP").alias("tp"))
    j = lab.join(oc, ["symbol", "bar_idx"]).toPandas()
    assert len(j) == len(long_walk) - 22 and (j["Label"].astype(bool) == j["tp"]).all()


def loop_walk(rows, kill=-0.2, cooldown=None):
    """Plain walk over the sorted candidates of one strategy: (entry indices, stopped)."""
    out, free, eq, peak, win = [], 0, 1.0, 1.0, []
    for idx, exit_, ret, bad in rows:
        if idx < free:
            continue
        out.append(idx)
        free = exit_
        eq *= 1 + ret
        peak = max(peak, eq)
        if kill is not None and eq / peak - 1 <= kill:
            return out, True
        if cooldown:
            win = (win + [(ret, bad)])[-10:]
            if any(b for _, b in win) and sum(r for r, _ in win) < -0.03:
                free, win = exit_ + 60, []
    return out, False


def random_candidates(n=6000, density=0.4, seed=0, hold=10, flat_trades=False):
    rng = np.random.default_rng(seed)
    frames = []
    for s, mean in (("AAA", 0.0004), ("BBB", -0.002)):
        idx = np.flatnonzero(rng.random(n) < density)
        dur = np.full(len(idx), hold) if flat_trades else rng.integers(1, hold + 1, len(idx))
        frames.append(pd.DataFrame({"symbol": s, "bar_idx": idx, "exit_idx": idx + dur,
                                    "ret": rng.normal(mean, 0.008, len(idx)), "anomalous": rng.random(len(idx)) < 0.05}))
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("density,flat_trades", [(0.4, False), (1.0, True), (0.01, False)])
def test_walk_matches_loop(spark, density, flat_trades):
    pdf = random_candidates(density=density, flat_trades=flat_trades)
    got = trades.simulate(spark.createDataFrame(pdf), ["symbol"]).toPandas()
    for s, g in pdf.groupby("symbol"):
        want, dead = loop_walk(g[["bar_idx", "exit_idx", "ret", "anomalous"]].itertuples(index=False))
        mine = got[got["symbol"] == s].sort_values("entry_idx")
        assert mine["entry_idx"].tolist() == want
        assert bool(mine["is_dead"].iloc[0]) == dead


def test_cooldown_matches_loop(spark):
    pdf = random_candidates(n=5000, density=0.5, seed=4)
    got = trades.with_cooldown(spark.createDataFrame(pdf), ["symbol"]).toPandas()
    plain = trades.non_overlapping(spark.createDataFrame(pdf), ["symbol"]).count()
    for s, g in pdf.groupby("symbol"):
        want, _ = loop_walk(g[["bar_idx", "exit_idx", "ret", "anomalous"]].itertuples(index=False), kill=None, cooldown=True)
        assert got[got["symbol"] == s].sort_values("entry_idx")["entry_idx"].tolist() == want
    assert len(got) < plain


def test_metric_window_padding(spark):
    pdf = pd.DataFrame({"symbol": "A", "trade_no": range(12), "ret": np.linspace(-0.02, 0.03, 12), "duration": 3})
    d = trades.metric_window(spark.createDataFrame(pdf), ["symbol"]).orderBy("trade_no").toPandas()
    assert all(len(w) == 10 for w in d["window"])
    assert sum(x[1] == 0 for x in d["window"][0]) == 9 and sum(x[1] == 0 for x in d["window"][11]) == 0


def test_exact_quantile_and_tail(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.repeat([1, 2, 3], [1000, 7, 1]), "ret": rng.normal(0, 0.02, 1008)})
    d = metrics.tail_risk(spark.createDataFrame(pdf), ["k"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        v = np.percentile(g["ret"], 5)
        assert d.loc[k, "var_95"] == pytest.approx(v, abs=1e-14)
        assert d.loc[k, "cvar_95"] == pytest.approx(g["ret"][g["ret"] <= v + 1e-12].mean())


def test_normal_functions(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.8, 0.99]
    d = spark.createDataFrame([(x,) for x in p], "p double").select("p", norm_ppf(F.col("p")).alias("z"))
    rows = d.select("p", "z", norm_cdf(F.col("z")).alias("q")).collect()
    for r in rows:
        assert r.q == pytest.approx(r.p, abs=1e-6)
        assert 0.5 * math.erfc(-r.z / math.sqrt(2)) == pytest.approx(r.p, rel=1e-7)


def test_one_trade_has_no_psr(spark):
    d = spark.createDataFrame([("A", 5, 0.02, 3, False)], "symbol string, exit_idx long, ret double, duration int, is_dead boolean")
    m = metrics.trade_metrics(d, ["symbol"]).first()
    assert m.psr == 0 and m.mdd == 0 and m.sharpe == 0 and m.win_rate == 1


def test_bootstrap_of_a_history_in_pieces_agrees(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": 1, "trade_no": np.arange(90), "ret": rng.normal(0, 0.02, 90)})
    specs = spark.createDataFrame([(1, "all", 90), (1, "first", 30)], "k long, part string, n long")
    got = bootstrap.path_drawdowns(spark.createDataFrame(pdf), specs, ["k"], ["part"], 60).orderBy("part", "sim").toPandas()
    assert len(got) == 120 and (got["mdd"] < 0).all() and got["mdd"].nunique() > 100
    sims = np.arange(60, dtype=np.int64)
    for part, n in (("all", 90), ("first", 30)):
        value = np.cumprod(1 + pdf["ret"].to_numpy()[bootstrap.draw(sims[:, None], np.arange(n)[None, :], n)], axis=1)
        want = (value / np.maximum.accumulate(value, axis=1) - 1).min(axis=1)
        assert np.allclose(got[got["part"] == part]["mdd"], want)
        monkeypatch.setattr(bootstrap, "CELLS", 60 * 7)              # seven draws of all paths at a time
        assert np.allclose(bootstrap._drawdowns(pdf["ret"].to_numpy()[:n], sims), want)


# --- position sizing ------------------------------------------------------------------------------

def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def lots(spark, price=1.10, stop=1.095, prob=None, thr=0.5):
    risk = F.lit(0.025) * (rules.kelly(F.lit(prob), F.lit(thr)) if prob else F.lit(1.0))
    return one(spark, rules.position_size(F.lit(10000.0), F.lit(price), F.lit(stop), F.lit(1e-5), F.lit(1.0), 0.01, risk))


def test_barrier_sides(spark):
    tp = one(spark, rules.take_profit(F.lit(1.1), F.lit(0.5), F.lit(2.0), F.lit(1)))
    sl = one(spark, rules.stop_loss(F.lit(1.1), F.lit(0.5), F.lit(1.5), F.lit(1)))
    assert tp > 1.1 > sl
    assert one(spark, rules.take_profit(F.lit(1.1), F.lit(0.5), F.lit(2.0), F.lit(-1))) < 1.1
    assert one(spark, rules.take_profit(F.lit(1.1), F.lit(0.0), F.lit(2.0), F.lit(1))) == 1.1


def test_position_size(spark):
    base = lots(spark)
    assert base >= 0 and abs(base / 0.01 - round(base / 0.01)) < 1e-6
    assert lots(spark, stop=1.10) == 0
    weak, normal, strong = (lots(spark, prob=p) for p in (0.53, 0.60, 0.70))
    assert weak < normal < strong
    assert normal / weak == pytest.approx(2, rel=0.05) and strong / normal == pytest.approx(2, rel=0.05)


def test_signal_of_unscored_bar_is_cash(spark):
    assert one(spark, rules.side(F.lit(None).cast("double"), F.lit(0.6), F.lit(True))) == 0


# --- audit and selection ---------------------------------------------------------------------------

def scored(spark, n, seed=42):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_idx": np.arange(n), "n_bars": n,
                                               "prob": rng.uniform(0.4, 0.7, n), "ret": rng.normal(0, 0.01, n)}))


def test_audit(spark):
    assert len(cv.paths()) == 15
    row = cv.audit(scored(spark, 300), ["symbol"]).first()
    assert 0 <= row.pbo <= 1 and row.n_paths == 15
    short = cv.audit(scored(spark, 50), ["symbol"]).first()
    assert short.pbo == 0 and short.n_paths == 0


def test_membership_matches_definition(spark):
    n, g, size, purge = 303, 6, 303 // 6, 10
    got = cv.cpcv_membership(scored(spark, n)).toPandas()
    bounds = [(i * size, (i + 1) * size if i < g - 1 else n) for i in range(g)]
    for path, test in cv.paths():
        part = got[got["path"] == path]
        want_test = {j for t in test for j in range(*bounds[t])}
        want_train = set()
        for k in range(g):
            if k not in test:
                lo = bounds[k][0] + (purge if k - 1 in test else 0)
                hi = bounds[k][1] - (purge if k + 1 in test else 0)
                want_train |= set(range(lo, hi))
        assert set(part[part["role"] == "test"]["bar_idx"]) == want_test
        assert set(part[part["role"] == "train"]["bar_idx"]) == want_train


def test_purged_folds(spark):
    got = cv.purged_folds(scored(spark, 400)).toPandas()
    f = got[got["fold"] == 1]
    assert set(f[f["role"] == "val"]["bar_idx"]) == set(range(133, 266))
    assert set(f[f["role"] == "train"]["bar_idx"]) == set(range(0, 73)) | set(range(276, 400))


def test_champion_gates(spark):
    rows = [("A", "m1", 30, False, -0.1, 0.5, 0.1, 1.0), ("A", "m2", 10, False, -0.1, 0.9, 0.9, 9.0),
            ("B", "m1", 5, True, -0.3, 0.1, 0.1, 0.1), ("C", "m1", 30, False, -0.1, 0.2, 0.2, 1.0), ("C", "m2", 30, False, -0.1, 0.2, 0.2, 1.0)]
    d = spark.createDataFrame(rows, "symbol string, model string, n long, is_dead boolean, mdd double, alpha double, cagr double, sharpe double")
    got = {r.symbol: r.model for r in champions(d, ["symbol"], ["model"]).collect()}
    assert got == {"A": "m1", "B": "m1", "C": "m1"}
    assert {r.symbol for r in champions(d, ["symbol"], ["model"], need_alive=True).collect()} == {"A", "C"}


def test_state_survives_a_restart(spark, tmp_path):
    from tidebar.streaming import monitors as smon
    path = str(tmp_path / "state")
    for batch, rows in enumerate(([("a", True, False)], [("b", False, True)], [("a", False, False)])):
        table = smon.VersionedTable(spark, path, smon.STATUS)               # a new object each time, as after a restart
        new = spark.createDataFrame(rows, smon.STATUS)
        smon.monitor_job(lambda _, new=new: new, table, str(tmp_path / "events"))(new, batch)
    got = {(r.symbol, r.quarantined, r.drifting) for r in smon.VersionedTable(spark, path, smon.STATUS).current().collect()}
    assert got == {("a", False, False), ("b", False, True)}
    events = [(r.batch_id, r.symbol, r.event) for r in spark.read.parquet(str(tmp_path / "events")).orderBy("batch_id").collect()]
    assert events == [(0, "a", "quarantine"), (1, "b", "drift"), (2, "a", "lift")]


def test_only_risen_multiples_are_recalibrated(spark):
    from tidebar.streaming import monitors as smon
    live = spark.createDataFrame([(s, k, 0.01 * (k % 5 - 2)) for s, n in (("a", 35), ("b", 65), ("c", 10)) for k in range(n)], smon.LIVE)
    none = spark.createDataFrame([], smon.LIVE)
    known = spark.createDataFrame([("a", 30), ("b", 30)], "symbol string, n_live long")
    assert {(r.symbol, r.n_live) for r in smon.recalibrate(none, live, n_sims=20).collect()} == {("a", 30), ("b", 60)}
    assert [(r.symbol, r.n_live) for r in smon.recalibrate(none, live, n_sims=20, known=known).collect()] == [("b", 60)]
