"""Micro-batch jobs: positions, recalibration and rebalancing, started again between batches."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import allocate, barriers, trades
from tidebar.session import scratch_path
from tidebar.streaming import monitors as smon, positions as spos


def bars_of(rng, symbol, n):
    close = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
    start = np.r_[close[0], close[:-1]]
    return pd.DataFrame({"symbol": symbol, "time": pd.date_range("2020-01-01", periods=n), "bar_idx": range(n), "open": start,
                         "high": np.maximum(start, close) * 1.004, "low": np.minimum(start, close) * 0.996, "close": close,
                         "EGARCH_Vol": rng.uniform(0.3, 1.5, n), "k_up": 2.0, "k_down": 1.5, "cost": 0.0001,
                         "prob": rng.uniform(0, 1, n), "bilateral": symbol != "B"})


@pytest.mark.parametrize("cuts", [(150,), (7, 8, 9, 60, 149, 150)])
def test_positions_over_restarts_equal_the_batch_walk(spark, cuts):
    rng = np.random.default_rng(len(cuts))
    pdf = pd.concat([bars_of(rng, s, 150) for s in ("A", "B")], ignore_index=True)
    pdf.loc[pdf["bar_idx"] >= 150 - 11, "prob"] = 0.5
    frame = spark.createDataFrame(pdf).withColumn("bar_idx", F.col("bar_idx").cast("long"))
    path, last = scratch_path(spark, "book"), 0
    for batch, end in enumerate(cuts):
        part = frame.filter((F.col("bar_idx") >= last) & (F.col("bar_idx") < end))
        spos.PositionBook(spark, path, thresholds=(0.5, 0.7)).job(part.select(*[c.split()[0] for c in spos.BARS.split(", ")]), batch)
        last = end
    book = spos.PositionBook(spark, path, thresholds=(0.5, 0.7))
    book.job(frame.limit(0).select(*[c.split()[0] for c in spos.BARS.split(", ")]), len(cuts))         # an empty batch
    got = {(r.symbol, r.threshold, r.entry_idx, r.exit_idx, r.side, r.exit_kind, round(r.ret, 9)) for r in book.closed().collect()}
    full = frame.withColumn("n_bars", F.lit(150).cast("long"))
    cands = trades.candidates(trades.signals(frame.select("symbol", "bar_idx", "prob", "bilateral"), (0.5, 0.7)), barriers.outcomes(full))
    want = {(r.symbol, r.threshold, r.entry_idx, r.exit_idx, r.side, r.exit_kind, round(r.ret, 9))
            for r in trades.non_overlapping(cands, ["symbol", "threshold"]).collect()}
    assert got == want and len(want) > 30
    assert spark.read.parquet(f"{path}/tail/v={len(cuts)}").count() <= 2 * 10


def test_a_replayed_batch_closes_nothing_twice(spark):
    rng = np.random.default_rng(3)
    pdf = bars_of(rng, "A", 80)
    frame = spark.createDataFrame(pdf).withColumn("bar_idx", F.col("bar_idx").cast("long")).select(
        *[c.split()[0] for c in spos.BARS.split(", ")])
    path = scratch_path(spark, "book")
    for batch, (a, b) in ((0, (0, 40)), (1, (40, 80)), (1, (40, 80))):
        spos.PositionBook(spark, path).job(frame.filter((F.col("bar_idx") >= a) & (F.col("bar_idx") < b)), batch)
    rows = spos.PositionBook(spark, path).closed()
    assert rows.count() == rows.dropDuplicates(["symbol", "threshold", "entry_idx"]).count() > 10


def test_recalibration_counts_on_and_reads_due_buckets_only(spark):
    path = scratch_path(spark, "recal")
    table = smon.VersionedTable(spark, f"{path}/risk", smon.RISK)
    history = spark.createDataFrame([], smon.LIVE)
    rows = {s: [(s, k, 0.01 if k % 3 else -0.02) for k in range(70)] for s in ("a", "b")}
    batches = [rows["a"][:20] + rows["b"][:5], rows["a"][20:40], rows["a"][40:55] + rows["b"][5:29], rows["a"][55:70] + rows["b"][29:31]]
    seen = []
    for i, batch in enumerate(batches):
        job = smon.recalibration_job(history, f"{path}/live", table, 50)              # a new job each time
        frame = spark.createDataFrame(batch, smon.LIVE)
        job(frame, i)
        if i == 1:
            job(frame, i)                                                             # the same batch again
        seen.append({r.symbol: r.n_live for r in table.current().collect()})
    assert seen == [{}, {"a": 30}, {"a": 30}, {"a": 60, "b": 30}]
    want = smon.recalibrate(history, spark.createDataFrame(rows["a"], smon.LIVE), n_sims=50).first()
    got = table.current().filter("symbol = 'a'").first()
    assert abs(got.mc_mdd_95 - want.mc_mdd_95) < 1e-12


def test_due_portfolios_get_weights(spark):
    rng, start = np.random.default_rng(5), date(2020, 1, 1)
    rows = [(p, s, start + timedelta(days=i), i, float(rng.normal(0.0005, 0.01 * (1 + k))))
            for p in ("P", "Q") for k, s in enumerate(("x", "y", "z")) for i in range(200)]
    rows += [("P", "still", start + timedelta(days=i), i, 0.0) for i in range(200)]
    returns = spark.createDataFrame(rows, "portfolio string, strategy string, date date, i long, ret double")
    table = smon.VersionedTable(spark, scratch_path(spark, "weights"), smon.WEIGHTS)
    clock = lambda *pairs: spark.createDataFrame([(p, start + timedelta(days=d)) for p, d in pairs], "portfolio string, now date")
    days = lambda: {(r.portfolio, (r.as_of - start).days) for r in table.current().select("portfolio", "as_of").distinct().collect()}
    for batch, ticks in enumerate([(("P", 120),), (("P", 140), ("Q", 140)), (("P", 150), ("Q", 160))]):
        smon.rebalance_job(returns, table)(clock(*ticks), batch)
        if batch == 1:
            assert days() == {("P", 120), ("Q", 140)}                                  # P is not due yet
    assert days() == {("P", 150), ("Q", 140)}
    got = table.current().toPandas()
    assert np.allclose(got.groupby("portfolio")["weight"].sum(), 1) and len(got) == 7
    part = np.vstack([[r for (p, s, _, i, r) in rows if p == "Q" and s == k and 40 <= i < 140] for k in "xyz"])
    w = allocate.hrp_weights(*allocate._cov_corr(part))
    perf = np.maximum(0.05, part.mean(1) / part.std(1, ddof=1) * 252 ** 0.5)
    mix = np.clip(0.15 * w + 0.85 * perf / perf.sum(), 0.15 / 3, min(0.55, 2.5 / 3))
    mix /= mix.sum()
    daily, even = mix @ part, part.mean(0)
    if daily.mean() / daily.std(ddof=1) < even.mean() / even.std(ddof=1):
        mix = np.full(3, 1 / 3)
    assert np.allclose(got[got["portfolio"] == "Q"].sort_values("strategy")["weight"], mix)
