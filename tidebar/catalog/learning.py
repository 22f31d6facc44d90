"""Features, models and monitors."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from tidebar.catalog.base import ctes, query, r
from tidebar.catalog.series import EMA_SQL, RSI_SQL
from tidebar.catalog.trading import LABEL_SQL, all_trades, bars_vol, labelled, oos_probs
from tidebar.functions.expr import dbl, r6
from tidebar.operators import features, fracdiff, indicators, models, monitors, residual_model, series, trades, volatility
from tidebar.plans import backtest
from tidebar.plans.preprocess import preprocess
from tidebar.session import cut, scratch_path
from tidebar.sources import market, sinks

COLS = ("MACD_Hist", "RSI", "ATR", "EGARCH_Vol")
LAGS = features.LOOK_BACK
N_IN = LAGS * len(COLS)


def labelled_features(spark, sf):
    """Labelled rows with indicator columns, renumbered from the first row with volatility."""
    d = indicators.add_indicators(bars_vol(spark, sf)).filter("EGARCH_Vol is not null")
    from tidebar.operators.barriers import label
    return series.with_bar_idx(label(series.with_bar_idx(d)))


def windows(spark, sf, lags=LAGS):
    """Training frame: vector of the lags, label, train flag; materialised once for many fits."""
    rows = cut(labelled_features(spark, sf))
    d = features.train_split(features.as_vector(features.lag_windows(rows, COLS, look_back=lags)))
    n_train = F.floor(F.col("n_bars") * 4 / 5)
    d = d.select("symbol", "bar_idx", "n_bars", "Label", "is_train", "features",
                 (F.col("bar_idx") - n_train).alias("test_idx"))
    return cut(models.dealt(d, rows.count(), lags * len(COLS), "symbol", "bar_idx"))   # even tasks for the fits, whatever the symbol


@query("w18_lag_windows", ctes("bars") + f"""
SELECT a.symbol, a.bar_idx, CAST(count(*)*2 AS INTEGER) AS size, {r('sum(b.close)')} AS sum_close, {r('sum(b.tick_volume)')} AS sum_volume,
       {r('arg_min(b.close, b.bar_idx)')} AS oldest, {r('arg_max(b.close, b.bar_idx)')} AS newest
FROM bars a JOIN bars b ON b.symbol=a.symbol AND b.bar_idx BETWEEN a.bar_idx-60 AND a.bar_idx-1 WHERE a.bar_idx>=60 GROUP BY 1, 2""")
def _(spark, sf):
    d = features.lag_windows(market.bars_d1(spark, sf), ("close", "tick_volume"), label=None)
    part = lambda k: F.aggregate(F.filter("window", lambda x, i: i % 2 == k), dbl(0.0), lambda s, x: s + x)
    return d.select("symbol", "bar_idx", F.size("window").alias("size"), r6(part(0)).alias("sum_close"), r6(part(1)).alias("sum_volume"),
                    r6(F.get("window", F.lit(0))).alias("oldest"), r6(F.get("window", F.lit(118))).alias("newest"))


@query("j12_exogenous_block", ctes("rets") + f""",
x AS (SELECT symbol, bar_idx, ret, lag(tick_volume) OVER (PARTITION BY symbol ORDER BY bar_idx) AS v, lag(log_ret) OVER (PARTITION BY symbol ORDER BY bar_idx) AS l FROM rets)
SELECT symbol, bar_idx, {r('ret')} AS ret, v AS tick_volume, {r('l')} AS log_ret FROM x WHERE v IS NOT NULL AND l IS NOT NULL""")
def _(spark, sf):
    d = series.log_return(series.simple_return(market.bars_d1(spark, sf)))
    d = features.exogenous_block(d, "ret", ["tick_volume", "log_ret"])
    return d.select("symbol", "bar_idx", r6("ret").alias("ret"), "tick_volume", r6("log_ret").alias("log_ret"))


@query("m1_standardise", ctes("rets") + f""",
st AS (SELECT symbol, avg(log_ret) AS m, stddev_pop(log_ret) AS s FROM rets WHERE bar_idx*5<n_bars*4 GROUP BY 1)
SELECT symbol, bar_idx, {r('greatest(-3::DOUBLE, least(3::DOUBLE, (log_ret-m)/CASE WHEN s>0 THEN s ELSE 1 END))')} AS log_ret_z FROM rets JOIN st USING (symbol)""")
def _(spark, sf):
    d = features.train_split(series.log_return(market.bars_d1(spark, sf)))
    return features.standardise(d, ["log_ret"], bound=3.0).select("symbol", "bar_idx", r6("log_ret_z").alias("log_ret_z"))


def ok(col="prob"):
    """A score is there and is a probability."""
    return F.coalesce(F.col(col).between(0, 1), F.lit(False))


# Rows that have a window: bars with volatility that can be labelled, renumbered, from the 61st on.
WIN_SQL = LABEL_SQL + """,
wn AS (SELECT symbol, bar_idx-500 AS bar_idx, n_bars-511 AS n_bars, "Label" FROM lab),
ws AS (SELECT *, bar_idx*5<n_bars*4 AS is_train, bar_idx-CAST(floor(n_bars*4/CAST(5 AS DOUBLE)) AS BIGINT) AS test_idx FROM wn WHERE bar_idx>=60)"""
TEST_SQL = WIN_SQL + """ SELECT symbol, bar_idx, "Label", true AS scored FROM ws WHERE NOT is_train"""


def _fit_score(name, kind, **params):
    """Fit on the training rows, score every test row: one row each, with a probability."""
    @query(name, TEST_SQL)
    def run(spark, sf):
        d = windows(spark, sf)
        m = models.fit(d.filter("is_train"), kind, N_IN, **params)
        s = models.score(m, d.filter("not is_train"), ("symbol", "bar_idx", "Label"))
        return s.select("symbol", "bar_idx", "Label", ok().alias("scored"))
    return run


# The smallest point of each published grid; boosted trees and nets with fewer rounds, as the README says.
_fit_score("m2_random_forest", "RANDOM_FOREST", numTrees=100, maxDepth=5, minInstancesPerNode=2)
_fit_score("m3_gradient_boosting", "XGBOOST", maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=0.8)
_fit_score("m4_sequence_net", "NET", units=32, maxIter=50)
_fit_score("m4b_logistic", "LOGISTIC", maxIter=20)
_fit_score("m4c_latent_forest", "LATENT_FOREST", components=8, numTrees=100, maxDepth=5)
_fit_score("m4e_deep_perceptron", "DEEP_NET", units=32, maxIter=50)


FFD_SQL = """,
fw AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS v UNION ALL
       SELECT k+1, -v*(CAST(0.4 AS DOUBLE)-(k+1)+1)/(k+1) FROM fw WHERE abs(-v*(CAST(0.4 AS DOUBLE)-(k+1)+1)/(k+1)) >= 1e-4),
fx AS MATERIALIZED (SELECT b.symbol, b.bar_idx-(SELECT max(k) FROM fw) AS bar_idx, b.n_bars-(SELECT max(k) FROM fw) AS n_bars, sum(fw.v*p.close) AS x
       FROM bars b JOIN fw ON true JOIN bars p ON p.symbol=b.symbol AND p.bar_idx=b.bar_idx-fw.k
       WHERE b.bar_idx>=(SELECT max(k) FROM fw) GROUP BY 1,2,3),
fy AS (SELECT symbol, bar_idx, n_bars, CASE WHEN x>lag(x) OVER (PARTITION BY symbol ORDER BY bar_idx) THEN 1 ELSE 0 END AS "Label" FROM fx)"""


def residual_matrix(spark, sf, exogenous=("tick_volume",)):
    """Fractionally differenced closes, renumbered, through the residual model."""
    d = fracdiff.frac_diff(market.bars_d1(spark, sf), 0.4).filter("close_FFD is not null")
    return residual_model.matrix(cut(series.with_bar_idx(d)), "close_FFD", exogenous)


@query("m4d_arma_residual", ctes("bars", recursive=True) + FFD_SQL + """
SELECT symbol, bar_idx, "Label", CAST(floor((bar_idx-ceil(n_bars*4/CAST(5 AS DOUBLE)))/60) AS INTEGER) AS epoch, true AS scored
FROM fy WHERE bar_idx*5>=n_bars*4 AND bar_idx>=60""")
def _(spark, sf):
    """Scores of every test row, refitted every 60 rows, by a net on past ARMA residuals and exogenous lags."""
    frame = residual_matrix(spark, sf)
    d = residual_model.walk_forward(frame, 2 * LAGS, 60, "NET", units=32, maxIter=20)
    return d.select("symbol", "bar_idx", "Label", "epoch", ok().alias("scored"))


TRIALS, FOLDS = 10, 3


@query("m5_purged_search", WIN_SQL + f""",
tr AS (SELECT symbol, bar_idx-60 AS i, CAST(floor(n_bars*4/CAST(5 AS DOUBLE)) AS BIGINT)-60 AS n FROM ws WHERE is_train),
fo AS (SELECT tr.*, fold, fold*(n//{FOLDS}) AS lo, CASE WHEN fold={FOLDS - 1} THEN n ELSE (fold+1)*(n//{FOLDS}) END AS hi
       FROM tr, (SELECT unnest(range({FOLDS})) AS fold))
SELECT trial, CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE i<lo-60 OR i>=hi+10) AS n_train, count(*) FILTER (WHERE i>=lo AND i<hi) AS n_val,
       true AS in_grid, true AS in_range, true AS fresh FROM fo, (SELECT CAST(unnest(range({TRIALS})) AS INTEGER) AS trial) GROUP BY 1, 2""")
def _(spark, sf):
    """Ten trials, each proposed from the scores of those before, over purged folds."""
    d = windows(spark, sf).filter("is_train").withColumn("train_idx", F.col("bar_idx") - LAGS).withColumn(
        "n_train", F.floor(F.col("n_bars") * 4 / 5) - LAGS)
    # the published widths; a tolerance, which ends training early, stands where recurrent nets have their dropout
    grid = models.GRIDS["NET"] | {"tol": [1e-2, 1e-3, 1e-4]}
    found = cut(models.search(d, "NET", N_IN, grid, TRIALS, n_splits=FOLDS, fixed={"maxIter": 20}))
    p = F.from_json("params", "units int, tol double")
    inside = reduce(and_, [p[name].isin(list(values)) for name, values in grid.items()])
    times = found.groupBy("params").agg(F.count_distinct("trial").alias("times"))
    return found.join(times, "params").select("trial", "fold", "n_train", "n_val", inside.alias("in_grid"),
                                              ok("score").alias("in_range"), (F.col("times") == 1).alias("fresh"))


@query("m6_walk_forward", WIN_SQL + """ SELECT symbol, bar_idx, "Label", CAST(floor(test_idx/CAST(60 AS DOUBLE)) AS INTEGER) AS epoch, true AS scored
FROM ws WHERE test_idx>=0""")
def _(spark, sf):
    """Every test row is scored; a fit serves 60 bars of every series."""
    d = windows(spark, sf)
    last = d.agg(F.floor(F.max("test_idx") / 60)).first()[0]          # one number: how many refits
    s = models.walk_forward(d, "LOGISTIC", N_IN, range(int(last) + 1), step=60, label_horizon=11, maxIter=10)
    return s.select("symbol", "bar_idx", "Label", "epoch", ok().alias("scored"))


@query("m7_in_sample_probabilities", WIN_SQL + " SELECT symbol, bar_idx, true AS scored FROM ws WHERE is_train")
def _(spark, sf):
    d = windows(spark, sf).filter("is_train")
    return models.score(models.fit(d, "LOGISTIC", N_IN, maxIter=10), d).select("symbol", "bar_idx", ok().alias("scored"))


@query("m8_fast_refit", WIN_SQL + " SELECT symbol, bar_idx, true AS scored FROM ws WHERE bar_idx>=n_bars-1000")
def _(spark, sf):
    d = windows(spark, sf)
    recent = d.filter(F.col("bar_idx") >= F.col("n_bars") - 1000)
    s = models.score(models.fit(recent, "LOGISTIC", N_IN, maxIter=10), recent)
    return s.select("symbol", "bar_idx", ok().alias("scored"))


@query("m9_model_round_trip", WIN_SQL + " SELECT symbol, CAST(0 AS DOUBLE) AS max_diff FROM ws GROUP BY 1")
def _(spark, sf):
    """Score with a model that was saved and loaded; the largest change must be 0."""
    d = windows(spark, sf)
    m = models.fit(d.filter("is_train"), "RANDOM_FOREST", N_IN, numTrees=5, maxDepth=4)
    path = scratch_path(spark, "model")
    m.save(path)
    a = models.score(m, d)
    b = models.score(models.Fitted.load(path), d).withColumnRenamed("prob", "prob2")
    return a.join(b, ["symbol", "bar_idx"]).groupBy("symbol").agg(F.max(F.abs(F.col("prob") - F.col("prob2"))).alias("max_diff"))


MATRIX = (("RANDOM_FOREST", {"numTrees": 100, "maxDepth": 5}), ("XGBOOST", {"maxIter": 10, "maxDepth": 3, "stepSize": 0.1}),
          ("NET", {"units": 32, "maxIter": 20}), ("DEEP_NET", {"units": 32, "maxIter": 20}),
          ("LATENT_FOREST", {"components": 8, "numTrees": 100, "maxDepth": 5}))
MACRO_COLS = ("VIX_close", "DXY_close", "Yield10Y")
DIFFED = ("open", "high", "low", "DXY_close", "Yield10Y")


def feature_table(spark, sf):
    """Labelled bars with the columns of all banks: differenced prices and macro series, indicators, volatility."""
    d = indicators.add_indicators(_macro_bars(spark, sf))
    for c in DIFFED:
        d = fracdiff.frac_diff(d, 0.4, c)
    from tidebar.operators.barriers import label
    return cut(series.with_bar_idx(label(series.with_bar_idx(d.filter("EGARCH_Vol is not null")))))


@query("x5_feature_chain")
def _(spark, sf):
    """The whole preprocessing of bars with macro columns: indicators, conditional volatility, smallest stationary orders,
    labels.  Which rows stay depends on the orders found, so there is no SQL for it."""
    d = preprocess(_macro_bars(spark, sf).drop("EGARCH_Vol", "k_up", "k_down", "cost", "bilateral"), ("open", "high", "low", "close"))
    return d.select("symbol", "time", "bar_idx", "close", *COLS, "open_FFD", "high_FFD", "low_FFD", "close_FFD", "Label")


@query("w14b_labels_on_conditional_volatility", ctes("bars") + """
SELECT symbol, bar_idx, true AS judged, true AS consistent FROM bars WHERE bar_idx>=500 AND bar_idx<n_bars-11""")
def _(spark, sf):
    """Labels from EGARCH forecasts instead of a rolling deviation: one per bar that has a forecast and a future."""
    from tidebar.operators.barriers import label
    v = cut(volatility.conditional_vol(market.bars_d1(spark, sf)).select("symbol", "bar_idx", "EGARCH_Vol"))
    d = market.with_params(market.bars_d1(spark, sf)).join(v, ["symbol", "bar_idx"], "left")
    d = label(d).filter("bar_idx >= 500")
    return d.select("symbol", "bar_idx", F.col("exit_kind").isNotNull().alias("judged"),
                    ((F.col("Label") == 1) == (F.col("exit_kind") == "TP")).alias("consistent"))


@query("m10_training_matrix", WIN_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + FFD_SQL + f""",
bk AS (SELECT unnest({sorted(features.banks('other'))}) AS bank),
md AS (SELECT unnest({[k for k, _ in MATRIX]}) AS model)
SELECT symbol, model, bank, count(*) AS n_test, CAST(sum("Label") AS BIGINT) AS n_up, true AS in_range, 1 AS n_summary FROM ws, bk, md WHERE NOT is_train GROUP BY 1, 2, 3
UNION ALL SELECT symbol, 'RESIDUAL_NET', bank, count(*), CAST(sum("Label") AS BIGINT), true, 1 FROM fy, bk WHERE bar_idx*5>=n_bars*4 AND bar_idx>=60 GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Six models on six banks over all symbols; the test report per cell, and the run summary upserted twice."""
    base = feature_table(spark, sf)
    n_rows = base.count()
    frames = {}
    for bank, cols in features.banks("other").items():
        cols = [c for c in cols if c in base.columns]
        d = features.train_split(features.as_vector(features.lag_windows(base, cols, look_back=LAGS)))
        d = d.select("symbol", "bar_idx", "Label", "is_train", "features")
        d = cut(models.dealt(d, n_rows, LAGS * len(cols), "symbol", "bar_idx"))
        frames[bank] = d, cols, models.scaled(d.filter("is_train"))
    diffed = cut(series.with_bar_idx(fracdiff.frac_diff(_macro_bars(spark, sf), 0.4, "close").filter("close_FFD is not null")))
    diffed = cut(indicators.add_indicators(diffed))
    for c in DIFFED:
        diffed = fracdiff.frac_diff(diffed, 0.4, c)
    diffed = cut(diffed.fillna(0.0, [f"{c}_FFD" for c in DIFFED]).fillna(0.0, ["EGARCH_Vol"]))
    residual = residual_model.filtered(diffed, "close_FFD")      # the same for every bank

    def cell(job):
        bank, kind, params = job
        if kind == "RESIDUAL_NET":
            cols = frames[bank][1]
            frame, start = residual_model.matrix(diffed, "close_FFD", cols, start=residual), None
            n_in = LAGS * (1 + len(cols))
        else:
            frame, start, n_in = frames[bank][0], frames[bank][2], LAGS * len(frames[bank][1])
        m = models.fit(frame.filter("is_train"), "NET" if kind == "RESIDUAL_NET" else kind, n_in, start, **params)
        rep = models.class_report(m.transform(frame.filter("not is_train")), ["symbol"])
        return rep.withColumns({"model": F.lit(kind), "bank": F.lit(bank), "params": F.lit(json.dumps(params))})

    jobs = [(b, k, p) for b in frames for k, p in (*MATRIX, ("RESIDUAL_NET", {"units": 32, "maxIter": 20}))]
    with ThreadPoolExecutor(4) as pool:
        out = cut(reduce(lambda a, b: a.unionByName(b), pool.map(cell, jobs)))
    summary = out.select(F.col("symbol").alias("asset"), "model", "bank", "params", "accuracy", "f1_macro")
    first = sinks.upsert_summary(summary.withColumn("run_no", F.lit(0)).limit(0), summary.withColumn("run_no", F.lit(1)))
    twice = sinks.upsert_summary(first, summary.withColumn("run_no", F.lit(2)))
    key = ["symbol", "model", "bank"]
    runs = twice.filter("run_no = 2").withColumnRenamed("asset", "symbol").groupBy(*key).agg(
        F.count(F.lit(1)).cast("int").alias("n_summary"))
    return out.join(runs, key).select(*key, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_test"),
                                      (F.col("tp") + F.col("fn")).alias("n_up"),
                                      (ok("accuracy") & ok("f1_macro")).alias("in_range"), "n_summary")


@query("m13_score_newest", WIN_SQL + " SELECT symbol, bar_idx, true AS scored FROM ws WHERE bar_idx=n_bars-1")
def _(spark, sf):
    d = windows(spark, sf)
    m = models.fit(d.filter("is_train"), "LOGISTIC", N_IN, maxIter=10)
    return models.score(m, series.last_n(d, 1)).select("symbol", "bar_idx", ok().alias("scored"))


@query("m14_rescore_recent", WIN_SQL + " SELECT symbol, bar_idx, bar_idx>=60 AS scored FROM wn WHERE bar_idx>=n_bars-300")
def _(spark, sf):
    """Newest 300 bars of each series; bars without a full window stay unscored (NULL)."""
    d = windows(spark, sf)
    m = models.fit(d.filter("is_train"), "LOGISTIC", N_IN, maxIter=10)
    bars = series.last_n(series.with_bar_idx(labelled_features(spark, sf).drop("bar_idx", "n_bars")), 300)
    s = bars.select("symbol", "bar_idx").join(models.score(m, series.last_n(d, 300)), ["symbol", "bar_idx"], "left")
    return s.select("symbol", "bar_idx", ok().alias("scored"))


@query("a21_f1_accuracy", LABEL_SQL + f""",
x AS (SELECT p.symbol, p.model, p.bank, l."Label" AS y, CASE WHEN prob>0.5 THEN 1 ELSE 0 END AS p FROM (SELECT p.* FROM
      (SELECT b.symbol, model, bank, bar_idx, ((bar_idx*7919+symbol_no*104729+model_no*1299709+bank_no*15485863)%1000)/CAST(1000 AS DOUBLE) AS prob
       FROM bars b JOIN (SELECT symbol, rank() OVER (ORDER BY symbol)-1 AS symbol_no FROM (SELECT DISTINCT symbol FROM bars)) USING (symbol),
       (VALUES ('RANDOM_FOREST',0,'Precio_Puro',0),('RANDOM_FOREST',0,'Tecnicos',1),('XGBOOST',1,'Precio_Puro',0),('XGBOOST',1,'Tecnicos',1)) g(model,model_no,bank,bank_no)
       WHERE bar_idx*5>=n_bars*4) p) p JOIN lab l USING (symbol, bar_idx)),
c AS (SELECT symbol, model, bank, count(*) FILTER (WHERE y=1 AND p=1) AS tp, count(*) FILTER (WHERE y=0 AND p=1) AS fp,
             count(*) FILTER (WHERE y=1 AND p=0) AS fn, count(*) FILTER (WHERE y=0 AND p=0) AS tn FROM x GROUP BY ALL)
SELECT symbol, model, bank, tp, fp, fn, tn, {r('(tp+tn)/CAST(tp+fp+fn+tn AS DOUBLE)')} AS accuracy,
       {r('(2*tp/CAST(2*tp+fp+fn AS DOUBLE)+2*tn/CAST(2*tn+fp+fn AS DOUBLE))/2')} AS f1_macro FROM c""")
def _(spark, sf):
    p = oos_probs(spark, sf).select("symbol", "model", "bank", "bar_idx", F.when(F.col("prob") > 0.5, 1).otherwise(0).alias("prediction"))
    d = labelled(spark, sf).select("symbol", "bar_idx", "Label").join(p, ["symbol", "bar_idx"])
    rep = models.class_report(d, ["symbol", "model", "bank"])
    return rep.withColumns({"accuracy": r6("accuracy"), "f1_macro": r6("f1_macro")})


@query("a22_feature_importance", """SELECT 4 AS n_columns, CAST(1 AS DOUBLE) AS total, true AS all_positive""")
def _(spark, sf):
    """Importance of the base columns, summed over their lags: shares of 1."""
    d = windows(spark, sf)
    m = models.fit(d.filter("is_train"), "RANDOM_FOREST", N_IN, numTrees=100, maxDepth=5)
    i = models.importance(m, COLS, spark)
    return i.agg(F.count("column").cast("int").alias("n_columns"), r6(F.sum("importance")).alias("total"),
                 (F.min("importance") > 0).alias("all_positive"))


MACRO_SERIES = list(market.PRIORITY_SERIES.values())


def _macro_bars(spark, sf):
    from tidebar.sources.ingest import join_macro
    return join_macro(bars_vol(spark, sf), market.macro_daily(spark, sf), MACRO_SERIES)


@query("a29_regimes")
def _(spark, sf):
    d = monitors.regimes(features.train_split(_macro_bars(spark, sf)), MACRO_SERIES, train="is_train")
    return d.select("symbol", "bar_idx", "regime", "is_crisis", "risk_mult")


def trade_rows(spark, sf):
    """Every trade's (return, duration, win); a strategy's first half of trades is for training."""
    t = backtest.numbered_trades(all_trades(spark, sf))
    return cut(t.withColumns({"dur": F.col("duration").cast("double"), "win": F.when(F.col("ret") > 0, 1.0).otherwise(0.0),
                              "is_train": F.col("trade_no") * 2 < F.col("n_trades")}))


@query("a30_reconstruction_error")
def _(spark, sf):
    """Errors of every trade under its own strategy's model of three columns, with that strategy's thresholds."""
    e = monitors.reconstruction_error(trade_rows(spark, sf), ["ret", "dur", "win"], k=1, train="is_train", keys=trades.STRATEGY)
    e = cut(e.select(*trades.STRATEGY, "trade_no", "n_trades", "is_train", "mse"))
    th = monitors.error_thresholds(e.filter("is_train"), trades.STRATEGY)
    return e.join(th, list(trades.STRATEGY)).withColumn("anomalous", F.col("mse") > F.col("p99"))


# Two standardised columns have the directions (1, s)/sqrt(2) with the sign s of their correlation, so the error has a closed form.
TWO_SQL = ctes("trades") + """,
tn AS (SELECT *, count(*) OVER (PARTITION BY symbol, model, bank, threshold) AS n_trades FROM trades),
ms AS (SELECT symbol, model, bank, threshold, avg(ret) AS mr, stddev_pop(ret) AS sr, avg(duration) AS md, stddev_pop(duration) AS sd,
              CASE WHEN covar_pop(ret, duration)<0 THEN -1 ELSE 1 END AS s
       FROM tn WHERE trade_no*2<n_trades GROUP BY ALL HAVING count(*)>=10 AND stddev_pop(ret)>0 AND stddev_pop(duration)>0),
er AS (SELECT tn.*, pow((ret-mr)/sr - s*((duration-md)/sd), 2)/4 AS mse FROM tn JOIN ms USING (symbol, model, bank, threshold))"""


def two_column_errors(spark, sf):
    t = trade_rows(spark, sf)
    enough = t.filter("is_train").groupBy(*trades.STRATEGY).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_pop("ret").alias("_r"), F.stddev_pop("dur").alias("_d")).filter(
        "_n >= 10 and _r > 0 and _d > 0").select(*trades.STRATEGY)
    t = t.join(enough, list(trades.STRATEGY), "left_semi")
    return monitors.reconstruction_error(t, ["ret", "dur"], k=1, train="is_train", keys=trades.STRATEGY)


@query("a30c_error_per_strategy", TWO_SQL + f" SELECT symbol, model, bank, threshold, trade_no, {r('mse')} AS mse FROM er")
def _(spark, sf):
    return two_column_errors(spark, sf).select(*trades.STRATEGY, "trade_no", r6("mse").alias("mse"))


@query("a31b_drift_of_errors", TWO_SQL + f""",
th AS (SELECT symbol, model, bank, threshold, quantile_cont(mse, CAST(0.9 AS DOUBLE)) AS p90 FROM er WHERE trade_no*2<n_trades GROUP BY ALL),
rc AS (SELECT symbol, model, bank, threshold, median(mse) AS median_mse FROM er WHERE n_trades>=30 AND trade_no>=n_trades-30 GROUP BY ALL)
SELECT symbol, model, bank, threshold, {r('median_mse')} AS median_mse, median_mse>p90 AS drift FROM rc JOIN th USING (symbol, model, bank, threshold)""")
def _(spark, sf):
    """Concept drift judged by the errors of each strategy's own model."""
    e = cut(two_column_errors(spark, sf))
    th = monitors.error_thresholds(e.filter("is_train"), trades.STRATEGY)
    d = monitors.concept_drift(e, th, trades.STRATEGY)
    return d.select(*trades.STRATEGY, r6("median_mse").alias("median_mse"), "drift")


ERR_SQL = ctes("trades") + """,
er AS (SELECT *, count(*) OVER (PARTITION BY symbol, model, bank, threshold) AS n_trades, pow(100*ret, 2)+duration/CAST(10 AS DOUBLE) AS mse FROM trades)"""


def _proxy_errors(spark, sf):
    """A closed-form error per trade, so that the threshold and drift steps can be checked in SQL."""
    t = backtest.numbered_trades(all_trades(spark, sf))
    return cut(t.withColumn("mse", F.pow(100 * F.col("ret"), dbl(2.0)) + F.col("duration") / dbl(10.0)))


@query("a30b_error_thresholds", ERR_SQL + f""" SELECT symbol, model, bank, threshold, {r('quantile_cont(mse, CAST(0.9 AS DOUBLE))')} AS p90,
{r('quantile_cont(mse, CAST(0.99 AS DOUBLE))')} AS p99 FROM er WHERE trade_no*2<n_trades GROUP BY ALL""")
def _(spark, sf):
    e = _proxy_errors(spark, sf).filter("trade_no * 2 < n_trades")
    d = monitors.error_thresholds(e, trades.STRATEGY)
    return d.select(*trades.STRATEGY, r6("p90").alias("p90"), r6("p99").alias("p99"))


@query("a31_concept_drift", ERR_SQL + f""",
th AS (SELECT symbol, model, bank, threshold, quantile_cont(mse, CAST(0.9 AS DOUBLE)) AS p90 FROM er WHERE trade_no*2<n_trades GROUP BY ALL),
rc AS (SELECT symbol, model, bank, threshold, median(mse) AS median_mse FROM er WHERE n_trades>=30 AND trade_no>=n_trades-30 GROUP BY ALL)
SELECT symbol, model, bank, threshold, {r('median_mse')} AS median_mse, median_mse>p90 AS drift FROM rc JOIN th USING (symbol, model, bank, threshold)""")
def _(spark, sf):
    e = _proxy_errors(spark, sf)
    th = monitors.error_thresholds(e.filter("trade_no * 2 < n_trades"), trades.STRATEGY)
    d = monitors.concept_drift(e, th, trades.STRATEGY)
    return d.select(*trades.STRATEGY, r6("median_mse").alias("median_mse"), "drift")
