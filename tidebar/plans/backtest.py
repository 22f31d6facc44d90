"""Tournament, leverage and report plans built from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidebar.functions.expr import dbl
from tidebar.functions.signals import kelly, risk_budget
from tidebar.operators.barriers import outcomes
from tidebar.operators.bootstrap import bootstrap_mdd
from tidebar.operators.champion import champions
from tidebar.operators.metrics import cagr, series_metrics, trade_metrics
from tidebar.operators.series import (affine_path, dense_index, block_of, equity, in_blocks, path_summary,
                                      range_index, simple_return, sma)
from tidebar.session import cut
from tidebar.operators.trades import STRATEGY, THRESHOLDS, candidates, signals, simulate

RISK_FREE = 0.05
SMA_BARS = {"D1": 200, "H4": 1200, "H1": 4800}
UNLEVERED_RISK = 0.015
EPOCH = 30


def run_trades(bars: DataFrame, probs: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
               max_hold: int = 10) -> DataFrame:
    """Selected trades of every strategy.  `bars`: vol and parameter columns; `probs`: bilateral."""
    return simulate(candidates(signals(probs, thresholds), outcomes(bars, max_hold)), STRATEGY, max_hold)


def market(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """First and last close and date of the evaluated bars."""
    return bars.groupBy(*keys).agg(
        F.min_by("close", "bar_idx").alias("first_close"), F.max_by("close", "bar_idx").alias("last_close"),
        F.datediff(F.max("time"), F.min("time")).alias("days"))


def evaluate(trades: DataFrame, bars: DataFrame, n_trials: int = 24) -> DataFrame:
    """Metrics, market return, alpha and CAGR per strategy.

    Alpha compares with the market up to the last trade of a stopped strategy, else to the end.
    """
    m = trade_metrics(trades, STRATEGY, n_trials).join(market(bars), "symbol")
    at_exit = bars.select("symbol", F.col("bar_idx").alias("last_exit"), F.col("close").alias("_x"))
    m = m.join(at_exit, ["symbol", "last_exit"])
    end = F.when(F.col("is_dead"), F.col("_x")).otherwise(F.col("last_close"))
    m = m.withColumns({"market_ret": F.col("last_close") / F.col("first_close") - 1,
                       "alpha": F.col("total_ret") - (end / F.col("first_close") - 1)})
    return m.withColumns({"cagr": cagr(F.col("total_ret"), F.col("days")),
                          "market_cagr": cagr(F.col("market_ret"), F.col("days"))}).drop("_x")


def pick_champions(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(best bank and threshold per symbol and model, best model per symbol)."""
    per_model = champions(evaluated, ["symbol", "model"], ["bank", "threshold"])
    return per_model, champions(per_model, ["symbol"], ["model"], need_alive=True)


def next_returns(bars: DataFrame) -> DataFrame:
    """Return of the bar after each bar (NULL on the last)."""
    return in_blocks(bars, lambda d, w: d.withColumn(
        "ret", F.lead("close").over(w()) / F.col("close") - 1), ahead=1)


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Simple returns from the second bar on."""
    return simple_return(bars).filter("bar_idx > 0")


def trend_returns(bars: DataFrame, n: int | None = None, timeframe: str = "D1") -> DataFrame:
    """Long/cash: the next bar's return where close > SMA, else 0; series shorter than n+1 give none.

    The average spans about 200 trading days, whatever the timeframe (`SMA_BARS`), unless `n` is given."""
    n = SMA_BARS[timeframe] if n is None else n
    enough = bars.filter(F.col("n_bars") >= n + 1)
    d = next_returns(sma(enough, n)).filter("ret is not null")
    return d.withColumn("ret", F.when(F.col("close") > F.col("sma"), F.col("ret")).otherwise(dbl(0.0)))


def tournament_report(evaluated: DataFrame, bars: DataFrame, timeframe: str = "D1") -> DataFrame:
    """Champions per model with risk-free, buy & hold and trend rows, one table per symbol."""
    sma_bars = SMA_BARS[timeframe]
    per_model, _ = pick_champions(evaluated)
    null = lambda t="double": F.lit(None).cast(t)
    champ = per_model.select("symbol", F.col("model").alias("name"), "bank", "threshold", "is_dead",
                             "alpha", "cagr", "n", "win_rate", "avg_duration", "sharpe", "starr", "mdd",
                             "cvar_95")

    def bench(df, name):
        return df.select("symbol", F.lit(name).alias("name"), null("string").alias("bank"),
                         null().alias("threshold"), null("boolean").alias("is_dead"),
                         null().alias("alpha"), "cagr", null("bigint").alias("n"),
                         null().alias("win_rate"), null().alias("avg_duration"), "sharpe",
                         null().alias("starr"), "mdd", "cvar_95")
    hold = bench(series_metrics(buy_and_hold(bars), ["symbol"]), "BUY_HOLD")
    trend = bench(series_metrics(trend_returns(bars, sma_bars), ["symbol"]), f"SMA_{sma_bars}")
    free = bench(bars.select("symbol").distinct().select(
        "symbol", dbl(RISK_FREE).alias("cagr"), null().alias("sharpe"), null().alias("mdd"),
        null().alias("cvar_95")), "RISK_FREE")
    return champ.unionByName(free).unionByName(hold).unionByName(trend)


def equity_points(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Curve points per champion strategy, with a leading 1.0 one day before the first exit."""
    t = trades.join(bars.select("symbol", F.col("bar_idx").alias("exit_idx"), F.col("time")),
                    ["symbol", "exit_idx"])
    pts = t.select(*STRATEGY, F.to_date("time").alias("date"), F.col("cum_ret").alias("equity"))
    lead = pts.groupBy(*STRATEGY).agg(F.date_sub(F.min("date"), 1).alias("date")).withColumn(
        "equity", dbl(1.0))
    return pts.unionByName(lead.select(*pts.columns))


def numbered_trades(trades: DataFrame, keys: Sequence[str] = STRATEGY) -> DataFrame:
    return dense_index(trades, keys, "exit_idx", block_of("exit_idx"), "trade_no", "n_trades")


def leveraged(trades: DataFrame, keys: Sequence[str] = STRATEGY, risk: float = 0.045,
              n_sims: int = 1000, include_current: bool = False) -> DataFrame:
    """Walk-forward leverage: budget from the bootstrap drawdown of the trades so far, re-estimated
    every 30 trades, times the Kelly tier; capital compounds.

    The estimate for an epoch uses the trades before it.  `include_current` moves each epoch one
    trade ahead, so that the first trade of an epoch is part of its own estimate.
    Needs prob and threshold.
    """
    keys = list(keys)
    t = cut(numbered_trades(trades, keys))
    shift = 1 if include_current else 0
    t = t.withColumn("epoch", F.floor((F.col("trade_no") + shift) / EPOCH))
    specs = (t.filter("epoch > 0").select(*keys, "epoch").distinct()
             .withColumn("n", F.col("epoch") * EPOCH))
    mdd = bootstrap_mdd(t, specs, keys, ["epoch"], n_sims)
    cap = risk * 1.5
    d = t.join(mdd, [*keys, "epoch"], "left")
    d = d.withColumn("risk_pct", risk_budget(F.coalesce("mc_mdd_95", dbl(-0.20)), risk, cap))
    d = d.withColumn("leverage", F.col("risk_pct") * kelly(F.col("prob"), F.col("threshold"))
                     / UNLEVERED_RISK)
    d = d.withColumn("lev_ret", F.col("ret") * F.col("leverage")).drop("cum_ret")
    return equity(d, "lev_ret", keys=keys, pos="trade_no").withColumnRenamed("cum_ret", "capital")


def journal_equity(journal: DataFrame, capital: float = 10000.0, fallback: float = 0.015) -> DataFrame:
    """Equity after each executed signal.

    pnl is +risk * (1.33 if the score is above 0.65 else 1), or -risk below the threshold.  A missing
    risk is a share of the running capital, so each row maps capital to m * capital + a; such maps
    chain by a scan in levels.  Rows are numbered by range partitions, whatever a month holds.
    """
    d = journal.filter("status = 'EJECUTADO'").withColumn("_all", F.lit(0))
    d = range_index(d, ["timestamp", "order_no"], "seq", "n_exec")
    gain = F.when(F.col("probability") >= F.col("threshold"),
                  F.when(F.col("probability") > 0.65, dbl(1.33)).otherwise(dbl(1.0))).otherwise(dbl(-1.0))
    has = F.col("risk_usd").isNotNull() & (F.col("risk_usd") > 0)
    d = d.withColumns({"_m": F.when(has, dbl(1.0)).otherwise(1 + dbl(fallback) * gain),
                       "_a": F.when(has, F.col("risk_usd") * gain).otherwise(dbl(0.0))})
    return affine_path(d, capital, "_m", "_a", "capital", keys=["_all"], pos="seq").drop("_m", "_a")


def live_kpis(curve: DataFrame, capital: float = 10000.0) -> DataFrame:
    """ROI, Sharpe, drawdown and win rate of a journal curve (from `journal_equity`)."""
    prev = in_blocks(curve, lambda d, w: d.withColumn(
        "_prev", F.coalesce(F.lag("capital").over(w()), dbl(capital))), keys=["_all"], back=1, pos="seq")
    d = prev.withColumn("ret", F.col("capital") / F.col("_prev") - 1)
    walked = equity(d, "ret", keys=["_all"], pos="seq", start_at_one=True)
    m = F.avg("ret") / F.stddev_pop("ret") * (252 ** 0.5)
    return walked.groupBy("_all").agg(
        F.max_by("capital", "seq").alias("capital"), F.count(F.lit(1)).alias("n_trades"),
        F.when(F.stddev_pop("ret") > 0, m).otherwise(dbl(0.0)).alias("sharpe"),
        F.least(F.min("drawdown"), dbl(0.0)).alias("mdd"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate")).withColumn(
        "roi", F.col("capital") / capital - 1).drop("_all")


def last_executions(journal: DataFrame, n: int = 20) -> DataFrame:
    """The newest n executed signals (top-n report)."""
    return (journal.filter("status = 'EJECUTADO'").orderBy(F.desc("timestamp"), F.desc("order_no")).limit(n))
