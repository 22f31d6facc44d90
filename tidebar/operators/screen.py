"""Universe screening: persistence, correlation and greedy decorrelation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidebar.functions.expr import clip, dbl
from tidebar.operators.series import block_of, dense_index, range_index, simple_return
from tidebar.session import cut

MAX_LAG = 100
RECENT = 1500
TILE = 64            # symbols whose returns meet in one matrix product

# Liquid tickers in order of priority, and those that also get an intraday variant.
PRIORITY = ("EURUSD", "GBPUSD", "USDJPY", "AUDUSD", "NZDUSD", "USDCAD", "USDCHF", "EURGBP", "EURJPY",
            "GBPJPY", "XAUUSD", "XAGUSD", "SP500", "US500", "NAS100", "US100", "GER40", "DE40",
            "UK100", "WTI", "XTIUSD", "XBRUSD")
WITH_H4 = ("EURUSD", "SP500", "US500", "XAUUSD")


def recent_bars(bars: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest n bars of each series, renumbered from 0."""
    first = F.greatest(F.col("n_bars") - n, F.lit(0).cast("long"))
    return (bars.filter(F.col("bar_idx") >= first)
            .withColumn("bar_idx", F.col("bar_idx") - first)
            .withColumn("n_bars", F.least(F.col("n_bars"), F.lit(n).cast("long"))))


def hurst(bars: DataFrame, col: str = "close", max_lag: int = MAX_LAG) -> DataFrame:
    """Rescaled-range exponent per symbol; 0.5 where a series is too short.

    Every row goes into one chunk per chunk length, so the unit of work is (symbol, length, chunk)
    with at most `max_lag` rows; a long series is simply many chunks.
    """
    sizes = F.array(*[F.lit(k) for k in range(10, max_lag, 5)])
    x = (bars.select("symbol", "bar_idx", "n_bars", F.col(col).alias("x"))
         .withColumn("k", F.explode(sizes))
         .withColumn("chunk", F.floor(F.col("bar_idx") / F.col("k")))
         .filter((F.col("chunk") < F.floor(F.col("n_bars") / F.col("k")))
                 & (F.floor(F.col("n_bars") / F.col("k")) >= 2)
                 & (F.col("n_bars") >= 2 * max_lag)))
    whole = Window.partitionBy("symbol", "k", "chunk")
    upto = whole.orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = x.withColumn("_d", F.col("x") - F.avg("x").over(whole)).withColumn("z", F.sum("_d").over(upto))
    rs = (z.groupBy("symbol", "k", "chunk")
          .agg((F.max("z") - F.min("z")).alias("r"), F.stddev_pop("x").alias("s"))
          .filter("s > 0")
          .groupBy("symbol", "k").agg(F.avg(F.col("r") / F.col("s")).alias("rs")))
    slope = (rs.groupBy("symbol").agg(
        F.regr_slope(F.ln("rs"), F.ln("k")).alias("h"), F.count(F.lit(1)).alias("n_sizes")))
    value = F.when(F.col("n_sizes") >= 2, clip(F.col("h"), 0.0, 1.0)).otherwise(dbl(0.5))
    return (bars.select("symbol").distinct().join(slope, "symbol", "left")
            .select("symbol", F.coalesce(value, dbl(0.5)).alias("hurst")))


def aligned_returns(bars: DataFrame, name: str = "symbol", ret: str = "ret",
                    time: str = "time") -> DataFrame:
    """Per symbol its returns in time order, with their times, so that any two symbols can be compared where both have
    one.  The arrays are bounded by the number of recent bars the caller keeps."""
    rows = F.sort_array(F.collect_list(F.struct(time, ret)))
    days = F.unix_micros(F.col(time).cast("timestamp")) if bars.schema[time].dataType.typeName() in (
        "date", "timestamp", "timestamp_ntz") else F.col(time).cast("long")
    return (bars.withColumn(time, days).groupBy(name).agg(rows.alias("_x"))
            .select(name, F.transform("_x", lambda s: s[time]).alias("t"), F.transform("_x", lambda s: s[ret]).alias("r")))


def _pair_sums(times: list, returns: list) -> tuple[np.ndarray, np.ndarray]:
    """(shared observations, correlation) of every two rows over the times both have."""
    at = np.unique(np.concatenate(times)) if len(times) else np.zeros(0)
    x, have = np.zeros((len(times), len(at))), np.zeros((len(times), len(at)))
    for k, (t, r) in enumerate(zip(times, returns)):
        place = np.searchsorted(at, t)
        x[k, place], have[k, place] = r, 1.0
    x -= have * (x.sum(1) / np.maximum(have.sum(1), 1))[:, None]          # centred once, for the digits
    n, s, q = have @ have.T, x @ have.T, (x * x) @ have.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, var = x @ x.T - s * s.T / n, q - s * s / n
        return n, np.where((var > 0) & (var.T > 0) & (n > 1), cov / np.sqrt(var * var.T), np.nan)


def correlation(arrays: DataFrame, name: str = "symbol") -> DataFrame:
    """Correlation of every unordered pair over the times they share: the pairs are the result, one row each.

    Symbols are dealt into tiles of about `TILE`; each pair of tiles meets under an equi key and is four matrix products.
    `arrays` is written once, as it is counted and then dealt.
    """
    arrays = cut(arrays)
    tiles = 1 + arrays.count() // TILE                       # one number; its square is the number of groups
    tile = F.pmod(F.xxhash64(name), F.lit(tiles))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    dealt = arrays.select(F.col(name).alias("a"), "t", "r", tile.alias("own"), other.alias("other")).select(
        "a", "t", "r", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        n, c = _pair_sums([np.asarray(t) for t in pdf["t"]], [np.asarray(r, float) for r in pdf["r"]])
        names, own = pdf["a"].to_numpy(object), pdf["own"].to_numpy()
        i, j = np.triu_indices(len(names), 1)
        if len(pdf) and pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            i, j = i[own[i] != own[j]], j[own[i] != own[j]]   # pairs within a tile belong to the tile itself
        i, j = i[n[i, j] > 0], j[n[i, j] > 0]                 # two symbols without a shared time are no pair
        corr = c[i, j].astype(object)
        corr[np.isnan(c[i, j])] = None
        return pd.DataFrame({"a": names[i], "b": names[j], "n_obs": n[i, j].astype(np.int32), "corr": corr})

    return dealt.groupBy("lo", "hi").applyInPandas(product, "a string, b string, n_obs int, corr double")


def greedy_decorrelate(ranked: DataFrame, corr: DataFrame, max_corr: float = 0.80) -> DataFrame:
    """Keep a candidate if its |correlation| with every one kept before is at most `max_corr`.

    `ranked`: symbol, rank, one row per candidate.  A round keeps every undecided candidate that conflicts with no undecided
    one before it and drops what conflicts with those; the result is that of the walk in order.  Rounds work on
    conflicts as rows, so no task sees all names.  `pos` is the place among the kept.
    """
    place = ranked.select("symbol", "rank")
    bad = corr.filter(F.abs("corr") > max_corr).select("a", "b")
    lower, upper = place.toDF("a", "_ra"), place.toDF("b", "_rb")
    first = F.col("_ra") < F.col("_rb")
    edges = cut(bad.join(lower, "a").join(upper, "b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi")))
    waiting = cut(place)
    kept = []
    while not edges.isEmpty():
        keep = cut(waiting.join(edges.select(F.col("hi").alias("symbol")).distinct(), "symbol", "left_anti"))
        kept.append(keep)
        gone = edges.join(keep.select(F.col("symbol").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("symbol")).distinct()
        waiting = cut(waiting.join(keep.select("symbol").unionByName(gone), "symbol", "left_anti"))
        still = waiting.select("symbol")
        edges = cut(edges.join(still.withColumnRenamed("symbol", "lo"), "lo", "left_semi")
                    .join(still.withColumnRenamed("symbol", "hi"), "hi", "left_semi"))
    out = reduce(DataFrame.unionByName, kept, waiting)
    numbered = dense_index(out.withColumn("_all", F.lit(0)), ["_all"], "rank", block_of("rank"), "pos")
    return numbered.select(F.col("pos").cast("int").alias("pos"), "symbol")


def screen_universe(bars: DataFrame, min_hurst: float = 0.55, max_corr: float = 0.80) -> DataFrame:
    """Hurst filter, then greedy decorrelation in symbol order; if nothing passes the filter, all candidates go on.

    Every symbol of `bars` is a candidate.  Two symbols are compared at the times both have, so a short series shortens
    only its own pairs.
    """
    recent = cut(recent_bars(bars).filter(F.col("n_bars") > 200))
    scores = hurst(recent)
    scores = cut(scores)
    if not scores.filter(F.col("hurst") >= min_hurst).isEmpty():
        scores = scores.filter(F.col("hurst") >= min_hurst)
    ranked = cut(range_index(scores, ["symbol"], "rank").select("symbol", "rank", "hurst"))
    returns = simple_return(recent.join(ranked.select("symbol"), "symbol", "left_semi"))
    corr = correlation(aligned_returns(returns))
    return greedy_decorrelate(ranked, corr, max_corr).join(ranked.select("symbol", "hurst"), "symbol")


def prioritise(symbols: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Priority tickers first (some with an H4 variant), then other visible symbols; a report of `max_candidates` rows
    where that is given (priority tickers always stay).

    `symbols`: symbol, visible, listing_no.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in PRIORITY]), F.col("symbol"))
    ranked = symbols.withColumn("_p", rank)
    pri = ranked.filter("_p > 0").select(
        "symbol", F.explode(F.when(F.col("symbol").isin(*WITH_H4), F.array(F.lit("D1"), F.lit("H4")))
                            .otherwise(F.array(F.lit("D1")))).alias("timeframe"),
        F.lit(0).alias("tier"), F.col("_p").cast("long").alias("seq"))
    other = ranked.filter((F.col("_p") == 0) & F.col("visible")).select(
        "symbol", F.lit("D1").alias("timeframe"), F.lit(1).alias("tier"), F.col("listing_no").alias("seq"))
    # `limit` under an order keeps per-task top rows only, so nothing is sorted whole
    top = pri.unionByName(other if max_candidates is None else other.orderBy("seq").limit(max_candidates))
    n_pri = F.count_if(F.col("tier") == 0).over(Window.partitionBy())
    order = Window.orderBy("tier", "seq", "timeframe")
    return (top.withColumn("_n", n_pri).withColumn("position", F.row_number().over(order))
            .filter((F.col("tier") == 0) | (F.lit(max_candidates).isNull()) | (F.col("position") <= F.lit(max_candidates)))
            .select("position", F.when(F.col("timeframe") == "D1", F.col("symbol"))
                    .otherwise(F.concat_ws("_", "symbol", "timeframe")).alias("name"),
                    "symbol", "timeframe"))
