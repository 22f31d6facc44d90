"""Micro-batch jobs: quarantine events, risk recalibration and rebalancing.

State lives in parquet tables, one folder per version, so a replayed batch writes the same folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.functions.expr import dbl
from tidebar.functions.signals import kill_switch, risk_budget
from tidebar.operators import allocate
from tidebar.operators.bootstrap import bootstrap_mdd
from tidebar.operators.series import dense_index, block_of
from tidebar.session import cut

RECALIBRATE_EVERY = 30
REBALANCE_DAYS = 30


class VersionedTable:
    """A small table replaced as a whole by each micro-batch: `<path>/v=<batch id>`.

    Nothing is kept in memory: the newest complete version is found in storage, so a restarted job goes on from it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        """Versions whose write was completed."""
        context = self.spark.sparkContext
        done = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        found = done.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(done) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("v=")) for f in found)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest complete version, of those below `before` where it is given."""
        old = [v for v in self.versions() if before is None or v < before]
        if not old:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={old[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def current(self) -> DataFrame:
        return self.read()


STATUS = "symbol string, quarantined boolean, drifting boolean"


def status_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per change: quarantine, lift, drift, drift_over.  Unseen symbols count as healthy."""
    o = old.select("symbol", F.col("quarantined").alias("_q"), F.col("drifting").alias("_d"))
    j = new.join(o, "symbol", "left").withColumns(
        {"_q": F.coalesce("_q", F.lit(False)), "_d": F.coalesce("_d", F.lit(False))})
    q, d = F.col("quarantined"), F.col("drifting")
    ev = F.array_compact(F.array(
        F.when(q & ~F.col("_q"), "quarantine").when(~q & F.col("_q"), "lift"),
        F.when(d & ~F.col("_d") & ~q, "drift").when(~d & F.col("_d") & ~q, "drift_over")))
    return j.select("symbol", F.explode(ev).alias("event"))


def monitor_status(trades: DataFrame, drift: DataFrame) -> DataFrame:
    """Current status per symbol from the replayed trades and the drift check."""
    dead = trades.groupBy("symbol").agg(F.bool_or("is_dead").alias("quarantined"))
    return dead.join(drift.select("symbol", "drift"), "symbol", "left").select(
        "symbol", "quarantined", F.coalesce("drift", F.lit(False)).alias("drifting"))


def monitor_job(replay: Callable[[DataFrame], DataFrame], table: VersionedTable, events_path: str):
    """foreachBatch job: `replay(batch)` gives the status; only changes are appended as events."""
    def job(batch: DataFrame, batch_id: int) -> None:
        new = cut(replay(batch))                 # used for the events and for the state
        old = table.read(batch_id)
        status_events(old, new).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{events_path}/batch={batch_id}")
        kept = old.join(new.select("symbol"), "symbol", "left_anti").unionByName(new)
        table.write(kept, batch_id)
    return job


LIVE = "symbol string, seq long, ret double"
RISK = "symbol string, n_live long, mc_mdd_95 double, optimal_risk_pct double, kill_switch_mdd double"


def recalibrate(history: DataFrame, live: DataFrame, every: int = RECALIBRATE_EVERY,
                n_sims: int = 1000, known: DataFrame | None = None) -> DataFrame:
    """New risk budget for each symbol whose number of live trades has reached a multiple of `every`.

    With `known` (symbol, n_live) only symbols whose multiple has risen since.  `history` and `live`: symbol, seq,
    ret.  Old and live returns are drawn from together, up to the
    last full multiple.
    """
    h = history.select("symbol", F.lit(0).alias("src"), "seq", "ret")
    n_live = live.groupBy("symbol").agg((F.floor(F.count(F.lit(1)) / every) * every).alias("n_live"))
    due = n_live.filter("n_live > 0")
    if known is not None:
        before = known.select("symbol", F.col("n_live").alias("_before"))
        due = due.join(before, "symbol", "left").filter("n_live > coalesce(_before, 0)").drop("_before")
    due = cut(due)
    numbered = dense_index(live, ["symbol"], "seq", block_of("seq"), "k")
    used = (numbered.join(due, "symbol").filter("k < n_live")
            .select("symbol", F.lit(1).alias("src"), "seq", "ret"))
    pool = h.join(due.select("symbol"), "symbol", "left_semi").unionByName(used)
    pool = pool.withColumn("_o", F.struct("src", "seq"))
    pool = dense_index(pool, ["symbol"], "_o", F.struct(F.col("src"), block_of("seq")), "trade_no", "n")
    specs = pool.groupBy("symbol").agg(F.max("n").alias("n"))
    mdd = bootstrap_mdd(pool, specs, ["symbol"], n_sims=n_sims)
    return mdd.join(due, "symbol").select(
        "symbol", "n_live", "mc_mdd_95", risk_budget(F.col("mc_mdd_95")).alias("optimal_risk_pct"),
        kill_switch(F.col("mc_mdd_95")).alias("kill_switch_mdd"))


COUNTS = "symbol string, n_seen long"
BUCKETS = 64


def recalibration_job(history: DataFrame, live_path: str, table: VersionedTable, n_sims: int = 1000):
    """foreachBatch job: append live returns, recompute the symbols that crossed a multiple, upsert.

    Counts per symbol are carried on, so a batch counts its own rows only.  Live returns lie in buckets of symbols, and only
    the buckets of symbols that are due are read back.
    """
    counts = VersionedTable(table.spark, f"{table.path}-counts", COUNTS)
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int")

    def job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("symbol", "seq", "ret", bucket.alias("bucket"), F.lit(batch_id).cast("long").alias("batch"))
        # a folder per bucket and batch: a batch that runs again replaces its own
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(live_path)
        new = batch.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_new"))
        seen = cut(counts.read(batch_id).join(new, "symbol", "full").select(
            "symbol", (F.coalesce("n_seen", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("n_seen")))
        old = table.read(batch_id)
        due = cut(seen.join(old.select("symbol", "n_live"), "symbol", "left").filter(
            F.floor(F.col("n_seen") / RECALIBRATE_EVERY) * RECALIBRATE_EVERY > F.coalesce("n_live", F.lit(0))).select("symbol"))
        buckets = [r[0] for r in due.select(bucket.alias("b")).distinct().collect()]          # at most BUCKETS numbers
        live = spark.read.schema(LIVE + ", bucket int, batch long").parquet(live_path).filter(
            F.col("bucket").isin(buckets) & (F.col("batch") <= batch_id)).drop("bucket", "batch")
        live = live.join(due, "symbol", "left_semi")
        fresh = cut(recalibrate(history, live, n_sims=n_sims, known=old))
        counts.write(seen, batch_id)
        table.write(old.join(fresh.select("symbol"), "symbol", "left_anti").unionByName(fresh), batch_id)
    return job


def rebalance_due(weights: DataFrame, now, days: int = REBALANCE_DAYS) -> DataFrame:
    """Portfolios whose newest weights are at least `days` old; `now` is a date column."""
    return (weights.groupBy("portfolio").agg(F.max("as_of").alias("as_of"))
            .filter(F.datediff(now, "as_of") >= days))


WEIGHTS = "portfolio string, strategy string, weight double, use_weighted boolean, as_of date"


def due_weights(returns: DataFrame, due: DataFrame) -> DataFrame:
    """Weights of every due portfolio from the last LOOKBACK days before its clock (`due`: portfolio, now).

    `returns`: portfolio, strategy, date, i (day number common to a portfolio), ret.  HRP weights are shrunk towards
    performance and stand against equal weights over the same days; the better of both becomes the weights of all
    strategies of the portfolio.  A portfolio with fewer than two moving strategies gets none.
    """
    past = returns.join(due, "portfolio").filter(F.col("date") < F.col("now"))
    newest = past.groupBy("portfolio").agg(F.max("i").alias("_last"))
    win = cut(past.join(newest, "portfolio").filter(F.col("i") > F.col("_last") - allocate.LOOKBACK).drop("_last"))
    by = ["portfolio"]
    arrays = cut(allocate.performance_weights(allocate.window_arrays(win, groups=by), by).filter("n_valid > 1"))
    weights = cut(allocate.shrink(arrays.drop("r").join(allocate.hrp(arrays, by), ["portfolio", "strategy"]), "hrp", by))
    contest = allocate.tournament(win, weights, groups=by).select("portfolio", "use_weighted")
    members = returns.join(due, "portfolio").select("portfolio", "strategy", "now").distinct()
    size = members.groupBy("portfolio").agg(F.count(F.lit(1)).alias("_n"))
    out = members.join(size, "portfolio").join(contest, "portfolio").join(
        weights.select("portfolio", "strategy", "weight"), ["portfolio", "strategy"], "left")
    return out.select("portfolio", "strategy", F.when(F.col("use_weighted"), F.coalesce("weight", dbl(0.0)))
                      .otherwise(1 / F.col("_n")).alias("weight"), "use_weighted", F.col("now").alias("as_of"))


def rebalance_job(returns: DataFrame, table: VersionedTable, days: int = REBALANCE_DAYS):
    """foreachBatch job on a clock stream (portfolio, now): portfolios without weights, or with weights `days` old, get new
    ones, upserted as a version."""
    def job(batch: DataFrame, batch_id: int) -> None:
        clock = batch.groupBy("portfolio").agg(F.max("now").alias("now"))
        old = table.read(batch_id)
        held = old.groupBy("portfolio").agg(F.max("as_of").alias("as_of"))
        due = cut(clock.join(held, "portfolio", "left").filter(
            F.col("as_of").isNull() | (F.datediff("now", "as_of") >= days)).select("portfolio", "now"))
        fresh = cut(due_weights(returns, due))
        table.write(old.join(fresh.select("portfolio").distinct(), "portfolio", "left_anti").unionByName(fresh), batch_id)
    return job


def run_job(stream: DataFrame, job, checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
