"""Position lifecycle: one open position per key and threshold, closed by a barrier or after `max_hold` bars.

A micro-batch is evaluated as a table: the exits of all its candidate entries at once (`barriers.outcomes`), then the walk that
takes them one after another (`trades.non_overlapping`).  What goes from batch to batch is small: the newest
`max_hold` bars of a key, which an open position still needs, and the bar from which a strategy is free again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.functions.expr import dbl
from tidebar.operators import barriers, trades
from tidebar.session import cut
from tidebar.streaming.monitors import VersionedTable

BARS = ("symbol string, time timestamp, bar_idx long, open double, high double, low double, close double, EGARCH_Vol double, "
        "k_up double, k_down double, cost double, prob double, bilateral boolean")
FREE = "symbol string, threshold double, free long"
OUT = ("symbol string, threshold double, entry_idx long, exit_idx long, side int, exit_kind string, duration int, "
       "prob double, ret double")
KEYS = ["symbol", "threshold"]


class PositionBook:
    """State and closed positions in a folder that all executors share; a job that is started again goes on from it."""

    def __init__(self, spark: SparkSession, path: str, max_hold: int = 10,
                 thresholds: Sequence[float] = trades.THRESHOLDS):
        self.spark, self.path, self.max_hold, self.thresholds = spark, path.rstrip("/"), max_hold, tuple(thresholds)
        self.tail = VersionedTable(spark, f"{self.path}/tail", BARS)
        self.free = VersionedTable(spark, f"{self.path}/free", FREE)

    def closed(self) -> DataFrame:
        """All positions closed so far."""
        if not self.free.versions():
            return self.spark.createDataFrame([], OUT)
        return self.spark.read.schema(OUT).parquet(f"{self.path}/closed/batch=*")

    def job(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch job; bars of a key arrive in time order from batch to batch, in any order within one."""
        rows = cut(self.tail.read(batch_id).unionByName(batch.select(*[c.split()[0] for c in BARS.split(", ")])))
        free = self.free.read(batch_id)
        seen = cut(rows.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n_bars")))
        bars = rows.join(seen, "symbol")
        found = barriers.outcomes(bars, self.max_hold, unfinished=True)
        cands = trades.candidates(trades.signals(rows.select("symbol", "bar_idx", "prob", "bilateral"), self.thresholds), found)
        cands = cands.join(free, KEYS, "left").filter(F.col("bar_idx") >= F.coalesce("free", F.lit(0)))
        # nothing seen so far ends an open position, so it holds every bar that has come
        end = F.when(F.col("exit_kind").isNull(), F.col("bar_idx") + self.max_hold).otherwise(F.col("exit_idx"))
        walk = trades.non_overlapping(cands.drop("free").withColumn("exit_idx", end), KEYS, self.max_hold)
        picked = cut(walk)
        done = F.col("exit_kind").isNotNull()
        picked.filter(done).select(*[c.split()[0] for c in OUT.split(", ")]).write.mode("overwrite").parquet(
            f"{self.path}/closed/batch={batch_id}")
        moved = picked.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(~done, F.col("entry_idx"))), F.max("exit_idx")).alias("free"))
        self.tail.write(bars.filter(F.col("bar_idx") >= F.col("n_bars") - self.max_hold).drop("n_bars"), batch_id)
        self.free.write(free.join(moved.select(*KEYS), KEYS, "left_anti").unionByName(moved), batch_id)


def position_bars(bars: DataFrame, scores: DataFrame, max_hold: int = 10) -> DataFrame:
    """Stream rows of every scored strategy: bars with parameters and score; bars whose trade could not be held to its
    end within the history carry no score."""
    d = bars.drop("bilateral").join(scores, ["symbol", "bar_idx"])
    whole = (F.col("bar_idx") < F.col("n_bars") - max_hold - 1) & F.col("EGARCH_Vol").isNotNull()
    return d.select(F.concat_ws("/", "symbol", "model", "bank").alias("symbol"), F.col("time").cast("timestamp").alias("time"), "bar_idx",
                    "open", "high", "low", "close", "EGARCH_Vol", *[F.col(c).cast("double").alias(c) for c in ("k_up", "k_down", "cost")],
                    F.when(whole, F.col("prob")).otherwise(dbl(0.5)).alias("prob"), "bilateral")
