"""Table, report and journal sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.sources.ingest import newest_per_key


def write_table(df: DataFrame, path: str, partition: str = "symbol", mode: str = "overwrite") -> None:
    """Parquet by symbol; a hot symbol is split over tasks by the rebalance hint and AQE."""
    df.hint("rebalance", partition).write.mode(mode).partitionBy(partition).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Run summaries, the newest per (asset, model, bank)."""
    return newest_per_key(old.unionByName(new), ["asset", "model", "bank"], ["run_no"])
