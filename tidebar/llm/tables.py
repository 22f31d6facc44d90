"""Written tables that cut lineage, and size checks before a broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidebar.session import scratch_path

BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers batches of at most BATCH_ROWS rows, so that a worker holds a few
    megabytes of text and its results at a time.  A smaller setting of the cluster stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def carried(docs: DataFrame, *made: str) -> Column:
    """All columns of `docs` as one struct, but those an operator makes itself: its own replace them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors.  With `folder`, a scratch
    folder that its owner removes once nothing reads from it any more."""
    spark = df.sparkSession
    path = f"{folder}/{label}-{uuid.uuid4().hex}" if folder else scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder through Spark's own file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, bytes_per_row, most: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of all rows is under the bound of a broadcast."""
    return (df.select(F.sum(bytes_per_row).alias("n")).first()["n"] or 0) <= most


def small_or_shuffled(df: DataFrame, bytes_per_row, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if the measured size of all its rows is under `most`; otherwise left to a
    shuffled join, which the optimizer may split where it is skewed."""
    return F.broadcast(df) if fits(df, bytes_per_row, most) else df
