"""Scans, incremental loading and normalisation of bars and macro series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tidebar.operators.series import KEYS, day_number, fill, running
from tidebar.session import cut

BAR_FIELDS = ("open", "high", "low", "close", "tick_volume", "real_volume", "spread")
BAR_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampType()), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("tick_volume", T.LongType()),
    T.StructField("real_volume", T.LongType()), T.StructField("spread", T.DoubleType())])
BAR_WIDTH = {"D1": "1 day", "H4": "4 hours", "H1": "1 hour"}


def read_bar_csv(spark: SparkSession, path: str, symbol_pattern: str = r"([^/]+)_daily\.csv$") -> DataFrame:
    """All bar files of a folder; the symbol comes from the file path.

    Columns are taken by each file's own header line, one that names `close`, so files may differ in column order and have
    a leading unnamed index column; a column that a file lacks is null.  Headers are joined to their files' lines, so
    any number of layouts is one plan, and files without lines give no rows.  Rows without a close are dropped.
    """
    fields = F.transform(F.split("value", ","), lambda f: F.trim(F.replace(f, F.lit('"'), F.lit(""))))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), fields.alias("f"))
    is_head = F.array_contains("f", "close")
    heads = lines.filter(is_head).select("file", F.col("f").alias("names")).dropDuplicates(["file"])
    at = {f.name: F.array_position("names", f.name) for f in BAR_SCHEMA}
    rows = lines.filter(~is_head).join(heads, "file")
    cols = [F.when(p > 0, F.get("f", p.cast("int") - 1)).try_cast(BAR_SCHEMA[c].dataType).alias(c) for c, p in at.items()]
    symbol = F.regexp_extract("file", symbol_pattern, 1)
    return rows.select(symbol.alias("symbol"), *cols).na.drop(subset=["close"])


def normalise_bars(df: DataFrame, timeframe: str = "D1", epoch: str = "time") -> DataFrame:
    """Epoch seconds to timestamp, first row per time, D1 truncated to the day, seven columns."""
    t = F.timestamp_seconds(F.col(epoch))
    order = Window.partitionBy("symbol", epoch).orderBy("row_no")
    first = (df.withColumn("_r", F.row_number().over(order)).filter("_r = 1"))
    time = F.date_trunc("day", t) if timeframe == "D1" else t
    return first.select("symbol", time.alias("time"), *BAR_FIELDS)


def read_range(df: DataFrame, start: int | None = None, end: int | None = None, time: str = "time") -> DataFrame:
    """Rows of the years start..end (open where not given), in one scan under one range predicate, which prunes
    partitions and row groups; the chunks of an extraction are the scan's own splits."""
    col, out = F.col(time), df.filter(F.col(time).isNotNull())
    if start is not None:
        out = out.filter(col >= F.make_date(F.lit(start), F.lit(1), F.lit(1)))
    if end is not None:
        out = out.filter(col < F.make_date(F.lit(end + 1), F.lit(1), F.lit(1)))
    return out


def bars_from_ticks(ticks: DataFrame, timeframe: str = "H4", keys: Sequence[str] = KEYS) -> DataFrame:
    """OHLC bars of a tick table: one aggregate with map-side combine, so hot symbols do not skew."""
    order = F.struct("time", "tick_id")
    return (ticks.groupBy(*keys, F.window("time", BAR_WIDTH[timeframe]).alias("_w"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                 F.count(F.lit(1)).alias("tick_volume"))
            .select(*keys, F.col("_w.start").alias("time"), "open", "high", "low", "close",
                    "tick_volume", F.lit(0).cast("long").alias("real_volume"),
                    F.lit(0.0).alias("spread")))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the largest `order`: an aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """Old and new rows together; the new row wins where both have a key."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return newest_per_key(both, list(keys), ["_batch"]).drop("_batch")


def high_water_mark(df: DataFrame, keys: Sequence[str] = KEYS, floor: str = "2000-01-01",
                    overlap_days: int = 1) -> DataFrame:
    """Where the next extraction of each series starts."""
    return df.groupBy(*keys).agg(F.greatest(
        F.date_sub(F.max("time"), overlap_days), F.lit(floor).cast("date")).alias("start"))


def incremental(df: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows at or after the mark of their series; series without a mark come whole."""
    joined = df.join(marks, list(keys), "left")
    return joined.filter(F.col("start").isNull() | (F.col("time") >= F.col("start"))).drop("start")


def stale_only(raw: DataFrame, processed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Raw rows of series whose newest raw bar is newer than the processed one."""
    keys = list(keys)
    r = raw.groupBy(*keys).agg(F.max("time").alias("_raw"))
    p = processed.groupBy(*keys).agg(F.max("time").alias("_done"))
    todo = r.join(p, keys, "left").filter(F.col("_done").isNull() | (F.col("_raw") > F.col("_done")))
    return raw.join(todo.select(*keys), keys, "left_semi")


def read_series_json(spark: SparkSession, path: str, out: str = "TPM") -> DataFrame:
    """Yearly documents {"serie": [{"fecha": ..., "valor": ...}]} as (date, value)."""
    schema = "serie array<struct<fecha:string,valor:double>>"
    return flatten_series(spark.read.schema(schema).option("multiLine", True).json(path), out)


def flatten_series(docs: DataFrame, out: str = "TPM", keep: Sequence[str] = ()) -> DataFrame:
    x = docs.select(*keep, F.explode("serie").alias("s"))
    return x.select(*keep, F.to_date(F.substring("s.fecha", 1, 10)).alias("date"), F.col("s.valor").alias(out))


def clean_spread(df: DataFrame, raw_date: str, raw_value: str, lag: int = 3,
                 out: str = "EMBI", keys: Sequence[str] = ()) -> DataFrame:
    """Coerce text to date and number (NULL on error), drop bad dates, delay by `lag` rows.

    The delay is by row within each of `keys`; days are numbered densely so that blocks can be used instead of one
    ordered partition.
    """
    from tidebar.operators.series import dense_index, lagged
    by = [*keys, "_all"]
    d = df.select(*keys, F.expr(f"try_to_date({raw_date})").alias("date"),
                  F.expr(f"try_cast({raw_value} as double)").alias(out), F.lit(0).alias("_all"))
    d = d.filter("date is not null")
    d = dense_index(d, by, "date", F.year("date"), "_pos")
    return lagged(d, [out], lag, keys=by, pos="_pos").drop("_all", "_pos")


def normalise_download(df: DataFrame) -> DataFrame:
    """Lower-case names, volume -> real_volume, tick_volume copy, zero spread, midnight times."""
    d = df.toDF(*[c.lower() for c in df.columns])
    d = d.withColumnsRenamed({"volume": "real_volume", "adj close": "adj_close"})
    return d.withColumns({"tick_volume": F.col("real_volume"), "spread": F.lit(0.0),
                          "time": F.date_trunc("day", F.col("time"))})


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monday to Friday between two dates, as a calendar spine."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as time")
    return days.filter(F.weekday("time") < 5)


def join_macro(bars: DataFrame, macro: DataFrame, cols: Sequence[str], backfill: bool = True,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars with the macro values of their date, holes filled from the bar before.

    Works for daily and intraday bars alike; the macro side is reduced to one row per date first.
    No broadcast hint: the optimizer broadcasts when the side is small.
    """
    one = macro.groupBy("date").agg(*[F.first(c).alias(c) for c in cols])
    joined = (bars.withColumn("date", F.to_date("time")).join(one, "date", "left").drop("date"))
    return fill(joined, cols, keys=keys, backfill=backfill)


def spine_join(spine: DataFrame, series: DataFrame, cols: Sequence[str],
               backfill: bool = True) -> DataFrame:
    """Calendar spine with sparse series, forward- then back-filled."""
    d = spine.join(series.withColumnRenamed("date", "time"), "time", "left")
    d = d.withColumns({"_all": F.lit(0), "_pos": day_number()})
    return fill(d, cols, keys=["_all"], pos="_pos", backfill=backfill).drop("_all", "_pos")


DAY = 86_400_000_000


def asof_backward(left: DataFrame, right: DataFrame, cols: Sequence[str], *,
                  by: Sequence[str] = (), time: str = "time", backfill: bool = True, width: int = DAY) -> DataFrame:
    """Newest right value at or before each left row; leading holes take the next right value.

    Time is cut into buckets of `width` microseconds.  The right side becomes one row per (by, bucket): its rows in
    time order, and what was last seen before and is first seen after it.  Left rows meet that row under an equi key,
    so neither side is ever ordered, and a crowded bucket of the left side is only a skewed join key, which can be split.
    A bucket of the right side is one array; choose `width` so that it stays small.
    """
    by = list(by)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    right = right.select(*by, micros.alias("_t"), *cols).withColumn("_bkt", F.floor(F.col("_t") / width).cast("long"))
    seen = lambda c: F.when(F.col(c).isNotNull(), F.col("_t"))
    buckets = cut(right.groupBy(*by, "_bkt").agg(
        F.sort_array(F.collect_list(F.struct("_t", *cols))).alias("_rows"),
        *[F.max_by(c, seen(c)).alias(f"_l_{c}") for c in cols], *[F.min_by(c, seen(c)).alias(f"_n_{c}") for c in cols]))
    lefts = left.withColumn("_bkt", F.floor(micros / width).cast("long"))
    asked = lefts.select(*by, "_bkt").distinct()

    def carried(kind: str, mark: str, writes_at: int) -> DataFrame:
        """Per asked bucket the values of the buckets before (`last`) or after (`next`) it: one row per bucket."""
        writers = buckets.select(*by, (F.col("_bkt") * 2 + writes_at).alias("_pos"), F.lit(False).alias("_ask"),
                                 *[F.col(f"{mark}{c}") for c in cols])
        readers = asked.select(*by, (F.col("_bkt") * 2 + 1 - writes_at).alias("_pos"), F.lit(True).alias("_ask"),
                               *[F.lit(None).cast(buckets.schema[f"{mark}{c}"].dataType).alias(f"{mark}{c}") for c in cols])
        both = writers.unionByName(readers).withColumn("_all", F.lit(0))
        ran = running(both, {f"_v{i}": (kind, f"{mark}{c}") for i, c in enumerate(cols)}, keys=[*by, "_all"], pos="_pos", size=1024)
        return ran.filter("_ask").select(*by, F.floor(F.col("_pos") / 2).cast("long").alias("_bkt"),
                                         *[F.col(f"_v{i}").alias(f"{mark}{c}") for i, c in enumerate(cols)])

    def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
        on = [*by, "_bkt"]
        table = table.withColumnsRenamed({k: f"_k_{k}" for k in on})
        same = reduce(and_, [rows[k].eqNullSafe(F.col(f"_k_{k}")) for k in on])
        return rows.join(table, same, "left").drop(*[f"_k_{k}" for k in on])

    d = attach(lefts, buckets.select(*by, "_bkt", "_rows"))
    d = attach(d, carried("last", "_l_", 1))
    if backfill:
        d = attach(d, carried("next", "_n_", 0))
    d = d.withColumn("_t", micros)
    value = {}
    for c in cols:
        past = F.filter("_rows", lambda s: (s["_t"] <= F.col("_t")) & s[c].isNotNull())
        found = [F.element_at(F.transform(past, lambda s: s[c]), F.when(F.size(past) > 0, F.lit(-1))), F.col(f"_l_{c}")]
        if backfill:
            ahead = F.filter("_rows", lambda s: (s["_t"] > F.col("_t")) & s[c].isNotNull())
            found += [F.get(F.transform(ahead, lambda s: s[c]), F.lit(0)), F.col(f"_n_{c}")]
        value[c] = F.coalesce(*found)
    marks = ["_l_", "_n_"] if backfill else ["_l_"]
    return d.withColumns(value).drop("_rows", "_t", "_bkt", *[f"{m}{c}" for m in marks for c in cols])
