"""Ordered-series primitives that never put a whole series into one task.

A series may hold a third of all rows, so a plain `Window.partitionBy(symbol)` would be one
giant task.  Two ways around it are used throughout:

* operators with a bounded reach (`look back L rows, look ahead A rows`) run on fixed-size
  blocks of `bar_idx`; rows near a block edge are copied into the neighbour block (`halo`) and the
  copies are dropped afterwards (`core`);
* running operators (sum, product, max, last non-null) run as a two-level scan: inside a block,
  plus a carry computed from one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.functions.expr import dbl
from tidebar.session import cut

KEYS = ("symbol",)
BLOCK = 4096
BLK = "_blk"


def block_of(pos: str | Column, size: int = BLOCK) -> Column:
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(col / F.lit(size)).cast("long")


def day_number(time: str = "time") -> Column:
    """Days since 1970-01-01: an order-preserving position for daily tables."""
    return F.datediff(F.col(time), F.lit("1970-01-01").cast("date"))


def dense_index(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, idx: str,
                n: str | None = None) -> DataFrame:
    """Dense 0-based number of each row by `order` inside `keys`, and (as `n`) the row count.

    `bucket` must rise with `order`.  Rows are counted per bucket with map-side combine; only the
    count table is prefix-summed, and only rows of one bucket are ever ordered together.
    """
    keys = list(keys)
    base = df.withColumn(BLK, bucket)
    counts = base.groupBy(*keys, BLK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, BLK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(n or "_total"))
    inside = Window.partitionBy(*keys, BLK).orderBy(order)
    return (base.withColumn("_rn", F.row_number().over(inside))
            .join(offsets, [*keys, BLK])
            .withColumn(idx, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop(BLK, "_rn", "_off", "_total"))


def range_index(df: DataFrame, order: Sequence[str], idx: str, n: str | None = None) -> DataFrame:
    """Dense 0-based number of each row of the whole table by `order`, and (as `n`) the row count.

    Rows are sorted into range partitions, so a crowded day or month is cut like any other stretch; a row's number is
    its place in its partition after the counts of the partitions before, one row each.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    placed = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias(n or "_total"))
    return (placed.withColumn("_rn", F.row_number().over(inside)).join(offsets, "_part")
            .withColumn(idx, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_off", "_total"))


def with_bar_idx(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "time",
                 bucket: str = "month") -> DataFrame:
    """Add dense `bar_idx` (by time) and `n_bars` per series, numbering month by month."""
    return dense_index(df.drop("bar_idx", "n_bars"), keys, time,
                       F.date_trunc(bucket, F.col(time)), "bar_idx", "n_bars")


def halo(df: DataFrame, back: int = 0, ahead: int = 0, size: int = BLOCK,
         pos: str = "bar_idx") -> DataFrame:
    """Copy each row into every block whose rows may look at it; `_blk` names the block."""
    last = block_of(F.col(pos) + back, size)
    if "n_bars" in df.columns and pos == "bar_idx":
        last = F.least(last, block_of(F.col("n_bars") - 1, size))
    first = F.greatest(F.lit(0).cast("long"), block_of(F.col(pos) - ahead, size))
    return df.withColumn(BLK, F.explode(F.sequence(first, F.greatest(first, last))))


def core(df: DataFrame, size: int = BLOCK, pos: str = "bar_idx") -> DataFrame:
    """Drop the copies made by `halo`."""
    return df.filter(F.col(BLK) == block_of(pos, size)).drop(BLK)


def in_blocks(df: DataFrame, build: Callable[[DataFrame, Callable], DataFrame], *,
              keys: Sequence[str] = KEYS, back: int = 0, ahead: int = 0,
              size: int = BLOCK, pos: str = "bar_idx") -> DataFrame:
    """Run `build(df, w)` on haloed blocks; `w(lo, hi)` gives a row frame, `w()` the ordered window."""
    base = Window.partitionBy(*keys, BLK).orderBy(pos)

    def frame(lo: int | None = None, hi: int | None = None):
        return base if lo is None else base.rowsBetween(lo, hi)

    return core(build(halo(df, back, ahead, size, pos), frame), size, pos)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by `cols` for a compute-heavy grouped kernel.

    Small shuffles are otherwise merged into few tasks by size, although each group takes seconds.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


# --- two-level scans ----------------------------------------------------------------------------

def running(df: DataFrame, scans: dict[str, tuple[str, str]], *, keys: Sequence[str] = KEYS,
            pos: str = "bar_idx", size: int = BLOCK) -> DataFrame:
    """Running aggregates from the start of each series up to and with the current row.

    `scans` maps an output name to (kind, column); kind is sum, product, max, min, last (last
    non-null) or next (next non-null, i.e. back-fill).
    """
    keys = list(keys)
    plain = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}
    base = df.withColumn(BLK, block_of(pos, size))
    upto = (Window.partitionBy(*keys, BLK).orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    # looking forward is a running frame over the reversed order: frames that end at "unbounded
    # following" are evaluated anew for every row
    onward = (Window.partitionBy(*keys, BLK).orderBy(F.desc(pos))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = Window.partitionBy(*keys).orderBy(F.desc(BLK)).rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carries = {}, [], []
    for i, (name, (kind, col)) in enumerate(scans.items()):
        c = F.col(col)
        if kind in plain:
            local[f"_l{i}"] = plain[kind](c).over(upto)
            totals.append(plain[kind](c).alias(f"_t{i}"))
            carries.append(plain[kind](f"_t{i}").over(before).alias(f"_c{i}"))
        elif kind == "last":
            local[f"_l{i}"] = F.last(c, ignorenulls=True).over(upto)
            totals.append(F.max_by(c, F.when(c.isNotNull(), F.col(pos))).alias(f"_t{i}"))
            carries.append(F.last(f"_t{i}", ignorenulls=True).over(before).alias(f"_c{i}"))
        elif kind == "next":
            local[f"_l{i}"] = F.last(c, ignorenulls=True).over(onward)
            totals.append(F.min_by(c, F.when(c.isNotNull(), F.col(pos))).alias(f"_t{i}"))
            carries.append(F.last(f"_t{i}", ignorenulls=True).over(after).alias(f"_c{i}"))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    carry = (base.groupBy(*keys, BLK).agg(*totals).select(*keys, BLK, *carries))
    out = base.withColumns(local).join(carry, [*keys, BLK])
    merged = {}
    for i, (name, (kind, _)) in enumerate(scans.items()):
        l, c = F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind == "sum":
            merged[name] = F.when(l.isNull(), c).otherwise(l + F.coalesce(c, F.lit(0)))
        elif kind == "product":
            merged[name] = l * F.coalesce(c, F.lit(1.0))
        elif kind == "max":
            merged[name] = F.greatest(l, c)
        elif kind == "min":
            merged[name] = F.least(l, c)
        else:
            merged[name] = F.coalesce(l, c)
    drop = [BLK] + [f"_{p}{i}" for i in range(len(scans)) for p in "lc"]
    return out.withColumns(merged).drop(*drop)


def fill(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = KEYS, pos: str = "bar_idx",
         backfill: bool = True, size: int = BLOCK) -> DataFrame:
    """Forward-fill, then (optionally) back-fill the leading gap, in place."""
    scans = {f"_f_{c}": ("last", c) for c in cols}
    if backfill:
        scans |= {f"_b_{c}": ("next", c) for c in cols}
    out = running(df, scans, keys=keys, pos=pos, size=size)
    picked = {c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_b_{c}")) if backfill else F.col(f"_f_{c}")
              for c in cols}
    return out.withColumns(picked).drop(*scans)


def clean_non_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """±Inf and NaN become NULL."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in cols})


# --- returns ------------------------------------------------------------------------------------

def simple_return(df: DataFrame, col: str = "close", out: str = "ret", **kw) -> DataFrame:
    """x / previous x - 1; the first row is 0."""
    return in_blocks(df, lambda d, w: d.withColumn(
        out, F.coalesce(F.col(col) / F.lag(col).over(w()) - 1, F.lit(0.0))), back=1, **kw)


def log_return(df: DataFrame, col: str = "close", out: str = "log_ret", **kw) -> DataFrame:
    """100 * (ln x - ln previous x); the first row is 0."""
    return in_blocks(df, lambda d, w: d.withColumn(
        out, F.coalesce(100 * (F.ln(col) - F.lag(F.ln(col)).over(w())), F.lit(0.0))), back=1, **kw)


def lagged(df: DataFrame, cols: Sequence[str], n: int, suffix: str | None = None, **kw) -> DataFrame:
    """Shift columns by n rows (publication lag, exogenous lag)."""
    name = (lambda c: c) if suffix is None else (lambda c: c + suffix)
    return in_blocks(df, lambda d, w: d.withColumns(
        {name(c): F.lag(c, n).over(w()) for c in cols}), back=n, **kw)


def sma(df: DataFrame, n: int, col: str = "close", out: str = "sma", **kw) -> DataFrame:
    """Simple moving average; NULL until n rows are there.

    The sum of n rows is the difference of two running sums of the block, so the cost per row does
    not grow with n.
    """
    kw.setdefault("size", max(BLOCK, 4 * n))

    def build(d, w):
        upto = w(Window.unboundedPreceding, 0)
        d = d.withColumns({"_s": F.sum(col).over(upto), "_k": F.count(col).over(upto)})
        whole = lambda c: F.col(c) - F.coalesce(F.lag(c, n).over(w()), F.lit(0))
        return (d.withColumns({"_sn": whole("_s"), "_kn": whole("_k")})
                .withColumn(out, F.when(F.col("_kn") == n, F.col("_sn") / n)).drop("_s", "_k", "_sn", "_kn"))
    return in_blocks(df, build, back=n, **kw)


def log_return_in(col: str, w) -> Column:
    """Log return in percent inside a block; 0 on the first bar of a series."""
    return F.when(F.col("bar_idx") == 0, F.lit(0.0)).otherwise(100 * (F.ln(col) - F.lag(F.ln(col)).over(w())))


def rolling_std(df: DataFrame, n: int, col: str, out: str, **kw) -> DataFrame:
    """Sample deviation of the n rows before the current one; NULL until n rows are there."""
    kw.setdefault("size", max(BLOCK, 4 * n))
    return in_blocks(df, lambda d, w: d.withColumn(
        out, F.when(F.count(col).over(w(-n, -1)) == n, F.stddev_samp(col).over(w(-n, -1)))),
        back=n, **kw)


def last_n(df: DataFrame, n: int, **kw) -> DataFrame:
    """The newest n bars of each series; needs `bar_idx` and `n_bars`, so no sort at all."""
    return df.filter(F.col("bar_idx") >= F.col("n_bars") - n)


# --- equity -------------------------------------------------------------------------------------

def equity(df: DataFrame, ret: str = "ret", *, keys: Sequence[str] = KEYS, pos: str = "bar_idx",
           size: int = 1024, start_at_one: bool = False) -> DataFrame:
    """Add `cum_ret` (product of 1+ret), `peak` and `drawdown`.

    The peak starts with the first value; with `start_at_one` it starts at 1.0.
    """
    keys = list(keys)
    base = df.withColumn(BLK, block_of(pos, size))
    upto = (Window.partitionBy(*keys, BLK).orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = (base.withColumn("_p", F.product(1 + F.col(ret)).over(upto))
             .withColumn("_m", F.max("_p").over(upto)))
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (local.groupBy(*keys, BLK)
              .agg(F.max_by("_p", pos).alias("_bp"), F.max("_p").alias("_bm"))
              .withColumn("_cp", F.coalesce(F.product("_bp").over(before), F.lit(1.0)))
              .withColumn("_cm", F.max(F.col("_cp") * F.col("_bm")).over(before))
              .select(*keys, BLK, "_cp", "_cm"))
    floor_ = [F.lit(1.0)] if start_at_one else []
    return (local.join(blocks, [*keys, BLK])
            .withColumn("cum_ret", F.col("_cp") * F.col("_p"))
            .withColumn("peak", F.greatest(F.col("_cp") * F.col("_m"), F.col("_cm"), *floor_))
            .withColumn("drawdown", F.col("cum_ret") / F.col("peak") - 1)
            .drop(BLK, "_p", "_m", "_cp", "_cm"))


def path_summary(df: DataFrame, ret: str = "ret", *, keys: Sequence[str] = KEYS,
                 pos: str = "bar_idx", size: int = 1024) -> DataFrame:
    """Total return and maximum drawdown per key, one row per key.

    Each block of a path is reduced to (product, peak, trough, drawdown); two neighbouring blocks
    combine exactly, because dividing by the larger of two peaks gives the smaller ratio.
    """
    keys = list(keys)
    base = df.withColumn(BLK, block_of(pos, size))
    upto = (Window.partitionBy(*keys, BLK).orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = (base.withColumn("_p", F.product(1 + F.col(ret)).over(upto))
              .withColumn("_m", F.max("_p").over(upto))
              .groupBy(*keys, BLK)
              .agg(F.max_by("_p", pos).alias("_bp"), F.max("_p").alias("_bm"),
                   F.min("_p").alias("_bl"), F.min(F.col("_p") / F.col("_m") - 1).alias("_bd")))
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("_cp", F.coalesce(F.product("_bp").over(before), F.lit(1.0)))
            .withColumn("_cm", F.max(F.col("_cp") * F.col("_bm")).over(before))
            .groupBy(*keys)
            .agg((F.product("_bp") - 1).alias("total_ret"),
                 F.least(F.min("_bd"), F.min(F.col("_cp") * F.col("_bl") / F.col("_cm") - 1))
                 .alias("mdd")))


MAPS = 64            # affine maps that meet in one row


def _affine_entries(maps: DataFrame, start: float, keys: Sequence[str]) -> DataFrame:
    """Value before every block; `maps`: keys, block, and v -> _m * v + _a over the block.

    MAPS neighbours compose to one map of the level above until a key's maps fit one row; values then come down.
    """
    keys = list(keys)
    one = F.struct(dbl(1.0).alias("m"), dbl(0.0).alias("a"))

    def groups(level):
        return (level.withColumn("_up", block_of(BLK, MAPS)).groupBy(*keys, "_up")
                .agg(F.sort_array(F.collect_list(F.struct(BLK, "_m", "_a"))).alias("_c")))

    levels, top = [cut(maps)], maps.agg(F.max(BLK)).first()[0] or 0           # one number: how many levels there are
    while top >= MAPS:
        both = F.aggregate("_c", one, lambda s, c: F.struct(
            (s["m"] * c["_m"]).alias("m"), (s["a"] * c["_m"] + c["_a"]).alias("a")))
        levels.append(cut(groups(levels[-1]).withColumn("_t", both).select(
            *keys, F.col("_up").alias(BLK), F.col("_t.m").alias("_m"), F.col("_t.a").alias("_a"))))
        top //= MAPS
    entered = None
    for level in reversed(levels):
        g = groups(level)
        if entered is None:
            g = g.withColumn("_first", dbl(start))
        else:
            g = g.join(entered.select(*keys, F.col(BLK).alias("_up"), F.col("_v0").alias("_first")), [*keys, "_up"])
        rows = F.slice(F.array(F.struct(F.lit(0).cast("long").alias(BLK), dbl(0.0).alias("v"))), 1, 0)
        walked = F.aggregate("_c", F.struct(F.col("_first").alias("v"), rows.alias("rows")), lambda s, c: F.struct(
            (s["v"] * c["_m"] + c["_a"]).alias("v"),
            F.concat(s["rows"], F.array(F.struct(c[BLK].alias(BLK), s["v"].alias("v")))).alias("rows")), lambda s: s["rows"])
        entered = g.select(*keys, F.explode(walked).alias("_s")).select(
            *keys, F.col(f"_s.{BLK}").alias(BLK), F.col("_s.v").alias("_v0"))
    return entered


def affine_path(df: DataFrame, start: float, mult: str, add: str, out: str, *,
                keys: Sequence[str], pos: str, size: int = 512) -> DataFrame:
    """Value after each row of v -> mult * v + add, as a scan of affine maps in levels.

    Inside a block v_t = P_t * (v_0 + sum add_k / P_k) with P the running product of `mult`, which
    must not be 0; blocks are short enough for P to stay in range.  Blocks are maps of the value before them.
    """
    keys = list(keys)
    base = df.withColumn(BLK, block_of(pos, size))
    upto = (Window.partitionBy(*keys, BLK).orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = (base.withColumn("_p", F.product(F.col(mult)).over(upto))
             .withColumn("_s", F.sum(F.col(add) / F.col("_p")).over(upto)))
    maps = (local.groupBy(*keys, BLK).agg(F.max_by("_p", pos).alias("_m"), F.max_by("_s", pos).alias("_bs"))
            .withColumn("_a", F.col("_m") * F.col("_bs")).drop("_bs"))
    return (local.join(_affine_entries(maps, start, keys), [*keys, BLK])
            .withColumn(out, F.col("_p") * (F.col("_v0") + F.col("_s")))
            .drop(BLK, "_p", "_s", "_v0"))
