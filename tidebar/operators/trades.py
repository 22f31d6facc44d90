"""Non-overlapping trade selection, kill switch, cooldown and trade windows.

The reference semantics walk a series bar by bar.  Here every candidate entry already knows its
exit (`barriers.outcomes`), and the walk over a block of bars depends on the past only through the
first bar that is free again.  A trade lasts at most `max_hold` bars, so that is one of `max_hold`
offsets into the block: each block is folded once per offset, the small offset maps are composed
in a tree, and the block is replayed from its true offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidebar.functions.signals import side
from tidebar.operators.series import BLK, block_of, equity
from tidebar.session import cut

STRATEGY = ("symbol", "model", "bank", "threshold")
THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
KILL = -0.20
WALK = 1024
FAN = 64             # block maps that meet in one row


def signals(probs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Signal rows per (symbol, model, bank, threshold); needs a `bilateral` column."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    return (probs.withColumn("threshold", F.explode(grid))
            .withColumn("side", side(F.col("prob"), F.col("threshold"), F.col("bilateral")))
            .filter("side <> 0"))


def candidates(signal_rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Signals with the exit of the trade they would open; the join key spreads every series."""
    return signal_rows.join(
        outcomes.select("symbol", "bar_idx", "side", "exit_idx", "exit_kind", "duration", "ret"),
        ["symbol", "bar_idx", "side"])


def _blocks(cands: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return (cands.withColumn(BLK, block_of("bar_idx", WALK)).groupBy(*keys, BLK)
            .agg(F.sort_array(F.collect_list(F.struct("bar_idx", *cols))).alias("_c")))


def _walk(first, width: int, collect: bool):
    """Fold of `_c`, neighbouring maps in order, from offset `first` into the first of them.

    Where the next block is missing no trade runs on into it, so its offset is 0.  Gives the offset after the last map,
    or with `collect` every block with the offset it is entered at.
    """
    zero = F.lit(0).cast("long")
    rows = F.slice(F.array(F.struct(zero.alias(BLK), zero.alias("off"))), 1, 0)

    def step(state, m):
        off = F.when(m[BLK] == state["blk"] + 1, state["off"]).otherwise(zero)
        out = [m[BLK].alias("blk"), F.get(m["_map"], off.cast("int")).alias("off")]
        if collect:
            out.append(F.concat(state["rows"], F.array(F.struct(m[BLK].alias(BLK), off.alias("off")))).alias("rows"))
        return F.struct(*out)

    start = [(F.col("_up") * FAN - 1).alias("blk"), first.alias("off")] + ([rows.alias("rows")] if collect else [])
    if collect:
        return F.aggregate("_c", F.struct(*start), step, lambda st: st["rows"])
    # a group whose last blocks are missing ends at offset 0 as well
    return F.aggregate("_c", F.struct(*start), step, lambda st: F.when(
        st["blk"] == F.col("_up") * FAN + FAN - 1, st["off"]).otherwise(zero))


def _groups(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Up to FAN neighbouring maps of a key in one row."""
    return (maps.withColumn("_up", F.floor(F.col(BLK) / FAN).cast("long")).groupBy(*keys, "_up")
            .agg(F.sort_array(F.collect_list(F.struct(BLK, "_map"))).alias("_c")))


def entry_offsets(maps: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Offset at which every block is entered; `maps`: keys, block, and for each entry offset the one after it.

    Maps compose, so FAN neighbours become one map of the level above, level by level until a key's maps fit one group;
    then the offsets come down again.  No row ever holds more than FAN maps.
    """
    keys = list(keys)
    levels, top = [cut(maps)], maps.agg(F.max(BLK)).first()[0] or 0          # one number: how many levels there are
    while top >= FAN:
        above = _groups(levels[-1], keys).select(*keys, F.col("_up").alias(BLK), F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda o: _walk(o, width, False)).alias("_map"))
        levels.append(cut(above))
        top //= FAN
    entered = None
    for level in reversed(levels):
        groups = _groups(level, keys)
        if entered is None:
            first = F.lit(0).cast("long")
        else:
            groups = groups.join(entered.select(*keys, F.col(BLK).alias("_up"), F.col("_off").alias("_first")), [*keys, "_up"])
            first = F.col("_first")
        entered = (groups.select(*keys, F.explode(_walk(first, width, True)).alias("_s"))
                   .select(*keys, F.col(f"_s.{BLK}").alias(BLK), F.col("_s.off").alias("_off")))
    return entered


def non_overlapping(cands: DataFrame, keys: Sequence[str] = STRATEGY, max_hold: int = 10) -> DataFrame:
    """Trades taken by walking the candidates in order and jumping to each exit bar."""
    keys = list(keys)
    cols = [c for c in cands.columns if c not in (*keys, "bar_idx")]
    blocks = cut(_blocks(cands, keys, cols))                                 # folded for the maps, then replayed
    begin = F.col(BLK) * WALK

    def free_after(first):
        return F.aggregate("_c", first, lambda nxt, c: F.when(
            c["bar_idx"] >= nxt, c["exit_idx"]).otherwise(nxt))

    maps = blocks.select(*keys, BLK, F.transform(
        F.sequence(F.lit(0), F.lit(max_hold - 1)),
        lambda o: F.greatest(free_after(begin + o) - begin - WALK, F.lit(0))).alias("_map"))
    starts = entry_offsets(maps, keys, max_hold)

    def take(state, c):
        free = c["bar_idx"] >= state["nxt"]
        return F.struct(
            F.when(free, c["exit_idx"]).otherwise(state["nxt"]).alias("nxt"),
            F.when(free, F.concat(state["picks"], F.array(c))).otherwise(state["picks"]).alias("picks"))

    picked = blocks.join(starts, [*keys, BLK]).select(*keys, F.explode(F.aggregate(
        "_c", F.struct((begin + F.col("_off")).alias("nxt"), F.slice("_c", 1, 0).alias("picks")),
        take, lambda s: s["picks"])).alias("_t"))
    return picked.select(*keys, "_t.*").withColumnRenamed("bar_idx", "entry_idx")


def apply_kill_switch(trades: DataFrame, keys: Sequence[str] = STRATEGY, limit: float = KILL) -> DataFrame:
    """Cut each strategy after the trade that brings it to the drawdown limit.

    Stopping never changes which earlier trades were taken, so it is a filter on the running
    drawdown.  `is_dead` marks stopped strategies; the stopping trade stays in.
    """
    keys = list(keys)
    walked = equity(trades, "ret", keys=keys, pos="exit_idx", start_at_one=True)
    dead = (walked.groupBy(*keys)
            .agg(F.min(F.when(F.col("drawdown") <= limit, F.col("exit_idx"))).alias("_dead_at")))
    return (walked.join(dead, keys)
            .filter(F.col("_dead_at").isNull() | (F.col("exit_idx") <= F.col("_dead_at")))
            .withColumn("is_dead", F.col("_dead_at").isNotNull())
            .drop("_dead_at", "peak", "drawdown"))


def simulate(cands: DataFrame, keys: Sequence[str] = STRATEGY, max_hold: int = 10,
             limit: float = KILL) -> DataFrame:
    return apply_kill_switch(non_overlapping(cands, keys, max_hold), keys, limit)


def with_cooldown(cands: DataFrame, keys: Sequence[str] = STRATEGY, *, bars: int = 60,
                  window: int = 10, loss: float = -0.03, pad_anomalous: bool = False) -> DataFrame:
    """Like `non_overlapping`, but pause `bars` bars when the last-`window` trades hold an anomaly
    (`anomalous` column of the candidate) and sum to less than `loss`; the window then restarts.

    The state carried between blocks is (first free bar, last window of trades).  All blocks are
    folded in parallel from a guessed state and refolded until no state changes: the fixed point is
    the exact walk.  States forget their past quickly, so few rounds are needed.
    """
    keys = list(keys)
    cols = [c for c in cands.columns if c not in (*keys, "bar_idx")]
    blocks = cut(_blocks(cands, keys, cols))
    item = "struct<ret:double,bad:boolean>"
    none = F.from_json(F.lit("[]"), f"array<{item}>")
    start = F.struct(F.lit(0).cast("long").alias("nxt"), none.alias("win"))

    def step(state, c):
        free = c["bar_idx"] >= state["nxt"]
        row = F.struct(c["ret"].alias("ret"), F.coalesce(c["anomalous"], F.lit(False)).alias("bad"))
        win = F.concat(state["win"], F.array(row))
        win = F.when(F.size(win) > window, F.slice(win, -window, window)).otherwise(win)
        pnl = F.aggregate(win, F.lit(0.0), lambda s, x: s + x["ret"])
        bad = F.exists(win, lambda x: x["bad"]) | (F.lit(pad_anomalous) & (F.size(win) < window))
        stop = bad & (pnl < loss)
        return F.struct(
            F.when(free, F.when(stop, c["exit_idx"] + bars).otherwise(c["exit_idx"]))
            .otherwise(state["nxt"]).alias("nxt"),
            F.when(free, F.when(stop, none).otherwise(win)).otherwise(state["win"]).alias("win"))

    by_key = Window.partitionBy(*keys).orderBy(BLK)
    state = blocks.select(*keys, BLK, start.alias("_in"))
    while True:
        folded = blocks.join(state, [*keys, BLK]).select(
            *keys, BLK, "_in", F.aggregate("_c", F.col("_in"), step).alias("_out"))
        moved = cut(folded.select(
            *keys, BLK, "_in", F.coalesce(F.lag("_out").over(by_key), start).alias("_new")))
        state = moved.select(*keys, BLK, F.col("_new").alias("_in"))
        if moved.filter(~F.col("_in").eqNullSafe(F.col("_new"))).isEmpty():
            break

    def take(s, c):
        nxt = step(s["st"], c)
        return F.struct(nxt.alias("st"),
                        F.when(c["bar_idx"] >= s["st"]["nxt"], F.concat(s["picks"], F.array(c)))
                        .otherwise(s["picks"]).alias("picks"))

    picked = blocks.join(state, [*keys, BLK]).select(*keys, F.explode(F.aggregate(
        "_c", F.struct(F.col("_in").alias("st"), F.slice("_c", 1, 0).alias("picks")), take,
        lambda s: s["picks"])).alias("_t"))
    return picked.select(*keys, "_t.*").withColumnRenamed("bar_idx", "entry_idx")


def metric_window(trades: DataFrame, keys: Sequence[str] = STRATEGY, n: int = 10) -> DataFrame:
    """Last-n trade metrics [ret, duration, win] per trade, zero rows in front where fewer exist.

    Needs `trade_no` (dense).  Blocks with an n-row halo keep a long strategy out of one task.
    """
    from tidebar.operators.series import in_blocks
    row = F.array(F.col("ret"), F.col("duration").cast("double"),
                  F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    zero = F.array(*[F.lit(0.0)] * 3)

    def build(d, w):
        d = d.withColumn("_w", F.collect_list(row).over(w(1 - n, 0)))
        pad = F.array_repeat(zero, F.lit(n) - F.size("_w"))
        return d.withColumn("window", F.concat(pad, F.col("_w"))).drop("_w")
    return in_blocks(trades, build, keys=keys, back=n - 1, pos="trade_no")
