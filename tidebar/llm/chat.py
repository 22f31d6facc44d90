"""Multi-party chat rendering: every participant in turn speaks as the assistant, in DataFrame operations only.

For each participant of a conversation (a role that is not a context role such as `system`), the dialogue is rendered
with that speaker's turns as `assistant` and everybody else's as `user` with a name; `system` turns stay context.  The
loss mask covers the text and end mark of the assistant's turns, as [start, stop) character spans.

A conversation is numbered in two steps (rows per bucket of `SEGMENT` turn numbers, then inside a bucket) and
rendered in segments of `SEGMENT` turns, one row each, so a very long conversation is spread over many rows; rows join
in segment order.  Segments of a conversation are gathered once and rendered per participant from that.

Defined cases: turns are ordered by turn, role and text, nulls first; a null role is the participant `unknown`; a null
text is empty; null ids form one conversation; repeated rows are repeated turns; a conversation of context roles only
has no participant and gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SEGMENT = 64
CONTEXT_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def numbered(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv, bucket rows with `at`: the dense number of a turn in its conversation."""
    bucket = F.floor(F.col("turn") / segment)
    rows = turns.withColumn("bucket", bucket)
    key = ["conv", "bucket"]
    inside = Window.partitionBy(*key).orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = Window.partitionBy("conv").orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    same = F.col("r.conv").eqNullSafe(F.col("o.conv")) & F.col("r.bucket").eqNullSafe(F.col("o.bucket"))
    rows = rows.withColumn("inside", F.row_number().over(inside) - 1).alias("r").join(offsets.alias("o"), same)
    return rows.select("r.conv", "role", "text", (F.col("inside") + F.col("offset")).alias("at"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           segment: int = SEGMENT, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """conv_id, perspective, segment, n_turns, rendered and mask (array of start, stop) per participant and segment."""
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    people = rows.where(~F.col("role").isin(*context_roles)).select("conv", "role").distinct()
    at = F.col("at").cast("long")
    gathered = (numbered(rows, segment).select("conv", F.expr(f"at div {segment}").alias("segment"), at.alias("at"), "role", "text")
                .groupBy("conv", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns")))
    each = gathered.alias("g").join(people.alias("p"), F.col("g.conv").eqNullSafe(F.col("p.conv"))).select(
        "g.conv", "segment", "turns", F.col("p.role").alias("perspective"))

    def parts(t):
        mine = t["role"] == F.col("perspective")
        head = F.when(mine, F.lit("assistant")).when(t["role"].isin(*context_roles), t["role"]).otherwise(
            F.concat(F.lit("user name="), t["role"]))
        return F.struct(mine.alias("mine"), F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
                        F.concat(t["text"], F.lit(CLOSE)).alias("body"))

    each = each.select("conv", "perspective", "segment", F.transform("turns", parts).alias("parts"))
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["end"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
            F.when(p["mine"], F.concat(a["spans"], F.array(F.struct(
                (a["end"] + F.length(p["head"])).alias("start"),
                (a["end"] + F.length(p["head"]) + F.length(p["body"])).alias("stop"))))).otherwise(a["spans"]).alias("spans")))
    return each.select(F.col("conv").alias(conv_id), "perspective", "segment", F.size("parts").alias("n_turns"),
                       F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
                       spans["spans"].alias("mask"))
