"""Operator 4: chat formatting by perspective rotation, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import partitions
from .common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns to a rendered part; a longer conversation goes on in the next part.
PART_TURNS = 64


def _plain(value: Column) -> Column:
    """Text that can't be taken for a mark of the template."""
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_target, rendered, mask_spans): each conversation as each participant sees it.

    For every role of a conversation its turns are rendered with that role as assistant and all others as named users.
    mask_spans lists `start:end` in code points of rendered, end exclusive, of what the assistant says with its closing
    mark; only that bears loss. Turns are ordered by turn, role and text; a null turn comes first, null roles and texts are
    empty, repeated rows are repeated turns, and rows with a null conv_id are one conversation. Marks of the template within
    texts are broken up. part_turns is how many turns a row renders at most: a conversation goes on in the next part, and its parts
    one after another are the whole rendering. Ranks come from one range partitioning and the counts by conversation and
    partition, one row each. Turns meet speakers by conversation and part, for which the speakers, without texts, are dealt out
    first; so a conversation of any length spreads over partitions and no row or task holds all its texts. Other columns are ignored, and an
    empty table gives an empty table.
    """
    parts = partitions(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _plain(F.col("role")).alias("role"), _plain(F.col("text")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = written(ranged.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_p")), "chat-ranged")
    runs = ranged.groupBy("conv_id", "_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(F.col("conv_id").alias("_c"), F.col("_p").alias("_bp"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = ranged.join(before, ranged["conv_id"].eqNullSafe(before["_c"]) & (ranged["_p"] == before["_bp"]))
    ranked = ranked.select("conv_id", "role", "text", (F.col("_at") - F.col("_first") + F.col("_before")).alias("k"))
    ranked = ranked.withColumn("part", F.expr(f"k div {part_turns}"))
    last = runs.groupBy("conv_id").agg(F.expr(f"(sum(_n) - 1) div {part_turns}").alias("_last")).select(F.col("conv_id").alias("_t"), "_last")
    speakers = ranged.groupBy("conv_id", "role").agg(F.lit(1)).select(F.col("conv_id").alias("_s"), F.col("role").alias("speaker"))
    wanted = speakers.join(last, F.col("_s").eqNullSafe(F.col("_t"))).select("_s", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_part"))
    seen = ranked.join(wanted, F.col("conv_id").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_part")))
    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.col("role"), F.lit("\n")))
    seen = seen.select("conv_id", "speaker", "part", F.struct("k", own.alias("own"), head.alias("head"), F.col("text").alias("text")).alias("s"))
    grouped = seen.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list("s")).alias("s"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        start = a["at"] + F.char_length(s["head"])
        end = start + F.char_length(s["text"]) + len(CLOSE)
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(s["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    rendered = F.array_join(F.transform("s", lambda s: F.concat(s["head"], s["text"], F.lit(f"{CLOSE}\n"))), "")
    spans = F.aggregate("s", zero, step)["spans"]
    return grouped.select("conv_id", "speaker", "part", F.size("s").cast("long").alias("n_turns"), F.size(F.filter("s", lambda s: s["own"])).cast("long").alias("n_target"), rendered.alias("rendered"), F.array_join(spans, ",").alias("mask_spans"))
