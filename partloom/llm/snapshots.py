"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation again and again as it grows. Every turn gets a rolling hash of all turns up to it; a
conversation whose last hash is the hash of an inner turn of a longer one is a snapshot of it and goes (anti-join), of
equal conversations the one with the smallest id stays. What is kept is rendered.

The rolling hash is a running exclusive-or of turn hashes that contain their place, so it can be taken in two levels:
inside blocks of ``BLOCK`` turns, and over the block totals of a conversation. A conversation of any length is spread over
its blocks, and is rendered as one row per block (``part``); nearly all have one part. Built-in functions only.

Edge cases: exactly repeated rows count once; turns are ordered by (turn, role, text), nulls first, a null role is
``unknown`` and a null text empty; rows without a conversation id are dropped (they belong to none); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import written

BLOCK = 256
SEEDS = (11, 23)


def render(role: Column, text: Column) -> Column:
    """One turn in the common chat markup."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), role, text; places are counted in ranges of turn numbers first."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.distinct().withColumn("range", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK))
    inner = ranged.withColumn("inside", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")))
    sizes = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    return inner.join(starts, ["conv_id", "range"]).select("conv_id", (F.col("start") + F.col("inside")).alias("place"), "role", "text")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, place and the rolling hash (two words) of the turns up to that place."""
    block = F.floor((F.col("place") - 1) / BLOCK)
    hashed = rows.select("conv_id", "place", block.alias("block"), *[F.xxhash64(F.lit(s), "place", "role", "text").alias(f"h{s}") for s in SEEDS])
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("conv_id", "place", "block", *[F.bit_xor(f"h{s}").over(upto).alias(f"i{s}") for s in SEEDS])
    totals = hashed.groupBy("conv_id", "block").agg(*[F.bit_xor(f"h{s}").alias(f"t{s}") for s in SEEDS])
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"t{s}").over(ahead), F.lit(0)).alias(f"s{s}") for s in SEEDS])
    a, b = SEEDS
    return inside.join(starts, ["conv_id", "block"]).select(
        "conv_id", "place", F.col(f"i{a}").bitwiseXOR(F.col(f"s{a}")).alias("ha"), F.col(f"i{b}").bitwiseXOR(F.col(f"s{b}")).alias("hb")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations to keep, and how many equal ones and snapshots each stands for.

    Both sides of the anti-join are distinct hashes, so a conversation or first turn that is very common is one row.
    """
    rolled = written(prefixes(rows), "prefixes")
    lengths = rolled.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    marked = rolled.join(lengths, "conv_id")
    ends = marked.where("place = n_turns").groupBy("ha", "hb", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    inner = marked.where("place < n_turns").select("ha", "hb").distinct()
    return ends.join(inner, ["ha", "hb"], "left_anti").select("conv_id", "n_turns", "n_equal")


def chat(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the conversation), n_equal and the rendered text of the part."""
    rows = written(placed(turns), "turns")
    kept = maximal(rows)
    part = F.floor((F.col("place") - 1) / BLOCK)
    piece = F.struct("place", render(F.col("role"), F.col("text")).alias("piece"))
    parts = rows.join(kept, "conv_id").groupBy("conv_id", part.alias("part"), "n_turns", "n_equal").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    return parts.withColumn("text", F.array_join(F.transform("turns", lambda t: t["piece"]), "")).drop("turns")
