"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, ``-ln(u) / weight``, from a hash of its id, so reruns agree. A source takes
its whole epochs first; what is left of its target goes to its documents in key order until their words are used up.

The prefix sum is taken in two levels: keys fall into key ranges of a few thousand documents, each range is ordered
alone, and only range totals are added up per source. A source with a third of all rows is thus spread over as many
tasks as it has ranges.

Edge cases: null ids share one draw, null sources form one source (the last), null texts have size 0 and are taken 0
times, repeated rows are documents of their own; without any words all targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.common import WORD
from partloom.session import written

LEAST_WEIGHT = 0.25
RANGE_ROWS = 4096


def draw(doc_id: Column, seed: str) -> Column:
    """Uniform in (0, 1): 52 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def letter_share(text: Column) -> Column:
    """Quality weight in [0.25, 1]: letters per word character; 1 without words."""
    chars = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    share = F.when(chars > 0, letters.cast("double") / chars.cast("double")).otherwise(1.0)
    return F.greatest(F.lit(LEAST_WEIGHT), share)


def sized(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size in words and sampling key, written once since four steps read it."""
    full = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        F.regexp_count(full, F.lit(WORD)).cast("bigint").alias("size"),
        (-F.log(draw(F.col("doc_id"), seed)) / letter_share(full)).alias("key"),
    )
    return written(rows, "mix-sizes")


def targets(rows: DataFrame, weights: tuple[int, ...], volume: float, most: float) -> DataFrame:
    """Per source: rows, words and target.

    Sources get ``volume`` times all words by weight, none more than ``most`` times its own words. Sources are
    ordered by the level at which they are full; one prefix sum over them gives the common level of the rest.
    """
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    full = ranked.withColumn("weight", weight.cast("bigint")).withColumn(
        "full_at", most * F.col("source_size") / F.col("weight")
    )
    every = Window.partitionBy()
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    words, share = F.sum("source_size"), F.sum("weight")
    level = (volume * words.over(every) - most * F.coalesce(words.over(before), F.lit(0))) / (
        share.over(every) - F.coalesce(share.over(before), F.lit(0))
    )
    levelled = full.withColumn("level", level).withColumn("is_full", F.col("level") >= F.col("full_at"))
    common = F.min(F.when(~F.col("is_full"), F.struct("full_at", "rank", "level"))).over(every)["level"]
    target = F.when(F.col("is_full"), most * F.col("source_size")).otherwise(common * F.col("weight"))
    return levelled.select("source", "n_docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), volume: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``: words the mix takes of the document.

    ``docs`` has doc_id, source and text. A document at the edge of the budget is taken whole if that comes closer
    to the target than leaving it.
    """
    rows = sized(docs, seed)
    goal = targets(rows, weights, volume, most)
    part = goal.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
        F.ceil(F.col("n_docs") / RANGE_ROWS).alias("ranges"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    joined = rows.join(part, rows["source"].eqNullSafe(part["of"])).drop("of")
    reach = F.lit(1.0) - F.exp(-F.col("key") * LEAST_WEIGHT)
    placed = joined.withColumn("slot", F.least(F.col("ranges") - 1, F.floor(reach * F.col("ranges"))))
    totals = placed.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("source").alias("of"), F.col("slot").alias("in_slot"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start")
    )
    inner = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    known = ordered.join(starts, ordered["source"].eqNullSafe(starts["of"]) & (ordered["slot"] == starts["in_slot"]))
    middle = F.col("start") + F.col("inside") + F.col("size") / 2.0
    taken = F.col("size") * (F.col("epochs") + F.when(middle <= F.col("rest"), 1).otherwise(0))
    return known.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))
