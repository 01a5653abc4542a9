"""Connected components by label hooking and pointer jumping, one written table per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.session import written


def components(links: DataFrame, steps: int | None = None, name: str = "labels") -> DataFrame:
    """(id, label) for every end of ``links`` (a, b); the label is the smallest id that can be reached.

    Aggregates and joins only, so a vertex with very many links stays spread. Labels fall at every step or the loop
    ends; paths halve by the jump. ``links`` should be a written table, it is read in every step. With ``steps`` it stops
    after so many: labels then join only what is connected, but not yet all of it.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a"))
    first = both.groupBy("src").agg(F.min("dst").alias("least"))
    labels = written(first.select(F.col("src").alias("id"), F.least("src", "least").alias("label")), name)
    step = 0
    while True:
        step += 1
        near = both.join(labels.toDF("dst", "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("src", "id"), "id").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        ahead = labels.toDF("label", "next")
        stepped = hooked.join(ahead, "label", "left").select("id", "old", F.least("label", "next").alias("label"))
        table = written(stepped, name)
        labels = table.select("id", "label")
        if step == steps or table.where(F.col("label") < F.col("old")).isEmpty():
            return labels
