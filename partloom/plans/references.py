"""Catalogue upkeep: load with texts, refresh of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import reference_text, text_hash
from partloom.operators.classify import Embedder
from partloom.sources.catalogue import prepare_references


def loaded_references(raw: DataFrame) -> DataFrame:
    """Valid catalogue rows with their text and its hash, ready for the embedding provider."""
    return (
        prepare_references(raw)
        .where(F.size("problems") == 0)
        .drop("problems")
        .withColumn("text", reference_text())
        .withColumn("text_hash", text_hash(F.col("text")))
    )


def stale_references(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows whose vector is missing or whose keyword, manufacturer or base scope changed."""
    before = old.select("id", *[F.col(c).alias(f"old_{c}") for c in ("keyword", "mfr", "base_scope")], F.lit(True).alias("known"))
    changed = (
        ~F.col("keyword").eqNullSafe(F.col("old_keyword"))
        | ~F.col("mfr").eqNullSafe(F.col("old_mfr"))
        | ~F.col("base_scope").eqNullSafe(F.col("old_base_scope"))
    )
    missing = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return (
        new.join(before, "id", "left")
        .where(missing | (F.coalesce("known", F.lit(False)) & changed))
        .select(*new.columns, reference_text().alias("text"))
    )


def refresh_embeddings(new: DataFrame, old: DataFrame, embedder: Embedder) -> DataFrame:
    """Catalogue with fresh vectors on the stale rows; the provider sees only those."""
    fresh = stale_references(new, old).where(F.col("text") != "").select("id", embedder(F.col("text")).alias("fresh"))
    return new.join(fresh, "id", "left").withColumn("embedding", F.coalesce("fresh", "embedding")).drop("fresh")
