"""From raw documents to a training mix: five stages, each over all that the one before kept.

Every stage takes and returns a table of documents (doc_id, text, lang, source, n_chars and whatever columns they came
with); the last adds what the mix takes of each. Stage results are written to the shared folder and read again, so a
lost executor costs the stage at hand only.

Edge cases are those of the operators; rows with a null id are never rejected or changed by the middle stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import alignment, mixing, sketching, templates, toxicity
from partloom.llm.common import table, without
from partloom.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the network learns from the labels of the documents at hand."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxic_score(docs, network) < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines stay in the first document only; n_chars follows the text."""
    return alignment.line_dedup(docs, length="n_chars").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: 5-word shingles, similarity 0.8."""
    found = sketching.near_duplicates(docs, width=5, percent=80)
    return without(docs, found.where("NOT kept").select("doc_id").distinct())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: size, source_size, target and taken words, with id and source."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]

# A trained network and sketches are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
