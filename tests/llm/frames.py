"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta", "vo") for b in ("", "ba", "den", "fi", "gor", "hup", "sel", "tin")]


def documents(spark, rows):
    """Rows are (doc_id, text) or longer; missing columns get plain values."""
    full = [(tuple(r) + ("en", "s", len(r[1] or ""))[len(r) - 2 :])[:5] for r in rows]
    return spark.createDataFrame(full, DOCS)


def clash(docs, *names):
    """The same documents with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in names or ("id", "kept", "score", "size", "key", "slot", "label", "words", "bucket", "digest", "run", "first", "toxic", "of"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def mutated(rng: random.Random, base: list[str], changes: int) -> list[str]:
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = "x" + str(rng.randrange(10**6))
    return out


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


ODD = [(None, "no id at all"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "word " * 60_000), (6, "x" * 300_000), (7, "\n" * 5000)]
