"""Language by prediction by partial matching: one byte context tree per language, frozen after training.

A tree counts which byte followed each context of up to ``ORDER`` bytes. The probability of a byte comes from the longest
context that was seen with it; every longer seen context charges an escape, ``distinct / (total + distinct)``. The
code length of a text is the sum over its bytes; the language with the shortest code wins and the score is its posterior
share. Since the trees are frozen, the code lengths of all (context, byte) pairs are tabulated once and a text is a sum of
table rows; contexts that no tree knows fall back to the table of the next lower order, which gives the exact same length
up to the escape of an empty context (0 bits).

The fit sees at most ``MOST_DOCS`` documents of at most ``MOST_CHARS`` characters per language, in the order of a hash of
their ids; every byte of every text is scored.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties go to the first language by name; without
any training text everything is ``und``; rows without a language or an id teach nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.common import remainder

ORDER = 3
MOST_DOCS, MOST_CHARS = 400, 20_000
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _contexts(symbols: np.ndarray, size: int, order: int) -> np.ndarray:
    """Number of the ``order`` symbols before each position from ``ORDER`` on."""
    out = np.zeros(len(symbols) - ORDER, np.int64)
    for k in range(order, 0, -1):
        out = out * size + symbols[ORDER - k : len(symbols) - k]
    return out


@dataclass
class Trees:
    """Tabulated code lengths. ``letter`` maps bytes to symbols; symbol 0 is any byte not met in training."""

    languages: list[str]
    letter: np.ndarray
    low: np.ndarray  # (size ** ORDER, languages): bits of a symbol after ORDER - 1 symbols
    place: np.ndarray  # size ** ORDER: row of a known full context, -1 if unknown
    high: np.ndarray  # (known contexts * size, languages): bits of a symbol after ORDER symbols

    @property
    def size(self) -> int:
        return round(len(self.place) ** (1 / ORDER))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        pad = b"\n" * ORDER
        out = np.zeros((len(texts), len(self.languages)))
        for k, text in enumerate(texts):
            symbols = self.letter[np.frombuffer(pad + text, np.uint8)].astype(np.int64)
            context = _contexts(symbols, self.size, ORDER)
            row, now = self.place[context], symbols[ORDER:]
            known = row >= 0
            out[k] = self.high[row[known] * self.size + now[known]].sum(axis=0, dtype=np.float64)
            if not known.all():
                short = context[~known] % self.size ** (ORDER - 1)
                out[k] += self.low[short * self.size + now[~known]].sum(axis=0, dtype=np.float64)
        return out


def grow(samples: dict[str, list[bytes]]) -> Trees | None:
    """Trees of the given training texts."""
    languages = sorted(k for k, texts in samples.items() if any(texts))
    if not languages:
        return None
    seen = np.unique(np.concatenate([np.frombuffer(t, np.uint8) for lang in languages for t in samples[lang]] + [np.frombuffer(b"\n", np.uint8)]))
    letter = np.zeros(256, np.int32)
    letter[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    streams = {}
    for lang in languages:
        parts = [letter[np.frombuffer(b"\n" * ORDER + t, np.uint8)].astype(np.int64) for t in samples[lang] if t]
        streams[lang] = [np.concatenate([_contexts(p, size, k) * size + p[ORDER:] for p in parts]) for k in range(ORDER + 1)]
    known = np.unique(np.concatenate([streams[lang][ORDER] // size for lang in languages]))
    place = np.full(size**ORDER, -1, np.int32)
    place[known] = np.arange(len(known))
    low = np.empty((size**ORDER, len(languages)), np.float32)
    high = np.empty((len(known) * size, len(languages)), np.float32)
    for j, lang in enumerate(languages):
        chance = np.full(size, 1.0 / size)
        chance[0] = 1.0 / size / max(1, 256 - len(seen))
        for order in range(ORDER):
            every = np.arange(size**order)
            chance = _blended(streams[lang][order], every, size, np.tile(chance.reshape(-1, size), (len(every) // max(1, len(chance) // size), 1)))
        low[:, j] = -np.log2(chance)
        below = chance.reshape(-1, size)[known % size ** (ORDER - 1)]
        high[:, j] = -np.log2(_blended(streams[lang][ORDER], known, size, below))
    return Trees(languages, letter, low, place, high)


def _blended(stream: np.ndarray, contexts: np.ndarray, size: int, below: np.ndarray) -> np.ndarray:
    """Chance of every symbol after every listed context: its count where it was seen, else escape times ``below``."""
    counts = np.zeros((len(contexts), size))
    keys, times = _counts(stream)
    counts[np.searchsorted(contexts, keys // size), keys % size] = times
    total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    whole = np.maximum(total + distinct, 1)
    escape = np.where(total > 0, distinct / whole, 1.0)
    return np.where(counts > 0, counts / whole, escape * below).ravel()


def sample(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """Bounded training sample (lang, text); ids are chosen before any text moves."""
    learn = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= MOST_CHARS)
    learn = learn.where(remainder(F.col("doc_id"), folds) != held)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = learn.select("lang", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_DOCS)
    wanted = ids.select(F.col("lang").alias("in_lang"), F.col("doc_id").alias("id")).distinct()
    return learn.join(wanted, (learn["doc_id"] == wanted["id"]) & (learn["lang"] == wanted["in_lang"]), "left_semi").select(
        "lang", "doc_id", F.col("text").cast("binary").alias("text")
    )


def fit(docs: DataFrame, folds: int = 4, held: int = 2) -> Trees | None:
    samples: dict[str, list[bytes]] = {}
    for row in sorted(sample(docs, folds, held).collect()):
        samples.setdefault(row["lang"], []).append(bytes(row["text"]))
    return grow(samples)


def predicted(docs: DataFrame, trees: Trees | None, text: str = "text") -> Column:
    """Struct of language and score for the text column of ``docs``."""
    if trees is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf(RESULT)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            bits = known.bits([bytes(t) for t in texts])
            bits -= bits.min(axis=1, keepdims=True) if len(bits) else 0
            best = bits.argmin(axis=1)
            share = 1.0 / np.exp2(-np.minimum(bits, 1000.0)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": [known.languages[k] for k in best], "score": share})

    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(spoken, guess(F.coalesce(F.col(text), F.lit("")).cast("binary"))).otherwise(unknown)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    trees = fit(docs, folds, held)
    rows = docs.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(True)).alias("held_out"), predicted(docs, trees).alias("guess")
    )
    return rows.select("doc_id", "held_out", "guess.lang_pred", "guess.score")
