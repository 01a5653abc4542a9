"""Helpers the operators of this package share: tables, hash remainders, word codes, join keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space; `bytes.split()` cuts at exactly these characters.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def words_of(text: Column) -> Column:
    """Array of the words of a text, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def without(docs: DataFrame, rejected: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose key is in the one-column frame ``rejected``; null keys stay."""
    gone = rejected.toDF("__gone")
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


class TokenTable(dict):
    """Token (bytes) -> row number in a growing table of facts, worked out once per distinct token.

    Bounded: past ``limit`` tokens the next batch starts with an empty table, so memory does not grow with the
    vocabulary of the corpus.
    """

    def __init__(self, facts, limit: int = 200_000):
        super().__init__()
        self.facts, self.limit, self.rows = facts, limit, []
        self._made: np.ndarray | None = None

    def __missing__(self, token: bytes) -> int:
        row = len(self.rows)
        self.rows.append(self.facts(token))
        self[token] = row
        return row

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def table(self, dtype) -> np.ndarray:
        """The facts of all tokens so far; only those of new tokens are converted."""
        made = self._made if self._made is not None else np.empty(0, dtype)
        if len(made) < len(self.rows):
            made = np.concatenate([made, np.array(self.rows[len(made) :], dtype)])
        self._made = made
        return made

    def trim(self) -> None:
        if len(self.rows) > self.limit:
            self.clear()
            self.rows.clear()
            self._made = None


def hash64(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (finaliser of a well known multiplicative hash)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` consecutive 64-bit codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15))
    for k in range(width):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mixed(out)


def flags(bits: DataFrame, width: int) -> np.ndarray:
    """``2^width`` flags, set where a number of the one column of ``bits`` (0 to 2^width - 1) is found.

    The bitmap is put together by an aggregate; what comes to the driver is ``2^width / 8`` bytes whatever the input.
    """
    shifted = bits.toDF("bit").select((F.col("bit") + 1).alias("bit"))
    parts = shifted.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << width, bool)
    for row in parts.collect():
        own = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        out[(row["part"] - 1) * len(own) : row["part"] * len(own)] = own
    return out


def slices(batch, rows: int = 512) -> Iterator:
    """Parts of an Arrow batch, so that few whole texts are Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
