"""Line dedup by pairwise alignment: aligned common blocks of lines are deleted from the later document.

Documents that overlap are found through the hashes of the lines they share. A rare line (``RARE`` documents or fewer)
pairs each of them with all earlier ones; a line of more documents pairs them with its first holder only, the smallest
id, so that pairs grow with the lines and not with the square of a line's holders. Pairs that share less than ``SEED``
words in whole lines are left alone.

Each pair is aligned by patience: lines that are unique on both sides and rise in both are anchors, equal lines next to them
extend the alignment, and what lies between anchors is aligned alike. A stretch of lines that follow each other on both sides is a
block; its size counts the words of its lines and the words that the lines just before and after it share at the side of
the block. Blocks of ``WORDS`` words or more go from the later document. The alignment only ever rises: of two blocks in
changed order one stays.

Lines are compared after trimming white space; lines without a word are neither compared nor counted, and go if the lines
with words around them go. The first holder is never changed on account of a later document.

Edge cases: a null text stays null; a null id is no holder and never changed; rows that repeat an id are the same
document: each text of it is aligned with earlier ids, none with another of the same id; an empty table gives no rows; a
document that is wholly repeated keeps its row with an empty text; other columns stay as they are, but for those that have the
names of the report, which it replaces.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.common import slices
from partloom.session import written

WORDS = 40  # least size of a block that goes
SEED = 10  # least words of the whole lines that a pair shares
RARE = 3  # documents of a line that pairs them all
REPORT = ("__deleted", "__blocks")

PARSED = "doc_id bigint, digest bigint, at array<int>, line array<bigint>, size array<int>, words binary"


def parse(text: bytes) -> tuple[list[int], list[int], list[int], bytes]:
    """Of the lines with a word: number, hash, words; and two bytes of hash for every word.

    The hashes of words only measure what edge lines share: two words are mixed up there once in 65 536 times.
    """
    at, line, size, words = [], [], [], []
    for k, raw in enumerate(text.split(b"\n")):
        own = raw.split()
        if own:
            at.append(k)
            line.append(xxhash.xxh3_64_intdigest(raw.strip()) - (1 << 63))
            size.append(len(own))
            words.extend(map(xxhash.xxh32_intdigest, own))
    return at, line, size, np.array(words, np.uint32).astype(np.uint16).tobytes()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    names = [c.split()[0] for c in PARSED.split(", ")]
    for batch in batches:
        for part in slices(batch):
            rows = [(i, d, *parse(t)) for i, d, t in zip(*[c.to_pylist() for c in part.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def patience(places: list[tuple[int, int]]) -> list[int]:
    """Positions (in ``places``) of a longest chain that rises strictly in both numbers."""
    order = sorted(range(len(places)), key=lambda k: (places[k][0], -places[k][1]))
    tops: list[int] = []
    piles: list[int] = []
    before: dict[int, int | None] = {}
    for k in order:
        pile = bisect_left(tops, places[k][1])
        before[k] = piles[pile - 1] if pile else None
        if pile == len(tops):
            tops.append(places[k][1])
            piles.append(k)
        else:
            tops[pile], piles[pile] = places[k][1], k
    chain, k = [], piles[-1] if piles else None
    while k is not None:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def matched(later: list[int], partner: list[int]) -> list[tuple[int, int]]:
    """Positions of lines aligned by patience, rising on both sides."""
    out, open_ = [], [(0, len(later), 0, len(partner))]
    while open_:
        a, a_end, b, b_end = open_.pop()
        while a < a_end and b < b_end and later[a] == partner[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and later[a_end - 1] == partner[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        once_a, once_b = Counter(later[a:a_end]), Counter(partner[b:b_end])
        there = {x: k for k, x in enumerate(partner[b:b_end], b) if once_b[x] == 1}
        both = [(k, there[x]) for k, x in enumerate(later[a:a_end], a) if once_a[x] == 1 and x in there]
        anchors = [both[k] for k in patience(both)]
        out.extend(anchors)
        for (i, j), (i_end, j_end) in zip([(a - 1, b - 1), *anchors], [*anchors, (a_end, b_end)], strict=True):
            if anchors:
                open_.append((i + 1, i_end, j + 1, j_end))
    return sorted(out)


def _edge(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words from the start of two lines."""
    n = min(len(a), len(b))
    different = np.flatnonzero(a[:n] != b[:n])
    return int(different[0]) if len(different) else n


def blocks(later, partner, least: int = WORDS) -> list[tuple[int, int]]:
    """First and last line (numbers in the text) of the blocks of ``later`` that go; both are results of ``parse``."""
    at, line, size, words = later
    _, other, other_size, other_words = partner
    pairs = matched(line, other)
    sides = [(np.frombuffer(w, np.uint16), np.concatenate([[0], np.cumsum(s)])) for w, s in ((words, size), (other_words, other_size))]
    row = lambda side, k: sides[side][0][sides[side][1][k] : sides[side][1][k + 1]]
    out, start = [], 0
    for k in range(1, len(pairs) + 1):
        if k < len(pairs) and pairs[k] == (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            continue
        (i, j), (i_end, j_end) = pairs[start], pairs[k - 1]
        n = int(sum(size[i : i_end + 1]))
        if i and j:
            n += _edge(row(0, i - 1)[::-1], row(1, j - 1)[::-1])
        if i_end + 1 < len(line) and j_end + 1 < len(other):
            n += _edge(row(0, i_end + 1), row(1, j_end + 1))
        if n >= least:
            out.append((int(at[i]), int(at[i_end])))
        start = k
    return out


def _blocks_of_pairs(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, digests, *both = (c.to_pylist() for c in part.columns)
                found = [blocks(x[:4], x[4:], least) for x in zip(*both, strict=True)]
                hit = [k for k, f in enumerate(found) if f]
                columns = [pa.array([c[k] for k in hit], pa.int64()) for c in (ids, digests)]
                lists = pa.array([[{"first": a, "last": b} for a, b in found[k]] for k in hit], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "digest", "blocks"])

    return work


def overlaps(table: DataFrame, seed: int = SEED, rare: int = RARE) -> DataFrame:
    """later and partner (structs of id and digest) of the documents to align."""
    key = F.struct("doc_id", "digest").alias("own")
    lines = table.select(key, F.explode(F.array_distinct(F.arrays_zip("line", "size"))).alias("l")).select("own", "l.line", "l.size")
    holders = lines.groupBy("line").agg(F.min("own").alias("first"), F.max("own.doc_id").alias("latest"), F.count(F.lit(1)).alias("n"))
    shared = holders.where(F.col("latest") > F.col("first.doc_id"))
    often = lines.join(shared.where(F.col("n") > rare).select("line", "first"), "line").select(F.col("own").alias("later"), F.col("first").alias("partner"), "size")
    # At most ``rare`` documents a line.
    few = lines.join(shared.where(F.col("n") <= rare).select("line"), "line", "left_semi").groupBy("line").agg(F.collect_list("own").alias("own"), F.max("size").alias("size"))
    each = few.select(F.explode("own").alias("later"), F.col("own").alias("all"), "size").select("later", F.explode("all").alias("partner"), "size")
    pairs = often.unionByName(each).where(F.col("partner.doc_id") < F.col("later.doc_id"))
    return pairs.groupBy("later", "partner").agg(F.sum("size").alias("n")).where(F.col("n") >= seed).select("later", "partner")


def common_blocks(docs: DataFrame, words: int = WORDS, seed: int = SEED, rare: int = RARE) -> DataFrame:
    """doc_id, digest of the text, and the blocks (first, last) that go from it."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    table = written(texts.mapInArrow(_parsed, PARSED).where(F.size("at") > 0), "parsed-lines")
    # Rows that repeat id and text are one.
    pairs = written(overlaps(table, seed, rare), "overlaps")
    ours = ["at", "line", "size", "words"]
    own = table.select(F.struct("doc_id", "digest").alias("own"), *ours).dropDuplicates(["own"])
    side = lambda name: own.join(pairs.select(F.col(name).alias("own")).distinct(), "own", "left_semi").withColumnRenamed("own", name)
    later = side("later")
    partner = side("partner").withColumnsRenamed({c: f"other_{c}" for c in ours})
    met = pairs.join(partner, "partner").join(later, "later")
    pairwise = met.select("later.doc_id", "later.digest", *ours, *[f"other_{c}" for c in ours]).mapInArrow(
        _blocks_of_pairs(words), "doc_id bigint, digest bigint, blocks array<struct<first:int,last:int>>"
    )
    return pairwise.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))


def cut(text: str, blocks: list[tuple[int, int]]) -> tuple[str, int]:
    """Text without the lines of the blocks, and how many lines went."""
    lines = text.split("\n")
    gone = set()
    for first, last in blocks:
        gone.update(range(first, last + 1))
    before, empty = True, []  # lines without a word since the last line with one, and whether that one went
    for k in range(len(lines) + 1 if gone else 0):
        if k < len(lines) and not lines[k].encode("utf-8", "surrogatepass").strip():
            empty.append(k)
            continue
        now = k == len(lines) or k in gone
        if before and now:
            gone.update(empty)
        before, empty = now, []
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone)


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_deleted", T.LongType()), T.StructField("n_blocks", T.LongType())])


@F.pandas_udf(RESULT)
def _rewritten(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
    out = [(*cut(text, [(b["first"], b["last"]) for b in own]), len(own)) for text, own in zip(texts, found, strict=True)]
    return pd.DataFrame(out, columns=RESULT.names)


def line_dedup(docs: DataFrame, words: int = WORDS, length: str | None = None) -> DataFrame:
    """``docs`` with repeated blocks cut from ``text``, plus ``__deleted`` lines and ``__blocks``.

    ``length`` names a column that holds the length of the text and follows it where lines went.
    """
    found = common_blocks(docs, words)
    kept = [c for c in docs.columns if c not in REPORT]
    # Positions instead of names, so that no column of the documents can clash with those of the join.
    own = docs.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    at = {c: f"c{k}" for k, c in enumerate(kept)}
    text, ident = F.col(at["text"]), F.col(at["doc_id"])
    joined = own.join(found, (ident == found["doc_id"]) & (F.xxhash64(text) == found["digest"]), "left").drop("doc_id", "digest")
    changed = text.isNotNull() & F.col("blocks").isNotNull()
    none = F.array().cast("array<struct<first:int,last:int>>")
    wide = joined.withColumn("new", F.when(changed, _rewritten(F.when(changed, text).otherwise(F.lit("")), F.coalesce("blocks", none))))
    after = {"text": F.when(changed, F.col("new.text")).otherwise(text)}
    if length is not None:
        after[length] = F.when(F.col("new.n_deleted") > 0, F.length("new.text").cast("bigint")).otherwise(F.col(at[length]))
    report = [F.coalesce(f"new.{c}", F.lit(0).cast("bigint")).alias(n) for c, n in zip(("n_deleted", "n_blocks"), REPORT, strict=True)]
    return wide.select(*[after.get(c, F.col(k)).alias(c) for c, k in at.items()], *report)
