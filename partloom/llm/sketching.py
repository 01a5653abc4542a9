"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``COORDS`` coordinates. In round r every element of a set is thrown into a bin with value r plus a
fraction; the first ``COORDS`` rounds pick the bin by hash, the next fill bin after bin, so every coordinate is filled
and a coordinate of two sets agrees with probability equal to their similarity. Large sets need one round.

Documents with equal sets form a class with one representative; only representatives are sketched into buckets (5
coordinates, 40 bands: a pair at 0.8 is missed once in ten million). In a bucket every member is compared with two
centres, its smallest and largest id, which is all pairs of up to three. The documents of larger buckets that still
span several components, say because a passage fills the band, go through an exact join on their rarest shingles. No
bucket is collected or capped, and no pair inside a component is compared again. Candidates are confirmed on full sets.

Edge cases: null or wordless texts have an empty set and are linked with nothing; a null id cannot be linked and is
its own (null) component; rows that repeat an id are the same document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import TokenTable, flags, hash64, mixed, rolled, slices
from partloom.llm.components import components
from partloom.session import written

ROWS, BANDS = 5, 40
ID_BITS = 23
COORDS = ROWS * BANDS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 40) - 1)


def sketch(items: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Coordinates of a non-empty set of 64-bit hashes: (round, fraction) of the least throw into each bin."""
    best = np.full(coords, _EMPTY, np.uint64)
    start = 0
    while start < 2 * coords:
        stop = min(2 * coords, start + max(1, 2048 // len(items)))
        rounds = np.arange(start, stop, dtype=np.uint64)
        thrown = mixed(items[None, :] ^ mixed(rounds + np.uint64(1))[:, None])
        bins = (thrown >> np.uint64(40)) % np.uint64(coords)
        bins[rounds >= coords] = (rounds[rounds >= coords] - np.uint64(coords))[:, None]
        values = (rounds << np.uint64(40))[:, None] | (thrown & _LOW)
        np.minimum.at(best, bins.ravel().astype(np.int64), values.ravel())
        if not (best == _EMPTY).any():
            break
        start = stop
    return best


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One bucket number per band; the band is part of the number."""
    rows = coordinates.reshape(BANDS, ROWS)
    out = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(17))
    for k in range(ROWS):
        out = mixed(out ^ rows[:, k])
    return out.view(np.int64)


class Shingles:
    """Sets of word shingles of texts given as UTF-8 bytes; A-Z are lowered, other letters stay."""

    def __init__(self, width: int):
        self.width = width
        self.tokens = TokenTable(hash64)

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        self.tokens.trim()
        at = self.tokens.codes(words)
        codes = self.tokens.table(np.uint64)[at]
        return np.unique(rolled(codes, min(self.width, len(codes))))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for part in slices(batch):
                sizes, digests, numbers, marks = [], [], [], []
                for text in part.column(1).to_pylist():
                    items = shingles.of(text)
                    sizes.append(len(items))
                    digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    coordinates = sketch(items) if len(items) else None
                    numbers.append([] if coordinates is None else bands(coordinates))
                    marks.append(None if coordinates is None else coordinates.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(numbers, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands", "marks"],
                )

    return run


def _sets(width: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, wanted = Shingles(width), shared.value
        for batch in batches:
            some = batch.filter(pa.array(wanted[batch.column(0).to_numpy() & (len(wanted) - 1)]))
            for part in slices(some):
                items = [np.sort(shingles.of(text).view(np.int64)) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.list_(pa.int64()))], ["id", "items"])

    return run


def _likely(least: int):
    """Keeps pairs that agree in ``least`` coordinates, each known by its last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDS) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_()))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = []
                for left, right in zip(part.column(2), part.column(3), strict=True):
                    x, y = left.values.to_numpy(), right.values.to_numpy()
                    few, many = (x, y) if len(x) <= len(y) else (y, x)
                    if 100 * len(few) < percent * len(many):
                        keep.append(False)
                        continue
                    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                    both = int((many[at] == few).sum())
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _plausible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches agree in all but a fifth of the coordinates fewer than expected at the similarity.

    That is seven standard deviations off, so a pair at the similarity is lost once in a hundred billion; full sets are
    moved for the others only.
    """
    marks = signed.where("marks IS NOT NULL").groupBy("doc_id").agg(F.min("marks").alias("marks"))
    with_left = pairs.join(marks.toDF("a", "x"), "a")
    with_both = with_left.join(marks.toDF("b", "y"), "b").select("a", "b", "x", "y")
    least = int((percent / 100 - 0.2) * COORDS)
    return written(with_both.mapInArrow(_likely(least), "a bigint, b bigint"), "pairs")


def _sets_of(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, items) of the documents whose ids are in the one column of ``ids``.

    A bitmap of the ids' low bits (1 MB) lets tasks pass over most other texts, so no text is shuffled, only sets.
    """
    once = written(ids.distinct(), "wanted")
    shared = texts.sparkSession.sparkContext.broadcast(flags(once.select(F.col("wanted").bitwiseAND((1 << ID_BITS) - 1)), ID_BITS))
    made = texts.where("doc_id IS NOT NULL").mapInArrow(_sets(width, shared), "id bigint, items array<bigint>")
    return written(made.join(once, made["id"] == once["wanted"], "left_semi"), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    with_left = pairs.join(sets.toDF("a", "x"), "a")
    with_both = with_left.join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return written(with_both.mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, at): for every set its first shingles in the order of their frequency.

    Two sets at the similarity share a shingle among their first ``n - ceil(n * percent / 100) + 1``. Shingles of one
    set alone come first and are only counted: ``at`` is the place in the whole order.
    """
    tokens = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ordered = tokens.join(shared, "token").groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("sets", "token"))).alias("some"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    alone = F.col("n") - F.size("some")
    first = F.slice("some", F.lit(1), F.greatest(F.lit(0), length - alone).cast("int"))
    return ordered.select("id", "n", alone.alias("alone"), F.posexplode(first).alias("k", "t")).select(
        F.col("t.token").alias("token"), "id", "n", (F.col("alone") + F.col("k")).alias("at")
    )


def _crowded_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs across components among the documents of open buckets that their rare shingles and sizes allow.

    A shared passage of thousands of documents is frequent and comes last in their order, so it brings none of them
    together unless it is nearly all they hold. At a shared shingle, what can still follow in both sets bounds their
    overlap, and with the sizes rules out all but few pairs inside the join. Only members outside the largest component
    of a shingle are set against the others: a family of near copies is never compared with itself.
    """
    first = _rare_first(sets, percent).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = written(first.select("token", "id", "n", "at", "label"), "rare-first")
    parts = first.groupBy("token", "label").agg(F.count(F.lit(1)).alias("members"))
    spans = parts.groupBy("token").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    open_ = first.join(spans.where("labels > 1").drop("labels"), "token")
    left = open_.where("label <> main").select(*[F.col(c).alias(f"l_{c}") for c in ("token", "id", "n", "at", "label")])
    share = percent / (100.0 + percent)
    need = (F.col("n") + F.col("l_n")) * share - 1e-9
    met = left.join(
        open_,
        (F.col("l_token") == F.col("token"))
        & (F.col("label") != F.col("l_label"))
        & (F.least(F.col("n") - F.col("at"), F.col("l_n") - F.col("l_at")) >= need)
        & (100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")),
    )
    return met.select(F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, marks binary"
    signed = written(texts.mapInArrow(_signatures(width), schema), "sketches")

    classes = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = classes.select("rep").distinct()
    members = signed.join(reps, signed["doc_id"] == reps["rep"], "left_semi").select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"))
    ends = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = written(ends.where("low < high"), "buckets")
    crowded = written(members.join(shared.where("n > 2"), "bucket").select("bucket", "id", "low", "high"), "crowded")
    pairs = (
        shared.select(F.col("low").alias("a"), F.col("high").alias("b"))
        .union(crowded.where("id <> low").select("low", "id"))
        .union(crowded.where("id <> high").select("id", "high"))
        .distinct()
    )
    pairs = _plausible(pairs, signed, percent)
    links = _confirmed(_sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("wanted")), width), pairs, percent)
    # Near enough to tell which buckets are settled; a component still in two parts costs some more pairs.
    labels = components(links, steps=2)

    seen = crowded.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    spans = seen.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    unsettled = seen.join(spans.where("least < most").select("bucket"), "bucket", "left_semi").select(F.col("id").alias("open_id")).distinct()
    sets = _sets_of(texts, unsettled.select(F.col("open_id").alias("wanted")), width)
    more = _confirmed(sets, _plausible(_crowded_pairs(sets, labels, percent), signed, percent), percent)
    labels = components(written(links.union(more), "links"))

    named = classes.join(labels.toDF("rep", "label"), "rep", "left").select(
        "digest", F.coalesce("label", "rep").alias("component_id")
    )
    known = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    linked = F.when(F.col("doc_id").isNotNull(), component)
    return known.select("doc_id", "n_shingles", linked.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
