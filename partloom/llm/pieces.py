"""Cross-tokenizer alignment: tokens of two tokenizers grouped between the byte offsets where both end one.

``aligned`` encodes every whole text with a byte-level BPE (A) and a sentence-piece BPE (B), finds the shared cuts by
divide and conquer, counts over the corpus in how many documents a pair of ids is linked, and returns one row per
document. ``stored`` is the intermediate table: groups, and each document's distinct linked pairs with how often.

Where the work runs: texts, cuts and pairs in Arrow batches; counts and their way back to the documents in joins and
aggregates. The most frequent pairs, at most ``HOT`` of them, are broadcast; all others hold less than one in ``HOT / 2``
of all links each and go through a shuffled join, so no key is hot.

Edge cases: a null or empty text, and one whose joined token bytes of either side differ from space + text (a text with
U+2581, say), has no tokens: zeros and an empty digest, and links nothing. Ids may be null or repeat (one row out per row
in); an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.session import written

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HOT = 1 << 17  # pairs broadcast at most: 17 bytes each
SLICE = 1 << 21  # characters of text worked on at once (a longer text is worked on alone)
PART = 1 << 16  # pairs in one stored row
BIG = 1 << 14  # links of a group from which they are counted by distinct ids instead of listed
CACHED = 300_000  # spans whose tokens are remembered, of 8 tokens on average at most

# Both tokenizers start anew at a single space between other characters, so a text is encoded span by span.
# U+180E and U+200B count as white space in some versions of Unicode only.
GAP = re.compile(" (?<=[^\\s\u180e\u200b] )(?=[^\\s\u180e\u200b])")

BLANK = re.compile("^[\\s\u180e\u200b]|[\\s\u180e\u200b]$")
FOREIGN = re.compile("[^\x00-\u024f]")
# Fixed value: how the byte-level vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = (
    "row bigint, doc_id bigint, part int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<bigint>"
)


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers of a worker, with the tokens of frequent spans."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = {i: piece for piece, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(letters.get(c, 63) for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Pieces that run across a space would make spans depend on each other: then whole texts are encoded.
        self.spans = not any(re.search("[^▁]▁", p) for p in pieces)
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=self._ranks(), special_tokens={})
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{mark}" for i in range(n) for mark in ",|;"]
        self.seen: dict[str, int] = {}
        self.clear()

    def _ranks(self) -> dict[bytes, int]:
        added = set(self.a.get_added_tokens_decoder())
        return {t: i for i, t in enumerate(self.a_bytes) if i not in added}

    def clear(self) -> None:
        self.seen.clear()
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.fits = np.empty(0, bool)

    def learn(self, spans: list[str], together: bool) -> None:
        """Encode spans; ``fits`` says whether the joined bytes are space + span on both sides.

        Spans without white space at their ends can be encoded ``together``, as one text that is cut again at their sizes.
        Where that text does not come back so, some span is a misfit, and each is encoded by itself.
        """
        if not spans:
            return
        fits, tables = np.ones(len(spans), bool), (self.a_bytes, self.b_bytes)
        done = False
        if together and self.spans:
            text = " ".join(spans)
            whole, size = (" " + text).encode(), np.cumsum(np.fromiter(map(len, [s.encode() for s in spans]), np.int64, len(spans)) + 1)
            few = [" ".join(spans[k : k + 64]) for k in range(0, len(spans), 64)]
            b = list(chain.from_iterable(self.b.encode(few, num_threads=1)))
            flats = [np.array(ids, np.int32) for ids in (self.encode_a(" " + text), b)]
            if all(b"".join(map(t.__getitem__, f.tolist())) == whole for t, f in zip(tables, flats, strict=True)):
                upto = [np.cumsum(n[f]) for n, f in zip(self.lengths, flats, strict=True)]
                ends = [np.searchsorted(u, size) for u in upto]
                done = all(np.array_equal(u[e], size) for u, e in zip(upto, ends, strict=True))
                ends = [e + 1 for e in ends]
        if not done:
            ids = [self.encode_a(" " + s) for s in spans], [self.b.encode(s, num_threads=1) for s in spans]
            flats = [np.array(list(chain.from_iterable(own)), np.int32) for own in ids]
            ends = [np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) for own in ids]
            for table, own in zip(tables, ids, strict=True):
                fits &= [b"".join(map(table.__getitem__, o)) == (" " + s).encode() for o, s in zip(own, spans, strict=True)]
        for k in (0, 1):
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + ends[k]])
            self.flat[k] = np.concatenate([self.flat[k], flats[k]])
        self.fits = np.concatenate([self.fits, fits])

    def encode_a(self, text: str) -> list[int]:
        """Ids of A. Letters whose class is the same in every version of Unicode go to the faster library."""
        if FOREIGN.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of all texts in a row, and where each text starts in them; misfits have no ids."""
        if len(self.seen) > CACHED or len(self.flat[0]) > 8 * CACHED:
            self.clear()
        cut = [GAP.split(t) if self.spans else [t] for t in texts]
        every = list(chain.from_iterable(cut))
        new = list(set(every).difference(self.seen))
        edges = {t for spans in cut for t in (spans[0], spans[-1])}  # only these may have white space at their ends
        odd = [t for t in edges.intersection(new) if BLANK.search(t) or not t]
        new = list(set(new).difference(odd)) if odd else new
        plain = new
        if FOREIGN.search(" ".join(new)):  # apart, so that the faster library gets the plain ones
            plain = [t for t in new if not FOREIGN.search(t)]
        groups = [(plain, True), ([] if plain is new else [t for t in new if FOREIGN.search(t)], True), (odd, False)]
        for spans, together in groups:
            self.seen.update(zip(spans, range(len(self.fits), len(self.fits) + len(spans)), strict=True))
            self.learn(spans, together)
        codes = np.fromiter(map(self.seen.__getitem__, every), np.int64, len(every))
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        if not self.fits[codes].all():
            kept = []
            for k, text in enumerate(texts):
                own = codes[starts[k] : starts[k + 1]]
                kept.append(own if self.fits[own].all() or self._joined(own, text) else own[:0])
            codes, starts = np.concatenate(kept), np.concatenate([[0], np.cumsum([len(own) for own in kept])])
        ids, at = [], []
        for flat, ends in zip(self.flat, self.ends, strict=True):
            n = ends[codes + 1] - ends[codes]
            upto = np.concatenate([[0], np.cumsum(n)])
            ids.append(flat[np.repeat(ends[codes] - upto[:-1], n) + np.arange(upto[-1])].astype(np.int64))
            at.append(upto[starts])
        return ids, at

    def _joined(self, spans: np.ndarray, text: str) -> bool:
        """Misfits of spans may still make up for each other."""
        whole = (" " + text).encode()
        for flat, ends, table in zip(self.flat, self.ends, (self.a_bytes, self.b_bytes), strict=True):
            if b"".join(table[i] for s in spans for i in flat[ends[s] : ends[s + 1]]) != whole:
                return False
        return True


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of A, and of B, that end at a shared offset, by divide and conquer.

    Offsets rise over all documents of the batch; ``starts`` hold where each document's tokens start, and one more.
    Both sides of a document end at the same offset. All open intervals of a level are worked on together: each looks
    for the common end nearest to its middle, to the right of it and else to the left, by bisecting one side for the end of the
    other in turn, and splits there; intervals without one are leaves.
    """
    filled = starts_a[1:] > starts_a[:-1]
    a_lo, a_hi, b_lo, b_hi = (x[filled] for x in (starts_a[:-1], starts_a[1:] - 1, starts_b[:-1], starts_b[1:] - 1))
    found_a, found_b = [a_hi], [b_hi]
    while True:
        inner = (a_lo < a_hi) & (b_lo < b_hi)  # both sides have ends before the last
        a_lo, a_hi, b_lo, b_hi = a_lo[inner], a_hi[inner], b_lo[inner], b_hi[inner]
        if not len(a_lo):
            return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))
        i, j, hit = _common(ends_a, ends_b, (a_lo + a_hi - 1) >> 1, a_lo, a_hi, b_lo, b_hi)
        i, j, a_lo, a_hi, b_lo, b_hi = (x[hit] for x in (i, j, a_lo, a_hi, b_lo, b_hi))
        found_a.append(i)
        found_b.append(j)
        a_lo, a_hi = np.concatenate([a_lo, i + 1]), np.concatenate([i, a_hi])
        b_lo, b_hi = np.concatenate([b_lo, j + 1]), np.concatenate([j, b_hi])


def _common(ends_a, ends_b, middle, a_lo, a_hi, b_lo, b_hi):
    """The common end next to the middle of each interval: index in A, index in B, whether there is one."""
    i, j, hit = middle.copy(), np.zeros_like(middle), np.zeros(len(middle), bool)
    for right in (True, False):
        open_ = np.flatnonzero(~hit)
        i[open_] = middle[open_]
        while len(open_):
            x = ends_a[i[open_]]
            at = np.searchsorted(ends_b, x) if right else np.searchsorted(ends_b, x, "right") - 1
            inside = at < b_hi[open_] if right else at >= b_lo[open_]
            open_, at, x = open_[inside], at[inside], x[inside]
            y = ends_b[at]
            j[open_] = at
            hit[open_[x == y]] = True
            open_, y = open_[x != y], y[x != y]
            at = np.searchsorted(ends_a, y) if right else np.searchsorted(ends_a, y, "right") - 1
            inside = at < a_hi[open_] if right else at >= a_lo[open_]
            open_ = open_[inside]
            i[open_] = at[inside]
    return i, j, hit


def linked(ids_a, ids_b, cut_a, cut_b, doc_of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) of all links with how often: document, pair (A id * 2^32 + B id), times.

    ``cut`` are the last tokens of the groups, in order. A group of very many links counts the distinct ids of its
    two sides instead of listing occurrences.
    """
    start_a, start_b = (np.concatenate([[0], cut + 1])[:-1] for cut in (cut_a, cut_b))
    n_a, n_b = cut_a + 1 - start_a, cut_b + 1 - start_b
    plain = np.flatnonzero(n_a * n_b < BIG)
    links = (n_a * n_b)[plain]
    upto = np.concatenate([[0], np.cumsum(links)])
    k = np.arange(upto[-1]) - np.repeat(upto[:-1], links)
    width = np.repeat(n_b[plain], links)
    a = ids_a[np.repeat(start_a[plain], links) + k // width]
    b = ids_b[np.repeat(start_b[plain], links) + k % width]
    key, times = np.unique((np.repeat(doc_of_group[plain], links) << 48) | (a << 24) | b, return_counts=True)
    keys, counts = [key], [times]
    for g in np.flatnonzero(n_a * n_b >= BIG):
        a, many_a = np.unique(ids_a[start_a[g] : cut_a[g] + 1], return_counts=True)
        b, many_b = np.unique(ids_b[start_b[g] : cut_b[g] + 1], return_counts=True)
        keys.append(((doc_of_group[g] << 48) | (a[:, None] << 24) | b[None, :]).ravel())
        counts.append((many_a[:, None] * many_b[None, :]).ravel())
    if len(keys) > 1:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(back, np.concatenate(counts).astype(float)).astype(np.int64)
    return key >> 48, ((key >> 24 & 0xFFFFFF) << 32) | (key & 0xFFFFFF), times


def _digests(pair: Pair, ids_a, ids_b, cut_a, cut_b, starts_a, starts_b) -> list[str]:
    """sha256 of every document's groups, written as `a,a|b,b;a|b`."""
    n_a, n_b = len(ids_a), len(ids_b)
    mark_a, mark_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    mark_a[cut_a], mark_b[cut_b] = 1, 2
    group_a = np.cumsum(mark_a) - mark_a  # groups before the token's own
    group_b = (np.cumsum(mark_b) - mark_b) // 2
    before_b, upto_a = np.concatenate([[0], cut_b + 1]), np.concatenate([cut_a + 1, [n_a]])
    order = np.empty(n_a + n_b, np.int64)
    order[np.arange(n_a) + before_b[group_a]] = ids_a * 3 + mark_a
    order[np.arange(n_b) + upto_a[group_b]] = ids_b * 3 + mark_b
    out = []
    for lo, hi in zip((starts_a + starts_b)[:-1].tolist(), (starts_a + starts_b)[1:].tolist(), strict=True):
        digest = hashlib.sha256()
        for at in range(lo, hi, SLICE):
            part = "".join(map(pair.written.__getitem__, order[at : min(hi, at + SLICE)].tolist()))
            digest.update((part[:-1] if at + SLICE >= hi else part).encode())
        out.append(digest.hexdigest() if hi > lo else "")
    return out


def align_texts(pair: Pair, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text: counts (n_a, n_b, n_groups, n_links) and digest; and the links of all texts as ``linked`` has them."""
    (ids_a, ids_b), (starts_a, starts_b) = pair.encode(texts)
    ends_a, ends_b = np.cumsum(pair.lengths[0][ids_a]), np.cumsum(pair.lengths[1][ids_b])
    cut_a, cut_b = shared_cuts(ends_a, ends_b, starts_a, starts_b)
    n = len(texts)
    doc_of_group = np.searchsorted(starts_a, cut_a, "right") - 1
    doc, pairs, times = linked(ids_a, ids_b, cut_a, cut_b, doc_of_group)
    counts = np.zeros((4, n), np.int64)
    counts[0], counts[1] = np.diff(starts_a), np.diff(starts_b)
    counts[2] = np.bincount(doc_of_group, minlength=n)
    np.add.at(counts[3], doc, times)
    return counts, _digests(pair, ids_a, ids_b, cut_a, cut_b, starts_a, starts_b), doc, pairs, times


def _packed(rows, doc_ids, counts, digests, doc, pairs, times) -> pa.RecordBatch:
    """Stored rows: a document's pairs in parts of ``PART``, at least one part each."""
    n = len(rows)
    first = np.searchsorted(doc, np.arange(n + 1))
    parts = np.maximum(1, -(-np.diff(first) // PART))
    of = np.repeat(np.arange(n), parts)
    part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    offsets = np.append(first[of] + part * PART, len(doc)).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
    at = pa.array(of)
    columns = [rows.take(at), doc_ids.take(at), pa.array(part, pa.int32()), *[pa.array(c[of], pa.int64()) for c in counts]]
    names = ["row", "doc_id", "part", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()).take(at), lists(pairs), lists(times)], names)


def stored(docs: DataFrame, text: str = "text", folder: str = FOLDER) -> DataFrame:
    """Written table of ``SCHEMA``: one row per document (more for very many pairs, numbered by ``part``)."""
    paths = f"{folder}/{A_FILE}", f"{folder}/{B_FILE}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*paths)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            lo, n = 0, batch.num_rows
            upto = np.cumsum(sizes)
            while lo < n:
                done = upto[lo - 1] if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(upto, done + SLICE, "right"))), lo + 4096, n)
                own = batch.slice(lo, hi - lo)
                texts = [t or "" for t in own.column(2).to_pylist()]
                full = [k for k, t in enumerate(texts) if t]
                counts, digests, doc, pairs, times = align_texts(pair, [texts[k] for k in full])
                every, marks = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
                every[:, full] = counts
                for k, d in zip(full, digests, strict=True):
                    marks[k] = d
                yield _packed(own.column(0), own.column(1), every, marks, np.array(full, np.int64)[doc], pairs, times)
                lo = hi

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return written(keyed.mapInArrow(work, SCHEMA), "pieces")


def pair_counts(table: DataFrame, name: str = "piece-pairs") -> DataFrame:
    """Written table: pair, its number of documents, and whether no pair of the same A id has more."""
    counts = written(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), name)
    a = F.shiftright("pair", 32)
    # One row per A id: the vocabulary bounds what is broadcast.
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    best = counts.withColumn("a", a).join(F.broadcast(most), "a")
    return written(best.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), name)


def _least_hot(counts: DataFrame, limit: int) -> int:
    """Smallest power of two that at most ``limit`` pairs reach."""
    by = {r["e"]: r["n"] for r in counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}
    e, total = 63, 0
    while e > 0 and total + by.get(e - 1, 0) <= limit:
        e -= 1
        total += by.get(e, 0)
    return 1 << min(e, 62)


def aligned(docs: DataFrame, text: str = "text", folder: str = FOLDER, hot: int = HOT) -> DataFrame:
    """One row per document: counts of tokens, groups and links, best links, summed counts, digest of the groups."""
    table = stored(docs, text, folder)
    counts = pair_counts(table)
    least = _least_hot(counts, hot)
    links = table.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    often = F.broadcast(counts.where(F.col("docs") >= least))
    near = links.join(often, "pair")
    far = links.join(often.select("pair"), "pair", "left_anti").join(counts.where(F.col("docs") < least), "pair")
    total = lambda rows: rows.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    both = total(near).unionByName(total(far)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return table.where("part = 0").join(both, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
