"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of its whole-word and character 3- to 5-gram vectors (hashed). Two gated recurrent passes read
windows of ``WINDOW`` words that overlap by half; attention pools their states into one logit per window. A document is
as toxic as its worst window; a two-parameter logistic turns that into the score.

Labels belong to documents, so training is on instances: of a toxic document the window that looks worst, of a clean one
the worst and a random one. The first vector coordinate starts from the log-odds of the gram over labelled documents.

The fit sees a bounded sample: at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents of at most ``MOST_CHARS``
characters, in the order of a hash of their ids. Scoring covers every window of every text.

Edge cases: a text without words scores 0; a null text is empty; labels that are null are not used, of several labels
of a document the highest counts; without toxic and clean examples every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.common import TokenTable, hash64, remainder, rolled

MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1000, 2000, 20_000
WINDOW, STRIDE = 32, 16
GRAM_BITS, WIDTH, HIDDEN = 16, 8, 12
EPOCHS, BATCH, RATE, GRAM_RATE = 8, 256, 0.01, 0.003
_STRIP = string.punctuation


def plain(token: bytes) -> str:
    word = token.decode("utf-8", "replace").casefold()
    return word.strip(_STRIP) or word


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all grams of the words, word after word, and where each word begins."""
    marked = ["<" + w + ">" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words)), sizes)
    whole = np.array([hash64(m.encode("utf-8", "surrogatepass")) for m in marked], np.uint64)
    buckets, owners = [whole >> np.uint64(64 - GRAM_BITS)], [np.arange(len(words))]
    for width in (3, 4, 5):
        n = len(points) - width + 1
        if n > 0:
            inside = owner[:n] == owner[width - 1 :]
            buckets.append((rolled(points, width) >> np.uint64(64 - GRAM_BITS))[inside])
            owners.append(owner[:n][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return np.concatenate(buckets)[order].astype(np.int64), starts


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word of every window, for documents of the given numbers of words laid end to end."""
    counts = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    ordinal = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return doc, (np.cumsum(sizes) - sizes)[doc] + ordinal * STRIDE


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; ``f`` and ``b`` are the two directions."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, prior: np.ndarray, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        some = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        w = {"gram": some(1 << GRAM_BITS, WIDTH, by=0.02)}
        w["gram"][:, 0] = prior
        for side in "fb":
            w["x" + side] = some(WIDTH, 3 * HIDDEN, by=0.5 / np.sqrt(WIDTH))
            w["c" + side] = np.zeros(3 * HIDDEN, np.float32)
            w["u" + side] = some(HIDDEN, 3 * HIDDEN, by=0.7 / np.sqrt(HIDDEN))
        w["look"], w["out"], w["off"] = some(2 * HIDDEN, by=0.3), some(2 * HIDDEN, by=0.3), np.zeros(1, np.float32)
        return cls(w)

    def inputs(self, words: list[str]) -> np.ndarray:
        buckets, starts = grams(words)
        return np.add.reduceat(self.weights["gram"][buckets], starts, axis=0)

    def logits(self, forward: np.ndarray, backward: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        """One logit per window. ``forward`` and ``backward`` hold the projected inputs of words, ``at`` the words of
        each window (window, step), ``last`` its number of words. States are kept feature by window."""
        n, steps = at.shape
        w, h = self.weights, HIDDEN
        short = bool((last < steps).any())
        states = np.empty((steps, 2 * h, n), np.float32)
        for side, table, order in (("f", forward, range(steps)), ("b", backward, range(steps - 1, -1, -1))):
            turn = np.ascontiguousarray(w["u" + side].T)
            state = np.zeros((h, n), np.float32)
            lo = 0 if side == "f" else h
            for t in order:
                given = np.ascontiguousarray(table[at[:, t]].T)
                past = turn @ state
                gates = given[: 2 * h] + past[: 2 * h]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new = past[2 * h :]
                new *= gates[h:]
                new += given[2 * h :]
                np.tanh(new, out=new)
                state = state - new
                state *= gates[:h]
                state += new
                if short:
                    state *= last > t
                states[t, lo : lo + h] = state
        look = np.einsum("tfn,f->tn", states, w["look"])
        worth = np.einsum("tfn,f->tn", states, w["out"])
        if short:
            look[np.arange(steps)[:, None] >= last[None, :]] = -1e9
        look -= look.max(axis=0)
        np.exp(look, out=look)
        return (look * worth).sum(axis=0) / look.sum(axis=0) + w["off"][0]


class Scorer:
    """Scores texts given as UTF-8 bytes; keeps the projected inputs of the words it has met, within a bound."""

    def __init__(self, network: Network, limit: int = 100_000):
        self.network, self.tokens = network, TokenTable(lambda token: token, limit)
        self.sides = {s: np.empty((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def project(self, tokens: list[bytes]) -> np.ndarray:
        codes = self.tokens.codes(tokens)
        have = len(self.sides["f"])
        for first in range(have, len(self.tokens.rows), 20_000):
            x = self.network.inputs([plain(t) for t in self.tokens.rows[first : first + 20_000]])
            for s in "fb":
                self.sides[s] = np.concatenate([self.sides[s], x @ self.network.weights["x" + s] + self.network.weights["c" + s]])
        return codes

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """Highest window logit of each text, -inf without words."""
        worst = np.full(len(texts), -np.inf)
        words = [t.split() for t in texts]
        start = 0
        while start < len(words):  # some hundred thousand words at a time, whole documents
            stop, total = start, 0
            while stop < len(words) and (stop == start or total + len(words[stop]) < 200_000):
                total += len(words[stop])
                stop += 1
            self._fill(words[start:stop], worst[start:stop])
            start = stop
        return worst

    def _fill(self, words: list[list[bytes]], worst: np.ndarray) -> None:
        if len(self.tokens.rows) > self.tokens.limit:
            self.tokens.trim()
            self.sides = {s: v[:0] for s, v in self.sides.items()}
        codes = self.project([w for each in words for w in each])
        sizes = np.array([len(each) for each in words])
        doc, first = windows(sizes)
        last = np.minimum(WINDOW, np.cumsum(sizes)[doc] - first)
        full = last == WINDOW
        for chosen in (np.flatnonzero(full), np.flatnonzero(~full)):
            for a in range(0, len(chosen), 1024):
                some = chosen[a : a + 1024]
                at = np.minimum(first[some, None] + np.arange(WINDOW), len(codes) - 1)
                np.maximum.at(worst, doc[some], self.network.logits(self.sides["f"], self.sides["b"], codes[at], last[some]))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        slope, shift = self.network.scale
        worst = self.worst(texts)
        return np.where(np.isfinite(worst), sigmoid(slope * np.maximum(worst, -1e6) + shift), 0.0)


def _gradients(net: Network, buckets, begins, counts, at, last, label) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the log loss of a batch of windows over the words given by their grams."""
    w, h = net.weights, HIDDEN
    n, steps = at.shape
    x = np.add.reduceat(w["gram"][buckets], begins, axis=0)
    live = (np.arange(steps) < last[:, None]).astype(np.float32)
    states, kept = np.zeros((n, steps, 2 * h), np.float32), {}
    for side, lo, order in (("f", 0, range(steps)), ("b", h, range(steps - 1, -1, -1))):
        given = (x @ w["x" + side] + w["c" + side])[at]
        state = np.zeros((n, h), np.float32)
        for t in order:
            past = state @ w["u" + side]
            gates = sigmoid(given[:, t, : 2 * h] + past[:, : 2 * h])
            new = np.tanh(given[:, t, 2 * h :] + gates[:, h:] * past[:, 2 * h :])
            kept[side, t] = state, gates, new, past[:, 2 * h :]
            state = (new + gates[:, :h] * (state - new)) * live[:, t, None]
            states[:, t, lo : lo + h] = state
    look = np.where(live > 0, states @ w["look"], -1e9)
    share = np.exp(look - look.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,ntf->nf", share, states)
    logit = pooled @ w["out"] + w["off"][0]
    p = sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
    d = ((p - label) / n).astype(np.float32)
    g = {"out": pooled.T @ d, "off": d.sum(keepdims=True)}
    d_pooled = d[:, None] * w["out"]
    d_share = np.einsum("ntf,nf->nt", states, d_pooled)
    d_look = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    g["look"] = np.einsum("nt,ntf->f", d_look, states)
    d_states = share[:, :, None] * d_pooled[:, None, :] + d_look[:, :, None] * w["look"]
    d_x = np.zeros_like(x)
    for side, lo, order in (("f", 0, range(steps - 1, -1, -1)), ("b", h, range(steps))):
        d_given = np.zeros((n, steps, 3 * h), np.float32)
        d_turn, carry = np.zeros_like(w["u" + side]), np.zeros((n, h), np.float32)
        for t in order:
            state, gates, new, held = kept[side, t]
            carry = (carry + d_states[:, t, lo : lo + h]) * live[:, t, None]
            keep, reset = gates[:, :h], gates[:, h:]
            d_new = carry * (1 - keep) * (1 - new * new)
            d_gates = np.concatenate([carry * (state - new), d_new * held], axis=1) * gates * (1 - gates)
            d_past = np.concatenate([d_gates, d_new * reset], axis=1)
            d_given[:, t] = np.concatenate([d_gates, d_new], axis=1)
            d_turn += state.T @ d_past
            carry = carry * keep + d_past @ w["u" + side].T
        by_word = np.zeros((len(x), 3 * h), np.float32)
        flat, cells = at.ravel(), d_given.reshape(-1, 3 * h)
        for k in range(3 * h):
            by_word[:, k] = np.bincount(flat, cells[:, k], len(x))
        g["u" + side], g["c" + side] = d_turn, cells.sum(axis=0)
        g["x" + side] = x.T @ by_word
        d_x += by_word @ w["x" + side].T
    spread = np.repeat(d_x, counts, axis=0)
    g["gram"] = np.stack([np.bincount(buckets, spread[:, k], 1 << GRAM_BITS) for k in range(WIDTH)], axis=1).astype(np.float32)
    return g, loss


class _Steps:
    """Gradient steps scaled by running moments."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}
        self.n = 0

    def apply(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray], decay: float) -> None:
        self.n += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, 5.0 / (size + 1e-9))
        for k, g in grads.items():
            g = g * np.float32(shrink)
            self.first[k] += np.float32(0.1) * (g - self.first[k])
            self.second[k] += np.float32(0.01) * (g * g - self.second[k])
            m, v = self.first[k] / (1 - 0.9**self.n), self.second[k] / (1 - 0.99**self.n)
            rate = decay * (GRAM_RATE if k == "gram" else RATE)
            weights[k] -= (rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)


def _log_odds(word_of: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, begins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Per gram: how much more often than by chance it stands in toxic documents, and less often in clean ones.

    Counts are set against those expected without a tie to the label, so rare grams stay near 0.
    """
    ends = np.append(begins[1:], len(buckets))
    seen = np.zeros((2, 1 << GRAM_BITS))
    at = 0
    for size, toxic in zip(sizes, label, strict=True):
        own = np.unique(word_of[at : at + size])
        at += size
        if len(own):
            seen[int(toxic), np.unique(np.concatenate([buckets[begins[k] : ends[k]] for k in own]))] += 1
    share = label.mean()
    expected = np.stack([seen.sum(axis=0) * (1 - share), seen.sum(axis=0) * share])
    return np.log((seen[1] + 1) / (expected[1] + 1)) - np.log((seen[0] + 1) / (expected[0] + 1))


def train(texts: list[bytes], label: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """Network fitted to whole labelled texts; None without examples of both labels."""
    words = [t.split() for t in texts]
    label = np.array(label, np.float32)
    if not len(label) or label.min() == label.max():
        return None
    names: dict[str, int] = {}
    word_of = np.array([names.setdefault(plain(w), len(names)) for each in words for w in each], np.int64)
    sizes = np.array([len(each) for each in words])
    if not len(word_of):
        return None
    buckets, begins = grams(list(names))
    counts = np.diff(np.append(begins, len(buckets)))
    prior = _log_odds(word_of, sizes, buckets, begins, label)
    net = Network.fresh((0.2 * prior).astype(np.float32), seed)
    doc, first = windows(sizes)
    last = np.minimum(WINDOW, np.cumsum(sizes)[doc] - first)
    at = word_of[np.minimum(first[:, None] + np.arange(WINDOW), len(word_of) - 1)]
    draw, steps = np.random.default_rng(seed), _Steps(net.weights)
    owned = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    feel = net.inputs(list(names))[:, 0]
    rank = np.where(np.arange(WINDOW) < last[:, None], feel[at], -np.inf).max(axis=1)
    for epoch in range(epochs):
        worst = np.array([a + rank[a:b].argmax() for a, b in zip(owned[:-1], owned[1:], strict=True)])
        random = owned[:-1] + (draw.random(len(worst)) * np.diff(owned)).astype(np.int64)
        chosen = np.unique(np.concatenate([worst, random[label[doc[random]] == 0]]))
        draw.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            some = chosen[a : a + BATCH]
            used, local = np.unique(at[some], return_inverse=True)
            span = counts[used]
            flat = np.repeat(begins[used] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            g, _ = _gradients(net, buckets[flat], np.cumsum(span) - span, span, local.reshape(len(some), WINDOW), last[some], label[doc[some]])
            steps.apply(net.weights, g, 1 - epoch / (epochs + 1))
        x = net.inputs(list(names))
        tables = [x @ net.weights["x" + s] + net.weights["c" + s] for s in "fb"]
        rank = np.concatenate([net.logits(*tables, at[a : a + 1024], last[a : a + 1024]) for a in range(0, len(at), 1024)])
    net.scale = _scaled(np.maximum.reduceat(rank, owned[:-1]), label[doc[owned[:-1]]])
    return net


def _scaled(logit: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic of the worst window; both labels weigh the same."""
    weight = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label == 0).sum()))
    middle, spread = logit.mean(), logit.std() + 1e-6
    z, slope, shift = (logit - middle) / spread, 1.0, 0.0
    for _ in range(rounds):
        off = weight * (sigmoid(slope * z + shift) - label)
        slope, shift = slope - 5 * (off @ z), shift - 5 * off.sum()
    return float(slope / spread), float(shift - slope * middle / spread)


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """Bounded training sample (text, toxic); ids are chosen before any text moves."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = known.where(remainder(F.col("doc_id"), folds) != held)
    short = docs.where(F.length("text") <= MOST_CHARS).select("doc_id").distinct()
    open_to = learn.join(short, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = open_to.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).union(open_to.where("toxic <> 1").orderBy(*order).limit(MOST_CLEAN))
    texts = docs.where(F.length("text") <= MOST_CHARS).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.least(F.lit(1), "toxic").cast("int").alias("toxic"))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted({row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)})
    network = train([text for _, text, _ in rows], [toxic for _, _, toxic in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)])], ["network"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Network | None:
    """Trains in one task, within the bounds of ``sample``; only the weights come to the driver. Row order is no matter."""
    known = sample(docs, labels, folds, held).repartition(1)
    made = known.mapInArrow(_train, "network binary").collect()
    return pickle.loads(made[0]["network"]) if made else None


def toxic_score(docs: DataFrame, network: Network | None, text: str = "text") -> Column:
    """Score column for the text column of ``docs``."""
    if network is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(np.concatenate([scorer.scores([bytes(t or b"") for t in texts[a : a + 256]]) for a in range(0, len(texts), 256)] or [np.empty(0)]))

    return scored(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def detect(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5)."""
    network = fit(docs, labels, folds, held)
    scored = docs.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(True)).alias("held_out"), toxic_score(docs, network).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
