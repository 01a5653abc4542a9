import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from partloom.llm import bytetrees, toxicity
from partloom.llm.queries import QUERIES
from tests.llm.frames import ODD, clash, documents, rows

SF = "/root/testdata/sf0.01"


def brute_bits(samples, text, order=bytetrees.ORDER):
    """Code length by walking down from the longest context, byte by byte."""
    alphabet = set(b"\n") | {b for texts in samples.values() for t in texts for b in t}
    size = len(alphabet) + 1
    out = []
    for lang in sorted(samples):
        counts = defaultdict(Counter)
        for t in samples[lang]:
            padded = b"\n" * order + t
            for k in range(order, len(padded)):
                for n in range(order + 1):
                    counts[padded[k - n : k]][padded[k]] += 1
        total, padded = 0.0, b"\n" * order + text
        for k in range(order, len(padded)):
            p = 1.0
            for n in range(order, -1, -1):
                seen = counts.get(padded[k - n : k])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if padded[k] in seen:
                    p *= seen[padded[k]] / whole
                    break
                p *= len(seen) / whole
            else:
                p *= 1 / size if padded[k] in alphabet else 1 / size / max(1, 256 - len(alphabet))
            total -= math.log2(p)
        out.append(total)
    return out


def test_code_lengths_equal_a_walk_through_the_trees():
    rng = random.Random(3)
    samples = {"a": [b"the theme of them", b"then there"], "b": ["der dié des den".encode()], "c": [b"xyx xyy"]}
    trees = bytetrees.grow(samples)
    for _ in range(60):
        text = "".join(rng.choice("thedrnisxyé qß") for _ in range(rng.randrange(0, 30))).encode()
        assert np.allclose(trees.bits([text])[0], brute_bits(samples, text), rtol=1e-4, atol=1e-3), text


def test_language_of_held_out_documents(spark):
    got = QUERIES["op4_language"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.96 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    docs = documents(spark, [(i, "the house and the garden " * 4, "en", "s", 0) for i in range(20)] + [(100 + i, t) for i, (_, t) in enumerate(ODD)] + [(200, "123 !?"), (None, "the")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in bytetrees.identify(clash(docs)).collect()}
    assert got[0][0] == "en" and got[101] == got[102] == got[103] == got[200] == ("und", 0.0)
    assert rows(bytetrees.identify(documents(spark, [(1, "abc", None, "s", 0)])), "lang_pred", "score") == [("und", 0.0)]
    assert bytetrees.identify(documents(spark, [])).count() == 0


def test_windows_cover_every_word_and_overlap():
    sizes = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    doc, first = toxicity.windows(sizes)
    starts = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        own = first[doc == k] - starts[k]
        covered = {p for a in own for p in range(a, min(n, a + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(own) == (0 if n == 0 else max(0, -(-(n - 32) // 16)) + 1)


def test_gradients_and_both_forward_passes():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(rng.standard_normal(1 << toxicity.GRAM_BITS).astype(np.float32))
    words = ["alpha", "beta", "gamma", "delta", "épsilon"]
    buckets, begins = toxicity.grams(words)
    counts = np.diff(np.append(begins, len(buckets)))
    at = rng.integers(0, 5, (6, toxicity.WINDOW))
    last, label = np.array([32, 5, 32, 1, 17, 32]), np.array([1, 0, 1, 0, 0, 1], np.float32)
    grads, loss = toxicity._gradients(net, buckets, begins, counts, at, last, label)
    x = net.inputs(words)
    logit = net.logits(*[x @ net.weights["x" + s] + net.weights["c" + s] for s in "fb"], at, last)
    assert abs(loss - np.mean(np.logaddexp(0, logit) - label * logit)) < 1e-4
    for name, place in (("uf", (2, 5)), ("ub", (1, 30)), ("xf", (0, 4)), ("cb", (7,)), ("look", (3,)), ("out", (20,)), ("gram", (buckets[3], 1))):
        kept, step, sides = net.weights[name][place], 1e-2, []
        for sign in (1, -1):
            net.weights[name][place] = kept + sign * step
            sides.append(toxicity._gradients(net, buckets, begins, counts, at, last, label)[1])
        net.weights[name][place] = kept
        assert abs((sides[0] - sides[1]) / (2 * step) - grads[name][place]) < 2e-3 + 0.05 * abs(grads[name][place]), name


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(1)
    plain = ["tree", "river", "stone", "cloud", "window", "table", "green", "walking"]
    bad = ["vileness", "vilely", "vilest", "scoundrel"]
    docs, labels = [], []
    for i in range(500):
        text = [rng.choice(plain) for _ in range(rng.randrange(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    frame, marks = documents(spark, docs + [(1000, None), (1001, ""), (None, "tree vilely")]), spark.createDataFrame(labels + labels[:5], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(clash(frame), marks).collect()}
    held = [i for i in range(500) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(500)) and len(held) > 50
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[1000]["score"] == got[1001]["score"] == 0.0
    again = {r["doc_id"]: r["score"] for r in toxicity.detect(clash(frame.repartition(3)), marks).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-4 for i in range(500))
    none = toxicity.detect(documents(spark, ODD), spark.createDataFrame([(4, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int"))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.detect(documents(spark, []), marks).count() == 0
    long = toxicity.detect(documents(spark, ODD + docs), marks).where("doc_id IN (5, 6)").collect()
    assert all(0 <= r["score"] <= 1 for r in long)
