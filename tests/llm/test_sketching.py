import random
import re

import numpy as np
import pytest

from partloom.llm import sketching
from partloom.llm.components import components
from partloom.llm.queries import QUERIES
from tests.llm.frames import ODD, clash, documents, mutated, rows, words

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
    if not w:
        return frozenset()
    k = min(width, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(pairs, width, percent=80):
    sets = {}
    for ident, text in pairs:
        sets.setdefault(ident, set()).add(shingles(text, width))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        ra, rb = sorted((find(a), find(b)))
                        root[rb] = ra
    return {i: find(i) for i in ids}


def test_every_coordinate_is_filled_and_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 150, 5000):
        items = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert not (sketching.sketch(np.sort(items)) == np.uint64(2**64 - 1)).any()
    agree = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 120, dtype=np.uint64)
        agree.append((sketching.sketch(base[:100]) == sketching.sketch(base[20:])).mean())
    assert abs(np.mean(agree) - 80 / 120) < 0.02


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, width):
    rng = random.Random(width)
    texts = []
    for size, members in ((60, 25), (200, 12), (9, 8)):  # groups whose members are near 0.8 of each other
        base = words(rng, size)
        texts += [" ".join(mutated(rng, base, rng.randrange(0, max(2, size // 12)))) for _ in range(members)]
    chain = words(rng, 80)
    for _ in range(14):  # each near the one before, the ends far apart
        chain = mutated(rng, chain, 2)
        texts.append(" ".join(chain))
    texts += [" ".join(words(rng, 50)) for _ in range(10)] + ["Same Text here", "same text HERE", "É accent", "é accent"]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    got = sketching.near_duplicates(clash(documents(spark, pairs)), width)
    want = brute(pairs, width)
    assert rows(got, "doc_id", "component_id") == sorted(want.items(), key=repr)
    assert rows(got, "doc_id", "n_shingles") == sorted(((i, len(shingles(t, width))) for i, t in pairs), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_crowded_buckets_are_settled(spark, monkeypatch):
    """Buckets so coarse that nearly everything meets: two centres reach little of it."""
    monkeypatch.setattr(sketching, "bands", lambda items: np.array([1, 2], np.int64))
    rng = random.Random(5)
    texts = [" ".join(m) for base in (words(rng, 40) for _ in range(6)) for m in (mutated(rng, base, 1) for _ in range(4))]
    passage = words(rng, 60)
    texts += [" ".join(words(rng, own) + passage + words(rng, 2)) for own in (2, 3, 5, 8, 12, 20, 30) for _ in range(5)]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    want = brute(pairs, 2)
    assert dict(rows(sketching.near_duplicates(documents(spark, pairs), 2), "doc_id", "component_id")) == want
    assert 8 < len(set(want.values())) < 50


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op3_near_duplicates"](spark, SF)
    assert dict(rows(got, "doc_id", "component_id")) == brute(docs, 2)


def test_odd_rows(spark):
    got = rows(sketching.near_duplicates(clash(documents(spark, ODD + [(8, "ONE"), (9, "one")])), 2), "doc_id", "n_shingles", "component_id", "kept")
    assert (None, 3, None, True) in got
    assert [(i, c) for i, _, c, _ in got if i in (1, 2, 3, 7)] == [(1, 1), (2, 2), (3, 3), (7, 7)]
    assert [g for g in got if g[0] in (4, 8, 9)] == [(4, 1, 4, True)] * 2 + [(8, 1, 4, False), (9, 1, 4, False)]
    assert sketching.near_duplicates(documents(spark, []), 2).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(50, 80)]
    got = dict(rows(components(spark.createDataFrame(links, "a bigint, b bigint")), "id", "label"))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in [1, *range(50, 80)]}}
