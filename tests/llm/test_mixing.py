from collections import defaultdict

from partloom.llm import mixing
from tests.llm.frames import ODD, clash, documents, rows


def poured(sizes, weights, volume, most):
    """Targets by pouring again and again, as the rule is worded."""
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), volume * sum(sizes.values())
    while left > 1e-9 and len(full) < len(names):
        open_ = [k for k in names if k not in full]
        total = sum(weight[k] for k in open_)
        share = {k: left * weight[k] / total for k in open_}
        left = 0.0
        for k in open_:
            room = most * sizes[k] - target[k]
            target[k] += min(room, share[k])
            left += share[k] - min(room, share[k])
            if share[k] >= room:
                full.add(k)
    return target


def some(n=600):
    return [(i, "w " * (1 + i * 7 % 40), "en", None if i % 11 == 0 else f"s{i % 7 % (1 + i % 5)}", 0) for i in range(n)]


def test_targets_and_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    got = mixing.mix(clash(documents(spark, some()), "key", "slot", "rest", "of", "size")).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = poured(sizes, (5, 2, 1), 1.5, 2.0)
    for k in sizes:
        assert abs(want[k] - target[k]) < 1e-6 * max(1, want[k])
        assert abs(taken[k] - target[k]) <= 40
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_reruns_and_ranges_agree(spark, monkeypatch):
    docs = documents(spark, some())
    first = rows(mixing.mix(docs), "doc_id", "taken")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    assert rows(mixing.mix(docs.repartition(7)), "doc_id", "taken") == first


def test_weights_favour_quality(spark):
    docs = [(i, ("good text " if i % 2 else "12 34 5a ") * 10, "en", "a", 0) for i in range(400)] + [(1000 + i, "b " * 2000, "en", "b", 0) for i in range(3)]
    taken = defaultdict(int)
    for r in mixing.mix(documents(spark, docs), weights=(1, 3)).where("source = 'a'").collect():
        taken[r["doc_id"] % 2] += r["taken"] / max(1, r["size"])
    assert taken[1] > taken[0]


def test_odd_rows(spark):
    got = mixing.mix(clash(documents(spark, ODD), "key", "slot", "target"))
    assert got.count() == len(ODD)
    assert rows(got.where("doc_id < 4"), "size", "taken") == [(0, 0)] * 3
    assert mixing.mix(documents(spark, [])).count() == 0
    empty = mixing.mix(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0)] * 2
