import random
from collections import defaultdict

import pytest

from partloom.llm import alignment
from partloom.llm.queries import QUERIES
from tests.llm.frames import ODD, clash, documents, rows, words

SF = "/root/testdata/sf0.001"


def lines_of(text):
    return [(k, x.encode().strip()) for k, x in enumerate(text.split("\n")) if x.encode().strip()]


def longest(places):
    """Length of the longest chain that rises on both sides, by trying all."""
    best = []
    for n, (_, y) in enumerate(places):
        best.append(1 + max((best[m] for m in range(n) if places[m][1] < y), default=0))
    return max(best, default=0)


def plain_patience(a, b, i=0, j=0):
    """Aligned positions by the textbook rule, recursive. Of chains equally long the library's counts."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *plain_patience(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    both = [(x, b.index(line)) for x, line in enumerate(a) if a.count(line) == 1 and b.count(line) == 1]
    chain = [both[k] for k in alignment.patience(both)]
    assert len(chain) == longest(both) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:], strict=False))
    out, x, y = [], 0, 0
    for p, q in [*chain, (len(a), len(b))] if chain else []:
        out += plain_patience(a[x:p], b[y:q], i + x, j + y)
        if p < len(a):
            out.append((i + p, j + q))
        x, y = p + 1, q + 1
    return out


def brute_deleted(pairs):
    """Lines that go: every later document against the partners that its lines give it."""
    split = {i: lines_of(t) for i, t in pairs}
    holders = defaultdict(set)
    for i, own in split.items():
        for _, x in own:
            holders[x].add(i)
    out = {}
    for i, own in split.items():
        shared = defaultdict(int)
        for x in {x for _, x in own}:
            earlier = [j for j in holders[x] if j < i]
            for j in earlier if len(holders[x]) <= alignment.RARE else [min(earlier)] if earlier else []:
                shared[j] += len(x.split())
        gone = set()
        for j in (j for j, n in shared.items() if n >= alignment.SEED):
            a, b = [x for _, x in own], [x for _, x in split[j]]
            aligned = plain_patience(a, b)
            stretch = []
            for p in [*aligned, None]:
                if stretch and (p is None or p != (stretch[-1][0] + 1, stretch[-1][1] + 1)):
                    n = sum(len(a[x].split()) for x, _ in stretch)
                    (x, y), (u, v) = stretch[0], stretch[-1]
                    for s, t, turn in [(x - 1, y - 1, -1), (u + 1, v + 1, 1)]:
                        if 0 <= s < len(a) and 0 <= t < len(b):
                            for one, two in zip(a[s].split()[::turn], b[t].split()[::turn]):  # noqa: B905
                                if one != two:
                                    break
                                n += 1
                    if n >= alignment.WORDS:
                        gone.update(own[s][0] for s, _ in stretch)
                    stretch = []
                stretch.append(p)
        out[i] = gone
    return out


def without(text, gone):
    """Text less the lines that go; a line without a word goes with its neighbours."""
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.encode().strip()]
    kept = []
    for k, x in enumerate(lines):
        around = [max((f for f in full if f < k), default=None), min((f for f in full if f > k), default=None)]
        empty_goes = gone and k not in full and all(f is None or f in gone for f in around)
        if k not in gone and not empty_goes:
            kept.append(x)
    return "\n".join(kept)


def expected(pairs):
    gone = brute_deleted(pairs)
    return {i: without(t, gone[i]) for i, t in pairs}


def deduped(spark, texts):
    return dict(rows(alignment.line_dedup(documents(spark, list(enumerate(texts)))), "doc_id", "text"))


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(words(rng, rng.choice((2, 3, 8, 12, 20, 30, 55, 90)))) for _ in range(25)]
    pairs = []
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.6 else " ".join(words(rng, 15)) for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.6:
            at = rng.randrange(20)
            block = pool[at : at + rng.randrange(2, 6)]
            if rng.random() < 0.4:  # edge lines shared in part
                block[0], block[-1] = " ".join(words(rng, 4)) + " " + block[0], block[-1] + " " + " ".join(words(rng, 4))
            lines[1:1] = block
        if rng.random() < 0.3:
            lines.insert(1, "  ")
        pairs.append((i, "\n".join(lines)))
    rng.shuffle(pairs)
    got = alignment.line_dedup(clash(documents(spark, pairs), "own", "line", "blocks", "later", "partner", "digest", "new", "c0", "__common", "__later", "__new", "__deleted"))
    assert got.columns.count("__deleted") == 1
    assert dict(rows(got, "doc_id", "text")) == expected(pairs)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(rows(QUERIES["op7_line_dedup"](spark, SF), "doc_id", "text")) == expected(docs)


def test_blocks_in_changed_order(spark):
    """The alignment rises: of two swapped blocks the larger chain goes and the other stays."""
    rng = random.Random(1)
    one, two = [" ".join(words(rng, 20)) for _ in range(4)], [" ".join(words(rng, 20)) for _ in range(3)]
    got = deduped(spark, ["\n".join(["start", *one, *two]), "\n".join([*two, "own line", *one])])
    assert got[1] == "\n".join([*two, "own line"])


def test_small_lines_and_shared_edges(spark):
    rng = random.Random(2)
    five = [" ".join(words(rng, 9)) for _ in range(5)]
    shared = words(rng, 60)
    cuts = [" ".join(shared[:15]), " ".join(shared[15:30]), " ".join(shared[30:45]), " ".join(shared[45:])]
    edged = lambda a, b: "\n".join([a + " " + cuts[0], *cuts[1:3], cuts[3] + " " + b])
    got = deduped(spark, ["a b\n" + "\n".join(five), "\n".join(five) + "\nc d", edged("x y", "z"), edged("other", "end of it")])
    assert got[1] == "c d"  # 45 words in five lines
    assert got[3] == "other " + cuts[0] + "\n" + cuts[3] + " end of it"  # 30 words in whole lines, 30 in shared edges
    short = "\n".join(five[:3])
    assert deduped(spark, [f"one\n{short}\ntwo", f"three\n{short}\nfour"])[1] == f"three\n{short}\nfour"  # 27 words stay


def test_many_share_one_passage(spark):
    passage = "\n".join(" ".join(words(random.Random(k), 30)) for k in range(2))
    pairs = [(i, f"own {i}\n{passage}") for i in range(300)]
    got = {r["doc_id"]: r for r in alignment.line_dedup(documents(spark, pairs)).collect()}
    assert got[0]["text"] == pairs[0][1]
    assert all((got[i]["text"], got[i]["__deleted"], got[i]["__blocks"]) == (f"own {i}", 2, 1) for i in range(1, 300))


def test_pairs_grow_with_lines(spark):
    """A line of many documents pairs each with its first holder; rare ones pair all."""
    rng = random.Random(4)
    hot, rare = " ".join(words(rng, 20)), " ".join(words(rng, 20))
    pairs = [(i, hot + (f"\n{rare}" if i % 20 == 3 else "") + f"\nown {i}") for i in range(60)]
    texts = documents(spark, pairs).select("doc_id", alignment.F.xxhash64("text").alias("digest"), alignment.F.col("text").cast("binary"))
    got = rows(alignment.overlaps(texts.mapInArrow(alignment._parsed, alignment.PARSED)).select("later.doc_id", alignment.F.col("partner.doc_id").alias("p")), "doc_id", "p")
    assert got == sorted([(i, 0) for i in range(1, 60)] + [(23, 3), (43, 3), (43, 23)], key=repr)


def test_patience_takes_a_longest_rising_chain():
    assert alignment.patience([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [1, 2, 4]
    assert alignment.patience([]) == []
    assert alignment.matched([1, 2, 3, 9, 4], [7, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (4, 5)]


def test_odd_rows(spark):
    long = " ".join(words(random.Random(3), 80))
    odd = ODD + [(10, long), (10, long), (10, "other\n" + long), (11, long), (None, long), (12, "kept\n" + long)]
    got = alignment.line_dedup(clash(documents(spark, odd)))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = rows(got, "doc_id", "text")
    assert [t for t in texts if t[0] == 10] == [(10, long)] * 2 + [(10, "other\n" + long)]
    assert (11, "") in texts and (None, long) in texts and (12, "kept") in texts and (1, None) in texts
    assert len(texts) == len(odd)
    assert rows(alignment.line_dedup(documents(spark, odd), length="n_chars").where("doc_id = 12"), "n_chars") == [(4,)]
    assert alignment.line_dedup(documents(spark, [])).count() == 0
    assert alignment.line_dedup(documents(spark, [(1, long)])).count() == 1
