import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from partloom.llm import pieces
from tests.llm.frames import ODD, clash, documents, rows, words

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    return pieces.Pair(f"{pieces.FOLDER}/{pieces.A_FILE}", f"{pieces.FOLDER}/{pieces.B_FILE}")


def plain_tokens(pair, text):
    """Ids and bytes of both sides as the libraries give them for the whole text."""
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text, num_threads=1)
    if b"".join(pair.a_bytes[i] for i in a) != (" " + text).encode() or b"".join(pair.b_bytes[i] for i in b) != (" " + text).encode():
        return [], []
    return [(i, len(pair.a_bytes[i])) for i in a], [(i, len(pair.b_bytes[i])) for i in b]


def plain_groups(a, b):
    """Groups by walking both sides at once."""
    out, ga, gb, at_a, at_b, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            ga.append(a[i][0])
            at_a += a[i][1]
            i += 1
        else:
            gb.append(b[j][0])
            at_b += b[j][1]
            j += 1
        if at_a == at_b:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(pair, docs):
    groups = [(d, *plain_tokens(pair, t or "")) if t else (d, [], []) for d, t in docs]
    groups = [(d, a, b, plain_groups(a, b)) for d, a, b in groups]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for *_, g in groups]
    often = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (x, _), n in often.items():
        most[x] = max(most[x], n)
    out = []
    for (d, a, b, g), own in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in own.items() if often[p] == most[p[0]])
        out.append((d, len(a), len(b), len(g), sum(own.values()), best, sum(n * often[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(5)
    letters = "ab zé ñ ü ß \n\t\r.,'’“—#$ 123 <s></s><unk><0x41> 中文 ий 🎉👩‍👩‍👧  　᠎​\x00\x85\xa0"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    plain = [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(60)]
    fixed = [" ", "  ", "\n", " a", "a ", "a  b", "<|endoftext|>", "a<|endoftext|>b <s> x", "▁", "a▁b c", "x ▁ y", "don't we'll 'tis", "aaaa" * 50, "=" * 77 + " " * 33 + "-" * 51]
    return made + plain + fixed + ["the cat sat, the cat."] * 5


@pytest.mark.parametrize("hot", [0, 40, pieces.HOT])
def test_against_whole_texts(spark, pair, hot):
    """All texts, with every pair shuffled, some broadcast, all broadcast."""
    docs = list(enumerate(odd_texts()))
    assert rows(pieces.aligned(documents(spark, docs), hot=hot), *COLUMNS) == brute(pair, docs)


def test_spans_give_the_tokens_of_whole_texts(pair):
    for text in odd_texts():
        (a, b), _ = pair.encode([text])
        plain = plain_tokens(pair, text)
        assert [a.tolist(), b.tolist()] == [[i for i, _ in side] for side in plain], text


def test_quick_library_equals_the_file(pair):
    rng = random.Random(9)
    letters = [chr(c) for c in range(1, 0x250)]
    for _ in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else "etaoin shrdlu' ") for _ in range(rng.randrange(1, 40)))
        assert pair.quick.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids


def test_cuts_by_bisection(pair):
    """Random ends of several documents against the plain intersection, far-off and missing cuts included."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        ends, starts, base = ([], []), ([0], [0]), 0
        for _ in range(rng.integers(1, 6)):
            size = int(rng.integers(0, 60))
            for k, density in enumerate(rng.random(2)):
                own = [e for e in range(1, size) if rng.random() < density] + ([size] if size else [])
                ends[k].extend(base + e for e in own)
                starts[k].append(len(ends[k]))
            base += size
        a, b, sa, sb = (np.array(x, np.int64) for x in (*ends, *starts))
        cut_a, cut_b = pieces.shared_cuts(a, b, sa, sb)
        shared = sorted(set(ends[0]) & set(ends[1]))
        assert a[cut_a].tolist() == shared and b[cut_b].tolist() == shared


def test_groups_of_very_many_links(spark, pair, monkeypatch):
    docs = [(1, "aaaa" * 500), (2, "the tokens of several words"), (3, "ab" * 700)]
    monkeypatch.setattr(pieces, "BIG", 2)
    got = [tuple(x.tolist() if hasattr(x, "tolist") else x for x in part) for part in pieces.align_texts(pair, [t for _, t in docs])]
    monkeypatch.undo()
    assert got == [tuple(x.tolist() if hasattr(x, "tolist") else x for x in part) for part in pieces.align_texts(pair, [t for _, t in docs])]


def test_pairs_in_parts(spark, pair, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "PART", 3)
    counts, digests, doc, pairs, times = pieces.align_texts(pair, ["one two three four five six seven", "x"])
    batch = pieces._packed(pa.array([7, 8]), pa.array([1, 2]), counts, digests, doc, pairs, times)
    assert batch.schema.names == [c.split()[0] for c in pieces.SCHEMA.split(", ")]
    parts = batch.to_pylist()
    assert [p["part"] for p in parts if p["row"] == 7] == list(range(-(-int((doc == 0).sum()) // 3)))
    assert [x for p in parts for x in p["pairs"]] == pairs.tolist()


def test_odd_rows(spark, pair):
    got = rows(pieces.aligned(clash(documents(spark, ODD), "row", "part", "pair", "docs", "best", "times")), *COLUMNS)
    assert got == brute(pair, ODD)
    assert rows(pieces.aligned(documents(spark, [])), *COLUMNS) == []
