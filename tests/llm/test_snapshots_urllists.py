import random

from partloom.llm import snapshots, urllists
from tests.llm.frames import rows

TURNS = "conv_id bigint, turn bigint, role string, text string"


def chats(spark, conversations):
    flat = [(c, t, "user" if t % 2 == 0 else "assistant", text) for c, texts in conversations.items() for t, text in enumerate(texts)]
    return spark.createDataFrame(flat, TURNS)


def test_only_maximal_conversations_stay(spark):
    rng = random.Random(4)
    conversations = {}
    for c in range(120):
        base = conversations[rng.randrange(c)] if c and rng.random() < 0.6 else []
        conversations[c] = base[: rng.randrange(len(base) + 1)] + [rng.choice("abc") for _ in range(rng.randrange(1, 4))]
    got = rows(snapshots.chat(chats(spark, conversations)), "conv_id", "n_turns")
    every = {tuple(v) for v in conversations.values()}
    inner = {v[:k] for v in every for k in range(1, len(v))}
    want = {}
    for c in sorted(conversations, reverse=True):
        if tuple(conversations[c]) not in inner:
            want[tuple(conversations[c])] = c
    assert got == sorted(((c, len(v)) for v, c in want.items()), key=repr)


def test_long_conversations_are_split_and_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BLOCK", 4)
    whole = [str(k) for k in range(30)]
    other = [*whole[:17], "different", *whole[18:25]]
    got = snapshots.chat(chats(spark, {1: whole, 2: whole[:13], 3: other, 4: whole, 5: whole[:8]}))
    parts = {}
    for r in got.orderBy("conv_id", "part").collect():
        parts.setdefault(r["conv_id"], []).append(r["text"])
    assert {c: "".join(p) for c, p in parts.items()} == {
        c: "".join(f"<|im_start|>{'assistant' if k % 2 else 'user'}\n{t}<|im_end|>\n" for k, t in enumerate(v)) for c, v in ((1, whole), (3, other))
    }
    assert len(parts[1]) == 8


def test_odd_turns(spark):
    odd = [(None, 0, "user", "x"), (1, None, None, None), (1, 5, "user", "b"), (1, 5, "user", "b"), (1, -7, "user", "a"), (2, 0, "user", "")]
    got = rows(snapshots.chat(spark.createDataFrame(odd, TURNS)), "conv_id", "n_turns", "text")
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == [(1, 3, turn("unknown", "") + turn("user", "a") + turn("user", "b")), (2, 1, turn("user", ""))]
    assert snapshots.chat(spark.createDataFrame([], TURNS)).count() == 0


LOG = "list string, kind string, entry string, action string, dated string"
CAPTURES = "page_id bigint, url string, fetched_on string"


def test_entries_count_while_they_are_active(spark):
    log = [
        ("a", "domain", "Bad.com", "add", "2024-01-10"),
        ("a", "domain", "bad.com", "add", "2024-01-12"),
        ("a", "domain", "bad.com", "remove", "2024-01-20"),
        ("a", "domain", "bad.com", "add", "2024-02-01"),
        ("b", "host", "x.bad.com", "add", "2024-01-15"),
        ("c", "host", "bad.com", "add", "2024-01-01"),
        ("c", "host", "bad.com", "remove", "2024-01-01"),
        ("a", "domain", None, "add", "2024-01-01"),
        ("a", "domain", "other.com", "add", None),
    ]
    log = spark.createDataFrame(log + log[:2], LOG)
    urls = ["http://x.bad.com/p", "https://u:p@BAD.com:80/", "http://notbad.com", "nothing", None, "http://other.com"]
    days = ["2024-01-09", "2024-01-10", "2024-01-19", "2024-01-20", "2024-02-02"]
    captures = [(i * 10 + j, u, d) for i, u in enumerate(urls) for j, d in enumerate(days)] + [(99, urls[0], None)]
    got = {r["page_id"]: r["lists"] for r in urllists.filtered(spark.createDataFrame(captures, CAPTURES), log).collect()}
    assert [got[k] for k in range(5)] == [None, "a", "a,b", "b", "a,b"]
    assert [got[10 + k] for k in range(5)] == [None, "a", "a", None, "a"]
    assert all(got[k] is None for k in got if k >= 20) and len(got) == len(captures)
    assert urllists.filtered(spark.createDataFrame([], CAPTURES), log).count() == 0
    assert urllists.filtered(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame([], LOG)).where("blocked").count() == 0
