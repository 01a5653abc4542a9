import pytest

from partloom.llm import quality
from tests.llm.frames import ODD, clash, documents, rows


def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)})


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c d a b c", "x y", "", "a b a b a b a b z", "a b c x a b c y a b c", "p q r s t"])
def test_repeated_words(spark, text):
    got = quality.ledger(documents(spark, [(1, text)])).first()
    assert got["n_repeat_words"] == brute_repeats(text.split())


def test_bits_policies_and_ablation(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    texts = [clean, "short", "###" + clean.replace(" ", " ### "), clean.upper(), "same line here\n" * 30]
    ledger = quality.ledger(documents(spark, list(enumerate(texts))))
    bits = dict(rows(ledger, "doc_id", "failed_bits"))
    names = {i: [n for k, (n, _) in enumerate(quality.RULES) if b >> k & 1] for i, b in bits.items()}
    assert names == {0: [], 1: ["few_words"], 2: ["symbols"], 3: ["shouting"], 4: ["repeated_words", "repeated_lines"]}
    assert dict(rows(quality.judge(ledger, "web-1"), "doc_id", "kept")) == {0: True, 1: False, 2: False, 3: True, 4: False}
    assert dict(rows(quality.judge(ledger, "base-1"), "doc_id", "base_failed")) == {0: False, 1: True, 2: False, 3: False, 4: True}
    counts = {r["rule"]: (r["fails"], r["fails_only_this"], r["kept_without"]) for r in quality.ablate(ledger, "web-2").collect()}
    assert counts["shouting"] == (1, 1, 2) and counts["repeated_words"] == (1, 0, 1) and counts["word_length"] == (0, 0, 1)


def test_odd_rows(spark):
    got = quality.judge(quality.ledger(clash(documents(spark, ODD))), "web-2")
    assert rows(got.where("doc_id < 4"), "doc_id", "n_words", "kept") == [(1, 0, False), (2, 0, False), (3, 0, False)]
    assert got.count() == len(ODD) and got.where("doc_id = 5 AND n_repeat_words = 60000").count() == 1
    assert quality.ledger(documents(spark, [])).count() == 0
    assert quality.ablate(quality.ledger(documents(spark, [])), "web-2").count() == 0


def test_filters_split_no_text_again(spark):
    """A filter on measurements stays above the generator: words and lines are split once each."""
    docs = documents(spark, [(1, "a b c")])
    for predicate in ("kept", "n_repeat_words > 5 AND n_words > 3"):
        plan = quality.judge(quality.ledger(docs), "web-2").where(predicate)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 2, predicate
