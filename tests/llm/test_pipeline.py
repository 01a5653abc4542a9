import random

import corpus_pipeline
from partloom.llm import toxicity
from tests.llm.frames import ODD, clash, documents, mutated, rows, words
from tests.llm.test_alignment import expected
from tests.llm.test_sketching import brute

SF = "/root/testdata/sf0.01"


def test_stages_over_the_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            scored = toxicity.detect(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r["doc_id"] for r in scored.collect() if r["predicted"] == 0}
        if name == "line dedup":
            small = dict(sorted(before.items())[:250])
            part = stage(spark, docs.where(docs.doc_id.isin(list(small))), SF)
            assert dict(rows(part, "doc_id", "text")) == expected(list(small.items()))
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] != before[r["doc_id"]])
        if name == "near-duplicates":
            small = dict(sorted(before.items())[:300])
            part = stage(spark, docs.where(docs.doc_id.isin(list(small))), SF)
            assert {i for (i,) in rows(part, "doc_id")} == {i for i, c in brute(list(small.items()), 5).items() if i == c}
        if name == "mixing":
            assert abs(sum(r["taken"] for r in after.values()) - 1.5 * sum(r["size"] for r in after.values())) < 60_000
        docs = out
    assert rows(corpus_pipeline.run(spark, SF), "doc_id", "taken") == rows(docs, "doc_id", "taken")


def test_decisions_take_effect_and_odd_rows_pass(spark):
    rng = random.Random(2)
    base, passage = words(rng, 200), " ".join(words(rng, 70))
    odd = ODD + [(50, " ".join(base)), (51, " ".join(mutated(rng, base, 2))), (60, "a\n" + passage), (61, "b\n" + passage), (None, "a\n" + passage)]
    docs = clash(documents(spark, odd))
    stages = dict(corpus_pipeline.STAGES)
    cut = stages["line dedup"](spark, docs, SF)
    assert cut.columns == docs.columns
    assert {("a\n" + passage, None), ("a\n" + passage, 60), ("b", 61)} <= {(r["text"], r["doc_id"]) for r in cut.collect()}
    near = stages["near-duplicates"](spark, docs, SF)
    ids = [i for (i,) in rows(near, "doc_id")]
    assert near.columns == docs.columns and 50 in ids and 51 not in ids and None in ids and {1, 2, 3, 4} <= set(ids)
    clean = stages["benchmark decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(odd)
    assert stages["mixing"](spark, docs, SF).count() == len(odd)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0
