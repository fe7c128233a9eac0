import os

import pytest

import corpus_pipeline
from tests.llm.cases import documents, none, without_clash
from tests.llm.test_bpe import ids_of
from tests.llm.test_ngram_join import brute
from triledger.llm import mixing, toxicity
from triledger.llm.queries import POWER, topic
from triledger.llm.tables import saved

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(saved(stage(spark, states[-1], FOLDER)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]
    assert all(s.columns == docs.columns for s in states[:-1])
    before, clean, distinct, apart, mixed, encoded = ({r["doc_id"]: r for r in s.collect()} for s in states)

    model = toxicity.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    bias, *slopes = model.weights
    known = model.lexicon()

    def logit(text):
        return bias + sum(w * e for w, e in zip(slopes, toxicity.evidence(text, known), strict=True))

    assert set(clean) == {i for i, r in before.items() if logit(r["text"]) < -0.8472978603872037}
    last = {}
    for i, r in clean.items():
        last[r["text"]] = max(i, last.get(r["text"], i))
    assert set(distinct) == set(last.values())
    assert set(apart) == {c for _, _, c in brute([(i, r["text"]) for i, r in sorted(distinct.items())])}
    drawn = mixing.mix(states[3], topic(), power=POWER).collect()
    assert set(mixed) == {r["doc_id"] for r in drawn if r["sampled"]}
    assert {i: r["ids"] for i, r in encoded.items()} == {i: ids_of(r["text"]) for i, r in mixed.items()}
    assert all(r["restored"] and r["n_tokens"] == len(r["ids"]) for r in encoded.values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(encoded)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_awkward_and_missing_documents(spark):
    for start in (documents(spark), without_clash(documents(spark)), none(spark)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = saved(stage(spark, docs, FOLDER))
            assert docs.columns == start.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert last.count() == docs.count() and all(r["restored"] for r in last.collect())
