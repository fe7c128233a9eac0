import random

import numpy as np
import pytest

from tests.llm.cases import documents, none, rows
from triledger.llm import ngram_join
from triledger.llm.ngram_join import components, shingle_sets, signatures, without_near_copies


def sets_of(texts):
    split = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in split]


def linked(a, b):
    return bool(a and b and 100 * len(a & b) >= 80 * len(a | b))


def brute(docs):
    """docs: (id, text) with distinct ids."""
    sets = sets_of([t for _, t in docs])
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs))


def near_copies(seed, families=40):
    rng = random.Random(seed)

    def word():
        return rng.choice("abcdefghij") + str(rng.randrange(400))

    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(families):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 700]))]
        base += passage if rng.random() < 0.3 else []
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(int(len(words) * rng.choice([0, 0.005, 0.02, 0.03, 0.05])) + rng.choice([0, 0, 1])):
                at = rng.randrange(len(words))
                if rng.random() < 0.4 and len(words) > 1:
                    del words[at]
                else:
                    words[at] = word()
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("options", [{}, {"n2": 3, "k2": 1, "share": 0.2}, {"n2": 4, "k2": 2, "share": 0.15}, {"share": 0.1, "least": 1},
                                     {"share": 0.05, "least": 1, "common": 0.2}])
def test_partners_share_signatures(options):
    texts = [*near_copies(5), "", None]
    sets = sets_of(texts)
    hashes, sizes = shingle_sets(texts)
    assert sizes.tolist() == [len(s) for s in sets]
    frequent = np.sort(hashes)[::7]
    for hot in (np.empty(0, np.uint64), frequent):
        found, counts, needs = signatures(hashes, sizes, hot, **options)
        ends = np.cumsum(counts)
        own = [set(found[e - c:e].tolist()) for e, c in zip(ends, counts, strict=True)]
        for i in range(len(sets)):
            for j in range(i):
                if linked(sets[i], sets[j]):
                    assert len(own[i] & own[j]) >= min(needs[i], needs[j]) >= 1


def test_components_are_exact(spark):
    texts = near_copies(11)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, components(frame).collect())) == brute(docs)
    assert sorted(r["doc_id"] for r in without_near_copies(frame).collect()) == sorted({c for _, _, c in brute(docs)})


def test_a_star_of_copies_that_are_not_linked_with_each_other(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    docs = [(7, " ".join(base))]
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(150), 3):
            words[at] = f"x{i}y{at}"
        docs.append((100 + i, " ".join(words)))
    docs += [(1000 + i, " ".join([*base[:60], *(f"z{i}q{j}" for j in range(100))])) for i in range(30)]
    expected = brute(docs)
    assert len({c for _, _, c in expected}) > 30
    for turns in (0, 8):
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted(map(tuple, components(frame, turns=turns).collect())) == expected


def test_awkward_documents(spark):
    got = components(documents(spark)).collect()
    assert len(got) == len(rows())
    of = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert of[1] == of[2] == of[3] == (3, 1)
    assert of[4] == (0, 4) and of[5] == (0, 5) and of[6] == (0, 6) and of[11] == (1, 11) and of[10] == (1, 10)
    assert of[7][1] == of[8][1] == of[9][1] == 7
    assert sorted((r["n_shingles"], r["component_id"] or -1) for r in got if r["doc_id"] is None) == [(0, -1), (3, 1)]
    assert components(none(spark)).count() == 0
    kept = without_near_copies(documents(spark))
    assert kept.columns == documents(spark).columns and without_near_copies(none(spark)).count() == 0
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 10, 10, 11]


def test_shared_members_are_told_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        members = [(s, m) for s in range(40) for m in range(s % 5) for _ in range(1 + (s + m) % 2)]
        frame = spark.createDataFrame(members, "sig long, lo long").repartition(3, "sig").sortWithinPartitions("sig", "lo")
        got = sorted(map(tuple, ngram_join._shared(frame).collect()))
        assert got == sorted({(s, m) for s, m in members if s % 5 > 1})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def crowd(seed, members):
    """Sets around one text that are mostly 0.5 to 0.8 similar; some share edits with each other, so that they link past the text."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(160)]
    shared = [(at, f"s{at}") for at in rng.sample(range(160), 24)]
    docs = [(5, " ".join(base))]
    for i in range(members):
        words = list(base)
        for at, word in rng.sample(shared, rng.choice([0, 0, 3, 12, 22])):
            words[at] = word
        for at in rng.sample(range(160), rng.choice([0, 1, 2, 4, 6, 8])):
            words[at] = f"x{i}y{at}"
        if rng.random() < 0.3:
            words = words[:rng.randrange(120, 160)]
        docs.append((100 + i, " ".join(words)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_crowd_of_nearly_similar_sets(spark, seed):
    docs = crowd(seed, 150)
    expected = brute(docs)
    assert 3 < len({c for _, _, c in expected}) < 150
    assert sorted(map(tuple, components(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == expected


def test_a_crowd_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(150), 7 if i % 2 else 2):
            words[at] = f"x{i}y{at}"
        docs.append((1 + i, " ".join(words)))
    compared = []

    def counted(pairs, *others):
        compared.append(pairs.count())
        return similar(pairs, *others)

    similar = ngram_join._similar
    monkeypatch.setattr(ngram_join, "_similar", counted)
    got = components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(docs)
    # 200 members apart, 20 000 pairs of them and 40 000 with the others.
    assert sum(compared) < 2 * len(docs)


def test_members_that_share_too_few_differences_are_left_out(spark):
    members = {10: (3, [1, 2, 3, 4]), 11: (3, [1, 2, 3]), 12: (3, [1, 2, 9]), 13: (2, [9, 8])}
    single = spark.createDataFrame([(1, m, m, least, h) for m, (least, own) in members.items() for h in own],
                                   "pivot long, rep long, c long, least long, h long")
    once = ngram_join._reaching(single)
    assert sorted((r["rep"], r["h"]) for r in once.collect()) == [*((m, h) for m in (10, 11) for h in (1, 2, 3)), (12, 1), (12, 2), (12, 9)]
    # 9 was shared with the member that has gone.
    assert sorted((r["rep"], r["h"]) for r in ngram_join._reaching(once).collect()) == [(m, h) for m in (10, 11) for h in (1, 2, 3)]


def test_differences_of_a_crowd_are_not_joined_in_vain(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    edits = [(at, f"s{at}") for at in range(0, 150, 6)]
    docs = [(0, " ".join(base))]
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), 12):
            words[at] = f"x{i}y{at}"
        for at, word in rng.sample(edits, 1):
            words[at] = word
        docs.append((1 + i, " ".join(words)))
    # Two that are linked past the text.
    docs += [(500 + i, " ".join([*(f"z{at}" if at % 13 == 0 else w for at, w in enumerate(base)), f"e{i}"])) for i in range(2)]
    seen = []

    def counted(single):
        seen.append(single.count())
        return often(single)

    often = ngram_join._often
    monkeypatch.setattr(ngram_join, "_often", counted)
    got = components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(docs)
    assert len({c for _, _, c in brute(docs)}) > 60
    assert seen[-1] < seen[0] / 20
