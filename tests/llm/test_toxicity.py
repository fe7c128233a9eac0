import os
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm import toxicity
from triledger.llm.toxicity import Lexicon, evidence, finds, learn, scored, without_toxic

FOLDER = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(word, terms):
    """Fewest edits behind the first letter with which a beginning of the word becomes a term."""
    best = 2
    for term in terms:
        most = 1 if len(term) >= toxicity.MISSPELLED_FROM else 0
        if word[:1] == term[0]:
            d = min(distance(word[1:n], term[1:]) for n in range(1, len(word) + 1))
            best = min(best, d if d <= most else 2)
    return best


def test_the_automaton_finds_what_comparing_finds():
    rng = random.Random(1)
    terms = ["abcab", "abba", "acbca", "babab", "cabcabc", "bca", "abcabca"]
    lexicon = Lexicon(terms)
    for _ in range(4_000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10)))
        assert lexicon.edits(word) == brute(word, terms), word
    exact = Lexicon(terms, frozenset(terms))
    assert exact.edits("abcab") == 0 and exact.edits("abcdab") == 2
    assert Lexicon([]).edits("abc") == 2


def test_quotations_count_less():
    lexicon = Lexicon(["idiot"])
    assert finds("you idiot!".split(), lexicon) == [(1, 1.0)]
    assert finds("you idoit".split(), lexicon) == []
    assert finds("you idiat".split(), lexicon) == [(1, toxicity.MISSPELLED)]
    assert finds('she said "you idiot" and left'.split(), lexicon) == [(3, toxicity.QUOTED)]
    assert finds('"quoted" words, idiot'.split(), lexicon) == [(2, 1.0)]
    assert evidence("x " * 50 + "idiot", lexicon) < evidence("idiot " * 3 + "x " * 48, lexicon)
    assert evidence(None, lexicon) == evidence("", lexicon) == (0.0, 0.0, 0.0)


def training(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice("abcdefgh") + rng.choice(["ring", "ton", "der", "lock"]) + str(rng.randrange(60)) for _ in range(60)]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["grumpel", "snark"]) + rng.choice(["", "er", "ig", "us"])
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_terms_generalise(spark):
    docs, labels = training(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    model = learn(frame, labels)
    assert {"grumpel", "snark"} <= {t[:7] for t in model.terms} | {t[:5] for t in model.terms}
    new = [(9001, "a morning grumpelish walk over the hill with friends of mine", None, None, 0), (9002, "a morning walk over the hill", None, None, 0),
           (9003, "a morning grumbelig snarkish walk", None, None, 0)]
    got = {r["doc_id"]: r for r in scored(documents(spark, new), model).collect() if r["doc_id"]}
    assert [got[i]["predicted"] for i in (9001, 9002, 9003)] == [1, 0, 1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for i, r in got.items() if i < 9000)
    kept = without_toxic(documents(spark, new), model)
    assert kept.columns == documents(spark).columns and kept.count() == len(rows()) + 1
    assert without_toxic(none(spark), model).count() == 0 and scored(none(spark), model).count() == 0


def test_misspellings_weigh_alike_whatever_the_size_of_the_sample(spark):
    docs, labels = training(spark)
    given = labels.collect()
    weights = []
    for copies in (1, 8):
        # In each copy of the corpus, two clean rows have a word that is one edit from a term.
        many = [(600 * k + i, f"{text} snackbar" if i in (1, 2) else text, *rest) for k in range(copies) for i, text, *rest in docs]
        frame = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
        model = learn(frame, spark.createDataFrame([(600 * k + i, 1, t) for k in range(copies) for i, _, t in given], labels.schema))
        assert "snark" in model.terms
        weights.append(dict(finds("a snurk walk".split(), model.lexicon())).get(1, 0))
    assert all(0.5 * toxicity.MISSPELLED < w <= toxicity.MISSPELLED for w in weights)
    lexicon = Lexicon(["idiot", "loser"], misspelled={"loser": 0.2})
    assert finds("idiat losen loser".split(), lexicon) == [(0, toxicity.MISSPELLED), (1, 0.2), (2, 1.0)]


def test_labels_of_the_held_out_quarter_are_not_used(spark):
    docs, labels = training(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert learn(frame, labels) == learn(frame, turned.unionByName(spark.createDataFrame([(None, 1, 1), (7, None, None)], labels.schema)))


def test_without_labels_all_scores_are_equal(spark):
    docs, labels = training(spark)
    frame = spark.createDataFrame(docs[:30], "doc_id long, text string, lang string, source string, n_chars long")
    for given in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(1))):
        model = learn(frame, given)
        assert model.terms == [] and len({r["score"] for r in scored(frame, model).collect()}) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    judged = scored(docs, learn(docs, labels)).filter("held_out").join(labels, "doc_id")
    right = {(r["toxic"], r["predicted"]): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    caught, missed, wrong = (right.get(k, 0) for k in ((1, 1), (1, 0), (0, 1)))
    assert caught >= 0.8 * (caught + missed) and caught >= 0.9 * (caught + wrong)


def test_terms_are_found_in_runs_of_letters():
    """Whatever they are glued to by; quotation marks still count."""
    lexicon = Lexicon(["idiot"])
    for text in ("you,idiot", "so-idiot", "x/idiot/y", "it's\u2019idiot", "1idiot2", "_idiot_", "¡idiot!"):
        assert evidence(text, lexicon)[0] > 0, text
    assert evidence('he wrote "you,idiot" there', lexicon)[0] < evidence("he wrote you,idiot there", lexicon)[0]
    assert evidence("idi ot", lexicon)[0] == evidence("12 , ; ...", lexicon)[0] == 0
