import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm import quality


def repeated(words, window=8):
    places = {}
    for i in range(len(words) - window + 1):
        places.setdefault(tuple(words[i:i + window]), []).append(i)
    return len({j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + window)})


def words_of(text):
    return (text or "").encode().split()


def base(text):
    words, text = words_of(text), text or ""
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated(words))


def texts(seed=4):
    rng = random.Random(seed)
    out = []
    for n in [0, 1, 7, 8, 9, 16, 17, 30, 100, 400]:
        for variety in (1, 2, 3, 50):
            words = [rng.choice(["ab", "é#", "x|y", " ", "<>"]) + str(rng.randrange(variety)) for _ in range(n)]
            out.append("".join(w + rng.choice([" ", "\n", "\t\x0b", "\r\n"]) for w in words))
    line = " ".join(f"l{i}" for i in range(9))
    return [*out, f"{line}\nother\n{line}\n{line}\n", f"{line} {line}", None, ""]


def test_counts(spark):
    frame = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.statistics(frame).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts())}


def data(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = rng.multivariate_normal([1.5, 0.2, 0.3, 1.0], np.diag([0.04, 0.3, 0.2, 1.0]) + 0.05, n)
    x[:n // 8] = rng.normal([4, 3, 3, 5], 0.1, (n // 8, 4))
    return x


def numpy_mcd(x):
    """Concentration steps in the same distance bins, from both starts."""
    best = None
    quartiles = np.percentile(x, [25, 50, 75], axis=0, method="inverted_cdf")
    starts = [(x.mean(axis=0), np.cov(x.T, bias=True)), (quartiles[1], np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2))]
    floors = np.diag(np.square(quality.FLOORS))
    for mean, cov in starts:
        cov, det = cov + floors, np.inf
        for _ in range(3):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(quality.BINS_PER_OCTAVE * np.log2(np.maximum(d, 1e-9))).clip(quality.LOWEST, quality.HIGHEST)
            near = bins <= np.sort(bins)[int(np.ceil(quality.SHARE * len(x))) - 1]
            new = np.cov(x[near].T, bias=True) * quality.consistency() + floors
            if np.log(np.linalg.det(new)) >= det:
                break
            mean, cov, det = x[near].mean(axis=0), new, np.log(np.linalg.det(new))
        if best is None or det < best[2]:
            best = mean, cov, det
    return best


def test_the_estimate_ignores_a_cluster_of_outliers(spark):
    x = data()
    frame = spark.createDataFrame([("=a", "=s", *map(float, r)) for r in x], "_lang string, _source string, " + ", ".join(f"x{i} double" for i in range(4)))
    got = quality.mcd(frame).first()
    mean, cov, det = numpy_mcd(x)
    assert got["log_det"] == pytest.approx(det, abs=0.2)
    assert [got[f"m{i}"] for i in range(4)] == pytest.approx(mean.tolist(), abs=0.05)
    factor = np.array([[got[f"r{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose(np.linalg.inv(factor.T @ factor), cov, atol=0.12)
    clean, bad = x[len(x) // 8:], x[:len(x) // 8]

    def distance(y):
        z = (y - np.array([got[f"m{i}"] for i in range(4)])) @ factor.T
        return (z * z).sum(axis=1)

    assert distance(clean).max() < quality.CUTOFF < distance(bad).min()


def test_consistency_of_normal_data():
    rng = np.random.default_rng(1)
    d = np.sort((rng.normal(size=(400_000, 4)) ** 2).sum(axis=1))[:300_000]
    assert quality.consistency() == pytest.approx(4 / d.mean(), rel=0.01)


def test_verdicts(spark):
    rng = random.Random(7)

    def prose(n):
        return " ".join(rng.choice(["the", "house", "walked", "over", "green", "a", "morning", "some"]) + rng.choice("abcdefgh") for _ in range(n))

    docs = [(i, prose(rng.randrange(60, 300)), "en", "s") for i in range(150)]
    docs += [(500 + i, " ".join(w + "###***" for w in prose(60).split()), "en", "s") for i in range(8)]
    docs += [(600, prose(19), "en", "s"), (601, "one two three four five six seven eight " * 30, "en", "s")]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(150))
    assert not any(got[500 + i]["kept"] or got[500 + i]["base_failed"] for i in range(8))
    assert got[600]["base_failed"] and got[601]["base_failed"] and not got[600]["kept"]


def test_awkward_documents(spark):
    got = quality.judged(documents(spark)).collect()
    counts = sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got)
    assert counts == sorted(repr((i, *base(t))) for i, t, *_ in rows())
    assert all(r["base_failed"] and r["kept"] is False for r in got)
    assert quality.judged(none(spark)).count() == 0
    words = " ".join(f"w{i}" for i in range(40))
    alone = documents(spark, [(70, words, None, None, 0), (71, words, None, "z", 0)]).filter("doc_id >= 70")
    assert all(r["kept"] for r in quality.judged(alone.withColumn("x0", F.lit("own"))).collect())


def test_estimates_of_a_group_do_not_depend_on_other_groups(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        size = 400 if g == 0 else 25
        for i in range(size):
            far = 3.0 if g == 0 and i % 10 < 2 else 0.0
            rows.append(("=en", f"={g}", *[rng.gauss(far, 1.0) * (1 + k) for k in range(quality.P)]))
    frame = spark.createDataFrame(rows, "_lang string, _source string, x0 double, x1 double, x2 double, x3 double").cache()
    together = {r["_source"]: r["log_det"] for r in quality.mcd(frame).collect()}
    assert len(together) == 60
    for source in ("=0", "=7", "=23"):
        alone = quality.mcd(frame.filter(F.col("_source") == source)).first()["log_det"]
        assert abs(together[source] - alone) < 1e-4
