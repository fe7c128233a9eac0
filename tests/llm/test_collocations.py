import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import documents, none, rows
from triledger.llm.collocations import hashed_phrases, phrases_of, scored, top


def brute(docs, least, longest=4, part=80):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    out = []
    frequent = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    longer = Counter()
    for (lang, w), a in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                x = (lang, w[i:i + k])
                longer[x] = max(longer[x], a)
    for (lang, w), a in frequent.items():
        if 100 * longer[lang, w] >= part * a and longer[lang, w]:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted(out)


def texts(seed, many=40):
    """Few words, so that phrases are frequent; odd ones among them."""
    rng = random.Random(seed)
    words = ["a", "b", "A", "the", "é", "a\x01b", "b\x00", "\x01", "a\x00\x01", "x-y"]
    out = []
    for i in range(many):
        said = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randrange(60)))
        out.append((1000 + i, said, rng.choice(["en", "de", None, "en"]), "s", 0))
    return out


@pytest.mark.parametrize(("each", "least"), [(200_000, 3), (60, 3)])
def test_against_counting_everything(spark, each, least):
    """One range, and many that begin inside the extensions of a phrase."""
    docs = [*texts(1), *rows()]
    found = scored(documents(spark, texts(1)), least=least, each=each)
    assert sorted(map(tuple, found.collect())) == brute(docs, least)


def test_ranges_and_batches(spark):
    """Extensions that go on in later batches of a range."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    from triledger.llm import tables
    plain, tables.plain_reads = tables.plain_reads, lambda spark: None
    try:
        found = scored(documents(spark, texts(2)).filter("doc_id >= 1000"), least=2, each=300)
        assert sorted(map(tuple, found.collect())) == brute(texts(2), 2)
    finally:
        tables.plain_reads = plain
        plain(spark)


def test_a_full_bitmap_loses_nothing():
    full = [np.full(64, 2 ** 64 - 1, dtype=np.uint64)] * 3
    said = [t for _, t, *_ in texts(3)]
    found = {n: (phrases, counts) for n, phrases, counts in phrases_of(said, "en", full)}
    for size in (1, 2, 3, 4):
        wanted = Counter()
        for text in said:
            for piece in re.split("[.,;:!?\\x0A-\\x0D]", text.replace("A", "a")):
                words = [w.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01") for w in re.findall("[^\\x20\\x09]+", piece)]
                wanted.update("\x00".join(words[i:i + size]) for i in range(len(words) - size + 1))
        phrases, counts = found[size]
        assert dict(zip([p.decode() for p in phrases.to_pylist()], counts.tolist(), strict=True)) == dict(wanted)
        assert sorted(hashed_phrases(said, "en", full[:size - 1])[1]) == sorted(wanted.values())


def test_top(spark):
    """Ranks by score, count and phrase, language by language."""
    wanted = {}
    for lang, phrase, a, l, r, n, score in sorted(brute(texts(4), 3), key=lambda x: (-x[6], -x[2], x[1].encode())):
        ranked = wanted.setdefault(lang, [])
        if len(ranked) < 5:
            ranked.append((lang, len(ranked) + 1, phrase, a, l, r, n, score))
    found = top(scored(documents(spark, texts(4)).filter("doc_id >= 1000"), least=3), 5)
    assert sorted(map(tuple, found.collect())) == sorted(x for v in wanted.values() for x in v)


def test_no_documents(spark):
    assert scored(none(spark)).count() == 0
    assert scored(documents(spark).filter("text is null"), least=1).count() == 0
