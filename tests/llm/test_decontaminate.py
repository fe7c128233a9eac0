import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm.decontaminate import Automaton, judged, normalised, scan, without_hits

ITEMS = [(1, "The cat sat, on a mat: the CAT sat on a"), (2, "b C d"), (3, None), (4, ""), (5, "twice-told"), (None, "one"), (10, "é É b"),
         (7, "cat sat on a mat the cat sat on a mat"), (7, "f g"), (8, "c d"), (9, "twice told"), (11, "a b c d e f g h i j k")]


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def brute(docs, items, window=10):
    held = {}
    for item, text in items:
        words = [w for w, *_ in words_of(text)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            held.setdefault(tuple(words[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in docs:
        words = [w for w, *_ in words_of(text)]
        hit, found = [False] * len(words), set()
        for n in {len(w) for w in held}:
            for i in range(len(words) - n + 1):
                if names := held.get(tuple(words[i:i + n])):
                    hit[i:i + n] = [True] * n
                    found |= names
        out.append((doc_id, len(words), sum(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("own") for c in ("item", "pattern", "spans")})


MORE = [(100, "x b c d y", "en", "s", 0), (101, "É é b-c", "en", "s", 0), (102, "A,b;c.d e f g h i j k l", "en", "s", 0), (103, "bb c d", "en", "s", 0),
        (104, "ONE", "en", "s", 0)]


@pytest.mark.parametrize("shard_bytes", [2 << 20, 60])
def test_against_brute_force(spark, shard_bytes):
    """Awkward documents and items, with one automaton and with several."""
    found = scan(documents(spark, MORE), frame(spark, ITEMS), shard_bytes=shard_bytes)
    assert sorted(map(tuple, judged(found).collect()), key=repr) == brute([*rows(), *MORE], ITEMS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é-", max_size=12), min_size=1, max_size=5), st.text(alphabet="aAb é-", max_size=40), st.integers(1, 4))
def test_automaton(items, text, window):
    listed = list(enumerate(items))
    patterns = []
    for i, said in listed:
        words = normalised(said).split()
        for j in range(max(1, len(words) - window + 1) if words else 0):
            patterns.append((str(i), b" " + b" ".join(words[j:j + window]) + b" "))
    n, spans, found = Automaton(patterns).scan(text)
    hit = sum(last - first + 1 for first, last, *_ in spans)
    digest = sha256(",".join(found).encode()).hexdigest()
    assert [(0, n, hit, len(found), digest, hit > 0)] == brute([(0, text)], listed, window)
    places = words_of(text)
    assert [(b, e) for *_, b, e in spans] == [(places[first][1], places[last][2]) for first, last, *_ in spans]


def test_passages_are_cut_out_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Ére: B c, D! end"), (2, "nothing here"), (3, "b c d")], "doc_id long, text string")
    found = scan(docs, frame(spark, ITEMS)).join(docs, "doc_id").select("doc_id", without_hits(F.col("text"), F.col("spans")).alias("t"))
    assert dict(found.collect()) == {1: "Ére: ! end", 2: "nothing here", 3: ""}


def test_nothing_to_find(spark):
    assert judged(scan(documents(spark), frame(spark, ITEMS[2:4]))).filter("contaminated or n_items > 0").count() == 0
    assert scan(none(spark), frame(spark, ITEMS)).count() == 0
    assert scan(documents(spark), frame(spark, ITEMS).limit(0)).count() == len(rows())
