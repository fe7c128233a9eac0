import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm.exact_dedup import exact_groups, without_copies


def brute(docs):
    groups = defaultdict(list)
    for i, text, *_ in docs:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, told = max(known, default=None), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not told, hashlib.sha256(text.encode()).hexdigest()))
            told |= i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4, 64, 4096])
@pytest.mark.parametrize("route", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3)), lambda c: F.lit(0).cast("long")])
def test_equal_texts_get_one_identity_whatever_the_hash(spark, block, route):
    more = [(100 + i, "x" * (i // 2) + "é" * (i % 2), "en", "s", 0) for i in range(30)]
    got = exact_groups(documents(spark, more).filter("doc_id is null or doc_id < 7 or doc_id > 9"), block_bytes=block, route=route)
    wanted = [r for r in [*rows(), *more] if r[0] is None or not 7 <= r[0] <= 9]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(wanted)


def test_long_texts(spark):
    assert sorted(map(tuple, exact_groups(documents(spark)).collect()), key=repr) == brute(rows())


def test_no_documents(spark):
    assert exact_groups(none(spark)).count() == 0
    assert without_copies(none(spark)).count() == 0


def test_one_row_of_each_text_stays_whole(spark):
    docs = documents(spark)
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(r[0] for r in brute(rows()) if r[3])
