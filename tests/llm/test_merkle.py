import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm.merkle import folded, manifest, witness_digest
from triledger.llm.queries import tampered_leaf, verified_manifest


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes, arity):
    """The root of the nodes, and the (left, right) siblings of each."""
    steps, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // arity * arity:at // arity * arity + arity]
            steps[i].append(("".join(run[:at % arity]), "".join(run[at % arity + 1:])))
        nodes, where = [h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)], [at // arity for at in where]
    return nodes[0], steps


def brute(docs, arity=16):
    groups = defaultdict(list)
    for r in docs:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], arity) for s in names]
    root, above = climb([t[0] for t in trees], arity)
    out = []
    for s, (subroot, steps), more in zip(names, trees, above, strict=True):
        for (_, _, leaf, r), own in zip(sorted(groups[s], key=lambda x: x[:3]), steps, strict=True):
            witness = own + more
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
                node = leaf_of(r[0], text, *r[2:])
            for left, right in witness:
                node = h(left, node, right)
            out.append((r[0], leaf, subroot, root, h(*[a + b for a, b in witness]), node, node == root))
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


MANY = [(100 + i, f"Text {i}", "en", f"s{i % 3}" if i % 5 else "hot", i) for i in range(300)]


@pytest.mark.parametrize(("arity", "height"), [(16, 3), (16, 1), (2, 2), (3, 1)])
def test_against_hashing_level_by_level(spark, arity, height):
    """Small blocks give many rounds within the groups; awkward rows give null names, ties and repeated rows."""
    docs = documents(spark, MANY)
    found = manifest(docs, carried=tampered_leaf(), arity=arity, height=height)
    assert got(verified_manifest(found)) == brute([*rows(), *MANY], arity)


def test_many_groups(spark):
    """More groups than a block holds, one leaf each: lone leaves are the roots of their groups."""
    each = [(i, f"T{i}", None, f"g{i:03}", None) for i in range(70)]
    found = manifest(documents(spark, each).filter("doc_id < 70 and source like 'g%'"), carried=tampered_leaf(), arity=4, height=2)
    assert got(verified_manifest(found)) == brute(each, 4)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257])
def test_sizes_around_full_runs(spark, n):
    each = [(i, "x", "en", "s", 1) for i in range(n)]
    found = manifest(spark.createDataFrame(each, "doc_id long, text string, lang string, source string, n_chars long"),
                     carried=tampered_leaf(), height=2)
    assert got(verified_manifest(found)) == brute(each)


def test_a_changed_leaf_does_not_verify(spark):
    found = manifest(documents(spark, MANY))
    wrong = found.withColumn("leaf", F.sha2(F.concat("leaf", F.lit("x")).cast("binary"), 256))
    assert found.filter(folded(F.col("leaf"), F.col("witness")) != F.col("root")).count() == 0
    assert wrong.filter(folded(F.col("leaf"), F.col("witness")) == F.col("root")).count() == 0
    assert found.select(witness_digest(F.col("witness"))).distinct().count() > 300


def test_no_documents(spark):
    assert manifest(none(spark)).count() == 0
