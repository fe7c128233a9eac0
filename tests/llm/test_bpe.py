import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm import bpe


def ids_of(text):
    return bpe.vocabulary(bpe.RANKS)[0].encode_ordinary(text or "")


def odd_texts():
    rng = random.Random(3)
    pieces = ["the ", "cat's", " 123456", "\n\n", "   ", "é", "日本語", "🙂", "\u00a0", "don't ", "##", "\t", "a" * 90, " " * 70, "'ll", "x"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(400))) for _ in range(60)] + [" " * 900, "z" * 900, "", None, "\n" * 333 + "a"]


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (64, 8), (200, 120), (32_768, 1_024)])
def test_chunks_give_the_ids_of_the_whole_text(spark, chunk, overlap):
    texts = odd_texts()
    frame = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = bpe.decode(bpe.encode(frame, chunk=chunk, overlap=overlap)).collect()
    assert sorted((r["doc_id"], r["ids"], bytes(r["bytes"])) for r in got) == sorted(
        (i % 50, ids_of(t), (t or "").encode()) for i, t in enumerate(texts))


def test_awkward_documents(spark):
    docs = documents(spark).drop("ids")
    got = bpe.decode(bpe.encode(docs, keep=("doc_id", "name", "_topic")), into="spelled")
    told = sorted(((r["doc_id"], r["name"], r["ids"], bytes(r["spelled"])) for r in got.collect()), key=repr)
    assert told == sorted(((i, "own name", ids_of(t), (t or "").encode()) for i, t, *_ in rows()), key=repr)
    assert bpe.encode(none(spark)).count() == 0


def test_digests_of_the_query(spark):
    frame = spark.createDataFrame([(1, "Hello  world's"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(frame)
    got = {r["doc_id"]: r["d"] for r in ids.select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("d")).collect()}
    assert got == {1: hashlib.sha256(" ".join(map(str, ids_of("Hello  world's"))).encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
