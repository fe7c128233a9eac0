import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm import token_edits
from triledger.llm.bpe import RANKS, vocabulary
from triledger.llm.token_edits import Tree, edited, grow

PIECES = st.lists(st.sampled_from(["the", " ", "  ", "\n", "don't", " 12", "é", "🙂", "#", " a b c d", " ", "\x1c", "x" * 40]), max_size=200)


def count(text):
    return len(vocabulary(RANKS)[0].encode_ordinary(text))


@settings(max_examples=60, deadline=None)
@given(PIECES, st.lists(st.tuples(st.integers(-3, 900), st.integers(0, 300), st.sampled_from(["", " ", "x", " new words", "\n", " \t", "'s"])), max_size=6))
def test_counts_follow_edits(pieces, edits):
    text = "".join(pieces)
    tree = Tree(text)
    assert tree.tokens == count(text)
    for at, removed, added in edits:
        tree.edit(at, removed, added)
        at = min(max(at, 0), len(text))
        text = text[:at] + added + text[at + removed:]
        assert "".join(tree.leaves) == text and tree.tokens == count(text)
        assert tree.sums[1, 0] == len(text)


def test_only_touched_leaves_are_encoded_again():
    rng = random.Random(1)
    text = " ".join("word" + str(rng.randrange(999)) for _ in range(20_000))
    tree = Tree(text)
    tree = Tree(text, RANKS, tree.leaf_tokens(), tree.leaf_starts())
    assert tree.encoded == 0
    tree.edit(70_000, 3, "abc")
    assert 0 < tree.encoded < 4 * token_edits.LEAF


def test_a_grown_leaf_is_cut_without_the_rest_of_its_tree():
    rng = random.Random(2)
    text = " ".join("word" + str(rng.randrange(999)) for _ in range(20_000))
    added = " ".join("new" + str(rng.randrange(99)) for _ in range(5_000))
    tree = Tree(text)
    tree = Tree(text, RANKS, tree.leaf_tokens(), tree.leaf_starts())
    tree.edit(70_000, 3, added)
    text = text[:70_000] + added + text[70_003:]
    assert "".join(tree.leaves) == text and tree.tokens == count(text) and tree.sums[1].tolist() == [len(text), count(text)]
    assert len(added) > token_edits.GROWN * token_edits.LEAF and tree.encoded < len(added) + 4 * token_edits.LEAF
    assert max(map(len, tree.leaves)) < 2 * token_edits.LEAF
    for at, removed, new in ((69_900, 30_000, "x y"), (0, 5, ""), (len(text), 0, added), (50, 10**6, added)):
        tree.edit(at, removed, new)
        at = min(at, len(text))
        text = text[:at] + new + text[at + removed:]
        assert "".join(tree.leaves) == text and tree.tokens == count(text)


def test_trees_kept_as_tables(spark):
    docs = [(i, " ".join(f"w{j * i % 37}" for j in range(i * 40))) for i in range(12)] + [(12, None), (13, "")]
    trees = grow(spark.createDataFrame(docs, "doc_id long, text string"))
    one = F.array(F.struct(F.lit(5).cast("long").alias("at"), F.lit(4).cast("long").alias("removed"), F.lit(" new").alias("added")), F.lit(None))
    once = edited(trees, one)
    twice = edited(once.select(*trees.columns), F.when(F.col("doc_id") != 3, one))
    for r in once.collect():
        was = dict(docs)[r["doc_id"]] or ""
        assert r["_text"] == was[:5] + " new" + was[9:] and r["n_before"] == count(was) and r["n_after"] == count(r["_text"])
    for r in twice.collect():
        was = dict(docs)[r["doc_id"]] or ""
        now = was[:5] + " new" + was[9:]
        now = now if r["doc_id"] == 3 else now[:5] + " new" + now[9:]
        assert r["_text"] == now and r["n_after"] == count(now)


def test_awkward_documents(spark):
    docs = documents(spark).drop("starts", "tokens").drop("_text")
    none_changed = edited(grow(docs, keep=("doc_id", "name")), F.lit(None).cast("array<struct<at: long, removed: long, added: string>>"))
    got = sorted(((r["doc_id"], r["name"], r["_text"], r["n_after"], r["n_encoded"]) for r in none_changed.collect()), key=repr)
    assert got == sorted(((i, "own name", t or "", count(t or ""), 0) for i, t, *_ in rows()), key=repr)
    assert grow(none(spark)).count() == 0
