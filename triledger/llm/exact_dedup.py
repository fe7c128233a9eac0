"""Exact duplicates by deterministic block naming (Karp, Miller and Rosenberg).

Texts are cut into blocks of a fixed number of bytes.  The distinct blocks are sorted into integer names; then the names of
adjacent blocks are named as pairs, level by level, until each document has one name.  Equal names mean equal texts: a name
stands for one block or one pair of names, never for a hash value.

Block texts are shuffled once, combined before the shuffle.  Names find their way back to the blocks by a 64-bit hash of the
block; a hash value that belongs to several blocks is noticed, and those blocks are compared themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triledger.llm.tables import packed, saved

BLOCK_BYTES = 4096
ROW = ["doc_id", "sha"]


def _blocks(docs: DataFrame, text: str, doc_id: str, size: int, route: Callable[[str], Column]) -> DataFrame:
    """One row per block: doc_id, sha, n (blocks of the text), pos, block, h."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / size)).cast("int")
    # The outer transform binds the bytes once; cutting is then linear in the text.
    cut = F.transform(F.array("bytes"), lambda b: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * size + 1, F.lit(size))))
    rows = rows.select("doc_id", F.unhex(F.sha2("bytes", 256)).alias("sha"), n.alias("n"), F.get(cut, F.lit(0)).alias("cut"))
    return rows.select("doc_id", "sha", "n", F.posexplode("cut").alias("pos", "block")).withColumn("h", route("block"))


def _named(keys: DataFrame, order: list[str]) -> DataFrame:
    """Integer names for distinct keys, in sorted order within each partition."""
    return keys.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _place() -> Column:
    return F.xxhash64("doc_id", "sha", "pos")


def _first_names(blocks: DataFrame) -> DataFrame:
    """doc_id, sha, n, pos, copies, name of every block."""
    distinct = blocks.groupBy("block").agg(F.min("h").alias("h"), F.min(_place()).alias("example"))
    names = saved(_named(distinct, ["block"]).select("h", "name", "example"))
    shared = saved(names.groupBy("h").count().filter("count > 1").select("h"))
    keys = [*ROW, "n", "pos", "copies"]
    blocks = blocks.withColumn("copies", F.lit(1).cast("long"))
    if not shared.facts["rows"]:
        return blocks.select(*keys, "h").join(names.select("h", "name"), "h").select(*keys, "name")
    # Several blocks have one hash value: these alone are told apart by their bytes.
    spelled = (
        blocks.withColumn("example", _place())
        .join(names.join(shared, "h", "left_semi"), ["h", "example"]).select("h", "block", "name").distinct())
    plain = blocks.select(*keys, "h").join(shared, "h", "left_anti").join(names.select("h", "name"), "h")
    told = blocks.join(shared, "h", "left_semi").join(spelled, ["h", "block"])
    return plain.select(*keys, "name").unionByName(told.select(*keys, "name"))


def identities(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, block_bytes: int = BLOCK_BYTES,
    route: Callable[[str], Column] = F.xxhash64,
) -> DataFrame:
    """doc_id, sha (digest of the text, binary), copies, level and name: (level, name) is equal exactly for equal texts.

    A null text counts as empty.  Rows are told apart by (doc_id, text); repeated rows may share a row here, `copies` counts.
    """
    state = saved(_first_names(_blocks(docs, text, doc_id, block_bytes, route)), n=F.max("n"))
    level, done, most = 0, [], state.facts["n"] or 1
    while True:
        done.append(state.filter(f"n <= {2 ** level}").select(*ROW, "copies", F.lit(level).alias("level"), "name"))
        if most <= 2 ** level:
            break
        level += 1
        # A repeated row brings the same name to the same place; the maximum is that name.  -1 stands for no neighbour.
        pairs = saved(
            state.filter(f"n > {2 ** (level - 1)}").groupBy(*ROW, "n", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.sum(F.when(F.col("pos") % 2 == 0, F.col("copies"))).alias("copies")))
        names = saved(_named(pairs.select("a", "b").distinct(), ["a", "b"]))
        state = saved(pairs.join(names, ["a", "b"]).select(*ROW, "n", "pos", "copies", "name"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, block_bytes: int = BLOCK_BYTES,
                 route: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; of several equal rows with that id, one stays.  A null doc_id
    counts as the smallest.  Null and empty texts are equal.  No documents give no rows; other columns are not read.
    """
    rows = saved(identities(docs, text, doc_id, block_bytes=block_bytes, route=route)
                 .groupBy("level", "name", *ROW).agg(F.sum("copies").alias("copies")))
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    each = rows.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_groups(docs, text, doc_id).filter("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("keep_sha"))
    own = docs.select(F.col(doc_id).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha"), packed(docs))
    both = own.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("keep_sha")))
    # A repeated row is there several times; one of them stays.
    one = Window.partitionBy("id", "sha").orderBy(F.lit(0))
    return both.withColumn("copy", F.row_number().over(one)).filter("copy = 1").select("_doc.*")
