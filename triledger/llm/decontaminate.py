"""Passages of benchmark items in documents, found by an Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, words parted by anything in ASCII that is neither letter nor digit.  The
windows of an item are its runs of so many words, or all its words where it has fewer.  The automaton holds the windows of all
items, each with a blank at both ends; a document's words, joined by blanks, run through it once, and the ends of what it finds
are mapped back to words and to characters of the original text.

The automaton is built in every worker from a broadcast of at most `shard_bytes` of windows.  Where the windows of all items are
larger, they are cut into several by a hash, and the documents are scanned once for each; the finds are then put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.llm.tables import saved

WINDOW = 10
SHARD_BYTES = 2 << 20
KEPT = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(0x80, 0x100))
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in KEPT else 32 for c in range(256))

FOUND = "n_words long, spans array<struct<first:long,last:long,begin:long,end:long>>, items array<string>"


def normalised(text: str | None) -> bytes:
    """The text's bytes, letters in lower case and everything between words blank; no byte moves."""
    return (text or "").encode().translate(_NORMAL)


def windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, pattern of every window.  An item without words has none; a null id is an item with an empty name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, patterns = [], []
            for name, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normalised(said).split()
                for i in range(min(len(words), max(1, len(words) - window + 1))):
                    names.append(name)
                    patterns.append(b" " + b" ".join(words[i:i + window]) + b" ")
                    if len(words) <= window:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(patterns, pa.binary())], names=["item", "pattern"])

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, pattern binary").distinct()


class Automaton:
    """The windows with their lengths in words and the items that have them."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        held: dict[bytes, list[str]] = {}
        for item, pattern in rows:
            held.setdefault(pattern, []).append(item)
        self.items = list(held.values())
        self.words = np.array([p.count(b" ") - 1 for p in held], dtype=np.int64)
        # Bytes go in as characters of the same number.
        self.automaton = ahocorasick.Automaton()
        for i, pattern in enumerate(held):
            self.automaton.add_word(pattern.decode("latin-1"), i)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Number of words, runs of hit words (first and last word, begin and end in characters), and the items found, sorted."""
        raw = normalised(text)
        words = raw.split()
        if not words or not self.items:
            return len(words), [], []
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), [], []
        ends, which = np.array(found, dtype=np.int64).T
        # The blank behind word j is the end of all windows that end with it.
        last = np.searchsorted(np.cumsum([len(w) + 1 for w in words]), ends)
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(depth, last - self.words[which] + 1, 1)
        np.add.at(depth, last + 1, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth)[:-1] > 0).astype(np.int8), [0]])))
        first, behind = edges[::2], edges[1::2]
        held = np.frombuffer(raw, np.uint8) != 32
        change = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
        # Bytes before a place, without those that go on a character, are its characters.
        characters = np.concatenate([[0], np.cumsum((np.frombuffer((text or "").encode(), np.uint8) & 0xC0) != 0x80)])
        begin, end = characters[change[::2][first]], characters[change[1::2][behind - 1]]
        items = sorted({item for i in np.unique(which) for item in self.items[i]})
        return len(words), list(zip(*(x.tolist() for x in (first, behind - 1, begin, end)), strict=True)), items


def _scanned(rows: DataFrame, keep: list[str], patterns, only_hits: bool) -> DataFrame:
    """`keep` and what the automaton finds in `_text`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns.value)
        span = pa.struct([(n, pa.int64()) for n in ("first", "last", "begin", "end")])
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("_text"):
                n, where, what = automaton.scan(text.as_py())
                counts.append(n)
                spans.append([dict(zip(("first", "last", "begin", "end"), s, strict=True)) for s in where])
                items.append(what)
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)),
                 pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(i) for i in items])) if only_hits else out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.select(*keep, "_text").mapInArrow(run, f"{kept}, {FOUND}")


def _merged(spans: Column) -> Column:
    """Runs of words that overlap or touch as one."""
    kind = "array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>"

    def add(done, span):
        before = F.element_at(done, -1)
        longer = F.when(span["last"] > before["last"], span).otherwise(before)
        joined = F.struct(before["first"].alias("first"), longer["last"].alias("last"), before["begin"].alias("begin"), longer["end"].alias("end"))
        touches = (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def scan(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
         item_text: str = "text", *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans (runs of hit words: first and last word, begin and end in characters of the
    text) and items (names of the items with a window there, sorted as text).

    Null texts and texts without words have no words and no finds.  Rows of one item id are one item with the windows of all;
    equal windows of several items count for each.  Repeated rows stay.  No items, no finds; no documents, no rows.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    patterns = saved(windows(items, item_id, item_text, window), bytes=F.sum(F.octet_length("pattern") + F.octet_length("item")))
    shards = max(1, -(-(patterns.facts["bytes"] or 0) // shard_bytes))

    def shard(i: int):
        # At most about `shard_bytes` come to the driver at once.
        part = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == i).orderBy("pattern", "item").toArrow()
        return spark.sparkContext.broadcast(list(zip(part["item"].to_pylist(), part["pattern"].to_pylist(), strict=True)))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    if shards == 1:
        return _scanned(rows, ["doc_id"], shard(0), False)
    rows = rows.withColumn("_sha", F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256))
    keep, found = ["doc_id", "_sha"], []
    for i in range(1, shards):
        part = shard(i)
        found.append(saved(_scanned(rows, keep, part, True)))
        part.unpersist()
    every = _scanned(rows, keep, shard(0), False)
    # What one document has in the other shards; repeated rows bring the same.
    more = reduce(DataFrame.unionByName, found).groupBy(*keep).agg(
        F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
    more = more.withColumnsRenamed({c: f"more_{c}" for c in keep})
    same = F.col("doc_id").eqNullSafe(F.col("more_doc_id")) & (F.col("_sha") == F.col("more__sha"))
    none = F.array()
    return every.join(more, same, "left").select(
        "doc_id", "n_words",
        _merged(F.concat("spans", F.coalesce("more_spans", none.cast("array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>")))).alias("spans"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", none.cast("array<string>"))))).alias("items"))


def judged(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of what `scan` found."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def without_hits(text: Column, spans: Column) -> Column:
    """The text without the passages found."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    begins = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.char_length(text).cast("long")))
    return F.array_join(F.zip_with(ends, begins, lambda e, b: F.substring(text, (e + 1).cast("int"), (b - e).cast("int"))), "")
