"""Jaccard join on word shingles with PartEnum signatures (Arasu, Ganti and Kaushik, "Efficient Exact Set-Similarity Joins").

Sets are grouped into bands of sizes; a set also enters the next band if a partner may be there.  Within a band the domain of
shingles is cut into `n1` partitions of `n2` parts; the signatures of a set are the contents of the subsets of n2 - k2 parts of
each partition.  Sets with a similarity of at least `percent` differ in at most k = (a + b)(100 - percent) / (100 + percent)
shingles, and a shingle is in few subsets; so all but that many signatures agree, and if each set keeps its first
k * subsets + t signatures in one common order, two such sets share t (or, where a set has fewer than that, as many fewer).  Signatures of frequent shingles only come last in that
order; which shingles are frequent is a matter of a sample, and changes the work but never the result.

Sets that share t signatures are candidates.  Their shingles are compared first with a central member of each signature group;
what is connected then needs no further comparison.  Members that are still apart are joined by the rarest of the shingles in
which they differ from the central one, and those that can be similar enough are compared whole: the components are exact.
Shingles are 64-bit hashes.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triledger.llm.tables import bitmap, may_contain, packed, partitions, release, saved
from triledger.operators.components import connected_components

WORDS, PERCENT = 5, 80
# Partitions per shingle of the largest set of a band, and at least; parts of a partition, and how many a subset leaves out.
SHARE, LEAST, N2, K2 = 0.35, 32, 1, 0
# t per shingle of the largest set of a band; at least one.
COMMON = 0.04
# Documents in the sample for frequent shingles, in how many of them a shingle must be, and how many shingles are taken.
SAMPLE, FREQUENT, FREQUENT_MOST = 4_000, 4, 100_000
SIGNATURES_PER_TASK = 2_000_000
PIECE = 4_000_000
BITS_MOST = 1 << 25
# How often members that share too few differences with others are left out, before the differences are joined.
ROUNDS = 2

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray, salt: np.uint64 = _A) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * salt
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _folded(words: list[np.ndarray]) -> np.ndarray:
    x = _mix(words[0])
    for w in words[1:]:
        x = _mix(x * _C + w)
    return x


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, one after the other, each sorted; and how many each text has.

    A-Z count as a-z; words are parted by ASCII white space; a text with fewer words is one shingle, one without words none.
    """
    split = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.empty(sizes.sum(), dtype=object)
    flat[:] = [w for s in split for w in s]
    hashes = pd.util.hash_array(flat, categorize=False).astype(np.uint64) if len(flat) else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    # Whole shingles begin where the row goes on for so many words.
    at = np.flatnonzero(np.arange(len(flat)) <= (begins + sizes - words)[row]) if len(flat) else np.empty(0, np.int64)
    found, owner = [_folded([hashes[at + j] for j in range(words)])] if len(at) else [np.empty(0, np.uint64)], [row[at]]
    for n in range(1, words):
        rows = np.flatnonzero(sizes == n)
        if len(rows):
            found.append(_mix(_folded([hashes[begins[rows] + j] for j in range(n)]) + np.uint64(n)))
            owner.append(rows)
    all_hashes, all_rows = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((all_hashes, all_rows))
    all_hashes, all_rows = all_hashes[order], all_rows[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (all_hashes[1:] != all_hashes[:-1]) | (all_rows[1:] != all_rows[:-1])
    return all_hashes[new], np.bincount(all_rows[new], minlength=len(texts)).astype(np.int64)


def _keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums per set that are equal for equal sets."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (_A, _C):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(hashes + salt, salt), dtype=np.uint64)])
        out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]


def signatures(hashes: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, *, percent: int = PERCENT, n2: int = N2, k2: int = K2,
               share: float = SHARE, least: int = LEAST, common: float = COMMON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets, one set after the other; how many each has; how many it shares with any partner at least.

    Two partners share at least the smaller one's number.
    """
    subsets = list(combinations(range(n2), n2 - k2))
    hit = comb(n2 - 1, n2 - k2 - 1)  # subsets that a shingle is in
    band = np.zeros(len(sizes), dtype=np.int64)
    band[sizes > 0] = np.floor(np.log2(sizes[sizes > 0])).astype(np.int64)
    largest = 100 * sizes // percent
    rare = np.ones(len(hashes), dtype=bool)
    if len(frequent) and len(hashes):
        place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rare = frequent[place] != hashes
    out, owner = [], []
    needs = np.full(len(sizes), np.iinfo(np.int64).max)
    for step in (0, 1):
        upper = (np.int64(2) << (band + step)) - 1
        chosen = (sizes > 0) & ((largest > upper // 2) | (step == 0))
        partner = np.minimum(largest, upper)
        differ = (sizes + partner) * (100 - percent) // (100 + percent)
        n1 = np.ceil(share * upper).astype(np.int64) + least
        pick = np.repeat(chosen, sizes)
        h, r = hashes[pick], np.repeat(np.arange(len(sizes)), sizes)[pick]
        if not len(h):
            continue
        # Sorted hashes are cut into ranges: the shingles of a part are neighbours.
        part = ((h >> np.uint64(32)) * (n1 * n2)[r].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (r[1:] != r[:-1])]))
        content = np.add.reduceat(_mix(h, _C), first)
        rares = np.add.reduceat(rare[pick].astype(np.int64), first)
        q, p, r = (part[first] % np.uint64(n2)).astype(np.int64), part[first] // np.uint64(n2), r[first]
        whole = np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])])
        group = np.cumsum(whole) - 1
        p, r = p[whole], r[whole]
        parts, any_rare, there = np.zeros((len(p), n2), np.uint64), np.zeros((len(p), n2), bool), np.zeros((len(p), n2), bool)
        parts[group, q], any_rare[group, q], there[group, q] = content, rares > 0, True
        sig, late, own = [], [], []
        for i, subset in enumerate(subsets):
            held = there[:, subset].any(axis=1)
            tag = (np.uint64(i) << np.uint64(8)) + (band + step)[r[held]].astype(np.uint64)
            total = parts[:, subset].sum(axis=1, dtype=np.uint64)[held]
            sig.append(_mix(total + _mix(p[held] * _C + tag)))
            late.append(~any_rare[:, subset].any(axis=1)[held])
            own.append(r[held])
        sig, late, own = np.concatenate(sig), np.concatenate(late), np.concatenate(own)
        order = np.lexsort((sig, late, own))
        sig, own = sig[order], own[order]
        counts = np.bincount(own, minlength=len(sizes))
        rank = np.arange(len(own)) - (np.cumsum(counts) - counts)[own]
        # One number for the band: then one partner that surely has so many in common with others is enough.
        asked = np.maximum(np.floor(common * upper).astype(np.int64), 1)
        needs = np.where(chosen, np.minimum(needs, np.clip(counts - differ * hit, 1, asked)), needs)
        kept = rank < (differ * hit + asked)[own]
        out.append(sig[kept])
        owner.append(own[kept])
        # Sets so small or so uneven that all their signatures may differ also meet each other.
        poor = np.flatnonzero(chosen & (counts <= differ * hit))
        out.append(_mix((band + step)[poor].astype(np.uint64) + _B))
        owner.append(poor)
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64), needs
    sig, own = np.concatenate(out), np.concatenate(owner)
    return sig[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(sizes)).astype(np.int64), needs


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of bytes, or one row."""
    for batch in batches:
        sizes = np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column("_text")], dtype=np.int64)
        piece = np.cumsum(sizes) // PIECE
        for begin, end in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.diff(piece, prepend=-1, append=-1))), strict=True):
            yield batch.slice(int(begin), int(end - begin))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values.view(np.int64)))


def _set_table(rows: DataFrame, frequent: np.ndarray | None, options: dict) -> DataFrame:
    """doc_id, n, hi, lo, need and the signatures of each row's set; without `frequent` its shingles instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            hashes, sizes = shingle_sets(batch.column("_text").to_pylist())
            hi, lo = _keys(hashes, sizes)
            values, counts, needs = (hashes, sizes, sizes) if frequent is None else signatures(hashes, sizes, frequent, **options)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(hi), pa.array(lo), pa.array(needs), _lists(values, counts)],
                names=["doc_id", "n", "hi", "lo", "need", "items"])

    return rows.select("doc_id", "_text").mapInArrow(run, "doc_id long, n long, hi long, lo long, need long, items array<long>")


def _frequent(rows: DataFrame) -> np.ndarray:
    """Shingles in many documents of a sample, at most FREQUENT_MOST."""
    every = max(1, rows.count() // SAMPLE)
    sample = _set_table(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), None, {})
    counts = sample.select(F.explode("items").alias("h")).groupBy("h").count().filter(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "h").limit(FREQUENT_MOST).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64))


def _shared(members: DataFrame) -> DataFrame:
    """Members (sig, lo) of the signatures that several sets have, each once; the input is sorted within partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), dtype=np.int64)  # the last row, whose group may go on
        told = False  # and whether it has been passed on
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in (0, 1)])], axis=1)
            new = np.ones(rows.shape[1], dtype=bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            rows = rows[:, new]
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.zeros(rows.shape[1], dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            out = keep.copy()
            if told and len(out):
                out[0] = False
            if rows.shape[1] > 1:
                told = bool(keep[-1])
            elif rows.shape[1]:
                told = told or bool(keep[-1])
            held = rows[:, -1:]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[0, out]), pa.array(rows[1, out])], names=["sig", "lo"])

    return members.mapInArrow(run, "sig long, lo long")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    met = _common(pairs, sets, "a", "b")
    return met.filter(_linked(percent)).select("a", "b").distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with the shingles of either side, `_a` and `_b`."""
    for name, items in ((a, "_a"), (b, "_b")):
        pairs = pairs.join(sets.select(F.col("rep").alias(name), F.col("items").alias(items)), name)
    return pairs


def _common(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with the sizes n and m of their sets and how many shingles they have in common."""
    met = _with_sets(pairs, sets, a, b)
    return met.select(*pairs.columns, F.size("_a").cast("long").alias("n"), F.size("_b").cast("long").alias("m"),
                      F.size(F.array_intersect("_a", "_b")).cast("long").alias("common"))


def _linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _often(single: DataFrame) -> DataFrame:
    """The differences h that members of several components have, and how many members have them."""
    often = single.groupBy("h").agg(F.count("*").alias("times"), F.min("c").alias("first"), F.max("c").alias("last"))
    return often.filter("first < last").select("h", "times")


def _reaching(single: DataFrame) -> DataFrame:
    """Differences (pivot, rep, c, least, h) that several components may have, of members with at least `least` of them.

    Two members that are linked have that many in common, so neither is left out.
    """
    often = saved(_often(single))
    bits = min(BITS_MOST, 1 << max(16, (16 * often.facts["rows"]).bit_length()))
    member = Window.partitionBy("pivot", "rep")
    there = single.filter(may_contain(bitmap(often, "h", bits), "h", bits)).withColumns(
        {"_there": F.count("*").over(member), "_least": F.min("least").over(member)})
    found = saved(there.filter("_there >= _least").select(*single.columns))
    release(often)
    return found


class _Candidates:
    """Sets by signature (sig, rep, n, need), and the links that have been found.

    Every signature has a pivot, the member that shares most signatures with others; the members of a pivot's signatures are its
    family.  Two sets that are similar enough share a signature, so one is the pivot or both are in the family.  All are
    compared with their pivots.  The rest is told by the differences to the pivot, x as the shingles that it and the pivot do not
    share: x and y differ in |dx| + |dy| - 2 |dx & dy| shingles, and may differ in (|x| + |y|)(100 - percent) / (100 + percent).
    What a crowd has in common is not in the differences, so what two members must share there is rare.
    """

    def __init__(self, groups: DataFrame, rows: DataFrame, percent: int):
        self.groups, self.percent = groups, percent
        spark = groups.sparkSession
        reps = saved(groups.select("rep").distinct())
        # Most texts share no signature: a bitmap of bounded size spares them the shuffle.
        bits = min(BITS_MOST, 1 << max(16, (32 * reps.facts["rows"]).bit_length()))
        some = rows.filter(may_contain(bitmap(reps, "rep", bits), "doc_id", bits)).join(reps, F.col("doc_id") == F.col("rep"))
        some = some.select("doc_id", "_text").repartition(partitions(spark, reps.facts["rows"], 20_000))
        self.sets = saved(_set_table(some, None, {}).select(F.col("doc_id").alias("rep"), "items"))
        release(reps)
        self.links: DataFrame | None = None

    def _found(self, links: DataFrame) -> int:
        found = saved(links)
        self.links = found if self.links is None else self.links.unionByName(found)
        return found.facts["rows"]

    def components(self) -> DataFrame:
        return connected_components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def families(self) -> DataFrame:
        """Each set with its pivots.

        Partners share at least either one's `need` of signatures.  A set leaves out the pivots of less than half as many, so two
        partners keep one of the pivots that they have in common.
        """
        weight = self.groups.groupBy("rep").agg(F.count("*").alias("w"))
        pivots = self.groups.join(weight, "rep").groupBy("sig").agg(F.max(F.struct("w", F.col("rep").alias("pivot"))).alias("p"))
        met = self.groups.join(pivots.select("sig", "p.pivot"), "sig").groupBy("rep", "pivot").agg(
            F.count("*").alias("times"), F.min("need").alias("need"))
        # A set has at most as many pivots as signatures.
        so_far = Window.partitionBy("rep").orderBy(F.col("rep") == F.col("pivot"), "times", "pivot").rowsBetween(Window.unboundedPreceding, 0)
        met = met.select("rep", "pivot", "need", F.sum("times").over(so_far).alias("told"))
        return met.filter("rep <> pivot and 2 * told > need - 1").select("rep", "pivot")

    def compare(self) -> DataFrame:
        """Compare all sets with their pivots: rep, pivot, their sizes n and m, common."""
        ties = saved(_common(self.families(), self.sets, "rep", "pivot"))
        self._found(ties.filter(_linked(self.percent)).select(*_ordered("rep", "pivot")).distinct())
        return ties

    def turn(self, salt: int) -> int:
        """Compare sets that are apart from most of their group with one other member of that part; how many new links there are."""
        placed = self.groups.join(self.components().withColumnsRenamed({"node": "rep", "root": "c"}), "rep", "left")
        placed = placed.select("sig", "rep", F.coalesce("c", "rep").alias("c"))
        counts = placed.groupBy("sig", "c").agg(
            F.count("*").alias("members"), F.max(F.struct(F.xxhash64("rep", F.lit(salt)).alias("h"), F.col("rep").alias("pivot"))).alias("p"))
        cores = counts.groupBy("sig").agg(F.max(F.struct("members", "c", "p")).alias("core")).select("sig", F.col("core.c").alias("core"), "core.p.pivot")
        pairs = placed.join(cores, "sig").filter("c <> core").select(*_ordered("rep", "pivot")).distinct()
        return self._found(_similar(pairs, self.sets, self.percent).join(self.links, ["a", "b"], "left_anti"))

    def differing(self, ties: DataFrame) -> None:
        """Compare the members of each family that are apart, where their differences to the pivot can have enough in common."""
        plus, minus = 100 + self.percent, 100 - self.percent
        placed = ties.join(self.components().withColumnsRenamed({"node": "rep", "root": "c"}), "rep", "left")
        size = F.col("n") + F.col("m") - 2 * F.col("common")
        # Members that are linked with the pivot are together already; of every two others, one is not.
        placed = placed.select("pivot", "rep", "n", "m", F.coalesce("c", "rep").alias("c"), (plus * size - minus * F.col("n")).alias("cost"))
        placed = placed.withColumn("outer", F.col("cost") > minus * F.col("m"))
        # x and y are linked if 2 * plus * |dx & dy| >= cost x + cost y: by the sizes alone a member shares at least `least`.
        least = F.when(F.col("outer"), (F.col("cost") - minus * F.col("m")) / (plus + minus)).otherwise(
            (F.col("cost") + minus * F.col("m")) / (2 * plus))
        placed = placed.withColumn("least", F.greatest(F.ceil(least), F.lit(1)))
        split = placed.groupBy("pivot").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.max("outer").alias("any"))
        members = saved(placed.join(split.filter("first < last and any").select("pivot"), "pivot"))
        sides = _with_sets(members.select("pivot", "rep", "c", "least"), self.sets, "rep", "pivot")
        differences = saved(sides.select("pivot", "rep", "c", "least", F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a")).alias("items")))
        # A number for a shingle in a family; if two had the same, there would be more to compare, not less.
        single = differences.select("pivot", "rep", "c", "least", F.explode("items").alias("h")).withColumn("h", F.xxhash64("pivot", "h"))
        stored = differences
        for _ in range(ROUNDS):
            single = _reaching(single)
            release(stored)
            stored = single
        often = saved(_often(single))
        met = single.join(often, "h")
        shared = met.groupBy("pivot", "rep").agg(F.array_sort(F.collect_list(F.struct("times", "h"))).alias("shared"))
        # A member shares no more than `shared`; so the `least` most frequent shingles but one can be left out.
        reach = 2 * plus * F.size("shared") - F.col("cost")
        heads = members.join(shared, ["pivot", "rep"]).withColumn("keep", F.size("shared") + 1 - F.col("least"))
        heads = saved(heads.filter("keep > 0").select(
            "rep", "n", "c", "cost", "outer", reach.alias("reach"),
            F.explode(F.slice("shared", F.lit(1), F.col("keep").cast("int"))["h"]).alias("h")))
        x, y = heads.filter("outer").alias("x"), heads.alias("y")
        meets = ((F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.cost") <= F.col("y.reach"))
                 & (F.col("y.cost") <= F.col("x.reach")) & (~F.col("y.outer") | (F.col("x.rep") < F.col("y.rep")))
                 & (100 * F.least("x.n", "y.n") >= self.percent * F.greatest("x.n", "y.n")))
        pairs = saved(x.join(y, meets).select(*_ordered("x.rep", "y.rep")).distinct())
        self._found(_similar(pairs, self.sets, self.percent))
        release(members, stored, often, heads, pairs)


def _sharing(groups: DataFrame) -> DataFrame:
    """Without the sets that share fewer signatures than partners do, and without groups of one."""
    for _ in range(2):
        enough = groups.groupBy("rep").agg(F.count("*").alias("times"), F.min("need").alias("need")).filter("times >= need").select("rep")
        groups = groups.join(enough, "rep", "left_semi")
        several = groups.groupBy("sig").count().filter("count > 1").select("sig")
        groups = saved(groups.join(several, "sig", "left_semi"))
    return groups


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, percent: int = PERCENT, n2: int = N2, k2: int = K2,
               share: float = SHARE, least: int = LEAST, common: float = COMMON, turns: int = 0) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows with equal ids are one document.  Null and empty texts have no shingles, link with nothing and are components of their
    own; a row without an id is a component without an id unless an equal set has one.  Other columns are not read.  `turns` are
    rounds that link sets with further members of their groups before; they change the work, never the result.
    """
    options = {"percent": percent, "n2": n2, "k2": k2, "share": share, "least": least, "common": common}
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    table = saved(_set_table(rows, _frequent(rows), options), signatures=F.sum(F.size("items")))
    key = ["n", "hi", "lo"]
    reps = saved(table.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("need").alias("need")))
    spread = partitions(docs.sparkSession, table.facts["signatures"] or 0, SIGNATURES_PER_TASK)
    members = table.select(F.explode("items").alias("sig"), "lo").repartition(spread, "sig").sortWithinPartitions("sig", "lo")
    shared = saved(_shared(members))
    # The signatures are not needed any more.
    narrow = saved(table.select("doc_id", *key))
    release(table)
    groups = _sharing(saved(shared.join(reps.filter("rep is not null"), "lo").select("sig", "rep", "n", "need").distinct()))
    release(shared)
    found = _Candidates(groups, rows, percent)
    ties = found.compare()
    for turn in range(turns):
        if not found.turn(turn):
            break
    release(groups)
    found.differing(ties)
    release(ties, found.sets)
    roots = found.components().withColumnsRenamed({"node": "rep", "root": "component_id"})
    whole = narrow.join(reps, key, "left").join(roots, "rep", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"),
                        F.coalesce("component_id", "rep", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The document with the smallest id of each component, with all its columns."""
    others = components(docs, text, doc_id).filter("component_id <> doc_id").select(F.col("doc_id").alias("dropped")).distinct()
    own = docs.select(F.col(doc_id).cast("long").alias("id"), packed(docs))
    return own.join(others, F.col("id") == F.col("dropped"), "left_anti").select("_doc.*")
