"""Phrases that occur together oftener than their parts suggest, by sorted count streams.

A phrase can only be frequent if the one without its last word and the one without its first word are.  So phrases are counted
length by length, by hashes first, only where a bitmap of the frequent shorter ones lets both through; in the end those that all
bitmaps let through are counted themselves.  The bitmaps are bounded: a full one spares less counting, but never loses a phrase.

The counts of all lengths then make one stream in prefix order and one in suffix order (words reversed).  In prefix order a
phrase stands behind all its beginnings and before all its extensions to the right, so one pass that holds the last count of
each length yields the counts of its beginnings and the largest count of an extension; in suffix order, of its ends and of the
extensions to the left.  A stream is cut into ranges at sampled borders, and the beginnings of the phrase at a border are sent
along into each range that holds extensions of theirs.  Nothing is looked up by a hash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triledger.llm.tables import partitions, release, saved

LONGEST, FREQUENT, TOP = 4, 30, 2_000
# An extension with this percentage of a phrase's count makes the phrase part of it.
PART = 80
SCALE = 2_000_000
UNKNOWN = "und"
# Bytes of text that a task counts before it hands counts on.
PIECE = 16 << 20
BATCH = 100_000
BITS_MOST = 1 << 27
# Phrases in one range of a stream, and sampled phrases a range for its borders; ranges at most.
RANGE, SAMPLED, RANGES_MOST = 200_000, 32, 4_096

_NORMAL = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _escaped(word: bytes) -> bytes:
    """Zero parts the words of a phrase and sorts before all else, so zero and one are spelled with two bytes inside words."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of the texts in order, and the number of the piece that it is in."""
    data = b"\n".join((t or "").encode() for t in texts).translate(_NORMAL)
    b = np.frombuffer(data, np.uint8)
    held = (b != 32) & (b != 10)
    change = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
    begins, ends = change[::2], change[1::2]
    piece = np.cumsum(b == 10, dtype=np.int32)[begins] if len(b) else np.empty(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b[held]))])
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if len(b) and b.min() <= 1:
        distinct = [_escaped(w) for w in distinct]
    return pa.array(distinct, pa.large_binary()), coded.indices.to_numpy().astype(np.int64), piece


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value comes first, and how often it comes."""
    number, distinct = pd.factorize(values)
    first = np.empty(len(distinct), dtype=np.int64)
    first[number[::-1]] = np.arange(len(values) - 1, -1, -1)
    return first, np.bincount(number, minlength=len(distinct))


def levels(distinct: pa.Array, code: np.ndarray, piece: np.ndarray, lang: str, known: list[np.ndarray], longest: int,
           exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of words, where the phrases begin that `known` lets through, their hashes, and a key of each distinct one.

    `known` are the bitmaps of the frequent phrases of one word, two words and so on.  Keys are made if `exact`.
    """
    spelled = np.empty(len(distinct), dtype=object)
    spelled[:] = distinct.to_pylist()
    salt = pd.util.hash_array(np.array([lang], dtype=object), categorize=False).astype(np.uint64)[0]
    own = _mix(pd.util.hash_array(spelled, categorize=False).astype(np.uint64) ^ salt)
    at, key, hashes = np.arange(len(code)), code, own[code]
    yield at, hashes, key
    for n in range(2, longest + 1):
        frequent = _held(known[n - 2], hashes)
        place = np.full(len(code) + 1, -1, dtype=np.int64)
        place[at[frequent]] = np.flatnonzero(frequent)
        # The phrase without its last word begins here, the one without its first word a word later.
        at = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
        at = at[at + n <= len(code)]
        at = at[piece[at] == piece[at + n - 1]]
        shorter, last = place[at], code[at + n - 1]
        hashes = _mix(hashes[shorter] * _B + own[last])
        if exact:
            # Keys stay small: distinct phrases are numbered before the next word joins.
            key = (pd.factorize(key[shorter])[0] if n > 2 else key[shorter]) * len(distinct) + last
        yield at, hashes, key


def hashed_phrases(texts: list[str | None], lang: str, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the phrases that are longer by a word than those of the last bitmap."""
    distinct, code, piece = words_of(texts)
    if not len(code):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    for _, hashes, _ in levels(distinct, code, piece, lang, known, len(known) + 1, False):
        pass
    first, counts = _unique(hashes)
    return hashes[first], counts


def phrases_of(texts: list[str | None], lang: str, known: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Number of words, phrases and counts of what the bitmaps let through; phrases longer than those of the last one unjudged.

    With 0 words come no phrase and the number of all words.
    """
    distinct, code, piece = words_of(texts)
    if not len(code):
        return
    yield 0, pa.nulls(1, pa.large_binary()), np.array([len(code)])
    for n, (at, hashes, key) in enumerate(levels(distinct, code, piece, lang, known, len(known) + 1, True), 1):
        if n <= len(known):
            frequent = _held(known[n - 1], hashes)
            at, key = at[frequent], key[frequent]
        if len(at):
            first, counts = _unique(key)
            words = [distinct.take(pa.array(code[at[first] + j])) for j in range(n)]
            yield n, words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(b"\x00", pa.large_binary())), counts


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str | None]]]:
    """Texts of one language, in pieces of a bounded size."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column("_text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text or "") + 1
            if size >= PIECE:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _hash_counts(rows: DataFrame, known) -> DataFrame:
    """h and f of the phrases longer by a word than the bitmaps', counted piece by piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [k.value for k in known]
        for lang, texts in _by_language(batches):
            hashes, counts = hashed_phrases(texts, lang, bits)
            for i in range(0, len(hashes), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[i:i + BATCH].view(np.int64)), pa.array(counts[i:i + BATCH])], names=["h", "f"])

    return rows.mapInArrow(run, "h long, f long")


def _phrase_counts(rows: DataFrame, known) -> DataFrame:
    """lang, size, phrase (null for all words of the language) and f, counted piece by piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [k.value for k in known]
        for lang, texts in _by_language(batches):
            for size, phrases, counts in phrases_of(texts, lang, bits):
                for i in range(0, len(phrases), BATCH):
                    part = phrases.slice(i, BATCH).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array([size] * len(part), pa.int32()), part, pa.array(counts[i:i + BATCH])],
                        names=["lang", "size", "phrase", "f"])

    return rows.mapInArrow(run, "lang string, size int, phrase string, f long")


def _bitmap(frequent: DataFrame, rows: int) -> np.ndarray:
    """Bits of the hashes; its size is bounded by BITS_MOST, whatever the input."""
    bits = min(BITS_MOST, 1 << max(12, (16 * rows).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = frequent.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", *, longest: int = LONGEST,
                     least: int = FREQUENT) -> tuple[DataFrame, DataFrame, int]:
    """The phrases with at least `least` occurrences (lang, phrase, size, f), words parted by zero; the words of each lang; rows."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("_text"))
    known = []
    for _ in range(longest - 1):
        # Phrases that share a hash are counted together here, which lets through too much, never too little.
        often = saved(_hash_counts(rows, known).groupBy("h").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("h"))
        known.append(spark.sparkContext.broadcast(_bitmap(often, often.facts["rows"])))
        release(often)
    counts = _phrase_counts(rows, known).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    found = saved(counts.filter((F.col("size") == 0) | (F.col("f") >= least)).select("lang", "phrase", "size", "f"))
    for bits in known:
        bits.unpersist()
    # One row a language has the number of its words.
    return found.filter("size > 0"), found.filter("size = 0").select("lang", F.col("f").alias("n")), found.facts["rows"]


def _ranges(stream: DataFrame, rows: int, each: int) -> list[tuple[bytes, bytes]]:
    """Borders (lang, key) that cut the stream into ranges of about as many rows; at most RANGES_MOST."""
    n = min(RANGES_MOST, -(-rows // each))
    if n < 2:
        return []
    every = max(1, rows // (n * SAMPLED))
    # A bounded number of phrases for each range, and as many at every run.
    sample = stream.filter(F.pmod(F.xxhash64("lang", "key"), F.lit(every)) == 0).orderBy("lang", "key").select("lang", "key").toArrow()
    drawn = list(zip(*(sample[c].cast(pa.binary()).to_pylist() for c in ("lang", "key")), strict=True))
    return sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []


def _placed(stream: DataFrame, borders: list[tuple[bytes, bytes]], longest: int) -> DataFrame:
    """The stream with its ranges; a phrase is also in each later range that begins inside its extensions (then not `own`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, part, own = [], [], []
            langs, keys = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "key"))
            for i, (lang, key) in enumerate(zip(langs, keys, strict=True)):
                at = bisect_right(borders, (lang, key))
                # Keys that go on with another word; zero comes before all else, one behind it.
                begin, end = bisect_left(borders, (lang, key + b"\x00")), bisect_left(borders, (lang, key + b"\x01"))
                for p in (at, *range(begin + 1, end + 1)):
                    row.append(i)
                    part.append(p)
                    own.append(p == at)
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int32()), pa.array(own)], names=[*batch.schema.names, "part", "own"])

    if not borders:
        return stream.withColumns({"part": F.lit(0), "own": F.lit(True)})
    return stream.mapInArrow(run, "lang string, key string, size int, f long, part int, own boolean")


def _passed(stream: DataFrame, longest: int) -> DataFrame:
    """lang, key, own, size, f, the counts p1, p2, ... of the phrase's beginnings and the largest count ext of an extension.

    The input is sorted by (part, lang, key) within partitions.  A phrase whose extensions go on in another batch comes again
    (not `own`) with the largest count there.
    """
    shorter = range(1, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if not n:
                continue
            size, f, part = (batch.column(c).to_numpy() for c in ("size", "f", "part"))
            at = np.arange(n)
            last = {k: np.maximum.accumulate(np.where(size == k, at, -1)) for k in shorter}
            before = [np.where((size > k) & (last[k] >= 0), f[np.maximum(last[k], 0)], 0) for k in shorter]
            ext = np.zeros(n, dtype=np.int64)
            for k in shorter:
                mine = np.flatnonzero(size == k)
                if len(mine):
                    # Longer phrases up to the next one of this size are behind this one.
                    most = np.maximum.reduceat(np.where(size == k + 1, f, 0), mine)
                    # Shorter phrases in between end them too, but then no phrase of k + 1 words comes before the next of k.
                    ext[mine] = most
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("key"), batch.column("own"), batch.column("size"), batch.column("f"),
                 *[pa.array(b, pa.int64()) for b in before], pa.array(ext)],
                names=["lang", "key", "own", "size", "f", *[f"p{k}" for k in shorter], "ext"])
            # The phrases that the next row may extend: the last of each size, each behind the shorter one.
            still, least = [], -1
            for k in shorter:
                i = int(last[k][-1])
                if i < 0 or i <= least:
                    break
                still.append(i)
                least = i
            rest = batch.take(pa.array(still, pa.int64()))
            own = batch.schema.get_field_index("own")
            held = rest.set_column(own, batch.schema.field(own), pa.array([False] * len(still)))

    kinds = ", ".join(f"p{k} long" for k in shorter)
    return stream.mapInArrow(run, f"lang string, key string, own boolean, size int, f long, {kinds}, ext long")


def _pass(stream: DataFrame, rows: int, longest: int, each: int) -> DataFrame:
    spark = stream.sparkSession
    borders = _ranges(stream, rows, each)
    placed = _placed(stream, borders, longest)
    n = len(borders) + 1
    spread = placed.repartition(n, "part") if n > 1 else placed.repartition(partitions(spark, 1, 1), "part")
    return _passed(spread.sortWithinPartitions("part", "lang", "key"), longest)


def _reversed(column: str) -> Column:
    return F.array_join(F.reverse(F.split(column, "\\x00")), "\x00")


def scored(docs: DataFrame, text: str = "text", lang: str = "lang", *, longest: int = LONGEST, least: int = FREQUENT,
           part: int = PART, each: int = RANGE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every frequent phrase of 2 or more words that is not part of a longer one.

    Words are parted by blanks and tabs, and phrases by .,;:!? and line ends; A-Z count as a-z.  `a` counts the phrase, `l` and
    `r` the two parts of the cut with the lowest score floor(2000000 a / (l + r)), the earliest of equal ones; `n` counts the
    words of the language.  A phrase is left out if a longer frequent one that holds it has at least `part` percent of its
    count; as a longer phrase is never more frequent than what it holds, that is so exactly if one longer by a word has.
    A null language is `und`; null and empty texts have no words; repeated rows count each; no documents give no rows.
    """
    phrases, totals, rows = frequent_phrases(docs, text, lang, longest=longest, least=least)
    prefix = phrases.select("lang", F.col("phrase").alias("key"), "size", "f")
    suffix = phrases.select("lang", _reversed("phrase").alias("key"), "size", "f")
    shorter = range(1, longest)
    mine = F.col("own")
    left = _pass(prefix, rows, longest, each).select(
        "lang", F.col("key").alias("phrase"), "size", "f", "ext", *[F.when(mine, F.col(f"p{k}")).alias(f"l{k}") for k in shorter],
        *[F.lit(None).cast("long").alias(f"r{k}") for k in shorter])
    right = _pass(suffix, rows, longest, each).select(
        "lang", _reversed("key").alias("phrase"), "size", "f", "ext", *[F.lit(None).cast("long").alias(f"l{k}") for k in shorter],
        *[F.when(mine, F.col(f"p{k}")).alias(f"r{k}") for k in shorter])
    both = left.unionByName(right).filter("size > 1").groupBy("lang", "phrase", "size", "f").agg(
        F.max("ext").alias("ext"), *[F.max(f"{s}{k}").alias(f"{s}{k}") for s in "lr" for k in shorter])
    a = F.col("f").cast("decimal(38,0)")
    both = both.filter(F.col("ext").cast("decimal(38,0)") * 100 < a * part)
    cuts = []
    for k in shorter:
        # The rest of a phrase of `size` words behind its first k.
        rest = F.coalesce(*[F.when(F.col("size") == k + j, F.col(f"r{j}")) for j in shorter])
        score = F.expr(f"cast((cast(f as decimal(19,0)) * {SCALE}) div (cast(l{k} as decimal(19,0)) + cast(_rest{k} as decimal(19,0))) as bigint)")
        both = both.withColumn(f"_rest{k}", rest)
        cuts.append(F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"_rest{k}").alias("r"))))
    both = both.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    plain = F.regexp_replace(F.regexp_replace(F.replace(F.col("phrase"), F.lit("\x00"), F.lit(" ")), "\\x01\\x01", "\x00"), "\\x01\\x02", "\x01")
    # The totals have one row a language.
    return both.join(F.broadcast(totals), "lang").select(
        "lang", plain.alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))


def top(phrases: DataFrame, most: int = TOP) -> DataFrame:
    """The first phrases of each language by score, count (both descending) and phrase, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
