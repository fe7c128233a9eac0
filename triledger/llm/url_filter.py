"""URL rules, and exact membership of listed keys by a cascade of Bloom filters.

Level 0 of the cascade encodes the listed keys; level 1 the unlisted keys of the corpus that level 0 lets through by mistake;
level 2 the listed keys that level 1 lets through, and so on until nothing passes by mistake.  The first level that a key fails
tells what it is, exactly, for every key of the corpus and of the list.

The cascade is a scalar of a known size.  Where it would outgrow `broadcast_bytes`, keys and filters are cut into shards by the
hash of the key, and each key meets the filters of its shard only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.llm.tables import saved

BITS_PER_KEY, HASHES = 10, 7
BROADCAST_BYTES = 32 << 20
# The share of other keys that a level lets through, and a little more.
MISTAKES = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host after the first :// with A-Z in lower case, and path; both empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[tuple[str, str, str]], host: str, path: str) -> tuple[Column, Column]:
    """Name and verdict of the longest (verdict, host, path) rule that fits the host or a parent of it, and the path's start."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit(f".{h}"))) & F.startswith(F.col(path), F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


class Cascade:
    """Filters by level and shard; `contains` adds a Boolean column to any rows with a key."""

    def __init__(self, levels: list[DataFrame], bits: list[int], shards: int):
        self.levels, self.bits, self.shards = levels, bits, shards

    def contains(self, rows: DataFrame, key: str, into: str) -> DataFrame:
        """Exact for keys of the list and of the universe; a null key is in no list."""
        if self.shards == 1:
            words = [level.select("words").scalar() for level in self.levels]
            return rows.withColumn(into, F.col(key).isNotNull() & self._verdict(words, key))
        filters = reduce(lambda a, b: a.join(b, "_shard"), (
            level.select(F.col("shard").alias("_shard"), F.col("words").alias(f"_w{i}")) for i, level in enumerate(self.levels)))
        # A null key goes anywhere; a busy shard is split by the adaptive join.
        met = rows.withColumn("_shard", _shard(key, self.shards)).join(filters, "_shard", "left")
        said = F.col(key).isNotNull() & self._verdict([F.col(f"_w{i}") for i in range(len(self.levels))], key)
        return met.withColumn(into, said).select(*rows.columns, into)

    def _verdict(self, words: list[Column], key: str) -> Column:
        said = F.lit(len(words) % 2 == 1)
        for i in reversed(range(len(words))):
            said = F.when(passes(words[i], key, i, self.bits[i]), said).otherwise(F.lit(i % 2 == 1))
        return said


def _shard(key: str, shards: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)), F.lit(0)).cast("int")


def _places(key: str, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(bits)) for i in range(HASHES)]


def passes(words: Column, key: str, level: int, bits: int) -> Column:
    held = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
            for p in _places(key, level, bits)]
    return reduce(lambda a, b: a & b, held)


def _level(keys: DataFrame, level: int, bits: int, shards: int) -> DataFrame:
    """One row per shard with the words of its filter; a row's size is bits / 8 bytes."""
    place = keys.select(_shard("key", shards).alias("shard"), F.explode(F.array(*_places("key", level, bits))).alias("p"))
    words = place.select("shard", F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    zeros = keys.sparkSession.range(shards * (bits // 64)).select(
        F.expr(f"cast(id div {bits // 64} as int)").alias("shard"), F.expr(f"id % {bits // 64}").alias("w"), F.lit(0).cast("long").alias("b"))
    whole = words.unionByName(zeros).groupBy("shard", "w").agg(F.bit_or("b").alias("b"))
    return whole.groupBy("shard").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def cascade(universe: DataFrame, listed: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES, least_shards: int = 1) -> Cascade:
    """The cascade for the keys `key` of the corpus and of the list; null keys and repetitions do not matter."""
    both = universe.select("key", F.lit(0).alias("l")).unionByName(listed.select("key", F.lit(1).alias("l")))
    alive = both.filter("key is not null").groupBy("key").agg((F.max("l") == 1).alias("listed"))
    alive = saved(alive, listed=F.sum(F.col("listed").cast("long")))
    total = alive.facts["listed"] or 0
    # The larger one of what the first two levels encode: the list, and the mistakes expected among all other keys.
    expected = max(total, int(MISTAKES * (alive.facts["rows"] - total)))
    shards = max(least_shards, -(-expected * BITS_PER_KEY // (8 * broadcast_bytes)))
    levels, bits = [], []
    while True:
        i = len(levels)
        listed_left = alive.facts["listed"] or 0
        encoded = listed_left if i % 2 == 0 else alive.facts["rows"] - listed_left
        bits.append(64 * max(1, -(-encoded * BITS_PER_KEY // (64 * shards))))
        if bits[i] > 8 * max(8, broadcast_bytes):
            # More mistakes than expected: no level may be larger, so all begins again with more shards.
            return cascade(universe, listed, broadcast_bytes=broadcast_bytes, least_shards=-(-encoded * BITS_PER_KEY // (8 * broadcast_bytes)))
        levels.append(saved(_level(alive.filter("listed" if i % 2 == 0 else "not listed"), i, bits[i], shards)))
        # Keys that the new level lets through: all that it encodes, and mistakes.
        if shards == 1:
            through = alive.filter(passes(levels[i].select("words").scalar(), "key", i, bits[i]))
        else:
            filters = levels[i].select(F.col("shard").alias("_shard"), "words")
            through = alive.withColumn("_shard", _shard("key", shards)).join(filters, "_shard").filter(
                passes(F.col("words"), "key", i, bits[i])).select("key", "listed")
        alive = saved(through, listed=F.sum(F.col("listed").cast("long")))
        if alive.facts["rows"] == encoded:
            return Cascade(levels, bits, shards)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",),
          *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`keep`, host, path, rule and verdict of every row: the longest rule's verdict, else block for hosts in `listed` (`key`).

    An empty host fits no rule and is in no list.  Repeated rows stay; columns outside `keep` are not read; no pages, no rows.
    """
    rows = pages.select(*keep, F.col(url).alias("_url"))
    host, path = host_and_path("_url")
    rows = rows.select(*keep, host.alias("host"), path.alias("path"))
    known = cascade(rows.select(F.col("host").alias("key")).distinct(), listed, broadcast_bytes=broadcast_bytes)
    name, said = longest_rule(rules, "host", "path")
    rows = known.contains(rows, "host", "_listed")
    return rows.select(*keep, "host", "path", name.alias("rule"),
                       F.coalesce(said, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))
