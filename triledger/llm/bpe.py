"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks that overlap.  Chunks are split into pre-tokens in parallel, each from its own first character.
The pattern never looks back, so from any boundary that a chunk shares with its left neighbour on, both see the same
boundaries: the text is cut at the first shared boundary of every overlap (not behind white space, where the pattern looks
ahead), and the pieces are encoded in parallel.  Decoding
concatenates the bytes of the ids.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triledger.llm.tables import saved

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK, OVERLAP = 32_768, 1_024


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def spelling(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    ranks = _ranks(path)
    spelled = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        spelled[i] = piece
    return spelled


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a rank file, and the bytes of each id."""
    encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    return encoder, spelling(path)


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str) -> list[int]:
    """Where pre-tokens begin, from the first character on."""
    return [m.start() for m in _pattern().finditer(text)]


def _ids(texts, path: str) -> pa.Array:
    encoder = vocabulary(path)[0]
    parts = [encoder.encode_to_numpy(t, disallowed_special=()) for t in texts]
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(ends, values)


def _encoded(rows: DataFrame, keep: list[str], path: str) -> DataFrame:
    """`keep` and the ids of `_text`, which is encoded whole."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Long rows in few batches of bounded size.
            size = max(1, int(len(batch) * 4e6 // max(1, batch.column("_text").nbytes)))
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                ids = _ids((t or "" for t in part.column("_text").to_pylist()), path)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], names=[*keep, "ids"])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return rows.select(*keep, "_text").mapInArrow(encode, schema)


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """_row, _chunk, _start and _piece: the text of each chunk and of the overlap behind it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                starts = list(range(0, len(text), chunk))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int64()),
                     pa.array([text[s:s + chunk + overlap] for s in starts], pa.string())], names=["_row", "_chunk", "_start", "_piece"])

    return rows.select("_row", "_text").mapInArrow(cut, "_row long, _chunk int, _start long, _piece string")


def _seams(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The boundaries that each chunk sees in the overlap at its head and in the one at its tail."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            heads, tails = [], []
            for start, piece in zip(batch.column("_start").to_pylist(), batch.column("_piece").to_pylist(), strict=True):
                seen = boundaries(piece)
                heads.append([start + b for b in seen if b < overlap])
                # Behind white space a piece would end otherwise than the text goes on: the pattern looks ahead there.
                tails.append([start + b for b in seen if b >= chunk and not piece[b - 1].isspace()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_chunk"), pa.array(heads, kind), pa.array(tails, kind)],
                names=["_row", "_chunk", "_head", "_tail"])

    return chunks.select("_row", "_chunk", "_start", "_piece").mapInArrow(look, "_row long, _chunk int, _head array<long>, _tail array<long>")


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), *, path: str = RANKS,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns `keep` of every document and `ids` (array<int>), as the rank file's encoder gives for the whole text.

    Null and empty texts get an empty array; repeated rows stay; columns outside `keep` are not read.  `keep` must not name
    `ids`.  If the chunks on both sides of an overlap share no boundary (one pre-token is longer than the overlap), the
    document is encoded in one piece.
    """
    keep = list(keep)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    long = F.char_length("_text") > chunk
    short = _encoded(rows.filter(long.isNull() | ~long), keep, path)
    # Written once, so that the row numbers hold.
    rows = saved(rows.filter(long).withColumn("_row", F.monotonically_increasing_id()))
    if not rows.facts["rows"]:
        return short
    # Chunks of one text are dealt out to many tasks.
    chunks = saved(_chunks(rows, chunk, overlap).repartition("_row", "_chunk"))
    order = Window.partitionBy("_row").orderBy("_chunk")
    whole = Window.partitionBy("_row")
    seam = F.array_min(F.array_intersect("_tail", F.lead("_head").over(order)))
    seams = (
        _seams(chunks, chunk, overlap).withColumn("_to", seam).withColumn("_from", F.lag("_to").over(order))
        .withColumn("_loose", F.count("*").over(whole) - F.count("_to").over(whole) > 1)
        .select("_row", "_chunk", "_from", "_to", "_loose"))
    seams = saved(seams)
    begin = F.coalesce(F.col("_from"), F.col("_start")) - F.col("_start")
    end = F.coalesce(F.col("_to") - F.col("_start"), F.char_length("_piece"))
    pieces = chunks.join(seams.filter("not _loose"), ["_row", "_chunk"]).select(
        "_row", "_chunk", F.substring("_piece", begin.cast("int") + 1, (end - begin).cast("int")).alias("_text"))
    joined = (
        _encoded(pieces, ["_row", "_chunk"], path).groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("_chunk", "ids"))).alias("p"))
        .select("_row", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))
    stitched = rows.select("_row", *keep).join(joined, "_row").select(*keep, "ids")
    loose = rows.join(seams.filter("_loose").select("_row").distinct(), "_row")
    return short.unionByName(stitched).unionByName(_encoded(loose, keep, path))


def decode(rows: DataFrame, ids: str = "ids", into: str = "bytes", *, path: str = RANKS) -> DataFrame:
    """All columns and the bytes of the ids, concatenated; null ids give no bytes, an unknown id is an error."""
    def spell(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spelled = spelling(path)
        for series in column:
            yield series.map(lambda row: b"" if row is None else b"".join(map(spelled.__getitem__, row.tolist())))

    return rows.withColumn(into, F.pandas_udf(spell, "binary")(F.col(ids)))
