"""Conversations as training text with a loss mask by token offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the assistant's turns are placed among the
token spans by binary search.  Control strings are added tokens, so no token reaches across the edge of a turn.

    <s>[INST]role[/INST]text</s>

Inside roles and texts a backslash is doubled and a control string gets a backslash behind its first character; `unescape`
takes both back.  A conversation beyond PART characters is rendered in several parts, cut between turns, where the control
strings part the tokens anyway: its tokens are the same, and no conversation has to fit in memory.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, decoders, pre_tokenizers

from triledger.llm.tables import partitions

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BEGIN, ROLE, TEXT, END = CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
PART = 1_000_000
LEARNED = "assistant"

_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    known = Tokenizer.from_file(path)
    known.encode_special_tokens = False
    # Offsets cover every character, blanks before words too.
    known.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    known.decoder = decoders.ByteLevel()
    known.post_processor = None
    known.add_tokens([AddedToken(c, normalized=False, special=False) for c in CONTROL])
    return known


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[int], list[int]]:
    """The text of the turns, and where the learned texts begin and end in it."""
    parts, begins, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{ROLE}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        if role == learned:
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        at += len(head) + len(body) + len(END)
    return "".join(parts), begins, ends


def masked(text: str, begins: list[int], ends: list[int], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the text, and which of them lie in the spans."""
    encoded = tokenizer(path).encode(text, add_special_tokens=False)
    offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
    # Spans and tokens are sorted: the first token that ends behind a span's begin, the first that begins at its end.
    first = np.searchsorted(offsets[:, 1], begins, side="right")
    last = np.searchsorted(offsets[:, 0], ends, side="left")
    edges = np.zeros(len(offsets) + 1, dtype=np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, np.maximum(first, last), -1)
    return np.array(encoded.ids, dtype=np.int32), np.cumsum(edges[:-1]) > 0


def _sorted(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Whole conversations in one partition each, in order; sorting spills, so their length does not matter."""
    spark = rows.sparkSession
    return rows.repartition(partitions(spark, 0, 1), key).sortWithinPartitions(key, *order)


def format_conversations(turns: DataFrame, *, path: str = VOCABULARY, learned: str = LEARNED, part: int = PART) -> DataFrame:
    """conv_id, part, formatted, ids, loss_mask: usually one row per conversation, in order of turn, role and text.

    Null texts and roles count as empty, a null conv_id is a conversation of its own, null turns come first, repeated rows are
    repeated turns.  Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, number, waiting, size = None, 0, [], 0

        def flush():
            text, begins, ends = render(waiting, learned)
            ids, mask = masked(text, begins, ends, path)
            return pa.RecordBatch.from_arrays(
                [pa.array([conversation], pa.int64()), pa.array([number], pa.int32()), pa.array([text]),
                 pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.bool_()))],
                names=["conv_id", "part", "formatted", "ids", "loss_mask"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if waiting and (conv != conversation or size > part):
                    yield flush()
                    number, waiting, size = (number + 1 if conv == conversation else 0), [], 0
                conversation = conv
                waiting.append((role or "", text or ""))
                size += len(waiting[-1][1])
        if waiting:
            yield flush()

    rows = _sorted(turns.select(F.col("conv_id").cast("long"), "turn", "role", "text"), "conv_id", ["turn", "role", "text"])
    return rows.mapInArrow(run, "conv_id long, part int, formatted string, ids array<int>, loss_mask array<boolean>")


def read_back(parts: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """Per conversation, from the formatted text: n_turns, turns_sha256; from the masked tokens: loss_chars, loss_sha256."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, current = tokenizer(path), None
        for frame in frames:
            out = []
            for conv, text, ids, mask in zip(frame["conv_id"], frame["formatted"], frame["ids"], frame["loss_mask"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if current is None or current[0] != conv:
                    if current is not None:
                        out.append(closed(current))
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _TURN.finditer(text):
                    current[1] += 1
                    current[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                mask = np.asarray(mask, dtype=np.int8)
                edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
                for a, b in edges.reshape(-1, 2):
                    said = unescape(known.decode(ids[a:b].tolist(), skip_special_tokens=False))
                    current[3] += len(said)
                    current[4].update(said.encode())
                current[5] += len(text)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if current is not None:
            yield pd.DataFrame([closed(current)], columns=names).astype({"conv_id": "Int64"})

    def closed(c: list) -> tuple:
        return c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _sorted(parts, "conv_id", ["part"]).mapInPandas(run, schema)
