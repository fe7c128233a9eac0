"""Token counts that follow edits.

Each document has a segment tree.  Its leaves are runs of whole pre-tokens, cut before a single blank between two other
characters, where a pre-token begins whatever stands around; a node holds the characters and tokens below it.  An edit finds its
leaves by the sums of characters; only they, and a neighbour where the edit touches a cut, are encoded again, and the sums above
them are updated.  A text without such blanks is one leaf.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triledger.llm.bpe import RANKS, vocabulary

LEAF = 256
# A leaf grown beyond so many times LEAF is cut again.
GROWN = 64
_CUT = re.compile(r"(?<=\S) (?=\S)")


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Where leaves begin: at the first safe cut `leaf` characters behind the last one."""
    out, at = [0], leaf
    while at < len(text):
        m = _CUT.search(text, at)
        if m is None:
            break
        out.append(m.start())
        at = m.start() + leaf
    return out


class Tree:
    """Sums of characters and tokens over the leaves of a text, which is kept in the leaves."""

    def __init__(self, text: str, path: str = RANKS, tokens: list[int] | None = None, starts: list[int] | None = None):
        self.path = path
        starts = cuts(text) if starts is None else starts
        self.leaves = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        self.encoded = 0
        self._add_up([self._count(leaf) for leaf in self.leaves] if tokens is None else tokens)

    def _add_up(self, counts: list[int]) -> None:
        """All sums from the leaves and their tokens, a level at a time."""
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width:self.width + len(counts), 0] = [len(leaf) for leaf in self.leaves]
        self.sums[self.width:self.width + len(counts), 1] = counts
        level = self.width
        while level > 1:
            level //= 2
            self.sums[level:2 * level] = self.sums[2 * level:4 * level].reshape(level, 2, 2).sum(axis=1)

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(vocabulary(self.path)[0].encode_ordinary(text))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_tokens(self) -> list[int]:
        return self.sums[self.width:self.width + len(self.leaves), 1].tolist()

    def leaf_starts(self) -> list[int]:
        return np.concatenate([[0], np.cumsum(self.sums[self.width:self.width + len(self.leaves) - 1, 0])]).tolist()

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one beyond the end), and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at - begin >= self.sums[node, 0] and self.sums[node + 1, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.width, begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        self.sums[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replace `removed` characters from `at` on (as far as there are so many) by `added`."""
        size = int(self.sums[1, 0])
        at = min(max(at, 0), size)
        removed = min(max(removed, 0), size - at)
        first, begin = self._leaf(at)
        last, _ = self._leaf(at + removed)
        # The cut before a leaf holds while its blank, the character behind it and the one before it do.
        while begin and at - begin < 2:
            first, begin = self._leaf(begin - 1)
        region = "".join(self.leaves[first:last + 1])
        end = begin + len(region)
        region = region[:at - begin] + added + region[at - begin + removed:]
        while end < size and (not region or region[-1].isspace()):
            last, start = self._leaf(end)
            end = start + len(self.leaves[last])
            region += self.leaves[last]
        while begin and (len(region) < 2 or not region[0] == " " or region[1].isspace()):
            first, begin = self._leaf(begin - 1)
            region = self.leaves[first] + region
        begins = cuts(region) if len(region) > GROWN * LEAF else [0]
        if len(begins) == 1:
            for leaf in range(first + 1, last + 1):
                if self.leaves[leaf]:
                    self._set(leaf, "", 0)
            self._set(first, region, self._count(region))
            return
        pieces = [region[a:b] for a, b in zip(begins, [*begins[1:], len(region)], strict=True)]
        counts = self.leaf_tokens()
        counts[first:last + 1] = [self._count(piece) for piece in pieces]
        self.leaves[first:last + 1] = pieces
        self._add_up(counts)


def _with(rows: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*rows.schema.fields, *(T.StructField(name, kind) for name, kind in more)])


def grow(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), *, path: str = RANKS) -> DataFrame:
    """`keep`, `_text` and the trees as tables: `starts` and `tokens` of the leaves.  A null text has one empty leaf."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            trees = [Tree(t.as_py(), path) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t.leaf_starts() for t in trees], kind), pa.array([t.leaf_tokens() for t in trees], kind)],
                names=[*batch.schema.names, "starts", "tokens"])

    return rows.mapInArrow(run, _with(rows, ("starts", T.ArrayType(T.LongType())), ("tokens", T.ArrayType(T.LongType()))))


def edited(trees: DataFrame, edits: Column, *, path: str = RANKS) -> DataFrame:
    """The columns of `grow` with the texts and trees after the edits, n_before, n_after and n_encoded (characters encoded again).

    `edits` is an array of (at, removed, added), done in order; places beyond the end mean the end, a null array or a null entry
    changes nothing, a null `added` adds nothing.
    """
    rows = trees.withColumn("_edits", edits)
    out = _with(trees, *((c, T.LongType()) for c in ("n_before", "n_after", "n_encoded")))
    names = trees.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            texts, starts, tokens, before, after, encoded = [], [], [], [], [], []
            for text, begins, counts, changes in zip(*(batch.column(c) for c in ("_text", "starts", "tokens", "_edits")), strict=True):
                tree = Tree(text.as_py(), path, counts.as_py(), begins.as_py())
                before.append(tree.tokens)
                for change in changes.as_py() or ():
                    if change is not None:
                        tree.edit(change["at"] or 0, change["removed"] or 0, change["added"] or "")
                texts.append("".join(tree.leaves))
                starts.append(tree.leaf_starts())
                tokens.append(tree.leaf_tokens())
                after.append(tree.tokens)
                encoded.append(tree.encoded)
            new = {"_text": pa.array(texts, pa.string()), "starts": pa.array(starts, kind), "tokens": pa.array(tokens, kind)}
            yield pa.RecordBatch.from_arrays(
                [*(new.get(c, batch.column(c)) for c in names), *(pa.array(x, pa.int64()) for x in (before, after, encoded))],
                names=[*names, "n_before", "n_after", "n_encoded"])

    return rows.mapInArrow(run, out)
