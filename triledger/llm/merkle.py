"""Merkle manifest of a table, with witnesses that grow while leaves are appended.

The leaves of a group are appended in order, in blocks aligned to `arity ** height` leaves, each block a stream of its own.  An
open subtree holds the nodes that have arrived and the partial witnesses of whoever lies below; when its last sibling arrives,
it is completed: every witness below is extended by its siblings, and the new node is appended one level higher.  The leaves of
one run share a witness, so a leaf costs little more than its digest.  The roots of the blocks are appended in the same way, in
blocks again, until one node of each group is left, and so are the roots of the groups.

Witnesses are put together from the top: each node gets what its block's root needs on its way up.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triledger.llm.tables import partitions, saved
from triledger.operators.ordered import ordered_scan

ARITY, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Leaves of one task.
LEAVES_PER_TASK = 1_000_000

STEPS = "array<struct<left:binary,right:binary>>"


def digest(*values: Column) -> Column:
    """SHA-256 (binary) of the values, one after the other: `-` for a null, else the number of UTF-8 bytes, `:` and the value."""
    texts = [v.cast("string") for v in values]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*framed).cast("binary"), 256))


def _joined(nodes: list[bytes]) -> bytes:
    return sha256(b"".join(nodes).hex().encode()).digest()


class Run:
    """Consecutive nodes that are hashed together (a lone root is not), and the witness of their parent so far."""

    def __init__(self, size: int, hashed: bool):
        self.size, self.hashed, self.steps = size, hashed, []


class Block:
    """The open subtrees of an aligned block, one a level."""

    def __init__(self, arity: int = ARITY, height: int = HEIGHT):
        self.arity, self.height = arity, height
        self.open: list[list[tuple[bytes, list[Run]]]] = [[] for _ in range(height + 1)]
        self.runs: list[Run] = []

    def append(self, node: bytes) -> None:
        self.open[0].append((node, []))
        level = 0
        while level < self.height and len(self.open[level]) == self.arity:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        nodes, below = [n for n, _ in self.open[level]], [b for _, b in self.open[level]]
        self.open[level] = []
        if level == 0:
            self.runs.append(Run(len(nodes), True))
            witnesses = self.runs[-1:]
        else:
            for i, runs in enumerate(below):
                step = b"".join(nodes[:i]), b"".join(nodes[i + 1:])
                for run in runs:
                    run.steps.append(step)
            witnesses = [run for runs in below for run in runs]
        self.open[level + 1].append((_joined(nodes), witnesses))

    def finish(self, first: bool) -> bytes:
        """The root of what has been appended.

        The first block of a group ends where one node is left, for if it is not full, there is no other.  All others go up to
        the full height.
        """
        for level in range(self.height + 1):
            nodes = self.open[level]
            if level == self.height or (first and len(nodes) == 1 and not any(self.open[level + 1:])):
                if not self.runs:
                    self.runs.append(Run(1, False))
                return nodes[0][0]
            if nodes:
                self._complete(level)


def _runs(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The runs of all blocks, appended in order: grp, block, run, members, hashed, steps and the root of the block.

    `nodes` has grp, block, pos, node and what else the members carry; it is sorted within partitions, no block in two of them.
    """
    members = [f for f in nodes.schema if f.name not in ("grp", "block")]
    out = T.StructType.fromDDL(f"grp string, block long, run int, hashed boolean, steps {STEPS}, root binary").add(
        "members", T.ArrayType(T.StructType(members)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held = None, None, []

        def finished() -> pa.RecordBatch:
            root = block.finish(key[1] == 0)
            content = pa.Table.from_batches(held).select([m.name for m in members]).combine_chunks().to_struct_array()
            content = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
            ends = np.cumsum([0, *(r.size for r in block.runs)]).astype(np.int32)
            n = len(block.runs)
            steps = [[{"left": left, "right": right} for left, right in r.steps] for r in block.runs]
            step_type = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                 pa.array([r.hashed for r in block.runs]), pa.array(steps, step_type), pa.array([root] * n, pa.binary()),
                 pa.ListArray.from_arrays(ends, content)],
                names=["grp", "block", "run", "hashed", "steps", "root", "members"])

        for batch in batches:
            keys = list(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist(), strict=True))
            digests = batch.column("node").to_pylist()
            begin = 0
            for i, k in enumerate(keys):
                if k != key:
                    if block is not None:
                        held.append(batch.slice(begin, i - begin))
                        yield finished()
                    key, block, held, begin = k, Block(arity, height), [], i
                block.append(digests[i])
            held.append(batch.slice(begin))
        if block is not None:
            yield finished()

    return nodes.mapInArrow(run, out)


def _rounds(nodes: DataFrame, rows: int, arity: int, height: int) -> list[DataFrame]:
    """The runs of the nodes (grp, pos, node and more), then those of the blocks' roots, and so on to one root a group."""
    spark, size, out = nodes.sparkSession, arity ** height, []
    while True:
        blocks = nodes.withColumn("block", F.expr(f"pos div {size}")).repartition(
            partitions(spark, rows, LEAVES_PER_TASK), "grp", "block").sortWithinPartitions("grp", "block", "pos")
        out.append(saved(_runs(blocks, arity, height), last=F.max("block"), blocks=F.count_if(F.col("run") == 0)))
        if not out[-1].facts["last"]:
            return out
        nodes = out[-1].filter("run = 0").select("grp", F.col("block").alias("pos"), F.col("root").alias("node"))
        rows = out[-1].facts["blocks"]


def _lower_hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _witnesses(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """What the members carry, with `root` of their group, `top` of all and the steps up to there.

    `top` has grp, its steps and the root of all.
    """
    step = F.transform("steps", lambda s: F.struct(_lower_hex(s["left"]).alias("left"), _lower_hex(s["right"]).alias("right")))
    above = None
    for runs in reversed(rounds):
        rows = runs.select("grp", "block", "members", "hashed", step.alias("own"), "root", F.transform(
            "members", lambda m: _lower_hex(m["node"])).alias("nodes"))
        if above is None:
            # One block a group: no group has more rows here than a block has runs.
            rows = rows.join(top, "grp")
        else:
            rows = rows.drop("root").join(above, ["grp", "block"])
        rows = rows.select("grp", "block", "hashed", "own", "more", "root", "top", "nodes", F.posexplode("members").alias("at", "member"))
        left = F.array_join(F.slice("nodes", 1, F.col("at")), "")
        right = F.array_join(F.slice("nodes", F.col("at") + 2, F.size("nodes")), "")
        first = F.when(F.col("hashed"), F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(
            F.array().cast("array<struct<left:string,right:string>>"))
        above = rows.select("grp", F.col("member.pos").alias("block"), "member", F.concat(first, "own", "more").alias("more"), "root", "top")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", group: str = "source", *,
             carried: Column | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, witness, subroot, root and `carried`, a binary column of the documents.

    The witness has one step for each hashing on the way up: the siblings' digests to the left and to the right, in lower-case
    hex.  Leaves of a group come by doc_id, null first, then by digest; equal rows are leaves beside each other.  Groups come by
    name, null first; a null group is one group.  No documents give no rows.  Only `fields`, doc_id and group are read.
    """
    # A group's name with a mark before it: null is apart from the empty name, and first.
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    more = F.lit(None).cast("binary") if carried is None else carried
    leaves = saved(docs.select(name.alias("grp"), F.col(doc_id).alias("doc_id"), digest(*[F.col(f) for f in fields]).alias("node"),
                               more.alias("carried")))
    rows = leaves.facts["rows"]
    placed = ordered_scan(leaves, ["grp"], ["doc_id", "node"], number="n", at_most=rows)
    inside = _rounds(placed.select("grp", (F.col("n") - 1).alias("pos"), "node", "doc_id", "carried"), rows, arity, height)
    last = inside[-1]
    subroots = last.filter("run = 0").select("grp", F.col("root").alias("node"))
    ordered = ordered_scan(subroots, [], ["grp"], number="n", at_most=last.facts["blocks"])
    across = _rounds(ordered.select(F.lit("").alias("grp"), (F.col("n") - 1).alias("pos"), "node", F.col("grp").alias("name")),
                     last.facts["blocks"], arity, height)
    # One row: the root of all.
    root = across[-1].filter("run = 0").select(F.lit("").alias("grp"), F.array().cast("array<struct<left:string,right:string>>").alias("more"),
                                              F.col("root").alias("top"))
    groups = _witnesses(across, root).select(F.col("member.name").alias("grp"), "more", "top")
    return _witnesses(inside, groups).select(
        F.col("member.doc_id").alias("doc_id"), _lower_hex(F.col("member.node")).alias("leaf"), F.col("more").alias("witness"),
        _lower_hex(F.col("root")).alias("subroot"), _lower_hex(F.col("top")).alias("root"), F.col("member.carried").alias("carried"))


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf (lower-case hex) and a witness lead to."""
    return F.aggregate(witness, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def witness_digest(witness: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
