"""A Merkle manifest of a data set: ternary trees stored in blocks, each block in van Emde Boas order.

Rows are leaves of their source's tree; the roots of the sources are the leaves of one more tree.  A tree is cut into
aligned subtrees of HEIGHT levels, and a subtree is one row of a table: a block.  Inside a block, nodes lie in van Emde
Boas order: the tree is split at half its height, the upper half comes first and then each lower subtree, all stored the
same way.  ``address`` turns (level, index) into the place by arithmetic alone, for construction as for siblings; it knows
no page or cache size, and any path crosses few runs of memory.  Block roots are the leaves of the next tier of blocks, up
to a tier of one block.

Construction works upwards, a tier at a time; proofs are handed downwards, from a block to the blocks under it.  Both move one
row for every block, apart from the leaves themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_code, valid_text
from .ranking import positions

ARITY = 3
#: Levels of a block above its leaves, by default: 729 leaves, 1,093 nodes, 35 KB.
HEIGHT = 6
DIGEST = 32
BLOCK_SCHEMA = "tree string, tier int, idx long, count int, height int, nodes binary, root binary"


def size(height: int) -> int:
    """Nodes of a full tree of ``height`` levels above its leaves."""
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of the level ``depth`` (0: root) in a full tree of ``height`` levels above its leaves."""
    if height == 0:
        return np.zeros(len(index), np.int64)
    upper = height // 2  # levels of the upper tree above its own leaves; under them hang the lower trees
    if depth <= upper:
        return address(upper, depth, index)
    lower = height - upper - 1
    under = ARITY ** (depth - upper - 1)
    return size(upper) + (index // under) * size(lower) + address(lower, depth - upper - 1, index % under)


@cache
def _level(height: int, depth: int) -> np.ndarray:
    out = address(height, depth, np.arange(ARITY**depth, dtype=np.int64))
    out.setflags(write=False)
    return out


def combine(hexes: list[str]) -> bytes:
    return hashlib.sha256("".join(hexes).encode()).digest()


def build_block(leaves: list[bytes], height: int) -> bytes:
    """The block over ``leaves``, ``height`` levels of hashing; places without a node are zero."""
    nodes = np.zeros((size(height), DIGEST), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        nodes[_level(height, depth)[: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
        hexes = [x.hex() for x in row]
        row = [combine(hexes[i : i + ARITY]) for i in range(0, len(row), ARITY)]
    return nodes.tobytes()


class Block:
    """A stored block: (height, number of leaves) and its nodes."""

    def __init__(self, height: int, count: int, nodes: bytes):
        self.height, self.nodes = height, nodes
        self.counts = [count]
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] // ARITY))

    def siblings(self, leaf: int) -> Iterator[tuple[int, list[bytes]]]:
        """From the leaf upwards: its place in its run, and the others of the run, left to right."""
        for up in range(self.height):
            at = _level(self.height, self.height - up)
            first, place = leaf - leaf % ARITY, leaf % ARITY
            others = [int(at[i]) * DIGEST for i in range(first, min(first + ARITY, self.counts[up])) if i != leaf]
            yield place, [self.nodes[i : i + DIGEST] for i in others]
            leaf //= ARITY

    def path(self, leaf: int) -> tuple[bytes, bytes]:
        """``siblings`` as stored: a byte for each level (place, and number of others times four) and the digests."""
        steps, digests = bytearray(), []
        for place, others in self.siblings(leaf):
            steps.append(place | len(others) << 2)
            digests += others
        return bytes(steps), b"".join(digests)


def fold(leaf: bytes, steps: bytes, digests: bytes) -> bytes:
    """The root that ``leaf`` leads to along a path."""
    at = 0
    for step in steps:
        place, others = step & 3, step >> 2
        row = [digests[i : i + DIGEST].hex() for i in range(at, at + others * DIGEST, DIGEST)]
        row.insert(place, leaf.hex())
        leaf, at = combine(row), at + others * DIGEST
    return leaf


def _build(batches: Iterator[pa.RecordBatch], tier: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, heights, counts = [], [], []
        for n, leaves in zip(batch.column("n").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
            height = next((h for h in range(most) if ARITY**h >= n), most)
            heights.append(height)
            counts.append(len(leaves))
            nodes.append(build_block([x["digest"] for x in leaves], height))
        k = batch.num_rows
        cols = [batch.column("tree"), pa.array([tier] * k, pa.int32()), batch.column("idx"), pa.array(counts, pa.int32()), pa.array(heights, pa.int32()), pa.array(nodes, pa.binary()), pa.array([x[:DIGEST] for x in nodes], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["tree", "tier", "idx", "count", "height", "nodes", "root"])


def _tiers(nodes: DataFrame, sizes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Tables of blocks over ``nodes`` (tree, pos, digest) of trees with ``n`` leaves (``sizes``), the lowest tier first."""
    most, block = sizes.agg(F.max("n")).first()[0] or 0, ARITY**height
    sizes, tiers = sizes.select("tree", "n"), []
    while True:
        packed = nodes.groupBy("tree", F.floor(F.col("pos") / block).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("leaves"))
        k = len(tiers)
        tiers.append(materialize(packed.join(sizes, "tree").mapInArrow(lambda it, k=k: _build(it, k, height), BLOCK_SCHEMA), f"{name}-{k}"))
        if most <= block:
            return tiers
        above = sizes.where(F.col("n") > block).withColumn("n", F.ceil(F.col("n") / block))
        nodes = tiers[-1].join(above, "tree", "left_semi").select("tree", F.col("idx").alias("pos"), F.col("root").alias("digest"))
        most, sizes = -(-most // block), above


def _down(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each leaf of the blocks: the way from it to the very root."""
    for batch in batches:
        for b in batch.to_pylist():
            block = Block(b["height"], b["count"], b["nodes"])
            ways = [block.path(i) for i in range(b["count"])]
            k = b["count"]
            cols = [pa.array([b["tree"]] * k, pa.string()), pa.array(range(b["idx"] * width, b["idx"] * width + k), pa.int64()), pa.array([s + b["steps"] for s, _ in ways], pa.binary()), pa.array([d + b["digests"] for _, d in ways], pa.binary()), pa.array([b["subroot"]] * k, pa.binary()), pa.array([b["top"]] * k, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["tree", "pos", "steps", "digests", "subroot", "top"])


_WAYS = "tree string, pos long, steps binary, digests binary, subroot binary, top binary"


def _walk_down(tiers: list[DataFrame], above: DataFrame, height: int, to_leaves: bool = True) -> DataFrame:
    """Ways of the leaves of the lowest tier (of its blocks, if not ``to_leaves``), given the way of each tree's root.

    above: tree, steps, digests, top.  A tree's highest block is the one whose tier has no other of it.
    """
    known: DataFrame | None = None
    for k in range(len(tiers) - 1, -1, -1):
        blocks = tiers[k]
        highest = blocks.join(tiers[k + 1].select("tree").distinct(), "tree", "left_anti") if k + 1 < len(tiers) else blocks
        here = highest.join(above, "tree").withColumn("subroot", F.col("root"))
        if known is not None:
            lower = blocks.join(known.withColumnRenamed("pos", "idx"), ["tree", "idx"])
            here = here.unionByName(lower.select(*here.columns))
        if k == 0 and not to_leaves:
            return here
        known = here.mapInArrow(lambda it: _down(it, ARITY**height), _WAYS)
    return known


def prefixed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 over the five fields."""
    fields = [prefixed(doc_id.cast("string")), prefixed(source), prefixed(lang), prefixed(n_chars.cast("string")), prefixed(text)]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def manifest(docs: DataFrame, claimed: Column | None = None, height: int = HEIGHT) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(leaves, blocks of the sources' trees by tier, blocks of the tree over the sources by tier), all tables.

    Leaves have tree, pos, doc_id, digest, claim: the digest with ``claimed`` in place of the text.
    """
    ship_code(docs.sparkSession)
    text = valid_text()
    named = [F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("source").cast("string")), F.make_valid_utf8(F.col("lang").cast("string")), F.col("n_chars").cast("long")]
    digest = leaf_digest(*named, text)
    claim = digest if claimed is None else leaf_digest(*named, claimed)
    tree = F.coalesce(F.concat(F.lit("="), named[1]), F.lit(""))  # null first; '' is no other source's name
    flat = docs.select(tree.alias("tree"), named[0].alias("doc_id"), digest.alias("digest"), claim.alias("claim"))
    placed, sizes = positions(flat, "tree", [F.asc_nulls_first("doc_id"), F.col("digest"), F.col("claim")], "leaves")
    leaves, sizes = materialize(placed, "leaves"), materialize(sizes, "trees")
    low = _tiers(leaves.select("tree", "pos", "digest"), sizes, height, "blocks")
    tops = None
    for k, blocks in enumerate(low):
        highest = blocks.join(low[k + 1].select("tree").distinct(), "tree", "left_anti") if k + 1 < len(low) else blocks
        tops = highest.select("tree", "root") if tops is None else tops.unionByName(highest.select("tree", "root"))
    roots = tops.select(F.lit("").alias("whole"), F.col("tree"), F.col("root").alias("digest"))
    ranked, whole = positions(roots, "whole", [F.col("tree")], "roots")
    ranked = materialize(ranked.withColumnRenamed("tree", "source_tree").withColumnRenamed("whole", "tree"), "roots")
    high = _tiers(ranked.select("tree", "pos", "digest"), whole.withColumnRenamed("whole", "tree"), height, "top")
    return leaves, low, [*high, ranked]


def _prove(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            block, rows = Block(b["height"], b["count"], b["nodes"]), b["rows"]
            for at in range(0, len(rows), 256):
                cut = rows[at : at + 256]
                ways = [block.path(r["pos"] % width) for r in cut]
                ways = [(s + b["steps"], d + b["digests"]) for s, d in ways]
                folded = [fold(r["claim"], s, d) for r, (s, d) in zip(cut, ways, strict=True)]
                k = len(cut)
                cols = [pa.array([r["doc_id"] for r in cut], pa.int64()), pa.array([r["digest"] for r in cut], pa.binary()), pa.array([b["subroot"]] * k, pa.binary()), pa.array([b["top"]] * k, pa.binary())]
                cols += [pa.array([s for s, _ in ways], pa.binary()), pa.array([d for _, d in ways], pa.binary()), pa.array(folded, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "leaf", "subroot", "root", "steps", "proof", "folded"])


def prove(docs: DataFrame, claimed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """For every row of ``docs`` (doc_id, source, lang, n_chars, text): its place in the manifest, and whether a claim holds.

    Returns doc_id, and as binary: leaf, subroot (of its source), root, steps and proof (see ``Block.path``; the siblings from
    the leaf to the root, 32 bytes each), folded (the root that the leaf with ``claimed`` in place of the text leads to).
    Rows of a source ascend by doc_id, null first; rows with one doc_id by digest.  Nulls are hashed as `-`; a null source is a
    tree of its own and the first; a null text is no empty text.  Bytes that are no UTF-8 read as U+FFFD.  Repeated
    rows are leaves of their own, each with its proof.  Texts are hashed whole, however long.  Empty tables give no
    rows; other columns are ignored.  ``height``: levels of a block; no result depends on it.
    """
    leaves, low, (*high, ranked) = manifest(docs, claimed, height)
    tip = high[-1].select("tree", F.lit(b"").alias("steps"), F.lit(b"").alias("digests"), F.col("root").alias("top"))
    over = _walk_down(high, tip, height).select("pos", "steps", "digests", "top").join(ranked.select(F.col("source_tree").alias("tree"), "pos"), "pos").drop("pos")
    blocks = _walk_down(low, materialize(over, "over"), height, to_leaves=False).select("tree", "idx", "count", "height", "nodes", "steps", "digests", "subroot", "top")
    held = leaves.groupBy("tree", F.floor(F.col("pos") / ARITY**height).alias("idx")).agg(F.collect_list(F.struct("pos", "doc_id", "digest", "claim")).alias("rows"))
    return held.join(blocks, ["tree", "idx"]).mapInArrow(lambda it: _prove(it, ARITY**height), "doc_id long, leaf binary, subroot binary, root binary, steps binary, proof binary, folded binary")
