"""SimHash near-duplicates by covering locality-sensitive hashing.

1. A text's fingerprint has a bit set where more than half of its shingle hashes have it.  Equal fingerprints are one
   node from here on.
2. Every bit position is given a non-zero vector of RADIUS + 1 bits.  A mask is the set of positions whose vector has
   an odd product with v, one mask for each non-zero v.  RADIUS differing positions give RADIUS linear equations in
   RADIUS + 1 unknowns, so some v solves them all: its mask holds none of these positions, and the two fingerprints are
   equal under it.  So each pair within the radius meets in one of 31 tables, for certain.
3. Positions share the 31 vectors evenly, so a mask leaves 30 to 32 of 64 bits open.  A crowded key is split by the same
   construction on the bits that it leaves open, down to 16 and then to 8 open bits, where no key can hold more than 256
   fingerprints.  So no key is cut off, and none is more than one small comparison.
4. A key's comparison gives links that join what its close pairs join, fewer than its members; links of all tables are
   joined to components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, materialize, ship_code, valid_text
from .components import components

RADIUS = 4
VECTORS = (1 << RADIUS + 1) - 1
BITS = 64
#: Fingerprints of one comparison; keys with more are split.
MOST = 512
#: Bytes of a text that are read at once.
WINDOW = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _masks(open_bits: list[int], vectors: list[int]) -> list[int]:
    """The mask of each v over the open bits, which take the vectors in turn."""
    given = [(bit, vectors[k % len(vectors)]) for k, bit in enumerate(open_bits)]
    return [sum(1 << bit for bit, m in given if (m & v).bit_count() % 2) for v in range(1, VECTORS + 1)]


@cache
def masks(path: tuple[int, ...] = ()) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(masks of the tables under the tables ``path``, the bits that each leaves open).

    On 16 bits, the vectors with the last bit set are used: a mask then leaves 8 open, or none.
    """
    left = (1 << BITS) - 1
    for depth, v in enumerate(path):
        left = masks(path[:depth])[1][v]
    bits = [b for b in range(BITS) if left >> b & 1]
    cover = _masks(bits, list(range(1, VECTORS + 1)) if len(bits) > 16 else list(range(1, VECTORS + 1, 2)))
    return tuple(cover), tuple(left & ~m for m in cover)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; of all words if there are fewer.  In pieces."""
    carry: list[bytes] = []
    at, n = 0, 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        if end < len(text):
            cut = _BLANK.search(text, end)
            end = cut.start() if cut else len(text)
        words = carry + text[at:end].lower().split()
        n += len(words) - len(carry)
        if len(words) >= size:
            yield np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)), np.uint64)
            words = words[len(words) - size + 1 :]
        carry, at = words, end
    if 0 < n < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), 42)], np.uint64)


def fingerprint(text: bytes, size: int) -> int:
    """Bits that are set in over half of the shingle hashes; 0 without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, size):
        n += len(h)
        for at in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            cut = batch.slice(at, 256)
            prints = [_signed(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size)) for t in cut.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def _close(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links between close fingerprints that join all that close pairs join."""
    left, out = fps, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left[:, None] ^ front[None, :64]) <= RADIUS
            hit = near.any(1)
            out += zip(front[near[hit].argmax(1)].tolist(), left[hit].tolist(), strict=True)
            front, left = np.concatenate([front[64:], left[hit]]), left[~hit]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each list of fingerprints."""
    for batch in batches:
        lists = batch.column("fps")
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
        n = np.diff(ends)
        two = ends[:-1][n == 2]
        a, b = flat[two], flat[two + 1]
        near = np.bitwise_count(a ^ b) <= RADIUS
        u, v = [a[near]], [b[near]]
        for k in np.flatnonzero(n > 2):
            if links := _close(flat[ends[k] : ends[k + 1]]):
                x = np.array(links, np.uint64)
                u.append(x[:, 0])
                v.append(x[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], names=["u", "v"])


def _keyed(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Each row under every mask of the tables below its own."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            cut = batch.slice(at, 8192)
            fp = cut.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            path = cut.column("path").to_numpy(zero_copy_only=False)
            key = cut.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for p in np.unique(path):
                here = path == p
                steps = tuple((int(p) >> 5 * d & 31) - 1 for d in range(depth))
                cover = np.array(masks(steps)[0], np.uint64)
                keys = key[here][:, None] | (fp[here][:, None] & cover)
                paths = np.broadcast_to(int(p) | np.arange(1, VECTORS + 1, dtype=np.int64) << 5 * depth, keys.shape)
                cols = [paths.reshape(-1), keys.reshape(-1).view(np.int64), np.repeat(fp[here], VECTORS).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["path", "key", "fp"])


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """Table of links (u, v) between the fingerprints of ``nodes`` (fp, distinct): enough to join whatever is within the radius."""
    rows = nodes.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key"), "fp")
    found, depth = [], 0
    while True:
        keyed = materialize(rows.mapInArrow(lambda it, d=depth: _keyed(it, d), "path long, key long, fp long"), "keyed")
        sizes = materialize(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        members = materialize(join_counted(keyed, sizes, ["path", "key"]), "members")
        discard(keyed, sizes)
        depth += 1
        small = members.where(F.col("n") <= most) if depth < 3 else members
        lists = small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(materialize(lists.select("fps").mapInArrow(_compare, "u long, v long").distinct(), "links"))
        if depth == 3 or members.where(F.col("n") > most).isEmpty():
            discard(members)
            break
        rows = materialize(members.where(F.col("n") > most).select("path", "key", "fp"), "crowded")
        discard(members)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def groups(docs: DataFrame, size: int = 4, most: int = MOST) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): its fingerprint and the group of near-duplicates that it belongs to.

    Words are cut at ASCII blanks, A-Z in lower case; shingles are ``size`` words, repeats included, or the whole sequence
    where it is shorter.  Fingerprints are linked if at most RADIUS bits differ.  Returns doc_id, fingerprint (16 lower-case
    hex digits), component_id (least doc_id that links reach).
    Null and blank texts have fingerprint zero and are linked like any other.  Rows without doc_id link others, too, and take
    the least doc_id of their group, null if there is none.  Rows that repeat a doc_id each have a result, that of
    their own text.  A bit that is set in just half of the hashes is 0.  Bytes that are no UTF-8 read as U+FFFD; texts are
    read whole, however long.  Empty tables give no rows; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    prints = materialize(base.mapInArrow(lambda it: _fingerprints(it, size), "doc_id long, fp long"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes, most)
    linked = components(edges).select(F.col("node").alias("fp"), "component")
    known = materialize(nodes.join(linked, "fp", "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component")), "known")
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    final = materialize(known.join(named, "component").select("fp", "n", "component_id"), "named")
    out = join_counted(prints, final, ["fp"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
