"""Bags of words that are alike, without comparing all of them: keys, sketches and exact sums as Arrow functions."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a sketch, one bit for each of its words' hashes.
SKETCH = 32
#: Words that are worked on at once.
WORDS = 2_000_000


def hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _cuts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most WORDS words together, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORDS, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the words of a column of lists without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _counted(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of each different word of each row, in this order."""
    keys, n = np.unique(rows * size + codes, return_counts=True)
    return keys // size, keys % size, n.astype(np.int64)


def prefixes(batches: Iterator[pa.RecordBatch], often: dict[str, int], share: float) -> Iterator[pa.RecordBatch]:
    """(id, h, often, sq, sketch) of each word of a bag (id, w) at which two bags can meet first.

    Words come in the order of ``often`` (place of a frequent word), all others before these.  Two bags that have ``share``
    of their squared norms in common have a first common word, and what comes from it on holds ``share`` of the norm.
    """
    for batch in batches:
        whole, flat = _lists(batch.column("w"))
        for lo, hi in _cuts(whole):
            offsets = whole[lo : hi + 1] - whole[lo]
            words = flat.slice(whole[lo], offsets[-1]).dictionary_encode()
            known = words.dictionary.to_pylist()
            if not known:
                continue
            h = np.array([hashed(x) for x in known], np.int64)
            place = np.array([often.get(x, -1) for x in known], np.int64)
            order = np.empty(len(known), np.int64)
            order[sorted(range(len(known)), key=lambda i: (place[i], h[i], known[i]))] = np.arange(len(known))
            back = np.argsort(order)
            row, code, n = _counted(np.repeat(np.arange(hi - lo), np.diff(offsets)), order[words.indices.to_numpy()], len(known))
            code = back[code]
            sq = np.bincount(row, n * n, hi - lo).astype(np.int64)
            before = np.cumsum(n * n) - n * n
            before -= before[np.searchsorted(row, row)]  # what the bag has in front of the word
            use = sq[row] - before >= share * sq[row] - 1e-6
            bits = np.zeros((hi - lo, SKETCH * 8), bool)
            bits[row, (h[code] & (SKETCH * 8 - 1))] = True
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH), hi - lo, [None, pa.py_buffer(np.packbits(bits, axis=1).tobytes())]).cast(pa.binary())
            mine = pa.array(row[use])
            cols = [batch.column("id").slice(lo, hi - lo).take(mine), pa.array(h[code[use]]), pa.array(place[code[use]] >= 0), pa.array(sq[row[use]]), sketch.take(mine)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "often", "sq", "sketch"])


def _near(sq: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, weight: float) -> np.ndarray:
    """Whether the bags may reach ``least`` (a squared cosine): a bit that only one sketch has is a word that only one bag has."""
    x, y = sketch[a], sketch[b]
    apart = lambda p, q, of: 1 - np.bitwise_count(p & ~q).sum(1, dtype=np.int64) / sq[of]
    reach = lambda s: s / (weight - (weight - 1) * s)
    return reach(apart(x, y, a)) * reach(apart(y, x, b)) >= least - 1e-9


def meetings(batches: Iterator[pa.RecordBatch], least: float, weight: float) -> Iterator[pa.RecordBatch]:
    """(x, y): ids of rows (id, h, part, side, sq, sketch), sorted by h and part, that share both and may be alike.

    side is 0 where all rows of the part meet; else rows of side 1 meet those of side 2.
    """
    names = ["id", "h", "part", "side", "sq", "sketch"]
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is None and rest is None:
            return
        new = [] if batch is None else [pa.Table.from_batches([batch]).select(names)]
        held = pa.concat_tables([*([] if rest is None else [rest]), *new]).combine_chunks()
        rest = None
        if not held.num_rows:
            continue
        h, part, side, sq = (held.column(c).to_numpy() for c in names[1:5])
        new_group = np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]
        starts = np.flatnonzero(new_group)
        if batch is not None:  # the last group may go on
            rest = held.slice(int(starts[-1]))
            held = held.slice(0, int(starts[-1]))
            starts = starts[:-1]
            if not held.num_rows:
                continue
        n = held.num_rows
        sizes = np.diff(np.r_[starts, n])
        end = np.repeat(starts + sizes, sizes)
        sketch = np.frombuffer(b"".join(held.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
        a, apart, found = np.arange(n), 0, []
        while True:
            apart += 1
            a = a[end[a] > a + apart]
            if not len(a):
                break
            b = a + apart
            met = (side[a] == 0) | (side[a] != side[b])
            at = a[met] if not met.all() else a
            if len(at):
                at = at[_near(sq, sketch, at, at + apart, least, weight)]
                found.append((at, at + apart))
        if found:
            ids = held.column("id").combine_chunks()
            x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(x):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], names=["x", "y"])


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb, ab, aa, bb) of pairs of bags (a, b, wa, wb): squared norms, and over the common words the sums of products and squares."""
    for batch in batches:
        (ao, af), (bo, bf) = (_lists(batch.column(c)) for c in ("wa", "wb"))
        for lo, hi in _cuts(ao + bo):
            size = hi - lo
            first = int(ao[hi] - ao[lo])
            words = pa.concat_arrays([af.slice(ao[lo], first), bf.slice(bo[lo], bo[hi] - bo[lo])]).dictionary_encode()
            codes, kinds = words.indices.to_numpy(), len(words.dictionary) + 1
            of = lambda o: np.repeat(np.arange(size), np.diff(o[lo : hi + 1]))  # noqa: E731, B023
            ka, na = np.unique(of(ao) * kinds + codes[:first], return_counts=True)
            kb, nb = np.unique(of(bo) * kinds + codes[first:], return_counts=True)
            both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            total = lambda rows, x: pa.array(np.bincount(rows, x.astype(float), size).astype(np.int64))  # noqa: E731, B023
            x, y, row = na[i], nb[j], both // kinds
            cols = [batch.column(c).slice(lo, size) for c in ("a", "b")]
            cols += [total(ka // kinds, na * na), total(kb // kinds, nb * nb), total(row, x * y), total(row, x * x), total(row, y * y)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "sa", "sb", "ab", "aa", "bb"])
