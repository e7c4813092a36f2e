"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, and exact confirmation.

1. Each text becomes its set of word shingles, a signature of SYMBOLS b-bit symbols and a digest of the set.  Texts
   with equal sets are one class from here on, known by a number of its own; ids come back in at the end.
2. Signatures within distance DISTANCE agree in some of CHUNKS chunks up to DISTANCE // CHUNKS symbols (pigeonhole).
   The allowed errors are enumerated: a chunk is a key once for each symbol left out.  Signatures that share no key are
   further apart than DISTANCE.
3. First round: in each key's bucket, everyone is paired with the bucket's least member only; pairs are confirmed on the
   full sets, and links joined to components.
4. Crowded buckets, of more than BLOCK classes, are split.  Those that share many members take one of these as their
   centre, and every member meets it on the full sets.  Two sets whose differences from the centre are disjoint differ by
   both of these together; if that allows a link, either is linked to the centre.  So all other links share a shingle of
   the differences, and each member has a row in the buckets of its first differences, as many as a link must meet.
   Differences that many members have come last.
5. Second round: buckets that still hold several components.  Members outside the largest component meet all others, in
   blocks that are bounded in rows and in shingles.  A first pass without texts leaves the members that have a partner of
   another component whose size and differences allow a link; the second compares the full sets.  A pair is looked at
   only in the first of the buckets of signature keys that it shares.
So no bucket is emitted as pairs, none is cut off, and every pair that shares a key is confirmed on full sets, or its
members are already linked, or their sizes or differences rule a link out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, lean, materialize, mix64, prefix_hash, ship_code, span_hash, text_chunks, valid_text, words_of
from .common import _LOWER
from .components import components

SYMBOLS, CHUNKS = 40, 8
WIDTH = SYMBOLS // CHUNKS
#: Largest signature distance that is guaranteed to be found.  At similarity 0.85 a signature differs in 6 of 40
#: symbols on average; 16 or more have a chance of 1e-4, and a pair is lost only if all 8 chunks have two errors or
#: more, a chance of 5.5e-7.  Nothing else is lost: there is no limit on the distance of pairs that share a key.
DISTANCE = 15
#: Rows on either side of one comparison in the second round, and shingles (8 bytes each), on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Last bits of a key that names no chunk and symbol, but a shingle by which members differ from their centre.
DIFFERENCE = 63
#: A difference comes last if one in so many of the centre's members has it, so fewer than so many times their mean number do.
FREQUENT = 8
#: Bits of a row's incidence with the block's shingles that are counted at once.
BITS = 1 << 19

_rng = np.random.default_rng(20240917)
_A = (_rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_C = mix64(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than ``size`` are one shingle."""
    low = _LOWER[data]
    start, end, row = words_of(low, offsets)
    h = span_hash(prefix_hash(low), start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    with np.errstate(over="ignore"):
        n = max(0, len(h) - size + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(size):
            grams += h[k : k + n] * _C[k]
        grams = mix64(grams)
        out = []
        for r in range(len(offsets) - 1):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                out.append(mix64(np.array([np.sum(h[a:b] * _C[: b - a]) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of 16 bits: the low bits of the least value of the set under each hash function."""
    least = np.full(SYMBOLS, np.uint64((1 << 64) - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            least = np.minimum(least, (s[at : at + 4096, None] * _A + _B).min(0))
        return mix64(least).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for cut, data, offsets in text_chunks(batches):
        sets = shingle_sets(data, offsets, size)
        with np.errstate(over="ignore"):
            d1 = np.array([np.sum(s) for s in sets], np.uint64)
            d2 = np.array([np.sum(mix64(s ^ np.uint64(0x5851F42D4C957F2D))) for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [cut.column("doc_id"), cut.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "h", "n_shingles", "d1", "d2", "sig"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for each chunk and each symbol of it that may be wrong."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            cut = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(cut.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            keys = []
            with np.errstate(over="ignore"):
                part = sig * _C[:WIDTH] + np.uint64(1)
                whole = mix64(part)
                total = whole.sum(2)
                for w in range(WIDTH):
                    keys.append(mix64(total - whole[:, :, w] + (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(w)) * np.uint64(0xD1342543DE82EF95)))
            keys = np.stack(keys, 2).reshape(len(sig), -1)
            keys = (keys & ~np.uint64(63)) | np.arange(keys.shape[1], dtype=np.uint64)  # the last bits name chunk and symbol
            ids = cut.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "id"])


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose sets are similar enough."""
    last_id, last = None, None
    for batch in batches:
        a_ids, b_ids = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for at in range(0, batch.num_rows, 64):
            cut = batch.slice(at, 64)
            b_sets = [s for _, d, o in text_chunks([cut], "text_b") for s in shingle_sets(d, o, size)]
            for k, t in enumerate(b_sets):
                if a_ids[at + k] != last_id:
                    ((_, d, o),) = text_chunks([cut.slice(k, 1)], "text_a")
                    last_id, last = a_ids[at + k], shingle_sets(d, o, size)[0]
                if 100 * min(len(last), len(t)) < percent * max(len(last), len(t)):
                    continue
                both = len(np.intersect1d(last, t, assume_unique=True))
                if both and 100 * both >= percent * (len(last) + len(t) - both):
                    keep.append(at + k)
        yield pa.RecordBatch.from_arrays([pa.array([a_ids[k] for k in keep], pa.int64()), pa.array([b_ids[k] for k in keep], pa.int64())], names=["a", "b"])


def _differences(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """For a centre a and each member b: whether they are linked, how many of b's differences a link shares at least, and the differences' keys.

    A link of b differs from it in (100 - percent) * n / percent shingles at most, and is no more than that nearer to the
    centre.  Where b is linked to the centre, only those that are not are looked for, which are further from it.
    """
    last_id, last = None, None
    for batch in batches:
        a_ids, b_ids = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        for at in range(0, batch.num_rows, 64):
            cut = batch.slice(at, 64)
            linked, least, keys = [], [], []
            b_sets = [s for _, d, o in text_chunks([cut], "text_b") for s in shingle_sets(d, o, size)]
            for k, t in enumerate(b_sets):
                if a_ids[at + k] != last_id:
                    ((_, d, o),) = text_chunks([cut.slice(k, 1)], "text_a")
                    last_id, last = a_ids[at + k], shingle_sets(d, o, size)[0]
                differ = np.setxor1d(t, last, assume_unique=True)
                n, m, apart = len(t), len(last), len(differ)
                near = n + m > apart and 100 * (n + m - apart) >= percent * (n + m + apart)
                linked.append(near)
                least.append(max(1, apart - (100 - percent) * n // percent, ((100 + percent) * apart + (100 - percent) * (m - n)) // (2 * (100 + percent)) + 1 if near else 1))
                centre = mix64(np.array([last_id], np.uint64) + _C[0])
                keys.append((mix64(differ ^ centre) | np.uint64(DIFFERENCE)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a_ids[at : at + 64], pa.int64()), pa.array(b_ids[at : at + 64], pa.int64()), pa.array(linked, pa.bool_()), pa.array(least, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["a", "b", "linked", "least", "keys"],
            )


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, key, times) of the differences that many of the centre's members in a batch have; any order of them is right, so the rest need no count."""
    for batch in batches:
        a, keys = batch.column("a").to_numpy(), batch.column("keys")
        for centre in np.unique(a):
            mine = np.flatnonzero(a == centre)
            found, times = np.unique(keys.take(pa.array(mine)).flatten().to_numpy(), return_counts=True)
            many = (times > 1) & (times * FREQUENT >= len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(many.sum(), centre)), pa.array(found[many]), pa.array(times[many])], names=["a", "key", "times"])


def _first_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, apart, rest) for the first differences of each member: how many it has, and how many follow this one."""
    for batch in batches:
        frequent, order = None, {}
        out = []
        for b, least, keys, now in zip(batch.column("b").to_pylist(), batch.column("least").to_pylist(), batch.column("keys"), batch.column("frequent"), strict=True):
            if now != frequent:
                frequent = now
                order = {x["key"]: x["times"] for x in now.as_py() or ()}
            keys = keys.values.to_numpy()
            times = np.array([order.get(x, 0) for x in keys.tolist()], np.int64)
            keys = keys[np.lexsort((keys, times))][: len(keys) - least + 1]
            out.append((keys, np.full(len(keys), b), np.full(len(keys), len(times)), len(times) - 1 - np.arange(len(keys))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["key", "id", "apart", "rest"])


def _shared_first(a: np.ndarray, b: np.ndarray, slot: int) -> np.ndarray:
    """Whether ``slot`` is the first key that each of ``a`` shares with each of ``b``."""
    differ = (a[:, None] != b[None]).reshape(len(a), len(b), CHUNKS, WIDTH)
    by_chunk = differ.sum(3, dtype=np.int8)
    chunk = slot // WIDTH
    first = (by_chunk[:, :, chunk] <= 1) & (by_chunk[:, :, :chunk] > 1).all(2)
    wrong = np.where(by_chunk[:, :, chunk] == 1, differ[:, :, chunk].argmax(2), 0)
    return first & (wrong == slot % WIDTH)


class _Block:
    """The rows of one comparison: those asked about, and those they are compared with."""

    def __init__(self, table: pa.Table):
        self.asked = np.asarray(table.column("asked").to_numpy(zero_copy_only=False), bool)
        self.ids, self.comp, self.n = table.column("id").to_numpy(), table.column("comp").to_numpy(), table.column("n").to_numpy()
        self.slot = int(np.uint64(table.column("key")[0].as_py() & 63))
        if self.slot == DIFFERENCE:
            self.apart, self.rest = table.column("apart").to_numpy(), table.column("rest").to_numpy()
        else:
            self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        self.q, self.r = np.flatnonzero(self.asked), np.flatnonzero(~self.asked)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of different components whose sizes and differences allow a link, a few askers at a time."""
        for at in range(0, len(self.q), 32):
            mine = self.q[at : at + 32]
            n, m = self.n[mine][:, None], self.n[self.r][None]
            may = (self.comp[mine][:, None] != self.comp[self.r][None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if self.slot != DIFFERENCE:
                may &= _shared_first(self.sig[mine], self.sig[self.r], self.slot)
            else:  # this is the first difference that they share, or they meet under that one; the shared ones are among the rest
                shared = 1 + np.minimum(self.rest[mine][:, None], self.rest[self.r][None])
                apart = self.apart[mine][:, None] + self.apart[self.r][None] - 2 * shared
                may &= (100 + percent) * apart <= (100 - percent) * (n + m)
            i, j = np.nonzero(may)
            yield mine[i], self.r[j]


def _involved(table: pa.Table, percent: int) -> pa.Table:
    """The block's rows that may be linked to another component."""
    block = _Block(table)
    keep = np.zeros(table.num_rows, bool)
    for i, j in block.pairs(percent):
        keep[i] = keep[j] = True
    return table.filter(pa.array(keep))


def _common(sets: list[np.ndarray], q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``q`` with those at ``r``."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    use = times[place] > 1
    place, owner = shared[place[use]], owner[use]
    out = np.zeros((len(q), len(r)), np.int64)
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, BITS):
        here = (place >= at) & (place < at + BITS)
        bits = np.zeros((len(sets), -(-min(BITS, int(shared[-1]) + 1 - at) // 64) * 64), bool)
        bits[owner[here], place[here] - at] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k, i in enumerate(q):
            out[k] += np.bitwise_count(packed[i] & packed[r]).sum(1, dtype=np.int64)
    return out


def _settle(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links of one block, confirmed on the full sets: enough of them to join whatever its links join."""
    block = _Block(table)
    sets = [x for _, d, o in text_chunks(table.select(["text"]).to_batches()) for x in shingle_sets(d, o, size)]
    n = np.array([len(x) for x in sets])
    both = dict(zip(block.q.tolist(), _common(sets, block.q, block.r), strict=True))
    column = np.zeros(len(n), np.int64)
    column[block.r] = np.arange(len(block.r))
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    a, b = [], []
    for i, j in block.pairs(percent):
        common = np.array([both[x][y] for x, y in zip(i.tolist(), column[j].tolist(), strict=True)], np.int64)
        linked = 100 * common >= percent * (n[i] + n[j] - common)
        for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
            u, v = root(int(block.comp[x])), root(int(block.comp[y]))
            if u != v:
                joined[u] = v
                a.append(block.ids[x])
                b.append(block.ids[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    full = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b")


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    return _with_texts(pairs, texts).mapInArrow(lean(lambda it: _confirm(it, size, percent)), "a long, b long")


def _split(crowded: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the members of crowded buckets (key, id) with a centre, and the buckets of their differences (key, id, apart, rest)."""
    weights = crowded.groupBy("id").agg(F.count("*").alias("weight"))
    centres = materialize(crowded.join(weights, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("a"), F.count("*").alias("n")), "centres")
    pairs = join_counted(crowded, centres, ["key"]).where("a <> id").select("a", F.col("id").alias("b")).distinct()
    met = materialize(_with_texts(pairs, texts).mapInArrow(lean(lambda it: _differences(it, size, percent)), "a long, b long, linked boolean, least long, keys array<long>"), "differences")
    members = met.groupBy("a").agg(F.count("*").alias("n"))
    times = met.mapInArrow(lean(_frequent), "a long, key long, times long").groupBy("a", "key").agg(F.sum("times").alias("times"))
    frequent = times.join(members, "a").where(F.col("times") * FREQUENT >= F.col("n")).groupBy("a").agg(F.collect_list(F.struct("key", "times")).alias("frequent"))
    known = materialize(members.join(frequent, "a", "left"), "frequent")
    rows = materialize(join_counted(met, known, ["a"]).select("b", "least", "keys", "frequent").mapInArrow(lean(_first_differences), "key long, id long, apart long, rest long"), "firsts")
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    found = materialize(met.where("linked").select("a", "b"), "links")
    buckets = materialize(join_counted(rows, shared, ["key"]).drop("n"), "split")
    discard(centres, met, known, rows, shared)
    return found, buckets


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, lead (whether the row's doc_id and text are the first of its group)."""
    spark = docs.sparkSession
    ship_code(spark)
    text = valid_text()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    sketches = materialize(base.mapInArrow(lean(lambda it: _sketch(it, size)), "doc_id long, h long, n_shingles long, d1 long, d2 long, sig binary"), "sketches")
    linked = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    own = linked.groupBy("n_shingles", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("one"), F.min("sig").alias("sig"))
    classes = materialize(own.withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = materialize(classes.select("id", "sig").mapInArrow(lean(_keys), "key long, id long"), "keys")
    hubs = materialize(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    members = materialize(join_counted(keyed, hubs, ["key"]).select("key", "id", "hub", "n"), "members")
    discard(keyed, hubs)
    wanted = members.select("id").distinct().join(classes.select("id", "one.*"), "id")
    texts = materialize(base.join(wanted, ["doc_id", "h"]).groupBy("id").agg(F.min("text").alias("text")), "texts")

    is_crowded = F.col("n") > BLOCK
    first = members.where(~is_crowded & (F.col("id") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links1 = materialize(_links(first, texts, size, percent), "links")
    buckets = members.where(~is_crowded).select("key", "id", F.lit(0).cast("long").alias("apart"), F.lit(0).cast("long").alias("rest"))
    if not members.where(is_crowded).isEmpty():
        found, differing = _split(members.where(is_crowded).select("key", "id"), texts, size, percent)
        links1, buckets = links1.unionAll(found), buckets.unionAll(differing)
    comp = materialize(components(links1.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    facts = classes.select("id", "sig", F.col("n_shingles").alias("n")).join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    has_sig = F.col("key").bitwiseAND(63) != DIFFERENCE
    placed = materialize(buckets.join(facts, "id").withColumn("sig", F.when(has_sig, F.col("sig"))), "placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("n").alias("weight")).where("lo <> hi").select("key", "n", "weight")
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    largest = by_comp.groupBy("key").agg(F.max(F.struct("rows", "comp", "weight")).alias("big")).select("key", "big")
    blocks = lambda rows, weight: F.greatest(F.ceil(rows / BLOCK), F.ceil(weight / BLOCK_SHINGLES)).cast("int")
    plan = open_keys.join(largest, "key").select("key", "n", F.col("big.comp").alias("big"), blocks(F.col("n"), F.col("weight")).alias("nr"), blocks(F.col("n") - F.col("big.rows"), F.col("weight") - F.col("big.weight")).alias("nq"))
    spread = join_counted(placed.withColumnRenamed("n", "size"), materialize(plan, "open"), ["key"]).drop("n").withColumnRenamed("size", "n")
    slot = F.abs(F.xxhash64("id") % F.lit(1 << 40))
    of = lambda q, r, asked: ("key", r.cast("int").alias("r"), q.cast("int").alias("q"), "id", "comp", "n", "sig", "apart", "rest", F.lit(asked).alias("asked"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = spread.withColumn("_q", each("nq")).select(*of(F.col("_q"), slot % F.col("nr"), False))
    asked = spread.where("comp <> big").withColumn("_r", each("nr")).select(*of(slot % F.col("nq"), F.col("_r"), True))
    involved = rows.unionByName(asked).groupBy("key", "r", "q").applyInArrow(lambda t: _involved(t, percent), "key long, r int, q int, id long, comp long, n long, sig binary, apart long, rest long, asked boolean")
    involved = materialize(involved, "involved")
    links2 = materialize(involved.join(texts, "id").groupBy("key", "r", "q").applyInArrow(lambda t: _settle(t, size, percent), "a long, b long"), "links")
    discard(members, texts, comp, placed, involved)

    final = components(links1.unionAll(links2).select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id")
    known = materialize(classes.drop("sig").join(final, "id", "left").withColumn("component", F.coalesce("component", "id")), "known")
    leads = known.groupBy("component").agg(F.min("one").alias("lead"))
    named = materialize(known.join(leads, "component").select("n_shingles", "d1", "d2", "n", "lead"), "named")
    rest = sketches.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("lead"))
    met = join_counted(linked, named, ["n_shingles", "d1", "d2"]).select("doc_id", "h", "n_shingles", F.col("lead.doc_id").alias("component_id"), (F.struct("doc_id", "h") == F.col("lead")).alias("lead"))
    return met.unionByName(rest)


def groups(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): the group of near-duplicates that it belongs to.

    Sets are the distinct ``size``-word shingles of the text with A-Z in lower case, words being cut at ASCII blanks;
    a text of fewer words is one shingle.  Rows are linked if 100 * intersection >= percent * union.  Returns doc_id,
    n_shingles, component_id (least doc_id that links reach), kept (doc_id = component_id).
    Null or blank texts have no shingles and no links; rows without doc_id are not linked either (component_id null,
    kept true).  Repeated rows each have a result.  Rows that share a doc_id but differ in text are linked by their own
    texts, each with the group of its text.  Texts are read whole, however long; bytes that are no UTF-8 read as U+FFFD.
    Empty tables give no rows; other columns are ignored.
    """
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: the one with the least doc_id.

    A document is a doc_id and a text: rows that repeat both stay or go together, and a doc_id with another text is judged
    by that text (of two texts of one doc_id in one group, the one with the least hash stays).  Rows without doc_id, and null
    and blank texts, are in no group and stay.  Long texts, bytes that are no UTF-8 and empty tables are as in ``groups``.
    """
    gone = _grouped(docs.select("doc_id", "text"), size, percent).where("NOT lead").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__id"]) & (F.xxhash64(F.make_valid_utf8(docs["text"].cast("string"))) == gone["__h"]), "left_anti")
