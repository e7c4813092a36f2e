"""Best-fit packing of tokenised documents into fixed-length sequences, in a tree of rounds.

Round 0 packs what a task reads, best fit in order of decreasing length.  Then bins travel, whole, as items: the open
bins of FAN_IN neighbours meet in one group of the next round, are packed again by best fit, and so on to one group.

Few bins need to travel, and this loses none.  Best fit leaves at most one bin that is half full or less, as two would
have been one; and two fuller ones never fit together.  So at most FAN_IN bins receive anything in a group of a round,
and FAN_IN * ROUNDS on the way up.  An emptier bin takes whatever a fuller one can, so handing on the emptiest
FAN_IN * ROUNDS fuller ones, and the one that is not, leaves as many sequences as handing on all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean, materialize, ship_code

CAPACITY = 4096
#: Id that ends every document.
SEPARATOR = 1
#: Tasks or groups whose open bins meet in one group of the next round, and rounds that any job needs at most.
FAN_IN, ROUNDS = 8, 8

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_COLUMNS = [f.name for f in _PIECE][:5]
BIN_SCHEMA = "sequence_id long, part long, size int, final boolean, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by decreasing size, each into the open bin with the least room that suffices."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r free places
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def _round(pieces: pa.StructArray, ends: np.ndarray, capacity: int, level: int, part: int) -> Iterator[pa.RecordBatch]:
    """Bins of one task or group, the emptiest first; all are final but those that can be of use further up.

    Items are runs of ``pieces``, up to each of ``ends``.
    """
    length = pieces.field("length").to_numpy()
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(length)])
    sizes = upto[ends] - upto[first]
    bins = best_fit(sizes.tolist(), capacity)
    size = np.array([sizes[b].sum() for b in bins], np.int64)
    order = np.argsort(size, kind="stable")
    final = (size[order] == capacity) | (np.arange(len(bins)) > FAN_IN * ROUNDS)
    for at in range(0, len(bins), 256):
        mine = order[at : at + 256]
        rows = [np.concatenate([np.arange(first[i], ends[i]) for i in bins[b]]) for b in mine.tolist()]
        stops = np.cumsum([len(x) for x in rows])
        rows = np.concatenate(rows)
        begin = np.cumsum(length[rows]) - length[rows]
        offset = begin - np.repeat(np.cumsum(size[mine]) - size[mine], np.diff(stops, prepend=0))
        taken = pieces.take(pa.array(rows))
        placed = pa.StructArray.from_arrays([*(taken.field(c) for c in _COLUMNS), pa.array(offset)], fields=list(_PIECE))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), placed)
        ids = ((level << 58) | (part << 32)) + np.arange(at, at + len(mine))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(mine), part)), pa.array(size[mine].astype(np.int32)), pa.array(final[at : at + 256]), lists], names=["sequence_id", "part", "size", "final", "pieces"])


def _pieces(batches: Iterator[pa.RecordBatch], c: bpe.Codec, capacity: int, separator: int) -> pa.StructArray:
    tail, parts = np.array([separator], "<u4").tobytes(), []
    for doc_ids, all_ids in bpe.encoded(batches, c):
        row, out = [], []
        for r, ids in enumerate(all_ids):
            ids += tail
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                row.append(r)
                out.append((k, at // 4, len(part) // 4, bpe.crc32(part)))
        cols = [doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(_PIECE)[1:5], strict=True))] if out else []
        if cols:
            parts.append(pa.StructArray.from_arrays(cols, fields=list(_PIECE)[:5]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(_PIECE)[:5]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns, per piece: doc_id, piece (from 0), start (tokens of its document before it), length, ids_crc32,
    sequence_id, offset.  A row's tokens are those of its whole text and then ``separator``; only longer ones are cut.
    Null text is empty: the separator alone.  Repeated rows are packed each; equal sizes go in the order read; an empty
    table gives no rows; other columns are ignored.  Texts are read whole, however long; bytes that are no UTF-8 read
    as U+FFFD.
    """
    spark = docs.sparkSession
    ship_code(spark)
    spec = spark.sparkContext.broadcast(bpe.spec_of(path))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(batches, bpe.codec(spec.value), capacity, separator)
        if len(pieces):
            yield from _round(pieces, np.arange(1, len(pieces) + 1), capacity, 0, TaskContext.get().partitionId())

    def merge(level: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            lists = group.column("pieces").combine_chunks()
            ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
            return pa.Table.from_batches(_round(lists.flatten(), ends, capacity, level, key[0].as_py()))

        return run

    bins = materialize(bpe._columns(docs).mapInArrow(lean(first), BIN_SCHEMA), "bins")
    parts = (bins.agg(F.max("part")).first()[0] or 0) + 1
    if parts > FAN_IN**ROUNDS:
        raise ValueError("more tasks than the rounds can join")
    done, level = [bins.where("final")], 0
    while parts > 1:
        level, parts = level + 1, -(-parts // FAN_IN)
        waiting = bins.where("NOT final").withColumn("part", F.floor(F.col("part") / FAN_IN))
        bins = materialize(waiting.groupBy("part").applyInArrow(merge(level), BIN_SCHEMA), "bins")
        done.append(bins.where("final"))
    done.append(bins.where("NOT final"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
