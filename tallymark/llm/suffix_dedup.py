"""Removal of repeated byte strings: a radix sort of suffixes, most significant digit first, of limited depth.

Two suffixes matter to each other only if their first LENGTH bytes are equal, so the sort stops there, and only its
classes of equal prefixes are needed, not their order.  A suffix leaves the sort as soon as its class has one member.
The digits are chosen so that nearly all suffixes leave before they become rows:

* digit 1 is the least GRAM-byte string (by hash) within the LENGTH bytes.  Equal prefixes have the same one at the
  same place, and neighbouring suffixes share it, so that a run of suffixes is one row.  Runs whose digit occurs once
  in the corpus are done: no prefix in them is repeated.
* digit 2 is the whole text of the run.  Runs that agree in it are repeated from end to end.
* digit 3, for runs that share digit 1 with others of a different digit 2 (at the ends of repeats), is the string that
  all suffixes of one stretch of STRETCH starts have in common; stretches that share it with no other run are done.
* digit 4 is the rest of the single suffix.

Classes are counted, never gathered, and the rows of a class that is hot meet its count where they are, so a string
that a third of all documents hold is no single task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, discard, join_counted, lean, materialize, mix64, prefix_hash, ship_code, span_hash, text_chunks, valid_text

LENGTH = 200
GRAM = 48
STRETCH = 16
_RUNS = "dk long, h long, pos long, kh long, c long"


def _anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """For each start, the place of the least value among ``window`` values from there; the first of equals."""
    n = len(grams) - window + 1
    bits = np.uint64(max(24, len(grams).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(key) // window)
    padded = np.full(rows * window, np.uint64((1 << 64) - 1))
    padded[: len(key)] = key
    grid = padded.reshape(rows, window)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(after[:n], before[window - 1 : window - 1 + n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor, digit 1, digit 2) of all runs; places count from the row's first byte."""
    empty = np.empty(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return empty, empty, empty, empty, empty, empty
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    anchor = _anchors(grams, length - gram + 1)
    start = np.arange(n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = start + length <= offsets[row + 1]
    start, anchor, row = start[inside], anchor[inside], row[inside]
    if not len(start):
        return empty, empty, empty, empty, empty, empty
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    s, e, a, r = start[first], start[last], anchor[first], row[first]
    return r, s - offsets[r], e - offsets[r], a - offsets[r], grams[a].view(np.int64), span_hash(prefix, s, e + length).view(np.int64)


def packed(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns and ``z``, the text compressed: what crosses a shuffle is a third smaller than under the shuffle's own codec."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                z = [press(t.encode("utf-8", "surrogatepass")) for t in cut.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in columns), pa.array(z, pa.binary())], names=[*columns, "z"])

    return rows.select(*columns, "text").mapInArrow(lean(run), f"{schema}, z binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows with ``text`` (string) in place of ``z``."""
    press = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        names = ["text" if c == "z" else c for c in batch.schema.names]
        for at in range(0, batch.num_rows, 64):
            cut = batch.slice(at, 64)
            texts = pa.array([press(z) for z in cut.column("z").to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "z" else cut.column(c) for c in cut.schema.names], names=names)


def _find_runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for cut, data, offsets in text_chunks(batches):
        # a long text in overlapping windows: a run that a window's end cuts is two runs, which later digits compare
        step = CHUNK_BYTES if cut.num_rows == 1 else max(1, len(data))
        for at in range(0, max(1, len(data) - length + 1), step):
            part = data[at : at + step + length - 1]
            r, s, e, a, kh, c = runs(part, offsets if len(part) == len(data) else np.array([0, len(part)]), length, gram)
            dk, h = (cut.column(k).to_numpy()[r] for k in ("dk", "h"))
            pos = ((s + at) << 16) | ((a - s) << 8) | (e - s)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (dk, h, pos, kh, c)], names=["dk", "h", "pos", "kh", "c"])


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = pos >> 16
    return s, s + ((pos >> 8) & 255), s + (pos & 255)


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(dk, h, kh, single, text, digit, lo, dist): the runs of each document, cut into stretches of starts.

    A stretch holds the starts at certain distances from the anchor; ``text`` is its own bytes, ``lo`` its first start
    and ``dist`` the distance from there to the anchor.  ``digit`` is what all of its possible suffixes have in common.
    """
    for cut, data, offsets in text_chunks(unpacked(batches)):
        ends = cut.column("ends")
        sizes = np.diff(ends.offsets.to_numpy())
        flat_ends = ends.flatten()
        run_doc = np.repeat(np.arange(len(sizes)), sizes)
        s, a, e = _unpack(flat_ends.field("pos").to_numpy())
        n_parts = (a - s) // STRETCH - (a - e) // STRETCH + 1
        run = np.repeat(np.arange(len(s)), n_parts)
        k = np.arange(len(run)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        block = (a - e)[run] // STRETCH + k
        far, near = (block + 1) * STRETCH - 1, block * STRETCH
        lo, hi = np.maximum(s[run], a[run] - far), np.minimum(e[run], a[run] - near)
        base = offsets[run_doc[run]]
        with np.errstate(over="ignore"):
            shared = span_hash(prefix_hash(data), base + a[run] - near, base + a[run] - far + length)
            digit = mix64(shared + block.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        body = data.tobytes()
        texts = [body[x:y] for x, y in zip((base + lo).tolist(), (base + hi + length).tolist(), strict=True)]
        doc, pick = pa.array(run_doc[run]), pa.array(run)
        cols = [cut.column("dk").take(doc), cut.column("h").take(doc), flat_ends.field("kh").take(pick), flat_ends.field("single").take(pick), pa.array(texts, pa.binary()), pa.array(digit), pa.array(lo), pa.array(a[run] - lo)]
        out = pa.RecordBatch.from_arrays(cols, names=["dk", "h", "kh", "single", "text", "digit", "lo", "dist"])
        yield from (out.slice(at, 8192) for at in range(0, max(1, out.num_rows), 8192))


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(kh, w, dk, h, start, single): each suffix of the stretches, by its own last digit."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            cut = batch.slice(at, 2048)
            raw = cut.column("text").to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            base = np.concatenate([[0], np.cumsum(sizes)])
            data = np.frombuffer(b"".join(raw), np.uint8)
            n = sizes - length + 1
            row = np.repeat(np.arange(len(raw)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = base[row] + k
            dist = cut.column("dist").to_numpy()[row] - k
            with np.errstate(over="ignore"):
                w = mix64(span_hash(prefix_hash(data), begin, begin + length) + dist.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)
            take = lambda name, row=row, cut=cut: cut.column(name).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([take("kh"), pa.array(w), take("dk"), take("h"), pa.array(cut.column("lo").to_numpy()[row] + k), take("single")], names=["kh", "w", "dk", "h", "start", "single"])


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, dk, h): dk and h name a document in joins; rows that share both have the same id and text."""
    text = F.coalesce(valid_text(), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(-(2**63))).alias("dk"), F.xxhash64(text).alias("h"))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(dk, h, ranges): for every document with repeated strings, the [from, to) byte ranges that they cover, unmerged."""
    if not 0 < gram <= length <= gram + 255:
        raise ValueError("length must be from gram to gram + 255")
    spark = docs.sparkSession
    ship_code(spark)
    base = docs.select("dk", "h", "text")
    found = materialize(base.mapInArrow(lean(lambda it: _find_runs(it, length, gram)), _RUNS), "runs")
    digit1 = materialize(found.groupBy("kh").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1").select("kh", "n", (F.col("lo") != F.col("hi")).alias("contested")), "digits")
    live = materialize(join_counted(found, digit1, ["kh"]).drop("n"), "runs")
    discard(found, digit1)
    first, last = F.shiftright("pos", 16), F.shiftright("pos", 16) + F.col("pos").bitwiseAND(F.lit(255))
    whole = lambda d: d.select("dk", "h", first.alias("a"), (last + length).alias("b"))
    contested = live.where("contested")
    digit2 = materialize(contested.groupBy("kh", "c").agg(F.count("*").alias("n"), F.min(F.struct("dk", "h", "pos")).alias("one")), "runs")
    ranges = whole(live.where("NOT contested")).unionAll(whole(join_counted(contested, digit2.where("n > 1").select("kh", "c", "n"), ["kh", "c"])))

    ends = digit2.select("one.*", "kh", (F.col("n") == 1).alias("single")).groupBy("dk", "h").agg(F.collect_list(F.struct("pos", "kh", "single")).alias("ends"))
    texts = packed(base, "dk", "h").join(ends, ["dk", "h"]).select("dk", "h", "z", "ends")
    parts = materialize(texts.mapInArrow(lean(lambda it: _stretches(it, length)), "dk long, h long, kh long, single boolean, text binary, digit long, lo long, dist long"), "stretches")
    digit3 = materialize(parts.groupBy("kh", "digit").agg(F.count("*").alias("n")).where("n > 1"), "digits")
    suffixes = materialize(join_counted(parts, digit3, ["kh", "digit"]).select("dk", "h", "kh", "single", "text", "lo", "dist").mapInArrow(lean(lambda it: _suffixes(it, length)), "kh long, w long, dk long, h long, start long, single boolean"), "suffixes")
    discard(parts, digit3)
    digit4 = suffixes.groupBy("kh", "w").agg(F.count("*").alias("n")).where("n > 1").select("kh", "w")
    alone = suffixes.where("single").join(digit4, ["kh", "w"]).select("dk", "h", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    every = ranges.unionAll(alone)
    return every.groupBy("dk", "h").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in unpacked(batches):
        kept, spans, sizes = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            body = text.encode("utf-8", "surrogatepass")
            gone = merge([(r["a"], r["b"]) for r in ranges or []])
            out, free = [], 0
            for a, b in gone:
                out.append(body[free:a])
                free = b
            kept.append(b"".join([*out, body[free:]]))
            spans.append([{"start": a, "stop": b} for a, b in gone])
            sizes.append(len(body))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): the text's UTF-8 bytes without those in repeated strings.

    A string is ``length`` bytes; it is repeated if it starts at two places or more, in one document or several,
    overlapping or not, all judged on the input.  Returns doc_id, n_bytes, spans (array of (start, stop) in bytes,
    maximal runs), kept (binary).  Null text is empty; texts shorter than ``length`` stay as they are; repeated rows
    are documents of their own, so all of what is long enough in them goes; null doc_ids are allowed; bytes that are no
    UTF-8 read as U+FFFD; long texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs)
    found = repeated(rows, length, gram)
    return packed(rows, "doc_id", "dk", "h").join(found, ["dk", "h"], "left").select("doc_id", "z", "ranges").mapInArrow(lean(_cut), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated strings cut out of ``text``; what is left of a character that a cut splits goes too.

    Rows are judged as in ``remove``: null texts stay null, rows that repeat lose all that is long enough in them.
    """
    names = docs.columns
    own = keyed(docs).select("dk", "h", "text", "doc_id")
    found = repeated(own, length, gram)
    text = F.coalesce(valid_text(), F.lit(""))
    rows = docs.withColumn("text", valid_text()).withColumns({"__dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__h": F.xxhash64(text)})
    found = found.select(F.col("dk").alias("__dk"), F.col("h").alias("__h"), F.col("ranges").alias("__ranges"))
    rows = rows.join(found, ["__dk", "__h"], "left").select(*names, "__ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("__ranges").to_pylist(), strict=True):
                if ranges and text:
                    body, out, free = text.encode("utf-8", "surrogatepass"), [], 0
                    for a, b in merge([(r["a"], r["b"]) for r in ranges]):
                        out.append(body[free:a])
                        free = b
                    text = b"".join([*out, body[free:]]).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(lean(run), docs.schema)
