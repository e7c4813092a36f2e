"""Exact removal of repeated lines and passages across the corpus, keeping the earliest occurrence.

Units are normalised and known by their digests.  There are two sorts: lines, and paragraphs of whole clauses.  A
paragraph starts at any clause and ends with the first clause that brings it to ``passage_words`` words, so a passage
that was set into the middle of another text is met, wherever its lines were broken.  A line is a unit from ``min_words``
words on.  Every later occurrence of a unit goes; what a document loses never depends on how often others hold it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, join_counted, materialize, ship_code, valid_text

#: Least words of a line.  Shorter ones ("The.", "Page 3") meet by chance.
MIN_WORDS = 5
#: Least words of a paragraph: a passage of over 50 words that starts and ends within clauses still has so many in whole ones.
#: The registered query takes it as the least length of a line, too.
PASSAGE_WORDS = 25
#: Bytes of a normalised unit that count as a word where blanks are rare (eight letters of a script of three bytes each).
WORD_BYTES = 24
#: A clause ends behind these before a blank, behind wide marks, and at the end of a line.
_CLAUSE = re.compile(r"[.,;:!?…]+(?=[\x20\x09-\x0D])|[。，、；：！？]+|\n")
UNIT_SCHEMA = "doc_id long, h long, start int, stop int, n int, d1 long, d2 int"


def normalise(text: str) -> tuple[bytes, int]:
    """(A-Z in lower case, runs of ASCII blanks as one space, none at the ends; number of words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(words), len(words)


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    part = text[start:stop]
    return stop - len(part.lstrip(BLANKS)), start + len(part.rstrip(BLANKS))


def _pieces(text: str, ends: Iterator[int]) -> list[tuple[int, int, bytes, int]]:
    """(start, stop, normal form, weight) of the parts of ``text`` between ``ends`` that have a word."""
    out, at = [], 0
    for end in [*ends, len(text)]:
        form, n = normalise(text[at:end])
        if n:
            out.append((*_trimmed(text, at, end), form, max(n, len(form) // WORD_BYTES)))
        at = end
    return out


def units(text: str, min_words: int, passage_words: int | None) -> list[tuple[int, int, bytes]]:
    """(start, stop, normal form) of the paragraphs, and of the lines that stand elsewhere."""
    out = []
    if passage_words is not None and (clauses := _pieces(text, (m.end() for m in _CLAUSE.finditer(text)))):
        whole = b" ".join(c[2] for c in clauses)
        lengths = np.array([len(c[2]) for c in clauses], np.int64)
        begin = (np.cumsum(lengths + 1) - lengths - 1).tolist()
        weight = np.array([c[3] for c in clauses], np.int64)
        total = np.cumsum(weight)
        last = np.searchsorted(total, total - weight + passage_words).tolist()
        out = [(clauses[i][0], clauses[j][1], whole[begin[i] : begin[j] + len(clauses[j][2])]) for i, j in enumerate(last) if j < len(clauses)]
    known = {(s, e) for s, e, _ in out}
    lines = _pieces(text, (m.end() for m in re.finditer("\n", text)))
    return out + [(s, e, form) for s, e, form, w in lines if w >= min_words and (s, e) not in known]


def _units(batches: Iterator[pa.RecordBatch], min_words: int, passage_words: int | None) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = ["doc_id", "h", "start", "stop", "n", "d1", "d2"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            cut = batch.slice(at, 256).to_pydict()
            rows: list[tuple] = []
            digests: list[bytes] = []
            for doc_id, text, h in zip(cut["doc_id"], cut["text"], cut["h"], strict=True):
                every = units(text or "", min_words, passage_words)
                for k, (start, stop, form) in enumerate(every):
                    digests.append(hashlib.blake2b(form, digest_size=12).digest())
                    rows.append((doc_id, h, start, stop, len(every) if k == 0 else None))
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            d = np.frombuffer(b"".join(digests), [("d1", "<i8"), ("d2", "<i4")])
            out = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(np.ascontiguousarray(d["d1"])), pa.array(np.ascontiguousarray(d["d2"]))], names=names)
            yield from (out.slice(k, 16384) for k in range(0, max(1, out.num_rows), 16384))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            cut = batch.slice(at, 1024)
            spans = [merge([(s["start"], s["stop"]) for s in x or []]) for x in cut.column("gone").to_pylist()]
            cols = [[len(x) for x in spans], [sum(b - a for a, b in x) for x in spans]]
            listed = [[{"start": a, "stop": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("n_units"), *(pa.array(c, pa.int64()) for c in cols), pa.array(listed, _SPANS)], names=["doc_id", "n_units", "n_removed", "removed_chars", "spans"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int | None = None) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): the lines and passages to remove.

    Units are the lines of at least ``min_words`` words and, unless it is None, paragraphs of ``passage_words``.
    Returns doc_id, n_units, n_removed (spans), removed_chars, spans (array of (start, stop) in code points of
    the text, in order, none touching the next).  A unit goes if its normal form occurs earlier, by (doc_id,
    hash of the text, start, stop); so the earliest stays, and nothing that overlaps it goes on its account.  In a script without
    blanks, WORD_BYTES bytes count as a word.  Null text reads as empty, bytes that are no UTF-8 as U+FFFD; a null
    doc_id ranks first; repeated rows (same doc_id and text) are one document and get the same result, documents with
    one doc_id but different texts are two; texts are read whole, however long.  Empty tables give no rows; other
    columns are ignored.
    """
    ship_code(docs.sparkSession)
    text = valid_text()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    found = materialize(base.mapInArrow(lambda it: _units(it, min_words, passage_words), UNIT_SCHEMA), "units")
    here = F.struct("doc_id", "h", "start", "stop")
    groups = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1")
    repeats = materialize(groups, "repeats")
    clear = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("start") < F.col("first.stop")))
    late = join_counted(found.drop("n"), repeats, ["d1", "d2"]).where(clear)
    gone = late.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    counted = found.where("n IS NOT NULL").groupBy("doc_id", "h").agg(F.max("n").alias("n_units"))
    on = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    full = base.select("doc_id", "h")
    full = full.join(counted, on(full, counted), "left").select(full["doc_id"], full["h"], F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))
    full = full.join(gone, on(full, gone), "left").select(full["doc_id"], "n_units", "gone")
    out = "doc_id long, n_units long, n_removed long, removed_chars long, spans array<struct<start:int,stop:int>>"
    return full.mapInArrow(_merged, out)


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; each takes the newline that follows it, too."""
    text, out, at = text or "", [], 0
    for start, stop in spans:
        out.append(text[at:start])
        at = stop + (text[stop : stop + 1] == "\n")
    return "".join([*out, text[at:]])
