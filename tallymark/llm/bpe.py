"""Byte-pair encoding and decoding, with a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves' left ends: leaf j holds the rank of the merge of symbol j with the next live symbol,
combined with j, so that the root is the leftmost merge of the lowest rank.  A merge changes three leaves; each is
updated along its path to the root.  Many distinct words go through the same steps at once, a row of a matrix each.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, ship_code, valid_text

#: Distinct words, and pieces of words, whose ids a worker remembers; beyond it, it starts anew.
CACHE_WORDS = 600_000
#: Rows of text that are encoded together.
ROWS = 256
#: Matrix cells that go through the tree at once.
CELLS = 1 << 20

_FRACTIONS = "²³¹¼½¾"
#: For texts below U+0250 without odd blanks: the word pattern in terms of the standard library's classes.
_PLAIN_WORD = re.compile(rf"[^\W\d_{_FRACTIONS}]+|'(?:s|t|re|ve|m|ll|d)|[\d{_FRACTIONS}]|(?:[^\s\w]|_)+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [c for _, c in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + i)) for i, b in enumerate(rest)])]


class PairTable:
    """rank of (left, right), or ``none``: two hash tables without chains, found by trying multipliers."""

    BITS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray, none: int):
        self.none = none
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        rank = np.arange(len(keys), dtype=np.int64)
        draw = np.random.default_rng(0)
        self.shift = np.uint64(64 - self.BITS)
        while True:
            self.a, self.b = (draw.integers(1, 1 << 63, 2, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
            h = self._slot(keys, self.a)
            _, first = np.unique(h, return_index=True)
            later = np.setdiff1d(rank, first)
            h2 = self._slot(keys[later], self.b)
            if len(np.unique(h2)) == len(h2):
                break
        empty = np.uint64((1 << 64) - 1)
        self.key = np.full((2, 1 << self.BITS), empty)
        self.val = np.full((2, 1 << self.BITS), none, np.int64)
        self.key[0, h[first]], self.val[0, h[first]] = keys[first], rank[first]
        self.key[1, h2], self.val[1, h2] = keys[later], rank[later]

    def _slot(self, keys: np.ndarray, by: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * by) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        h, h2 = self._slot(keys, self.a), self._slot(keys, self.b)
        return np.where(self.key[0, h] == keys, self.val[0, h], np.where(self.key[1, h2] == keys, self.val[1, h2], self.none))


class Codec:
    """Encoder and decoder for a tokenizer file of the kind with word ends: NFC, lower case, blanks dropped."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model = t["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        end = model["end_of_word_suffix"] or ""
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]), len(merges))
        self.merged = np.array([vocab[a + b] for a, b in merges] + [0])
        chars = byte_chars()
        self.inner, self.last = np.array([vocab[c] for c in chars]), np.array([vocab[c + end] for c in chars])
        self.byte_of = {c: i for i, c in enumerate(chars)}
        self.special = {x["content"]: x["id"] for x in t["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.spec, self._exact = spec, None
        self.whole: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}

    # -- words ---------------------------------------------------------------------------------------------------
    def words(self, text: str) -> tuple[bool, list[str]]:
        """(False, the blank-separated words of the lower-cased text), or (True, the pieces that are encoded one by one).

        Pieces never cross blanks, so words do where the text has plain characters and no special tokens.
        """
        if self.cut_special and "<|" in text and len(parts := self.cut_special.split(text)) > 1:
            return True, list(chain.from_iterable([p] if i % 2 else self._pieces(p) for i, p in enumerate(parts)))
        if _NOT_PLAIN.search(text) is None:
            return False, text.lower().split()
        return True, self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if _NOT_PLAIN.search(text) is None:
            return _PLAIN_WORD.findall(text.lower())
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_str(self.spec)
        pieces = self._exact.pre_tokenizer.pre_tokenize_str(self._exact.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    # -- encoding ------------------------------------------------------------------------------------------------
    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.words(t) for t in texts]
        words, pieces = set().union(*(w for exact, w in split if not exact)), set().union(*(w for exact, w in split if exact))
        new = words.difference(self.whole)
        if len(self.whole) + len(new) > CACHE_WORDS:
            self.whole, new = {}, words
        parts = {w: _PLAIN_WORD.findall(w) for w in new}
        pieces.update(*parts.values())
        missing = pieces.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache = {s: self.cache[s] for s in self.special}
            missing = pieces.difference(self.cache)
        self._learn(list(missing))
        get = self.cache.__getitem__
        for w, p in parts.items():
            self.whole[w] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))
        whole = self.whole.__getitem__
        return [b"".join(map(get if exact else whole, w)) for exact, w in split]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        width = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for p in np.unique(width):
            mine = np.flatnonzero(width == p)
            step = max(1, CELLS // int(p))
            for at in range(0, len(mine), step):
                rows = mine[at : at + step]
                for k, ids in zip(rows, self._merge([raw[k] for k in rows], sizes[rows], int(p)), strict=True):
                    self.cache[words[k]] = ids

    def _merge(self, raw: list[bytes], sizes: np.ndarray, p: int) -> list[bytes]:
        n, none = len(raw), self.pairs.none
        cells = np.zeros((n, p), np.uint8)
        live = np.arange(p)[None, :] < sizes[:, None]
        cells[live] = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[cells]
        sym[np.arange(n), sizes - 1] = self.last[cells[np.arange(n), sizes - 1]]
        if p > 1:
            infinite = none * p
            tree = np.full((n, 2 * p), infinite, np.int64)
            pair = (np.arange(p)[None, :] + 1) < sizes[:, None]
            r, c = np.nonzero(pair)
            rank = self.pairs(sym[r, c], sym[r, c + 1])
            tree[r, p + c] = np.where(rank < none, rank * p + c, infinite)
            for node in range(p - 1, 0, -1) if p <= 64 else []:
                np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
            if p > 64:
                lo = p
                while lo > 1:
                    tree[:, lo // 2 : lo] = np.minimum(tree[:, lo : 2 * lo : 2], tree[:, lo + 1 : 2 * lo : 2])
                    lo //= 2
            nxt = np.broadcast_to(np.arange(1, p + 1), (n, p)).copy()
            prv = np.broadcast_to(np.arange(-1, p - 1), (n, p)).copy()
            self._run(tree, sym, nxt, prv, live, sizes, p, infinite)
        out = sym[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _run(self, tree: np.ndarray, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray, live: np.ndarray, sizes: np.ndarray, p: int, infinite: int) -> None:
        none = self.pairs.none

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            node = at + p
            tree[rows, node] = value
            while p > 1 and len(rows) and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def ranked(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            rank = self.pairs(sym[rows, a], sym[rows, b])
            return np.where(rank < none, rank * p + a, infinite)

        rows = np.arange(len(tree))
        while len(rows := rows[tree[rows, 1] < infinite]):
            rank, at = np.divmod(tree[rows, 1], p)
            right = nxt[rows, at]
            after = nxt[rows, right]
            sym[rows, at] = self.merged[rank]
            live[rows, right] = False
            nxt[rows, at] = after
            put(rows, right, infinite)
            has = after < sizes[rows]
            prv[rows[has], after[has]] = at[has]
            value = np.full(len(rows), infinite)
            value[has] = ranked(rows[has], at[has], after[has])
            put(rows, at, value)
            before = prv[rows, at]
            has = before >= 0
            r, b = rows[has], before[has]
            put(r, b, ranked(r, b, at[has]))

    # -- decoding ------------------------------------------------------------------------------------------------
    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by blanks; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist() if i in names])


def codec(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in kept:
        kept[key] = Codec(spec)
    return kept[key]


def spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc ids, token ids) of the rows, ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            cut = batch.slice(at, ROWS)
            yield cut.column("doc_id"), c.encode_all(t or "" for t in cut.column("text").to_pylist())


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of each row's whole text; null text has no ids, bytes that are no UTF-8 read as U+FFFD, repeated rows each have theirs."""
    ship_code(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in encoded(batches, codec(spec.value)):
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)], names=["doc_id", "ids"])

    return _columns(docs).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of each row's ``ids``; null ids decode to the empty text."""
    ship_code(rows.sparkSession)
    spec = rows.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            texts = [c.decode(np.array([i for i in x or [] if i is not None and i >= 0], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: its whole text encoded and decoded again.

    Null text is empty: no tokens, digests of nothing.  Bytes that are no UTF-8 read as U+FFFD; texts are read whole.  Repeated rows each have a result; ties do not arise; an empty
    table gives no rows; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for doc_ids, ids in encoded(batches, c):
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _columns(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
