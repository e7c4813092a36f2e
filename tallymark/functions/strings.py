"""String distances that Spark lacks, as Arrow-batched functions; use them after a join's equality keys only."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def damerau_levenshtein(a: str, b: str) -> int:
    """Unrestricted distance: insert, delete, replace, swap of neighbours with edits between them.

    What both begin and end with costs nothing and is cut off first.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    last_row: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_col = 0
        for j, y in enumerate(b, 1):
            k, m = last_row.get(y, 0), last_col
            if x == y:
                last_col = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last_row[x] = i
    return d[-1][-1]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string and any window of the longer one, windows that hang over its ends included."""
    s, t = sorted((a, b), key=len)
    if not s:
        return 0.0 if t else 100.0
    n = len(s)
    return max(indel_ratio(s, t[max(0, i) : i + n]) for i in range(1 - n, len(t)) if t[max(0, i) : i + n])


def _codes(texts: list[str]) -> np.ndarray:
    """Characters as a table of numbers, a row a text, 0 behind its end."""
    length = max(map(len, texts), default=0) or 1
    return np.array([t.encode("utf-32-le", "surrogatepass").ljust(4 * length, b"\0") for t in texts], f"S{4 * length}").view(np.uint32).reshape(len(texts), length) if texts else np.zeros((0, 1), np.uint32)


class AlikeNames:
    """Whether names reach a ratio (``indel_ratio``), many pairs at a time."""

    def __init__(self, names: list[str], cutoff: float):
        self.names, self.cutoff = names, cutoff
        self.length = np.array([len(x) for x in names], np.int64)
        short = [x if len(x) <= 63 else "" for x in names]
        self.codes = _codes(short)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.length[a], self.length[b]
        out = np.zeros(len(a), bool)
        worth = np.flatnonzero(200.0 * np.minimum(la, lb) >= (self.cutoff - 1e-9) * (la + lb))
        if not len(worth):
            return out
        pairs, back = np.unique(a[worth] * np.int64(len(self.names)) + b[worth], return_inverse=True)
        out[worth] = self._ratio(pairs // len(self.names), pairs % len(self.names))[back] >= self.cutoff
        return out

    def _ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.length[a], self.length[b]
        common = np.zeros(len(a), np.int64)
        long = (la > 63) | (lb > 63)
        for i in np.flatnonzero(long):
            common[i] = common_subsequence(self.names[a[i]], self.names[b[i]])
        s = np.flatnonzero(~long)
        x, y, n = self.codes[a[s]], self.codes[b[s]], la[s].astype(np.uint64)
        full = (np.uint64(1) << n) - np.uint64(1)
        v = full.copy()
        for j in range(int(lb[s].max(initial=0))):
            m = np.zeros(len(s), np.uint64)
            for i in range(int(la[s].max(initial=0))):
                m |= (x[:, i] == y[:, j]).astype(np.uint64) << np.uint64(i)
            u = v & np.where(j < lb[s], m, np.uint64(0)) & full
            v = ((v + u) | (v - u)) & full
        common[s] = la[s] - np.bitwise_count(v)
        return np.where(la + lb > 0, 200.0 * common / np.maximum(la + lb, 1), 100.0)


class Texts:
    """Texts whose unrestricted edit distances (``damerau_levenshtein``) are taken many pairs at a time, within groups that start at ``starts``."""

    #: Cells that are worked on at once, so that they stay in a core's cache.
    CELLS = 1 << 19

    def __init__(self, texts: list[str], starts: np.ndarray):
        self.length = np.array([len(t) for t in texts], np.int64)
        head = len(_common_start(texts))
        cut = []
        for lo, hi in zip(starts, [*starts[1:], len(texts)], strict=True):  # what all begin or end with costs nothing
            own = [t[head:] for t in texts[lo:hi]]
            tail = len(_common_start([t[::-1] for t in own])) if hi - lo > 16 else 0
            cut += [t[: len(t) - tail] for t in own]
        self.codes, self.n = _codes(cut), np.array([len(t) for t in cut], np.int64)
        if len(self.codes) and self.codes.max() < 256:
            self.codes = self.codes.astype(np.uint8)
        self.codes = np.ascontiguousarray(self.codes.T)
        self.scratch: tuple | None = None

    def edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        step = max(256, self.CELLS // (len(self.codes) + 1) ** 2)
        for at in range(0, len(a), step):
            out[at : at + step] = self._edits(a[at : at + step], b[at : at + step])
        return out

    def _edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All cells of all pairs.  A swap with letters between on both sides never costs less than replacing them, so they
        are on one side only, and the nearest place to swap with is carried along the row or the column."""
        la, lb = self.n[a], self.n[b]
        m, n, size = int(la.max(initial=0)), int(lb.max(initial=0)), len(a)
        kind, never = (np.uint8, 127) if m + n < 100 else (np.int32, (1 << 29) - 1)  # x | never is never, as all distances are less
        one_more, none = kind(1), kind(never)
        if self.scratch is None or self.scratch[0] != (m, n, size):  # memory that is touched once
            self.scratch = (m, n, size), np.empty((m + 1, n + 1, size), kind), np.empty((n + 1, size), kind), np.empty((6, n, size), kind), np.empty((2, size), kind), np.empty((n, size), bool)
        _, d, down, (apart, shut, last, near, t, u), (along, one), differ = self.scratch
        x, y = np.take(self.codes, a, axis=1), np.take(self.codes, b, axis=1)[:n]
        d[0] = np.arange(n + 1, dtype=kind)[:, None]
        d[:, 0] = np.arange(m + 1, dtype=kind)[:, None]
        down.fill(never)  # by column: the least way to a swap that leaves letters out above
        for i in range(1, m + 1):
            np.not_equal(x[i - 1], y, out=differ)
            np.copyto(apart, differ)
            np.multiply(apart, none, out=shut)
            row = d[i]
            np.add(d[i - 1, 1:], one_more, out=t)
            np.add(d[i - 1, :-1], apart, out=u)
            np.minimum(t, u, out=row[1:])
            if i > 1 and n > 1:
                np.add(down, one_more, out=down)
                np.bitwise_or(d[i - 2, : n - 1], last[1:], out=t[1:])
                np.minimum(down[2:], t[1:], out=down[2:])
                np.bitwise_or(down[2:], shut[:-1], out=t[1:])
                np.add(t[1:], one_more, out=t[1:])
                np.minimum(row[2:], t[1:], out=row[2:])
                np.bitwise_or(d[i - 2, : n - 1], shut[:-1], out=near[1:])
                along.fill(never)
            for j in range(1, n + 1):
                if i > 1 and j > 1:
                    np.add(along, one_more, out=along)
                    np.minimum(along, near[j - 1], out=along)
                    np.bitwise_or(along, last[j - 1], out=one)
                    np.minimum(one, row[j - 1], out=one)
                    np.add(one, one_more, out=one)
                else:
                    np.add(row[j - 1], one_more, out=one)
                np.minimum(row[j], one, out=row[j])
            last, shut = shut, last
        return d[la, lb, np.arange(size)]


def _common_start(texts: list[str]) -> str:
    if not texts:
        return ""
    a, b = min(texts), max(texts)
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def _pairwise(f, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="object").astype("Float64" if kind == "double" else "Int64")

    return run


def udf_damerau_levenshtein():
    return _pairwise(damerau_levenshtein, "int")


def udf_token_sort_ratio():
    return _pairwise(token_sort_ratio, "double")


def udf_partial_ratio():
    return _pairwise(partial_ratio, "double")


def udf_signature():
    """sha256=... header of a body under a secret; null without a secret."""

    @F.pandas_udf("string")
    def run(body: pd.Series, secret: pd.Series) -> pd.Series:
        return pd.Series(["sha256=" + hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest() if isinstance(s, str) and isinstance(b, str) else None for b, s in zip(body, secret, strict=True)])

    return run


def udf_two_decimals():
    """Numbers of an array with two decimals, rounded by their exact values (99.125 is 99.12), as C prints them; Java rounds halves up."""

    @F.pandas_udf("array<string>")
    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [None if v is None or v != v else f"{v:.2f}" for v in x] for x in numbers])

    return run
