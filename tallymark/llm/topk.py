"""Exact top-k inner-product search without random access (NRA).

Queries and rows are dealt into groups, every block of queries with every part of the rows.  In a group, rows come in
blocks in which every dimension is a sorted list.  A query reads the lists in step and in order, from the upper end
where its weight is positive and from the lower end where it is negative.  A row's lower bound, which takes unread
entries at the far end of their lists, is kept and raised by what is read; its upper bound takes them at the last value
read.  Rows whose upper bound is under the k-th lower bound leave for good.  Reading stops when few rows are left; these scores are completed.
The k-th best score is carried from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code

#: Queries and rows that one group holds at most (about; of 64 dimensions: 1 MB and 64 MB).
QUERY_BLOCK, ROW_PART = 4096, 1 << 18
#: Entries of each list that are read before the bounds are looked at first; twice as many before the next time.
FIRST_DEPTH = 64
ROW_BLOCK = 4096
#: Queries that advance together; their bounds for a block of rows take 4 MB a matrix.
TOGETHER = 128
SCHEMA = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part: id and vector present, no null or non-finite component."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)


def _matrix(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scaled integer vectors) of the batch, by vector length."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    col = batch.column("embedding")
    values, offsets = col.values.to_numpy(zero_copy_only=False).astype(np.float64), col.offsets.to_numpy()
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        cells = values[offsets[rows][:, None] + np.arange(d)]
        yield ids[rows], np.floor(scale * cells)


class _Best:
    """The k best (score, id) so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, i: int, score: np.ndarray, vec: np.ndarray) -> None:
        s, v = np.concatenate([self.score[i], score]), np.concatenate([self.vec[i], vec])
        top = np.lexsort((v, -s))[: self.k]
        self.score[i], self.vec[i] = s[top], v[top]


def scan_block(best: _Best, ids: np.ndarray, x: np.ndarray) -> int:
    """Run NRA for all queries over one block; returns the greatest depth to which a query has read the lists.

    Queries advance together, so that reading a stretch of all lists is one matrix product; each stops on its own.
    """
    n, k, d = x.shape[0], best.k, x.shape[1]
    up = np.argsort(x, axis=0, kind="stable")
    place = np.empty_like(up)
    np.put_along_axis(place, up, np.arange(n)[:, None], 0)
    lists = np.take_along_axis(x, up, 0)
    # 2d columns: a list from its upper end, for positive weights, and from its lower end, for negative ones
    turn_all = np.concatenate([n - 1 - place, place], 1).astype(np.int32)  # when an entry is read
    far = np.concatenate([lists[0], lists[-1]])
    gain_all = np.concatenate([x, x], 1) - far  # what reading it adds to the lower bound
    deepest = 0
    for at in range(0, len(best.ids), TOGETHER):
        live = np.arange(at, min(at + TOGETHER, len(best.ids)))
        weight = np.concatenate([np.maximum(best.q[live], 0), np.minimum(best.q[live], 0)], 1)
        rows, turn, gain = np.arange(n), turn_all, gain_all
        low = np.repeat((weight @ far)[:, None], n, 1)
        stays = ids[None] != best.ids[live][:, None]
        tau, read = best.score[live, -1], 0
        while len(live):
            depth = min(n, max(FIRST_DEPTH, 2 * read))
            low += weight @ np.where((turn >= read) & (turn < depth), gain, 0.0).T
            edge = np.concatenate([lists[n - depth], lists[depth - 1]]) - far
            high = low + weight @ np.where(turn < depth, 0.0, edge).T
            read = depth
            if len(rows) >= k:
                tau = np.maximum(tau, np.partition(np.where(stays, low, -np.inf), len(rows) - k, 1)[:, len(rows) - k])
            stays &= high >= tau[:, None]
            done = (stays.sum(1) <= 8 * k) | (read == n)
            for r in np.flatnonzero(done):
                c = rows[stays[r]]
                if len(c):
                    best.offer(int(live[r]), x[c] @ best.q[live[r]], ids[c])
            live, weight, low, stays, tau = live[~done], weight[~done], low[~done], stays[~done], tau[~done]
            used = stays.any(0)
            if 2 * used.sum() < len(rows):
                rows, turn, gain, low, stays = rows[used], turn[used], gain[used], low[:, used], stays[:, used]
        deepest = max(deepest, read)
    return deepest


def _part(key: tuple, rows: pa.Table, queries: pa.Table, k: int, scale: int) -> pa.Table:
    """Best rows of one part for one block of queries."""
    by_dim: dict[int, _Best] = {}
    for batch in queries.combine_chunks().to_batches():
        for ids, q in _matrix(batch, scale):
            by_dim[q.shape[1]] = _Best(ids, q, k)
    for batch in rows.to_batches(max_chunksize=ROW_BLOCK):
        for ids, x in _matrix(batch, scale):
            if (best := by_dim.get(x.shape[1])) is None or not x.shape[1]:
                continue
            if np.abs(x).max() * max(1.0, np.abs(best.q).max()) * x.shape[1] >= 2**51:
                raise ValueError("scaled components are too large for exact scores")
            scan_block(best, ids, x)
    out = []
    for best in by_dim.values():
        q, r = np.nonzero(np.isfinite(best.score))
        out.append(pa.table({"query_id": pa.array(best.ids[q], pa.int64()), "vec_id": pa.array(best.vec[q, r], pa.int64()), "score": pa.array(best.score[q, r].astype(np.int64))}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product for each query.

    Both take (vec_id, embedding); components count as floor(scale * x).  Returns query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id; a query never finds its own id; fewer candidates give fewer rows.
    Rows with a null id or vector, or null or non-finite components, take no part, nor do empty vectors; vectors of
    another length than the query's are no candidates of it.  Repeated vec_ids among the rows are candidates each; among
    the queries the least vector stands for the id.  Empty tables give no rows; other columns are ignored.  Components
    so large that a score could reach 2^51 raise: bounds must be exact.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    rows, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = rows.count()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = max(1, -(-n // ROW_PART), min(2 * spark.sparkContext.defaultParallelism, n // ROW_BLOCK + 1))
    number = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select("vec_id", "embedding", number(parts).alias("part"), every(blocks).alias("block"))
    right = asked.select("vec_id", "embedding", number(blocks).alias("block"), every(parts).alias("part"))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda key, a, b: _part(key, a.select(["vec_id", "embedding"]), b.select(["vec_id", "embedding"]), k, scale), SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
