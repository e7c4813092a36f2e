"""A vector index that grows by batches and answers range queries without loss.

PIVOTS vectors of the first batch are fixed.  Every stored vector keeps its distances to them and lies in the cell of the
nearest.  A query can have a neighbour within r only where its own distance to each pivot differs by r at most (triangle
inequality): whole cells are told off by their ranges of distances; what is left of the vectors and of the queries meets in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.config import DUPLICATE, DuplicateConfig
from tallymark.functions.expressions import squared_distance
from tallymark.sources.handoff import exists

PIVOTS = 16
#: Slack for what rounding may do to a difference of distances.
ROUNDING = 1e-6
#: Rows of a cell that meet a query in one task; larger cells are dealt over salts.
SALT_ROWS = 20_000
#: Vectors of one packed block.
PACK = 1024
_PACKED = pa.schema([("cell", pa.int32()), ("dims", pa.int32()), ("salts", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector without nulls or other things that are no numbers."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e150))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)) & (F.size("embedding") > 0))


def _to_pivots(embedding: Column, pivots: list[list[float]]) -> Column:
    """Distances to the pivots; vectors of another length have none, and are met in a cell of their own."""
    known = F.transform(F.array(*[F.array(*map(F.lit, p)) for p in pivots]), lambda p: F.sqrt(squared_distance(embedding, p)))
    return F.when(F.size(embedding) == len(pivots[0]), known)


def append(vectors: DataFrame, path: str) -> None:
    """Add a batch (vec_id, embedding) to the index at ``path``, which the first batch makes."""
    spark, rows = vectors.sparkSession, _valid(vectors)
    pivots = _pivots(spark, path)
    if not pivots:
        rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("embedding").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
        pivots = _pivots(spark, path)
    if not pivots:
        return  # an empty batch makes no index
    d = _to_pivots(F.col("embedding"), pivots)
    placed = rows.withColumn("d", d).withColumn("cell", F.coalesce(F.array_position("d", F.array_min("d")).cast("int"), F.lit(0)))
    placed.write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def _pivots(spark: SparkSession, path: str) -> list[list[float]]:
    if not exists(spark, f"{path}/pivots"):
        return []
    return [list(r.embedding) for r in spark.read.schema("embedding array<double>").parquet(f"{path}/pivots").collect()]  # PIVOTS rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, dims, salts, ids, data): blocks of rows (cell, id, v, salts) of one cell and length, as bytes."""
    for batch in batches:
        by: dict[tuple[int, int, int], list[int]] = {}
        lists, ids = batch.column("v"), batch.column("id").to_numpy()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, (cell, salts) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("salts").to_pylist(), strict=True)):
            by.setdefault((cell, int(ends[i + 1] - ends[i]), salts), []).append(i)
        for (cell, dims, salts), rows in by.items():
            for at in range(0, len(rows), PACK):
                cut = rows[at : at + PACK]
                data = np.stack([flat[ends[i] : ends[i + 1]] for i in cut])
                yield pa.RecordBatch.from_pylist([{"cell": cell, "dims": dims, "salts": salts, "ids": ids[cut].tobytes(), "data": data.tobytes()}], schema=_PACKED)


def _nearest(batches: Iterator[pa.RecordBatch], k: int, cutoff: float) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, distance): of each block, the ``k`` nearest to each query of the other that lie within the cutoff, and whatever is as near.

    Distances of these are summed in the order of the dimensions, as the JVM does, so that rounding shows nowhere.
    """
    for batch in batches:
        for dims, ids, data, q_ids, q_data in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "data", "q_ids", "q_data")), strict=True):
            v, x = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dims)
            q, y = np.frombuffer(q_ids, np.int64), np.frombuffer(q_data).reshape(-1, dims)
            apart, mine, other = np.empty_like(x), [], []
            for i, one in enumerate(y):
                np.subtract(x, one, out=apart)
                d = np.einsum("ij,ij->i", apart, apart)
                d[v == q[i]] = np.inf
                use = np.flatnonzero(d <= cutoff * (1 + 1e-9) + 1e-5)
                if len(use) > k:
                    near = np.partition(d[use], k - 1)[k - 1]
                    use = use[d[use] <= near * (1 + 1e-9) + 1e-5]
                other.append(use)
                mine.append(np.full(len(use), i))
            a, b = np.concatenate(mine), np.concatenate(other)
            exact = np.zeros(len(a))
            for j in range(dims):
                step = x[b, j] - y[a, j]
                exact += step * step
            yield pa.RecordBatch.from_arrays([pa.array(q[a]), pa.array(v[b]), pa.array(exact)], names=["query_id", "vec_id", "distance"])


def search(queries: DataFrame, path: str, cfg: DuplicateConfig = DUPLICATE) -> DataFrame:
    """The ``knn_k`` nearest stored vectors within ``knn_distance`` (squared) of each query: query_id, rank, vec_id, distance, similarity.

    As ``duplicates.nearest`` with its cutoff over all vectors that were appended; the query's own id is left out.
    """
    spark = queries.sparkSession
    pivots, rows = _pivots(spark, path), spark.read.parquet(f"{path}/rows")
    reach = float(cfg.knn_distance) ** 0.5 + ROUNDING
    q = _valid(queries).withColumn("dq", _to_pivots(F.col("embedding"), pivots)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "dq")
    n = len(pivots)
    ranges = rows.groupBy("cell").agg(F.count("*").alias("rows"), F.array(*[F.min(F.get("d", F.lit(i))) for i in range(n)]).alias("lo"), F.array(*[F.max(F.get("d", F.lit(i))) for i in range(n)]).alias("hi"))
    cells = F.broadcast(ranges)  # PIVOTS + 1 rows at most
    each = F.sequence(F.lit(0), F.lit(n - 1))
    open_ = F.forall(each, lambda i: (F.get("dq", i) <= F.get("hi", i) + reach) & (F.get("dq", i) >= F.get("lo", i) - reach))
    alike = F.col("dq").isNull() == (F.col("cell") == 0)
    asked = q.crossJoin(cells).where(alike & F.coalesce(open_, F.lit(True)))
    salts = F.ceil(F.col("rows") / SALT_ROWS).cast("int")
    asked = asked.select("cell", F.col("query_id").alias("id"), F.col("q").alias("v"), salts.alias("salts"))
    stored = rows.join(F.broadcast(ranges.select("cell", salts.alias("salts"))), "cell").select("cell", F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "salts")
    shape = "cell int, dims int, salts int, ids binary, data binary"
    ours = stored.mapInArrow(_packed, shape).withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int")).drop("salts")
    theirs = asked.repartition("cell").mapInArrow(_packed, shape).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("cell", "dims", "salt", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    far = float(cfg.knn_distance)
    near = ours.join(theirs, ["cell", "dims", "salt"]).mapInArrow(lambda it: _nearest(it, cfg.knn_k, far), "query_id long, vec_id long, distance double")
    found = near.select("query_id", "vec_id", F.round("distance", 6).alias("distance")).where(F.col("distance") < cfg.knn_distance)
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.knn_k).select("query_id", "rank", "vec_id", "distance", F.round(F.greatest(F.lit(0.0), (1 - F.col("distance")) * 100), 4).alias("similarity"))
