"""The vector index's search in blocks against all pairs."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from tallymark.config import DUPLICATE
from tallymark.sources import vector_index


def test_blocks_equal_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SALT_ROWS", 7)
    monkeypatch.setattr(vector_index, "PACK", 3)
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(i % 3, 0.3), 3) for _ in range(4 if i % 10 else 2)]) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for half in (0, 1):
        vector_index.append(v.where(F.col("vec_id") % 2 == half), f"{tmp_path}/index")
    found = vector_index.search(v.where("vec_id % 4 = 0"), f"{tmp_path}/index", replace(DUPLICATE, knn_distance=0.6))
    want = []
    for i, x in rows[::4]:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(x, y)), 6), j) for j, y in rows if i != j and len(x) == len(y))
        want += [(i, r, j, d) for r, (d, j) in enumerate([p for p in near if p[0] < 0.6][:5], 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in found.collect())
    assert got == sorted(want) and len(want) > 50
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair
