"""SimHash groups against all pairs; the cover itself; crowded keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import queries, simhash

from . import brute
from .test_operators import corpus, frame


def check(spark, rows, **kwargs):
    prints = [brute.fingerprint(t) for _, t in rows]
    want = sorted((i if i is not None else -1, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute.close_components(rows, prints), strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.groups(frame(spark, rows), **kwargs).collect())
    assert got == want


@pytest.mark.parametrize("most", [512, 4])  # 4: keys are split
def test_groups(spark, most):
    rows = [*corpus(1, 80), *corpus(2, 50), (None, "no id here"), (None, None), (3, "another text of one id"), (3, "one"), (90, "ONE\ttwo"), (91, "word " * 300_000), (92, "a b c d e f " * 9), (93, "a b c d e f " * 9 + "g")]
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(400)]
    for i in range(200, 290):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "x"
        rows.append((i, " ".join(w)))
    check(spark, rows, most=most)


def test_empty_table(spark):
    assert simhash.groups(frame(spark, [(1, "x")]).where("doc_id > 1")).count() == 0


def test_every_pair_within_the_radius_meets():
    rng = random.Random(6)
    cover, left = simhash.masks()
    assert len(cover) == 31 and {x.bit_count() for x in left} <= {30, 31, 32}
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        for v in (v for v in range(31) if not differ & cover[v]):
            under, open_bits = simhash.masks((v,))
            assert all(x.bit_count() <= 16 for x in open_bits)
            for w in (w for w in range(31) if not differ & under[w]):
                last, few = simhash.masks((v, w))
                assert max(x.bit_count() for x in few) <= 8 and any(not differ & m for m in last)
        assert any(not differ & m for m in cover)


def test_a_crowd_of_close_fingerprints(spark):
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [(np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(40) for b in range(a)]
    far = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre, *(np.array([c ^ f for f in flips], np.uint64) for c in centre[:2]), far]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.u, r.v) for r in simhash.links(nodes, most=64).collect()]
    got = np.array(links, np.int64).view(np.uint64)
    assert (np.bitwise_count(got[:, 0] ^ got[:, 1]) <= 4).all()
    up = {int(x): int(x) for x in fps}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in got.tolist():
        up[root(a)] = root(b)
    for i, x in enumerate(fps):  # every close pair is joined
        for y in fps[:i][np.bitwise_count(fps[:i] ^ x) <= 4]:
            assert root(int(x)) == root(int(y))


def test_hash_is_sparks_own(spark):
    text = "Some Words make four word shingles here"
    w = text.lower().split()
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    jvm = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    assert [h for piece in simhash.shingle_hashes(text.encode(), 4) for h in piece.view(np.int64).tolist()] == jvm


def test_windows_of_a_long_text(monkeypatch):
    text = ("Ab cd  ef\tgh\nij " * 40).encode()
    whole = np.concatenate(list(simhash.shingle_hashes(text, 4)))
    for window in (1, 2, 3, 7, 50):
        monkeypatch.setattr(simhash, "WINDOW", window)
        assert np.array_equal(np.concatenate(list(simhash.shingle_hashes(text, 4))), whole)


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(5, 40)]
    frame(spark, rows).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_simhash_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [brute.fingerprint(t) for _, t in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute.close_components(rows, prints), strict=True))
