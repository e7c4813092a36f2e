"""The Merkle manifest against a plain version: heights, uneven runs, nulls, repeats, and the layout of blocks."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import merkle, queries

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, leaf string, root double, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "x", 1, "y", 0.5, "z") for i, s, lang, n, t in rows], DOCS)


def proven(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.leaf).hex(), bytes(r.subroot).hex(), bytes(r.root).hex(), brute.hashlib.sha256(bytes(r.proof).hex().encode()).hexdigest(), bytes(r.folded).hex()) for r in df.collect())


def expected(rows, other):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in brute.merkle([(*r, other(r[-1])) for r in rows]))


def corpus(sizes, seed=3):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), source, rng.choice(["en", None, "é"]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "é\n" * rng.randint(0, 9), str(rng.random())])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [6, 2])  # blocks of 9: several tiers, in the trees of sources and over them
def test_against_plain_trees(spark, height):
    rows = corpus({None: 4, "": 1, "a": 3, "b": 28, "é": 81, "zz": 82, "hot": 700, "Z": 2, "z": 9, **{f"s{i}": 1 for i in range(20)}})
    rows += [(None, "b", "en", 1, "same"), (None, "b", "en", 1, "same"), (None, "b", "en", 1, "other"), (5, "hot", "en", 2, "twice"), (5, "hot", "en", 2, "twice"), (6, None, None, None, "long " * 200_000)]
    got = proven(merkle.prove(frame(spark, rows), claimed=F.replace("text", F.lit("\n"), F.lit("")), height=height))
    assert got == expected(rows, lambda t: t and t.replace("\n", ""))


def test_a_lone_row_and_no_row(spark):
    rows = [(7, "s", "en", 1, "one")]
    assert proven(merkle.prove(frame(spark, rows))) == expected(rows, lambda t: t)
    assert merkle.prove(frame(spark, [(1, "s", "en", 1, "x")]).where("doc_id < 0")).count() == 0


def test_any_change_of_a_row_is_found(spark):
    rows = corpus({"a": 40, "b": 5})
    changed = merkle.prove(frame(spark, rows), claimed=F.concat(F.coalesce("text", F.lit("")), F.lit("!")))
    assert changed.where("folded = root").count() == 0 and merkle.prove(frame(spark, rows)).where("folded <> root").count() == 0


def test_bytes_that_are_no_utf8(spark):
    df = frame(spark, [(1, "s", "en", 1, "x"), (2, "s", "en", 1, "y")]).withColumn("text", F.expr("cast(X'61ff62' AS STRING)"))
    assert proven(merkle.prove(df)) == expected([(1, "s", "en", 1, "a�b"), (2, "s", "en", 1, "a�b")], lambda t: t)


@pytest.mark.parametrize("height", range(8))
def test_layout_is_van_emde_boas(height):
    places = np.concatenate([merkle.address(height, d, np.arange(3**d)) for d in range(height + 1)])
    assert sorted(places) == list(range(merkle.size(height)))  # a permutation of the places
    if height > 1:  # the upper half comes first, and each lower tree is a run of places in the same order
        upper, lower = height // 2, height - height // 2 - 1
        for d in range(upper + 1):
            assert np.array_equal(merkle.address(height, d, np.arange(3**d)), merkle.address(upper, d, np.arange(3**d)))
        for d in range(lower + 1):
            at = merkle.address(height, upper + 1 + d, np.arange(3 ** (upper + 1 + d))).reshape(3 ** (upper + 1), -1)
            want = merkle.size(upper) + np.arange(3 ** (upper + 1))[:, None] * merkle.size(lower) + merkle.address(lower, d, np.arange(3**d))
            assert np.array_equal(at, want)


def test_query(spark, tmp_path):
    rows = corpus({"a": 50, "b": 5, None: 3})
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    spoilt = lambda r: r[-1].replace("\n", "") if r[-1] and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[-1]
    want = brute.merkle([(*r, spoilt(r)) for r in rows])
    assert sorted(tuple(r) for r in got.collect()) == sorted((*w, w[-1] == w[3]) for w in want)
