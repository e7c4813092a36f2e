"""The registered queries' own columns on a small table, against plain versions and the tokenizer's library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import discriminant, pii, queries

from . import brute
from .test_operators import corpus, frame

public_tokenizers = pytest.importorskip("public_tokenizers")


def stored(spark, tmp_path, rows):
    frame(spark, rows).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ROWS = [*corpus(21, 50), (900, "Mail joe@a.co or +49 (30) 123-4567; 10.0.0.1, 999.1.1.1; 4111 1111 1111 1111"), (901, "héé ana@b.org"), (902, None), (903, "x@y.z 1.2.3.4 1.2.3.4")]


def test_pii_columns(spark, tmp_path):
    got = queries.op3_pii(spark, stored(spark, tmp_path, ROWS))
    assert got.columns == ["doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans"]
    for r in got.collect():
        found = brute.personal(dict(ROWS)[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (pii.KINDS.index(x[0]), x[1])))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in found) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_bpe_and_packing_columns(spark, tmp_path):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    sf, texts = stored(spark, tmp_path, ROWS), dict(ROWS)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}
    got = queries.op6_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        own = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(own, skip_special_tokens=False).encode()).hexdigest()
    packed = queries.op9_packing(spark, sf).collect()
    want = sorted((i, k, 4096 * k, len(x[4096 * k : 4096 * (k + 1)]), zlib.crc32(np.array(x[4096 * k : 4096 * (k + 1)], "<u4").tobytes())) for i, own in ids.items() for x in [[*own, 1]] for k in range(-(-len(x) // 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_suffix_columns(spark, tmp_path):
    got = queries.op4_suffix_dedup(spark, stored(spark, tmp_path, ROWS))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == dict(zip([i for i, _ in ROWS], brute.suffixes(ROWS), strict=True))


def test_topk_columns(spark, tmp_path):
    rng = random.Random(3)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(250)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vectors.items()}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op1_exact_topk(spark, str(tmp_path)).collect())
    best = lambda q: sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:10]
    assert got == [(q, k, i, -s) for q in (0, 100, 200) for k, (s, i) in enumerate(best(q), 1)]


def test_words_between_in_long_texts():
    """Offsets are code points, counted once for a text."""
    text = "né " * 50 + "name: Zoë Müll ends " * 3
    every = np.full(pii.FILTER_BITS // 64, (1 << 64) - 1, np.uint64)
    batch = pii.pa.RecordBatch.from_pydict({"h": pii.pa.array([b"a", b"b"], pii.pa.binary()), "text": [text, text]})
    out = next(iter(pii._enclosed(iter([batch]), every)))
    assert out.num_rows and all(len(text[a:b].split()) == 1 for a, b in zip(out["start"].to_pylist(), out["stop"].to_pylist(), strict=True))
    assert {text[a:b] for a, b in zip(out["start"].to_pylist(), out["stop"].to_pylist(), strict=True)} >= {"Müll", "Zoë", "ends"}


def test_quality_reads_odd_bytes(spark):
    docs = frame(spark, [(i, "good words are here. " * 5) for i in range(20)] + [(100 + i, "### $$$") for i in range(20)])
    odd = frame(spark, [(999, "x")]).withColumn("text", F.expr("cast(X'61ff62' AS STRING)"))
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i in [*range(20), *range(100, 120)]], "doc_id long, quality int")
    rows = discriminant.classify(docs.unionByName(odd), labels).collect()
    assert len(rows) == 41 and all(0 <= r.score <= 1 for r in rows)
