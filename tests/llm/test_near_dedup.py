"""Near duplicates where ids repeat, texts are long or odd, and blocks are bounded by shingles."""

import pytest

from tallymark.llm import near_dedup, queries

from . import brute
from .test_operators import corpus, frame, near_copies

WORDS = [f"w{i}" for i in range(60)]
A, B, C = " ".join(WORDS[:50]), " ".join(f"b{x}" for x in WORDS), "a text of its own that nothing else has " * 3
B_NEAR = B.rsplit(" ", 1)[0] + " end"


def test_repeated_ids_lose_no_link(spark):
    docs = frame(spark, [(5, A), (5, B), (8, B), (9, B_NEAR)])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(docs, 3, 85).collect()) == [(5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False)]


def test_repeated_ids_lose_no_text(spark):
    docs = frame(spark, [(5, A), (8, A), (8, C), (9, B), (9, B_NEAR), (9, B)])
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect())
    assert (5, A) in kept and (8, A) not in kept and (8, C) in kept and len({t for i, t in kept if i == 9}) == 1


def test_pairs_of_distant_signatures_are_confirmed(spark, monkeypatch):
    """Whatever shares a key is compared on full sets: with one symbol a chunk, keys say nothing, and no pair is lost."""
    rows = near_copies(4, 120)
    flat = lambda s: near_dedup.np.zeros(near_dedup.SYMBOLS, near_dedup.np.uint16)
    monkeypatch.setattr(near_dedup, "signature", flat)
    sketches = list(near_dedup._keys(iter([near_dedup.pa.table({"id": [1, 2], "sig": [flat(0).tobytes()] * 2}).to_batches()[0]])))
    assert len(set(sketches[0].column("key").to_pylist())) == 40  # the bucket is the same for both
    table = near_dedup.pa.table({"key": [0] * len(rows), "id": [i for i, _ in rows], "comp": [i for i, _ in rows], "n": [len(brute.shingles(t, 3)) for _, t in rows], "sig": [flat(0).tobytes()] * len(rows), "asked": [k % 2 == 0 for k in range(len(rows))], "text": [t for _, t in rows]})
    kept = near_dedup._settle(table.filter(near_dedup.pa.compute.is_in(table["id"], near_dedup._involved(table.drop_columns("text"), 85)["id"])), 3, 85)
    up = {i: i for i, _ in rows}
    root = lambda i: i if up[i] == i else root(up[i])
    for a, b in zip(kept["a"].to_pylist(), kept["b"].to_pylist(), strict=True):
        up[root(a)] = root(b)
    sets = {i: brute.shingles(t, 3) for i, t in rows}
    for i, _ in rows[::2]:
        for j, _ in rows[1::2]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert root(i) == root(j)


@pytest.mark.parametrize("shingles", [200, 1 << 21])
def test_blocks_by_shingles_and_long_texts(spark, monkeypatch, shingles):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [*corpus(9), *near_copies(9, 80), (5000, long), (5001, long + " more"), (5002, long.replace("long7 ", ""))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(frame(spark, rows)).collect()}
    assert got == brute.components(rows)


def test_query(spark, tmp_path):
    rows = corpus(12)
    frame(spark, rows).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_minhash_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.components(rows)
