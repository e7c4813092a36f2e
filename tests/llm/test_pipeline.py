"""The stages one after the other, each against a plain version where there is one."""

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import labelled


def test_stages_on_odd_rows(spark, tmp_path):
    """Null texts and ids, a repeated row, an empty table, a column that operators use themselves."""
    rows, labels = labelled(13, 60)
    rows += [(2000, None), (None, "no id at all"), (None, None), (2001, ""), rows[0]]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h string")
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now, empty = docs, docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        none = stage(spark, empty, sf)
        assert none.count() == 0
        if name != "packing":
            assert now.columns == none.columns == docs.columns
            kept = [(r.doc_id, r.text) for r in now.collect()]
            assert (2000, None) in kept and (None, None) in kept and sum(i is None for i, _ in kept) == 2
    assert sum(r.doc_id is None for r in now.collect()) == 2


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = labelled(11, 200)
    passage = " ".join(f"p{rng.randrange(10**5)}" for _ in range(60))
    rows += [(1000, rows[3][1]), (1001, f"{rows[5][1]} {passage}"), (1002, f"{passage} {rows[9][1]}"), (1003, "mail me at bob@mail.example.com please and thanks"), (1004, "a grob-nik and a pfurzo in one text"), (1005, "x " * 5000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now, held = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        held[name] = now
        if name != "packing":
            assert now.columns == docs.columns
        if name == "near_dedup":
            comp = brute.components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in now.collect()} == {i for i, (_, c) in comp.items() if i == c}
        if name == "suffix_dedup":
            inp = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
            out = [(r.doc_id, r.text) for r in now.orderBy("doc_id").collect()]
            assert [i for i, _ in inp] == [i for i, _ in out]
            for (_, t), (n, gone, _, _), (_, u) in zip(inp, brute.suffixes(inp), out, strict=True):
                assert len(u.encode()) == n - gone and len(t) >= len(u)
        if name == "pii":
            assert not any(brute.personal(r.text) for r in now.collect())
            assert all(r.n_chars == len(r.text) for r in now.collect())
    toxic = {i for i, _, t in labels if t} | {1004}
    left = {r.doc_id for r in held["toxicity"].collect()}
    assert len(left & toxic) <= 2 and len({i for i, _ in rows} - toxic - left) <= 4
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in held["pii"].collect()}
    assert corpus_pipeline.run(spark, sf).count() == now.count()
