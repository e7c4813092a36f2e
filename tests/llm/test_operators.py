"""Each operator against brute force, and on nulls, blanks, ties, repeats, empty tables and clashing columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import bpe, discriminant, line_dedup, near_dedup, packing, pii, quality_rules, suffix_dedup, topk, toxicity

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, score double, n_words string, kept string, id long, h string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1.0, "x", "y", 7, "z") for i, t in rows], DOCS)


def corpus(seed, n=60):
    """Random texts with copies, near copies, shared passages, junk, blanks, nulls and a long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "one two")]
    base = [word() for _ in range(80)]
    for i in range(6, n):
        kind = rng.random()
        w = [word() for _ in range(rng.randint(3, 120))]
        if kind < 0.3:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.5:
            w.insert(rng.randrange(len(w)), passage)
        elif kind < 0.6 and rows[-1][1]:
            w = [rows[-1][1]]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    rows.append((n, "ab" * 300 + " " + " ".join(word() for _ in range(3000))))
    return rows


def shape(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# -- 1 ----------------------------------------------------------------------------------------------------------------
def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 16)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0, None]), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (None, x[1].tolist()), (9005, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit("a"), "query_id": F.lit(0)})
    got = {}
    for q, rank, vec, score in shape(topk.search(v, v.where("vec_id % 500 = 0"), 10), "query_id", "rank", "vec_id", "score"):
        got.setdefault(q, {})[rank] = (vec, score)
    y = np.floor(1024 * x.astype(np.float64))
    for q in range(0, 5000, 500):
        s = y @ y[q]
        want = sorted(((-int(s[i]), i) for i in range(5000) if i != q))[:10]
        assert [got[q][k + 1] for k in range(10)] == [(i, -s) for s, i in want]
    few = topk.search(v.where("vec_id < 4"), v.where("vec_id = 0"), 10)
    assert few.count() == 3
    assert topk.search(v.where("false"), v.where("false")).count() == 0


# -- 2, 5 -------------------------------------------------------------------------------------------------------------
def labelled(seed, n):
    rng = random.Random(seed)
    say = lambda: " ".join("".join(rng.choice(["ta", "re", "mi", "lo", "ne", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80)))
    bad = ["grobnik", "zwackel", "pfurzo"]
    rows, labels = [], []
    for i in range(n):
        t, toxic, junk = say(), rng.random() < 0.3, rng.random() < 0.25
        if toxic:
            w = t.split()
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b)
            t = " ".join(w)
        if junk:
            t = " ".join(x + rng.choice(["###", "%%%"]) for x in t.split())
        rows.append((i, t))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def classified(spark):
    rows, labels = labelled(4, 400)
    docs = frame(spark, [*rows, (None, "a grobnik"), (900, None), (901, ""), (rows[0][0], rows[0][1])])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    return rows, labels, docs, lab


def test_quality(spark, classified):
    _, labels, docs, lab = classified
    out = discriminant.classify(docs, lab).toPandas()
    truth = {i: q for i, q, _ in labels}
    held = out[out.held_out & out.doc_id.isin(truth.keys())]
    assert len(out) == 404 and out.score.between(0, 1).all()
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    assert held.held_out.sum() == sum(zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in held.doc_id)
    assert set(discriminant.classify(docs, lab.where("quality = 1")).toPandas().score) == {0.5}
    assert discriminant.classify(docs.where("false"), lab).count() == 0


def test_toxicity(spark, classified):
    _, labels, docs, lab = classified
    out = toxicity.classify(docs, lab).toPandas()
    truth = {i: t for i, _, t in labels}
    held = out[out.held_out & out.doc_id.isin(truth.keys())]
    assert len(out) == 404 and out.score.between(0, 1).all()
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    assert out[out.doc_id.isin([900, 901])].predicted.tolist() == [0, 0]
    bent = frame(spark, [(1, "so a grob-nik here"), (2, "you z w a c k e l"), (3, "zwacxkel tare"), (4, "tare milo nesu")])
    scored = toxicity.drop_toxic(docs.where("doc_id < 400").unionAll(bent.withColumn("doc_id", F.col("doc_id") + 10000)), lab)
    assert {r.doc_id for r in scored.where("doc_id > 10000").collect()} == {10004}
    assert scored.columns == docs.columns
    assert set(toxicity.classify(docs, lab.where("toxic = 0")).toPandas().score) == {0.0}


def test_kernel_is_the_folded_weight():
    vocab, marks = ["grobnik", "grobbnik", "tare"], ["grobnik", "milo"]
    k = toxicity._kernel(vocab, marks)
    weight = np.zeros(toxicity.LETTERS**3)
    for w, t, x in toxicity._feature_rows(marks):
        np.add.at(weight, t, x * np.array([2.0, -1.0])[w])
    margin, _ = toxicity.Model(weight, 0.0, 1.0, 0.0).worst(toxicity._joined(vocab))
    assert np.allclose(margin, k @ [2.0, -1.0], atol=1e-5)


# -- 3 ----------------------------------------------------------------------------------------------------------------
def test_base_spans():
    rng = random.Random(9)
    for alphabet in ("ab1290.@+- ()%x-_é", "0123456789....  +-", "+1 ()-.2"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == brute.personal(t), t
    for t in ("1" * 60_000, "1." * 30_000, "a" * 60_000, "+1(((" * 10_000):
        pii.base_spans(t)


def test_discovery(spark):
    rows = [(i, f"word{i} lorem Reach them: bob{i}@mail.example.com now") for i in range(6)]
    rows += [(100, "lorem Reach them: bob_at_mail77 now"), (101, "lorem ipsum x77777 now"), (None, "Reach them: zed_at_mail99"), (102, None), (103, ""), (0, rows[0][1])]
    docs = frame(spark, rows)
    out = {r.doc_id: (len(r.base), [(s.kind, s.start, s.stop) for s in r.more]) for r in pii.spans(docs).collect()}
    assert out[5] == (1, []) and out[100] == (0, [(0, 18, 31)]) and out[101] == (0, []) and out[102] == out[103] == (0, [])
    assert out[None] == (0, [(0, 12, 25)])
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[100] == "lorem Reach them: <email> now" and texts[102] is None
    assert pii.spans(docs.where("false")).count() == 0


def test_discovery_on_a_planted_set(spark):
    """Precision and recall of identifiers in no fixed format, in contexts that fixed ones share; others must not be taken."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    odd = lambda: rng.choice([f"{word()}_at_{word()}{rng.randint(10, 99)}", f"0{rng.randint(10, 99)} {rng.randint(1000, 9999)} {rng.randint(100, 999)}", word() + "." + word()])
    rows, want = [], {}
    for i in range(600):
        before, kind = some(8), rng.random()
        if kind < 0.35:
            rows.append((i, f"{before} please write to {word()}{i}@mail.example.com before noon {some(6)}"))
        elif kind < 0.45:  # a context that only discovered ones and these few share
            rows.append((i, f"{before} kindly reach them at {word()}{i}@mail.example.com or later {some(6)}"))
        elif kind < 0.55:
            x = odd()
            rows.append((i, f"{before} please write to {x} before noon {some(6)}"))
            want[i] = (len(before) + 17, len(before) + 17 + len(x))
        else:
            rows.append((i, f"{before} {rng.randint(1000, 99999)} {some(4)} v{rng.randint(100, 999)}.{rng.randint(10, 99)} {some(3)}"))
    got = {r.doc_id: [(s.start, s.stop) for s in r.more] for r in pii.spans(frame(spark, rows)).collect()}
    found = [(i, s) for i, x in got.items() for s in x]
    right = sum(want.get(i) == s for i, s in found)
    assert right >= 0.9 * len(want) and right >= 0.95 * len(found), (right, len(want), len(found))


# -- 4 ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, seed):
    rows = corpus(seed)
    rows += [(500, "xy" * 150), (501, "z" * 199), (502, "z" * 200), (503, "é" * 150), (504, rows[20][1][3:] if rows[20][1] else "")]
    out = suffix_dedup.remove(frame(spark, rows))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    got = {r[0]: tuple(r[1:]) for r in out.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.suffixes(rows), strict=True)}


def test_suffix_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = frame(spark, [(1, long), (1, long), (None, long + " tail"), (2, None), (3, "short")])
    out = {(r.doc_id, len(r.kept)) for r in suffix_dedup.remove(docs).collect()}
    assert out == {(1, 0), (None, 5), (2, 0), (3, 5)}
    kept = suffix_dedup.cut_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert suffix_dedup.remove(docs.where("false")).count() == 0


# -- 6, 9 -------------------------------------------------------------------------------------------------------------
ODD = ["", "   ", "I'm can't WE'LL 'S", "a" * 3000, "Σίσυφος ΣΑΣ", "İstanbul é", "<|endoftext|>abc<|startoftext|> x", "x<|endoftext|", "日本語 123 ½²", "\x1c a\x85b\xa0c", "🙂👍🏽 ok", "a_b__c 12.5%", "it's'll''s", "ª º ⅷ ٣", None]


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = list(enumerate(ODD)) + [(100 + i, x) for i, x in corpus(3)]
    docs = frame(spark, rows)
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, x in rows:
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == want, x
        assert back[i] == t.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(docs, PATH).count() == len(rows)
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0


def test_plain_words_match_unicode_categories():
    import unicodedata

    for cp in range(0x250):
        c = chr(cp)
        if bpe._NOT_PLAIN.search(c) or c.isspace():
            continue
        two = bpe._PLAIN_WORD.findall(c + c)
        kind = unicodedata.category(c)[0]
        assert two == ([c, c] if kind == "N" else [c + c]), hex(cp)
        assert (len(bpe._PLAIN_WORD.findall("a" + c)) == 1) == (kind == "L"), hex(cp)


def test_packing(spark):
    rows = list(enumerate(ODD)) + [(100 + i, x) for i, x in corpus(5, 200)] + [(None, "no id"), (0, "")]
    docs = frame(spark, rows).repartition(5)
    cap = 256
    out = packing.pack(docs, PATH, capacity=cap).toPandas()
    c = bpe.Codec(bpe.spec_of(PATH))
    tail = np.array([1], "<u4").tobytes()
    want = sorted((-1 if i is None else i, k, at // 4, zlib.crc32(ids[at : at + 4 * cap])) for i, t in rows for ids in [c.encode_all([t or ""])[0] + tail] for k, at in enumerate(range(0, len(ids), 4 * cap)))
    assert sorted(zip(out.doc_id.fillna(-1).astype(int), out.piece, out.start, out.ids_crc32, strict=True)) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= cap
    assert out.sequence_id.nunique() <= 1.1 * len(packing.best_fit(out.length.tolist(), cap))
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)


# -- 7 ----------------------------------------------------------------------------------------------------------------
def test_quality_rules(spark):
    rows = corpus(6) + [(800, "a b c d e " * 30), (801, "\n".join(["same line here"] * 3)), (802, "a b c d e a b c d e x"), (803, "### " * 40)]
    out = quality_rules.judge(frame(spark, rows))
    got = {r[0]: tuple(r[1:]) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute.rules(t) for i, t in rows}
    assert out.where("base_failed AND kept").count() == 0
    odd = spark.createDataFrame([(1, "w " * 12, None, None), (1, "w " * 12, None, None), (None, None, "en", None)], "doc_id long, text string, lang string, source string")
    assert quality_rules.judge(odd).count() == 3
    assert quality_rules.judge(odd.where("false")).count() == 0


def test_adaptive_bounds(spark):
    rng = random.Random(2)
    say = lambda extra: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]) + str(rng.randint(0, 999)) + extra for _ in range(60))
    rows = [(i, say("")) for i in range(40)] + [(100 + i, say("###")) for i in range(4)]
    kept = {r.doc_id for r in quality_rules.judge(frame(spark, rows)).where("kept").collect()}
    assert kept == set(range(40))


def test_a_source_full_of_symbols_sets_its_own_bound(spark):
    rng = random.Random(3)
    say = lambda mark, share: " ".join(f"{rng.choice(['alpha', 'beta', 'gamma'])}{rng.randint(0, 999)}" + mark * (rng.random() < share) for _ in range(100))
    code = [(i, say("|", 0.5), "en", "code") for i in range(200)]
    news = [(1000 + i, say("", 0), "en", "news") for i in range(200)] + [(2000, say("|", 0.5), "en", "news")]
    docs = spark.createDataFrame(code + news, "doc_id long, text string, lang string, source string")
    lost = {r.doc_id for r in quality_rules.judge(docs).where("NOT kept").collect()}
    assert 2000 in lost and not lost & set(range(200)) and len(lost) <= 5


# -- 8 ----------------------------------------------------------------------------------------------------------------
def near_copies(seed, n):
    """A large group around one text, some members too far from it but close to each other, and its exact copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates(spark, monkeypatch, seed, n, percent):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # so that buckets are cut into blocks
    rows = corpus(seed) + near_copies(seed, 150)
    out = near_dedup.groups(frame(spark, rows), n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == brute.components(rows, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_near_duplicate_edge_cases(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(5, t), (3, t), (3, t), (None, t), (9, None), (8, "  ")])
    out = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.groups(docs).collect())
    assert out == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False), (8, 8, True), (9, 9, True)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 3, 8, 9]
    assert near_dedup.groups(docs.where("false")).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------------------------
def test_lines(spark):
    a, b = "The First line has words", "another line of five words"
    rows = [(2, f"{a}\nkept here alone are words\nshort"), (1, f"  the  first LINE has words \n{b}"), (3, f"{b}\nshort\n{b}"), (4, None), (5, ""), (None, f"{b} now")]
    out = {r.doc_id: (r.n_units, [(s.start, s.stop) for s in r.spans]) for r in line_dedup.repeated_lines(frame(spark, rows)).collect()}
    assert out == {2: (2, [(0, 24)]), 1: (2, []), 3: (2, [(0, 26), (33, 59)]), 4: (0, []), 5: (0, []), None: (1, [])}
    assert line_dedup.remove_spans(rows[2][1], [(0, 26), (33, 59)]) == "short\n"
    twice = line_dedup.repeated_lines(frame(spark, [(1, a), (1, a), (2, a)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(1, 0), (1, 0), (2, 1)]
    assert line_dedup.repeated_lines(frame(spark, []).where("false")).count() == 0


def test_packing_with_many_open_bins(spark):
    rows = [(i, "ab " * (5 + i % 2)) for i in range(6000)] + [(10_000 + i, "ab") for i in range(40)]
    out = packing.pack(frame(spark, rows).repartition(23), PATH, capacity=9).toPandas()
    assert len(out) == len(rows) and out.groupby("sequence_id").length.sum().max() <= 9
    n = out.groupby("doc_id").length.sum()
    bound = max(-(-int(n.sum()) // 9), int((n > 4.5).sum()))
    assert out.sequence_id.nunique() == bound


@pytest.mark.parametrize("operator", ["encode", "pack", "suffixes", "lines", "groups", "spans"])
def test_bytes_that_are_no_utf8(spark, operator):
    docs = spark.createDataFrame([(1, bytearray(b"\xff\x61\x20bob@mail.example.com")), (2, bytearray(b"fine"))], "doc_id long, b binary").selectExpr("doc_id", "CAST(b AS STRING) AS text")
    run = {"encode": lambda d: bpe.round_trip(d, PATH), "pack": lambda d: packing.pack(d, PATH), "suffixes": suffix_dedup.remove, "lines": lambda d: line_dedup.repeated_lines(d, 1, 25), "groups": near_dedup.groups, "spans": pii.spans}
    assert sorted(r.doc_id for r in run[operator](docs).collect()) == [1, 2]
