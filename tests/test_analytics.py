import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallymark.operators import analytics, anomaly, assessment, duplicates, imaging
from tallymark.sources import ingest
from tallymark.streaming import pipeline


def test_metrics_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)]
    r = analytics.model_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    pairs = [(a, b) for la, a in rows if la for lb, b in rows if not lb]
    assert r.auc == round(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs), 6)
    assert (r.precision, r.recall) == (round(2 / 3, 6), round(2 / 3, 6))


def test_reviews_and_listing(spark):
    inv = spark.createDataFrame([(1, "flagged"), (2, "flagged")], "invoice_id long, status string")
    t = [dt.datetime(2024, 1, i) for i in range(1, 5)]
    reviews = spark.createDataFrame([(1, 1, "reject", t[0]), (2, 1, "approve", t[1]), (3, 1, "request_info", t[2]), (4, 2, "request_info", t[3])], "review_id long, invoice_id long, decision string, created_at timestamp_ntz")
    assert {r.invoice_id: r.status for r in analytics.apply_reviews(inv, reviews).collect()} == {1: "approved", 2: "flagged"}
    assert analytics.listing(inv, status="nonsense").count() == 2


def test_outbox(spark):
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "view", "{}")], "event_id long, ts timestamp_ntz, event_type string, props string")
    conf = spark.createDataFrame([("a", ["view", "*"], "s", True), ("b", ["view"], None, False), ("c", ["error"], None, True)], "url string, events array<string>, secret string, is_active boolean")
    got = analytics.outbox(ev, conf).collect()
    assert [(r.url, r.event_type) for r in got] == [("a", "view")]


def test_ingest(spark):
    rows = [("a.pdf", 3, b"abc"), ("b.exe", 3, b"abc"), ("c.png", 0, b""), ("d.PNG", 60 * 1024 * 1024, b"x")]
    good, bad = ingest.ingest(spark.createDataFrame(rows, "path string, length long, content binary"))
    assert [r.path for r in good.collect()] == ["a.pdf"]
    assert {r.path for r in bad.collect()} == {"b.exe", "c.png", "d.PNG"}


def test_fence(spark):
    rows = [(1, 10.0)] * 9 + [(1, 40.0)]
    r = anomaly.fence(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()
    assert (r.lower, r.upper) == (8.5, 11.5)


def normal_rows(spark, n, outliers=0):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=13))) for i in range(n)] + [(10_000 + k, *map(float, 6 + rng.normal(size=13))) for k in range(outliers)]
    return spark.createDataFrame(rows, ["invoice_id", *anomaly.FEATURES])


@pytest.mark.parametrize("n", [600, 3000])  # all rows in every tree; rows drawn by hash
def test_forest_is_the_same_for_any_partitioning(spark, n):
    std = normal_rows(spark, n, 3)
    one, many = (sorted(map(tuple, anomaly.grow_forest(std.repartition(k), n + 3, trees=20).collect())) for k in (1, 7))
    assert one == many and {x[0] for x in one} == set(range(20))
    held = anomaly.samples(std, n + 3, trees=20).groupBy("tree").count().collect()
    assert [r["count"] for r in held] == [256] * 20
    x = np.array([r[1:] for r in std.collect()])
    assert set(anomaly.Forest(one, 256).isolation(x).argsort()[-3:]) == {n, n + 1, n + 2}


def test_network_learns_alike_in_any_partitioning(spark):
    std = normal_rows(spark, 400, 4)
    one, many = (anomaly.fit_network(std.repartition(k), 404, epochs=6) for k in (1, 5))
    assert np.allclose(one.weights, many.weights, atol=1e-9)
    x = np.array([r[1:] for r in std.where("invoice_id < 10000").collect()])
    fresh = anomaly.Network.fresh()
    assert one.error(x).mean() < fresh.error(x).mean()
    value, slope = fresh.gradient(x[:20])
    for k in (0, 500, 1000, len(slope) - 1):  # slopes are those of the error
        step = np.zeros_like(slope)
        step[k] = 1e-6
        assert np.isclose((anomaly.Network(fresh.weights + step).gradient(x[:20])[0] - value) / 1e-6, slope[k], atol=1e-3)


def test_planted_outliers_rank_first(spark):
    std = normal_rows(spark, 500, 5)
    got = anomaly.learned(std, model=anomaly.train(std, epochs=15)).orderBy(F.desc("anomaly_score")).limit(5).collect()
    assert {r.invoice_id for r in got} == {10_000 + k for k in range(5)} and all(r.isolated and r.anomalous for r in got)


def test_retraining_as_one_step(spark, tmp_path):
    cols = "invoice_id long, vendor_name string, total_amount double, tax_amount double, subtotal double, invoice_date timestamp_ntz, due_date timestamp_ntz, ocr_confidence double, status string"
    t = dt.datetime(2024, 1, 5)
    inv = spark.createDataFrame([(i, "v", 100.0 + i % 17, 10.0, 90.0, t, t, 90.0, "approved" if i % 2 else "flagged") for i in range(140)], cols)
    assert anomaly.retrain(inv.limit(60), f"{tmp_path}/few", epochs=2) == {"trained": False, "rows": inv.limit(60).where("status = 'approved'").count(), "path": None}
    assert anomaly.retrain(inv, f"{tmp_path}/model", epochs=2) == {"trained": True, "rows": 70, "path": f"{tmp_path}/model"}
    model = anomaly.load(spark, f"{tmp_path}/model")
    scored = assessment.anomaly_branch(model)(inv).collect()
    assert len(scored) == 140 and all(r.score is not None for r in scored) and set(model.moments) == set(anomaly.FEATURES)


def test_imaging():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 255, (128, 128)).astype(float)
    g[64:80, 96:112] = g[0:16, 0:16]
    assert (64, 96, 0, 0) in imaging.copied_blocks(g)
    assert np.isclose(np.linalg.norm(imaging.fingerprint(g)), 1) and len(imaging.fingerprint(g)) == 256
    assert imaging.similarity(g, g) == pytest.approx(1) and imaging.similarity(g, 255 - g) < 0.2
    assert [len(h) for h in imaging.hashes(g).split(":")] == [64, 64, 64]
    flat = np.full((64, 64), 9.0)
    assert imaging.compression_error(flat)[0] < 1


def test_stream_equals_batch(spark, tmp_path):
    cols = "invoice_id long, invoice_number string, vendor_name string, total_amount double, tax_amount double, invoice_date timestamp_ntz, due_date timestamp_ntz, created_at timestamp_ntz, ocr_confidence double, forgery_score double, duplicate_score double, file_hash string"
    t = dt.datetime(2024, 1, 5)
    row = lambda i, h: (i, f"A-{i}", "Acme", 10.0 * i, 1.0, t, t, t + dt.timedelta(hours=i), 90.0, 0.0, 0.0, h)
    rows = [row(1, "a"), row(2, "a"), row(3, "b"), row(4, "c"), row(5, "b")]
    broken = row(6, None)
    for k, part in enumerate((rows[:3], [*rows[3:], broken])):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipeline.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    pipeline.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.invoice_id: (r.duplicate_of, r.new_status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.invoice_id: (r.duplicate_of, r.new_status) for r in pipeline.process_batch(spark.createDataFrame(rows, cols), None).rows.collect()}
    assert {k for k, v in got.items() if v[0]} == {k for k, v in want.items() if v[0]} == {2, 5}
    bad = spark.read.parquet(f"{tmp_path}/out.errors").collect()
    assert [(r.invoice_id, r.error, r.status) for r in bad] == [(6, "no content hash", "uploaded")] and 6 not in got


def test_signed_messages(spark):
    import hashlib
    import hmac

    ev = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), "view", "{}") for i in range(200)], "event_id long, ts timestamp_ntz, event_type string, props string")
    conf = spark.createDataFrame([("a", ["*"], "s", True), ("b", ["view"], None, True)], "url string, events array<string>, secret string, is_active boolean")
    got = analytics.outbox(ev, conf).collect()
    assert len(got) == 400
    for r in got:
        assert r.signature == ("sha256=" + hmac.new(b"s", r.body.encode(), hashlib.sha256).hexdigest() if r.url == "a" else None)


def test_first_heatmap_and_audit(spark, tmp_path):
    t = [dt.datetime(2024, 1, i) for i in (1, 2)]
    res = spark.createDataFrame([(1, "b.png", t[1]), (1, "a.png", t[0]), (2, "gone.png", t[0]), (3, None, t[0])], "invoice_id long, heatmap_path string, created_at timestamp_ntz")
    files = spark.createDataFrame([("a.png", b"x"), ("b.png", b"y")], "path string, content binary")
    assert sorted((r.invoice_id, r.path, r.found) for r in analytics.heatmap_of(res, files).collect()) == [(1, "a.png", True), (2, "gone.png", False)]
    rows = spark.createDataFrame([("login", 1, None, None, None, t[0]), ("review", 1, None, "7", "{1}", t[1])], "action string, user_id long, entity_type string, entity_id string, details string, created_at timestamp_ntz")
    analytics.append_audit(rows, f"{tmp_path}/audit")
    analytics.append_audit(rows, f"{tmp_path}/audit")
    got = spark.read.parquet(f"{tmp_path}/audit")
    assert got.count() == 4 and {(r.action, r.entity_type, r.details) for r in got.collect()} == {("login", "system", "{}"), ("review", "invoice", "{1}")}


def test_templates_and_fonts(spark):
    import numpy as np

    from tallymark.operators import imaging

    page = np.random.default_rng(1).integers(0, 255, (200, 120)).astype(float)
    assert imaging.template_score(page, page[:50]) == (100.0, True)
    assert imaging.template_score(page, 255 - page[:50])[1] is False
    chars = [(1, 10.0)] * 9 + [(1, 40.0)] + [(2, 10.0)] * 3
    got = {r.image_id: (r.characters, r.outliers, r.score) for r in imaging.font_consistency(spark.createDataFrame(chars, "image_id long, height double")).collect()}
    assert got == {1: (10, 1, 30.0), 2: (3, 0, 0.0)}


def test_saved_model_scores_alike(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=13))) for i in range(120)] + [(500, *[9.0] * 13)]
    std = spark.createDataFrame(rows, ["invoice_id", *anomaly.FEATURES])
    model = anomaly.train(std, epochs=3)
    anomaly.save(model, spark, f"{tmp_path}/model")
    a, b = (sorted(map(tuple, anomaly.learned(std, model=m).collect())) for m in (model, anomaly.load(spark, f"{tmp_path}/model")))
    assert a == b and max(a, key=lambda r: r[1])[0] == 500 and 5 <= sum(r[2] for r in a) <= 15
    few = anomaly.learned(std.where("invoice_id < 10")).collect()
    assert len(few) == 10 and all(r.anomaly_score is None for r in few)


INVOICE = "invoice_id long, vendor_name string, total_amount double, invoice_date timestamp_ntz"


def test_window_matches_on_streams_equal_those_on_tables(spark, tmp_path):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    known = [(1, "acme corp", 10.0, day(0)), (5, "Acme Corp", 10.0, day(0)), (2, "corp acme", 10.0, day(80)), (3, "Other", 10.0, day(0)), (4, None, 10.0, day(0)), (6, "acme corpo", 10.0, day(5)), (7, "acme corp", 10.0, day(181))]
    new = [(10, "acme corp", 10.0, day(90)), (11, "Acme Corp", 11.0, day(1)), (12, "Other", None, day(0))]
    for name, rows in (("new", new), ("known", known)):
        spark.createDataFrame(rows, INVOICE).write.parquet(f"{tmp_path}/{name}")
    tables = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("new", "known")]
    streams = [pipeline.read(spark, f"{tmp_path}/{n}", t.schema) for n, t in zip(("new", "known"), tables, strict=True)]
    q = pipeline.window_matches(*streams).writeStream.format("memory").queryName("window_matches").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = [(10, 1, 90), (10, 2, 10), (10, 6, 85)]
    every = spark.createDataFrame(new + known, INVOICE)
    assert sorted((r.invoice_id, r.matched_id, r.day_diff) for r in duplicates.time_window(every).collect() if r.invoice_id in (10, 11, 12) and r.matched_id < 10) == want
    assert sorted(map(tuple, spark.table("window_matches").collect())) == sorted(map(tuple, pipeline.window_matches(*tables).collect())) == want
