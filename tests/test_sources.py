"""Growing vector index, page files, delivery."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.config import IngestConfig
from tallymark.operators import analytics, duplicates
from tallymark.sources import ingest, pages, vector_index
from tallymark.streaming import delivery


def hits(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.distance, r.similarity) for r in df.collect())


def test_two_batches_answer_as_one_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    x = centre[rng.integers(0, 12, 600)] + 0.15 * rng.normal(size=(600, 8))
    x[100:110] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (None, x[1].tolist()), (1003, [1.0, 2.0]), (1004, [1.0, 2.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in range(3):  # three batches
        vector_index.append(v.where(F.pmod(F.coalesce("vec_id", F.lit(0)), F.lit(3)) == k), f"{tmp_path}/index")
    asked = v.where("vec_id % 20 = 0 OR vec_id = 1003")
    whole = v.where(F.size("embedding") == 8).where(~F.isnan(F.get("embedding", F.lit(0)))).where("vec_id IS NOT NULL")
    want = hits(duplicates.nearest(whole, whole.where("vec_id % 20 = 0")))
    assert hits(vector_index.search(asked, f"{tmp_path}/index")) == sorted([*want, (1003, 1, 1004, 0.01, 99.0)]) and len(want) > 100


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    vector_index.append(none, f"{tmp_path}/index")
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], none.schema)
    vector_index.append(one, f"{tmp_path}/index")  # the first batch with vectors gives the pivots
    assert len(hits(vector_index.search(one, f"{tmp_path}/index"))) == 2
    vector_index.append(one, f"{tmp_path}/other")
    assert hits(vector_index.search(one, f"{tmp_path}/other")) == [(1, 1, 2, 0.0, 100.0), (2, 1, 1, 0.0, 100.0)]


def test_batch_limit_and_tracking(spark):
    rows = spark.createDataFrame([(f"{k}.pdf", 1, b"x") for k in range(3)] + [("b.exe", 1, b"x")], "path string, length long, content binary")
    good, bad = ingest.ingest_batch(rows)
    ids = {r.path: r.tracking_id for r in [*good.collect(), *bad.collect()]}
    assert len(set(ids.values())) == 4 and all(len(x) == 32 for x in ids.values()) and ids == {r.path: r.tracking_id for part in ingest.ingest_batch(rows.limit(4)) for r in part.collect()}
    with pytest.raises(ValueError, match="more than 3 files"):
        ingest.ingest_batch(rows, IngestConfig(max_files=3))


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in {"a.txt": b"one\ftwo", "b.html": "<p>PAYMENT TERMS</p>é".encode(), "c.txt": b"\xff\xfe", "d.pdf": b"%PDF", "deep/e.scan": b"abc", "f": b"x", "g.none": b"0"}.items():
        (tmp_path / "in" / name).write_bytes(content)

    def nothing(content):
        return []

    got = pages.read_pages(spark, f"{tmp_path}/in", {"scan": lambda b: [b.decode().upper()], "none": nothing})
    rows = {(r.path.rsplit("/", 1)[-1], r.page_number): (r.text, r.error) for r in got.collect()}
    assert rows["a.txt", 1] == ("one", None) and rows["a.txt", 2] == ("two", None) and rows["e.scan", 1] == ("ABC", None)
    assert rows["b.html", 1] == ("\nPAYMENT TERMS\né", None)
    assert {k for k, (t, e) in rows.items() if e} == {("c.txt", 1), ("d.pdf", 1), ("f", 1), ("g.none", 1)} and all(t == "" for t, e in rows.values() if e)
    assert "UnicodeDecodeError" in rows["c.txt", 1][1] and rows["d.pdf", 1][1] == "ValueError: no recogniser for .pdf"


def test_delivery_sends_once_and_retries(spark, tmp_path):
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), "view", "{}") for i in range(6)], "event_id long, ts timestamp_ntz, event_type string, props string")
    conf = spark.createDataFrame([("good", ["*"], "s", True), ("bad", ["view"], None, True)], "url string, events array<string>, secret string, is_active boolean")
    box = analytics.outbox(events, conf)
    log, path = str(tmp_path / "log"), f"{tmp_path}/attempts"
    open(log, "w").close()

    def send(url, body, headers):
        with open(log, "a") as f:
            f.write(f"{url} {headers.get(delivery.SIGNATURE, '-')[:7]}\n")
        if url == "bad":
            raise ConnectionError("down")
        return 200

    t = dt.datetime(2024, 1, 2)
    sent = lambda: sorted(open(log).read().split("\n")[:-1])
    first = delivery.deliver(box, path, send, t, most=3, first_wait=60).collect()
    assert len(first) == 12 and sent() == ["bad -"] * 6 + ["good sha256="] * 6
    assert {r.due for r in first if r.url == "bad"} == {t + dt.timedelta(seconds=60)} and all(r.error is None and r.due is None for r in first if r.url == "good")
    delivery.deliver(box, path, send, t + dt.timedelta(seconds=30), most=3, first_wait=60)  # the batch comes again, too early
    assert len(sent()) == 12
    delivery.deliver(box.unionAll(box), path, send, t + dt.timedelta(seconds=61), most=3, first_wait=60)
    assert len(sent()) == 18 and delivery.failures(spark, path).count() == 0
    delivery.deliver(box, path, send, t + dt.timedelta(seconds=500), most=3, first_wait=60)
    delivery.deliver(box, path, send, t + dt.timedelta(days=5), most=3, first_wait=60)
    gone = delivery.failures(spark, path).collect()
    assert len(sent()) == 24 and len(gone) == 6 and {(r.url, r.attempt, r.error) for r in gone} == {("bad", 3, "ConnectionError: down")}
