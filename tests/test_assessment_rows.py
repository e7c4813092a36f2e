"""What the assessment of all invoices does with its rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallymark.operators import assessment, imaging
from tallymark.sources import handoff, views


def test_font_score_of_an_array(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([1, 2, 2, 3, 3, 50, -40]))) for i in range(60) for _ in range(rng.randint(1, 12))]
    chars = spark.createDataFrame(rows, "image_id long, height double")
    want = {r.image_id: r.score for r in imaging.font_consistency(chars).collect()}
    got = {r.image_id: r.s for r in chars.groupBy("image_id").agg(F.collect_list("height").alias("h")).select("image_id", imaging.font_score(F.col("h")).alias("s")).collect()}
    assert got == want and len(set(want.values())) > 2


def test_rows_without_contents_are_not_dealt_by_them(spark):
    """Invoices are dealt by their ids alone; a null file_hash would bring nearly all of them to one task."""
    t = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, "a", t), (2, "a", t), (3, None, t), (4, None, t)], "invoice_id long, file_hash string, created_at timestamp_ntz")
    out = assessment.first_of_content(batch)
    assert {r.invoice_id: r.duplicate_of for r in out.collect()} == {1: None, 2: 1, 3: None, 4: None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = assessment.first_of_content(batch)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftOuter, (((file_hash" not in plan and "Join LeftOuter, (file_hash" not in plan


def test_errors_and_rows_come_from_one_assessment(spark, monkeypatch):
    ran = []
    real = views.assessed
    monkeypatch.setattr(views, "assessed", lambda *x: ran.append(x) or real(*x))
    monkeypatch.setattr(handoff, "_kept", {})
    assert views.branch_errors(spark, "/root/testdata/sf0.001").count() >= 0 and views.scored(spark, "/root/testdata/sf0.001").count() > 0
    assert len(ran) == 1
