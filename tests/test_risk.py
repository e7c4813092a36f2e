"""Scores at both sides of each threshold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.config import RISK
from tallymark.operators import risk

SCHEMA = "id string, invoice_number string, vendor_name string, total_amount double, tax_amount double, subtotal double, invoice_date timestamp_ntz, due_date timestamp_ntz, ocr_confidence double"


def d(*x):
    return dt.datetime(*x)


ROWS = [
    ("r1", "A-1", "Acme", 150000.0, 45000.0, None, d(2024, 1, 6), d(2024, 1, 16), 50.0),
    ("r2", None, None, None, None, None, None, None, None),
    ("r3", "A-3", "Acme", 0.0, 0.0, None, d(2024, 1, 5), d(2024, 1, 5), 60.0),
    ("r4", "A-4", "Acme", 10000.0, 300.0, None, d(2024, 1, 5), d(2024, 1, 20), 90.0),
    ("r5", "A-5", "Acme", 10000.5, 299.0, None, d(2024, 1, 5), d(2024, 1, 19), 90.0),
]


def test_rules_and_heuristics(spark):
    rows = risk.with_heuristics(risk.with_rule_score(spark.createDataFrame(ROWS, SCHEMA)))
    got = {r.id: (r.rule_score, r.anomaly_score) for r in rows.collect()}
    assert got == {"r1": (80, 45), "r2": (15, 30), "r3": (5, 10), "r4": (0, 15), "r5": (30, 0)}


def test_rule_flags(spark):
    flags = {r.id: r.rule_flags for r in risk.with_rule_score(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert flags["r1"] == ["round_number_high_amount", "unusual_tax_rate_30.00%", "weekend_invoice_date", "very_high_amount", "short_payment_terms_10_days"]
    assert flags["r2"] == ["missing_fields:invoice_number,vendor_name,total_amount"]


@pytest.mark.parametrize(("total", "more"), [(130.0, 0), (130.01, 25)])
def test_three_sigma(spark, total, more):
    row = spark.createDataFrame([("x", "A", "Acme", total, None, None, d(2024, 1, 5), None, 90.0)], SCHEMA).withColumns({"vendor_avg": F.lit(100.0), "vendor_std": F.lit(10.0)})
    assert risk.with_rule_score(row).first().rule_score == more


@pytest.mark.parametrize(
    ("scores", "want"),
    [
        ((88.0, 12.0, 45.0, 80.0), (56.65, "medium", "manual_review", "forgery")),
        ((50.0, 60.0, 0.0, 0.0), (30.0, "low", "auto_approve", "forgery")),
        ((100.0, 0.0, 0.0, 0.2), (30.04, "medium", "manual_review", "forgery")),
        ((100.0, 100.0, 100.0, 25.0), (85.0, "high", "manual_review", "forgery")),
        ((100.0, 100.0, 100.0, 26.0), (85.2, "critical", "block_and_alert", "forgery")),
        ((0.0, 0.0, 0.0, 0.0), (0.0, "low", "auto_approve", "none")),
        ((None, None, None, None), (0.0, "low", "auto_approve", "none")),
    ],
)
def test_composite(spark, scores, want):
    row = spark.createDataFrame([scores], "forgery_score double, duplicate_score double, anomaly_score double, rule_score double")
    r = risk.with_composite(row).first()
    assert (r.risk_score, r.risk_level, r.recommended_action, r.dominant_risk) == want


def test_reconfiguration(spark):
    cfg = RISK.with_weights(forgery=1.0, duplicate=0.0).with_thresholds(low_max=10.0)
    row = spark.createDataFrame([(20.0, 90.0, 0.0, 0.0)], "forgery_score double, duplicate_score double, anomaly_score double, rule_score double")
    r = risk.with_composite(row, cfg).first()
    assert (r.risk_score, r.risk_level) == (20.0, "medium")
