"""The matches nearest by amount against the ranks of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import strings
from tallymark.functions.expressions import amount_similarity
from tallymark.operators import duplicates
from tallymark.plans import catalog


@pytest.mark.parametrize("kind", ["copies", "near ties", "missing"])
def test_nearest_amounts_equal_all_pairs(spark, kind):
    rng = random.Random(2)
    amount = {"copies": lambda: float(rng.randint(1, 9)), "near ties": lambda: 1e9 + rng.randint(0, 60), "missing": lambda: rng.choice([None, 0.0, -3.0, 5.0, float(rng.randint(1, 50))])}[kind]
    rows = spark.createDataFrame([(i, rng.choice(["a", "b", None]), rng.randint(0, 1), amount()) for i in rng.sample(range(1000), 150)], "invoice_id long, k string, m int, amount double").repartition(3)
    other = rows.select(F.col("invoice_id").alias("b_invoice_id"), "k", "m", F.col("amount").alias("b_amount"))
    pairs = rows.join(other, ["k", "m"]).where("invoice_id < b_invoice_id").select("invoice_id", "b_invoice_id", F.lit(100.0).alias("sim_vendor"), F.round(amount_similarity("amount", "b_amount"), 6).alias("similarity"))
    assert sorted(map(tuple, duplicates.nearest_amounts(rows, ["k", "m"], 4).collect()), key=str) == sorted(map(tuple, duplicates.pair_rows(pairs, 4).collect()), key=str)


def test_no_row_for_each_pair(spark, tmp_path):
    """The queries over parts deal out their rows, and compare them where they are."""
    spark.range(60).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit(1).alias("p_size"), (F.col("id") + 9.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("duplicate_pairs", "duplicates_of_invoice", "similar_invoice_lists", "pair_similarities"):
        plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join Inner" not in plan, name
    assert [r.invoice_id for r in catalog.queries()["duplicates_of_invoice"](spark, str(tmp_path)).collect()] == [0] * 10


def test_two_decimals_by_exact_value(spark):
    got = spark.createDataFrame([([99.125, 99.135, 99.115, 100.0, None],)], "x array<double>").select(strings.udf_two_decimals()("x").alias("s")).first().s
    assert got == ["99.12", "99.14" if f"{99.135:.2f}" == "99.14" else "99.13", f"{99.115:.2f}", "100.00", None]
