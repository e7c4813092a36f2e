import datetime as dt

from pyspark.sql import functions as F

from tallymark.functions import expressions as X


def test_age_counts_fractions_of_seconds(spark):
    now = dt.datetime(2024, 1, 30, 12, 0, 0, 100_000)
    ages = {0: 59.4, 1: 59.6, 2: 539.2, 3: 539.7, 4: 3599.4, 5: 86399.6}
    rows = [(k, now - dt.timedelta(seconds=s)) for k, s in ages.items()]
    got = spark.createDataFrame(rows, "k int, t timestamp_ntz").select("k", X.relative_time("t", F.lit(now)).alias("age")).collect()
    assert {r.k: r.age for r in got} == {0: "just now", 1: "1m ago", 2: "8m ago", 3: "9m ago", 4: "59m ago", 5: "1d ago"}
