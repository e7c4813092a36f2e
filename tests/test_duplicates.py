import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark.functions import strings
from tallymark.operators import duplicates


def test_string_distances():
    assert strings.damerau_levenshtein("CA", "ABC") == 2
    assert strings.damerau_levenshtein("INV-1001", "INV-1010") == 1
    assert strings.token_sort_ratio("Acme Corp", "Corp Acme") == 100
    assert strings.partial_ratio("abc", "xxabcxx") == 100
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        lcs = max((len(s) for n in range(len(a) + 1) for s in map("".join, itertools.combinations(a, n)) if _within(s, b)), default=0)
        assert strings.common_subsequence(a, b) == lcs
        assert strings.damerau_levenshtein(a, b) == strings.damerau_levenshtein(b, a)


def _within(s, t):
    it = iter(t)
    return all(c in it for c in s)


def test_fuzzy_pair(spark):
    cols = "invoice_id long, invoice_number string, vendor_name string, total_amount double, invoice_date timestamp_ntz"
    rows = [(1, "INV-1001", "Acme Corp", 100.0, dt.datetime(2024, 1, 1)), (2, "INV-1010", "Corp Acme", 90.0, dt.datetime(2024, 3, 14)), (3, None, "Acme Corp", 5.0, None)]
    got = duplicates.fuzzy(duplicates.candidates(spark.createDataFrame(rows, cols)).where("invoice_id = 1")).collect()
    assert [(r.b_invoice_id, r.similarity, r.near_duplicate) for r in got] == [(2, 89.72, True)]


@pytest.mark.parametrize(("day", "amount", "hit"), [((2024, 3, 31), 100.0, True), ((2024, 4, 1), 100.0, False), ((2024, 1, 1), 100.01, False)])
def test_window(spark, day, amount, hit):
    rows = [(1, "Acme", 100.0, dt.datetime(2024, 1, 1)), (2, "Acme", amount, dt.datetime(*day))]
    got = duplicates.time_window(spark.createDataFrame(rows, "invoice_id long, vendor_name string, total_amount double, invoice_date timestamp_ntz")).collect()
    assert sorted((r.invoice_id, r.matched_id) for r in got) == ([(1, 2), (2, 1)] if hit else [])


def _cosine(x, y):
    c = 1 + math.log(1.5)
    w = lambda t: 1.0 if t in x and t in y else c
    dot = sum(x[t] * y[t] for t in x if t in y)
    return dot / math.sqrt(sum((n * w(t)) ** 2 for t, n in x.items()) * sum((n * w(t)) ** 2 for t, n in y.items()))


def test_semantic_equals_direct_computation(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    bags = {}
    for i, t in enumerate(texts):
        bags.setdefault(tuple(sorted(t.split())), i)
    want = {(a, b): s for (x, a), (y, b) in itertools.combinations(sorted(bags.items(), key=lambda z: z[1]), 2) if (s := _cosine(Counter(x), Counter(y))) >= 0.85}
    got = duplicates.semantic(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(want, abs=1e-6)


def test_composite(spark):
    df = spark.createDataFrame([(0.0, 89.72, 90.0, 100.0)], "exact double, fuzzy double, semantic double, window double")
    r = duplicates.composite(df).first()
    assert r.duplicate_score == 54.92 and not r.is_duplicate and r.summary.startswith("Flagged:")


def test_knn_cutoff(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = duplicates.nearest(v, v.where(F.col("vec_id") == 1)).collect()
    assert [(r.vec_id, r.rank, r.distance) for r in got] == [(2, 1, 0.02)]


def test_summary_names_what_was_found(spark):
    rows = [(100.0, 0.0, 0.0, 0.0, 7, None, None), (0.0, 100.0, 100.0, 100.0, None, 3, 9), (0.0, 10.0, 0.0, 0.0, None, None, None), (0.0, 0.0, 90.04, 100.0, None, 0, 4)]
    df = spark.createDataFrame(rows, "exact double, fuzzy double, semantic double, window double, duplicate_of long, day_diff int, window_match long")
    assert [r.summary for r in duplicates.composite(df).collect()] == [
        "EXACT DUPLICATE detected (matches invoice 7)",
        "Flagged: semantic line-item match (100.0%); same vendor+amount within 3 days (invoice 9)" if 0.3 * 100 + 0.2 * 100 + 0.1 * 100 <= 60 else "",
        "No significant duplicates found",
        "Flagged: semantic line-item match (90.0%); same vendor+amount within 0 days (invoice 4)",
    ]


def test_pair_rows(spark):
    m = spark.createDataFrame([(1, 2, 90.0, 70.0), (1, 3, None, 80.0)], "invoice_id long, b_invoice_id long, sim_vendor double, similarity double")
    rows = duplicates.pair_rows(m, k=1)
    assert sorted((r.invoice_id, r.matched_invoice_id, r.levenshtein_score, r.duplicate_probability) for r in rows.collect()) == [(1, 3, 0.0, 80.0), (2, 1, 90.0, 70.0), (3, 1, 0.0, 80.0)]
    assert [r.matched_invoice_id for r in duplicates.duplicates_of(duplicates.pair_rows(m), 1).collect()] == [3, 2]
    assert {r.invoice_id: [x.invoice_id for x in r.similar_invoices] for r in duplicates.similar_invoices(duplicates.pair_rows(m)).collect()}[1] == [3, 2]
