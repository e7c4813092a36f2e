from collections import Counter

from tallymark.operators import analytics, duplicates

from .test_duplicates import _cosine


def test_item_matches_equal_direct_computation(spark):
    lines = {1: ["blue widget a1", "red ring b2", ""], 2: ["widget blue a1", "red ring b2"], 3: ["blue widget a1", "red ring b2", "red ring b2"], 4: ["other thing"], 5: ["red ring b2 large", "blue widget a1 b7"], 6: [" "]}
    got = {(r.a, r.b): r for r in duplicates.item_matches(spark.createDataFrame([(i, x) for i, xs in lines.items() for x in xs], "invoice_id long, item string")).collect()}
    bag = lambda xs: Counter(" ".join(xs).split())
    groups = {1: lines[1], 3: lines[3], 4: lines[4], 5: lines[5]}  # 1 and 2 have the same words
    want = {(a, b): _cosine(bag(groups[a]), bag(groups[b])) for a in groups for b in groups if a < b}
    assert {k: round(r.similarity, 6) for k, r in got.items()} == {k: round(s, 6) for k, s in want.items() if s >= 0.85} and (1, 3) in got
    pairs = [(x, y) for x in lines[1] for y in lines[3] if x.strip() and y.strip() and _cosine(bag([x]), bag([y])) >= 0.85]
    assert got[1, 3].matched_items == len(pairs) == 3 and got[1, 3].best_item == 1.0


def test_auc_of_unrounded_scores(spark):
    rows = [(k % 2, 0.5 + k * 1e-9) for k in range(200)] + [(1, 0.7), (0, 0.7), (0, None)]
    r = analytics.model_metrics(spark.createDataFrame(rows, "label int, score double").repartition(7)).first()
    pairs = [(a, b) for la, a in rows if la and a is not None for lb, b in rows if not lb and b is not None]
    assert r.auc == round(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs), 6)
